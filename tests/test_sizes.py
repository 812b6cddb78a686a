"""Queries on tables that the given ones lack: values on which Java and C round differently."""

import os

import oracle
from clinframe import registry


def test_file_labels_halves(spark, sf_dir, tmp_path):
    # Keys of the form 3k + 2 have 100 x price bytes: odd multiples of a quarter megabyte; 3k + 1 have price bytes: halves of a kilobyte.
    prices = [(3 * i + 2, 2621.44 * i) for i in range(1, 200)] + [(3 * i + 1, 512.0 * i) for i in range(1, 200)]
    for t in oracle.TABLES:
        if t != "orders":
            os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.createDataFrame(prices, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "made"))
    (part,) = [p for p in (tmp_path / "made").iterdir() if p.name.startswith("part-")]
    part.rename(tmp_path / "orders.parquet")
    assert oracle.same(spark, str(tmp_path), registry.QUERIES["file_labels"], registry.ORACLE["file_labels"]) == len(prices)
