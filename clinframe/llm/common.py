"""What the corpus operators share: scratch tables, size-checked joins, row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A side of a join is broadcast only if its measured rows x bytes stay below this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset in a local session (tests) a local folder is made once and set on the context.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty() and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if held.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="clinframe-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """How tasks open a file in the shared folder: pyarrow's file system for its scheme, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def discard(df: DataFrame) -> None:
    """Remove the table that materialise() made for df."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def bounded_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, rows: int, row_bytes: int, how: str = "left", salts: int = 64) -> DataFrame:
    """Join a side of `rows` counted rows: by broadcast within BROADCAST_BYTES, else by salted shuffle.

    Keys match null-safely. spread: a well-mixed expression of left's row; it deals a hot key's rows to
    `salts` tasks, and right is repeated so many times.
    """
    taken = [*left.columns, *right.columns]
    names = [_free(taken, f"_key{i}") for i in range(len(on))]
    right = right.withColumnsRenamed(dict(zip(on, names)))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(on, names)]
    if rows * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), same, how).drop(*names)
    salt, other = _free(taken, "_salt"), _free(taken, "_salt_r")
    left = left.withColumn(salt, F.pmod(spread, F.lit(salts)).cast("int"))
    right = right.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*same, F.col(salt) == F.col(other)], how).drop(*names, salt, other)


def dense_index(df: DataFrame, groups: list[str], order: list[str], spread: Column, rows: int, out: str, bucket_rows: int = 50_000, least: int = 64) -> DataFrame:
    """df with `out`: gapless numbers from 0 within each of the few groups, without one task for a group.

    Rows fall into hash buckets of about bucket_rows; a window numbers each (group, bucket), and the buckets'
    running totals, of which there are groups x buckets, are added. Numbers follow bucket, then `order`.
    """
    n = max(least, -(-rows // bucket_rows))
    bucket, inside, before, count = (_free([*df.columns, out], c) for c in ("_bucket", "_local", "_before", "_n"))
    dealt = df.withColumn(bucket, F.pmod(spread, F.lit(n)).cast("int"))
    keys = [*groups, bucket]
    sizes = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(before, F.coalesce(F.sum(count).over(earlier), F.lit(0))).drop(count)
    local = dealt.withColumn(inside, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return local.join(starts, keys).withColumn(out, (F.col(before) + F.col(inside)).cast("long")).drop(bucket, inside, before)


def _free(taken: list[str], name: str) -> str:
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores so that it doesn't clash with a column of df."""
    return _free(df.columns, name)


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast(T.StringType()), F.lit(""))
