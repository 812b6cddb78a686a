"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated Poisson(rate_s) times, where rate_s = budget x weight_s x total / size_s, so
that the expected output holds every source at its target share. The Poisson draw inverts the distribution
function at a uniform number hashed from seed and document id: the same input gives the same output, whatever
the partitions, retries or order. All of it is DataFrame expressions; the only shuffle is the global one.

Defined cases: a null source is a source of its own; a null text has size 0; sources without bytes and sources
not listed in `weights` get rate 0; weights of a source that is listed twice add up; repeated rows share their id and so their count; an empty table gives an
empty table; columns of the input are kept as they are, and the added columns get trailing underscores if
their name is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.llm import common

SEED = "mix-1"
#: Rates above this are drawn as a sum of equal independent parts, each at most this.
PART_RATE = 16.0
#: Terms of a part's distribution: P(X > 80 | 16) < 1e-28, below the 2^-52 grain of the uniform number.
TERMS = 80
FACTORIALS = [float(math.factorial(k)) for k in range(TERMS + 1)]


def unit_interval(*parts: Column | str) -> Column:
    """52 bits of an md5 over the parts, as a number in (0, 1)."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.0) -> DataFrame:
    """(source, rate, parts, cdf): cdf holds a part's P(X <= k) for k = 0 .. TERMS.

    weights: (source, weight) of any scale; None gives all sources the same weight.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        w = weights.groupBy(F.col("source").alias("of_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source").fillna(0.0, ["weight"])
    sizes = common.materialise(sizes, "mix-sizes")
    total, all_weight = sizes.where("bytes > 0").agg(F.sum("bytes"), F.sum("weight")).first()
    if not total or not all_weight:
        share = F.lit(0.0)
    else:
        share = F.lit(float(budget)) * F.col("weight") / F.lit(float(all_weight)) * F.lit(float(total)) / F.col("bytes")
    rated = sizes.select("source", F.when(F.col("bytes") > 0, share).otherwise(0.0).alias("rate"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int"))
    part = F.col("rate") / F.col("parts")
    facts = F.array(*[F.lit(x) for x in FACTORIALS])
    pmf = F.transform(F.sequence(F.lit(0), F.lit(TERMS)), lambda k: F.exp(-part) * F.pow(part, k) / F.element_at(facts, k + 1))
    cdf = F.transform(F.sequence(F.lit(1), F.lit(TERMS + 1)), lambda k: F.aggregate(F.slice("pmf", 1, k), F.lit(0.0), lambda a, x: a + x))
    return rated.withColumn("pmf", pmf).withColumn("cdf", cdf).drop("pmf")


def replicate(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs repeated to target weights and globally shuffled, with `copy` (from 1) and `shuffle_key` added."""
    copy, key = common.free_name(docs, "copy"), common.free_name(docs, "shuffle_key")
    rate, parts, cdf, times = (common.free_name(docs, c) for c in ("mix_rate", "mix_parts", "mix_cdf", "mix_times"))
    rates = common.materialise(source_rates(docs, weights, budget), "mix-rates").withColumnsRenamed({"rate": rate, "parts": parts, "cdf": cdf})
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    joined = common.bounded_join(docs, rates, ["source"], F.xxhash64("doc_id"), rates.count(), 8 * (TERMS + 12), "inner")
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: unit_interval(seed, doc, j))
    counts = F.transform(draws, lambda u: F.size(F.filter(cdf, lambda c: c <= u)))
    n = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    repeated = joined.withColumn(times, n).where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    keyed = repeated.withColumn(key, F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), doc, F.col(copy).cast("string"))))
    return keyed.drop(rate, parts, cdf, times).repartition(F.col(key)).sortWithinPartitions(key)


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(common.table(spark, sf_dir, "documents"))


SQL_OP10 = f"""
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS bytes FROM documents GROUP BY source),
totals AS (SELECT sum(bytes) AS total, count(*)::DOUBLE AS w FROM sizes WHERE bytes > 0),
rated AS (SELECT source, CASE WHEN bytes > 0 THEN 1.0::DOUBLE * 1.0::DOUBLE / w * total / bytes ELSE 0.0::DOUBLE END AS rate FROM sizes, totals),
parted AS (SELECT source, rate, greatest(1, ceil(rate / {PART_RATE}::DOUBLE))::INT AS parts FROM rated),
facts AS (SELECT unnest(range(0, {TERMS + 1}))::INT AS k, unnest([{', '.join(f'{x!r}::DOUBLE' for x in FACTORIALS)}]) AS f),
pm AS (SELECT source, parts, k, exp(-(rate / parts)) * pow(rate / parts, k) / f AS p FROM parted, facts),
cdf AS (SELECT source, parts, list(c ORDER BY k) AS cdf FROM (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pm) GROUP BY source, parts),
drawn AS (SELECT d.*, c.cdf, unnest(range(1, c.parts + 1)) AS j FROM documents d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source),
unis AS (SELECT *, (('0x' || substr(md5('{SEED}|' || doc_id || '|' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)}::DOUBLE AS u FROM drawn),
counted AS (SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cdf, lambda c: c <= u)))::INT AS n FROM unis GROUP BY ALL),
copied AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM counted WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, copy, md5('{SEED}|order|' || doc_id || '|' || copy) AS shuffle_key FROM copied
"""
