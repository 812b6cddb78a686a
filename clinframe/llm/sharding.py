"""Sharding by balanced label propagation.

Documents start in shards by a hash, counts at most one apart. In each round every linked document looks, through its
groups, at the shards where its neighbours are and prefers the one with most of them; moves are made under quotas
that leave every shard's count as it was: what moves into a shard is matched by what moves out, other movers
first, then unlinked documents, which may stand anywhere. So the `rows` law (counts at most one apart) holds
in every round, and cut links go down.

Links are groups of documents (a pair is a group of two): a group of k stands for all links within it, which are
never written out. A group larger than half a shard can't stay whole; it is cut beforehand into pieces that fit.
A shard with more demand than room gets a price, which rises from round to round and turns later rounds elsewhere.

A round is joins and sums over (row, group) and (group, shards); large groups are met by salt in proportion to
their share of the rows. The driver sees only shards x shards counts. Each round's placement is a table in the
shared folder.

Defined cases: a null text has no bytes (size 1) and links to nothing; empty texts link like others; repeated rows are placed each; links of unknown documents
are dropped; an empty table gives an empty one; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.llm import common

SHARDS = 16
ROUNDS = 6
#: A hot group is dealt to one salt for each 1/SALTS of the rows.
SALTS = 1024
FREE = -1


def quotas(wanted: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(moves, fillers): how many of `wanted` may go from i to j, and how many free rows go from i to j in return.

    Rows out equal rows in for every shard, and no shard sends more free rows than it has.
    """
    moves = wanted.copy()
    while True:
        surplus = moves.sum(0) - moves.sum(1)
        over = surplus - free
        worst = int(over.argmax())
        if over[worst] <= 0:
            break
        # Take the excess from the arrivals in proportion; that may send other shards over, but moves only shrink.
        arrivals = moves[:, worst]
        kept = arrivals * (arrivals.sum() - over[worst]) // arrivals.sum()
        moves[:, worst] = kept
    fillers = np.zeros_like(moves)
    give, take = np.maximum(surplus, 0), np.maximum(-surplus, 0)
    i = j = 0
    while i < len(give) and j < len(take):
        n = min(give[i], take[j])
        fillers[i, j] += n
        give[i] -= n
        take[j] -= n
        i, j = i + (give[i] == 0), j + (take[j] == 0)
    return moves, fillers


def _salts(size: Column, rows: int) -> Column:
    return F.ceil(size * F.lit(SALTS / max(1, rows))).cast("int")


def _shares(members: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """Of each group its size and at[s], the share of its members in shard s."""
    here = members.join(placed.select("uid", "shard"), "uid")
    sums = [F.sum((F.col("shard") == s).cast("long")).alias(f"__{s}") for s in range(n)]
    return here.groupBy("group").agg(*sums, F.count(F.lit(1)).alias("size")).select("group", "size", F.array(*[F.col(f"__{s}") / F.col("size") for s in range(n)]).alias("at"))


def propagate(placed: DataFrame, members: DataFrame, rows: int, n: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """placed (uid, shard, ...) after the rounds. members: (uid, group, size)."""
    price = np.zeros(n)
    for step in range(rounds):
        shares = common.materialise(_shares(members, placed, n), "shard-shares")
        salted = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("size"), rows) - 1))).select("group", "salt", "at")
        mine = members.withColumn("salt", F.pmod(F.xxhash64("uid"), _salts(F.col("size"), rows)).cast("int")).select("uid", "group", "salt")
        # A group's members must agree where its shards are level: a small amount by group and shard decides.
        tie = lambda s: F.pmod(F.xxhash64("group", F.lit(s)), F.lit(1 << 20)) / float(1 << 30)
        pulls = [F.sum(F.element_at("at", s + 1) + tie(s)).alias(f"__{s}") for s in range(n)]
        pulled = mine.join(salted, ["group", "salt"]).groupBy("uid").agg(*pulls)
        score = F.array(*[F.struct((F.col(f"__{s}") - F.lit(float(price[s]))).alias("v"), F.lit(s).alias("s")) for s in range(n)])
        best = pulled.select("uid", F.array_max(score)["s"].alias("want"), F.array(*[F.col(f"__{s}") - F.lit(float(price[s])) for s in range(n)]).alias("of"))
        wanting = placed.join(best, "uid", "left")
        gain = F.element_at("of", F.col("want") + 1) - F.element_at("of", F.col("shard") + 1)
        wanting = wanting.withColumn("want", F.when(F.col("want").isNull(), F.lit(FREE)).when(gain > 1e-12, F.col("want")).otherwise(F.col("shard"))).drop("of")
        wanting = common.materialise(wanting, "shard-wanting")
        wanted, free = np.zeros((n, n), np.int64), np.zeros(n, np.int64)
        for r in wanting.groupBy("shard", "want").count().collect():
            if r.want == FREE:
                free[r.shard] = r["count"]
            elif r.want != r.shard:
                wanted[r.shard, r.want] = r["count"]
        moves, fillers = quotas(wanted, free)
        if not moves.sum():
            common.discard(wanting)
            break
        refused = wanted.sum(0) - moves.sum(0)
        price += np.where(refused > 0, 0.05 + 0.3 * refused / np.maximum(1, wanted.sum(0)), 0)
        # Ranks within (shard, want) decide who goes; movers beyond the quota and free rows beyond the need stay.
        bounds = []
        for i in range(n):
            bounds += [(i, j, moves[i, j], j) for j in range(n) if moves[i, j]]
            upto = np.cumsum(fillers[i])
            bounds += [(i, FREE, upto[j], j) for j in range(n) if fillers[i, j]]
        going = {(i, w): [] for i, w, _, _ in bounds}
        for i, w, limit, j in bounds:
            going[i, w].append((int(limit), j))
        changing = F.struct("shard", "want").isin([F.struct(F.lit(i), F.lit(w)) for i, w in going])
        touched = common.dense_index(wanting.where(changing), ["shard", "want"], ["uid"], F.xxhash64("uid", F.lit(step)), rows, "rank")
        to = F.col("shard")
        for (i, w), limits in going.items():
            inner = F.col("shard")
            for limit, j in reversed(limits):
                inner = F.when(F.col("rank") < limit, F.lit(j)).otherwise(inner)
            to = F.when((F.col("shard") == i) & (F.col("want") == w), inner).otherwise(to)
        moved = touched.withColumn("shard", to.cast("int")).drop("rank", "want")
        now = common.materialise(wanting.where(~changing).drop("want").unionByName(moved), "shard-placed")
        for old in (wanting, shares, placed):
            common.discard(old)
        placed = now
    return placed


def cut_share(placed: DataFrame, members: DataFrame, n: int = SHARDS) -> float:
    """The share of links (pairs within a group) whose documents are in different shards."""
    kept = F.aggregate("at", F.lit(0.0), lambda a, x: a + x * F.col("size") * (x * F.col("size") - 1))
    r = _shares(members, placed, n).select(kept.alias("kept"), (F.col("size") * (F.col("size") - 1)).alias("all")).agg(F.sum("kept"), F.sum("all")).first()
    return 1 - r[0] / r[1] if r[1] else 0.0


def shard(docs: DataFrame, links: DataFrame | None = None, n: int = SHARDS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(placement, members): docs' rows as doc_id, size, text_crc32, shard, slot, and the groups that linked them.

    links: (doc_id, group); None links equal texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5("text")).alias("digest"),
    )
    narrow = common.materialise(narrow, "shard-narrow")
    rows = narrow.count()
    spread = F.xxhash64("doc_id", "digest", "size")
    numbered = common.materialise(common.dense_index(narrow.withColumn("__all", F.lit(0)), ["__all"], ["doc_id", "digest"], spread, rows, "uid").drop("__all"), "shard-numbered")
    if links is None:
        grouped = numbered.where("digest IS NOT NULL").select("uid", F.col("digest").alias("group"))
    else:
        grouped = numbered.join(links.select("doc_id", F.col("group").cast("string").alias("group")).distinct(), "doc_id").select("uid", "group")
    sizes = common.materialise(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("group", "g"), "shard-groups")
    linked = common.materialise(grouped, "shard-linked").join(sizes, F.col("group") == F.col("g")).drop("g")
    # A hot group's pieces of half a shard at most.
    most = max(1, rows // (2 * n))
    pieces = F.ceil(F.col("size") / most).cast("int")
    piece = F.pmod(F.xxhash64("uid"), pieces)
    members = linked.select("uid", F.when(pieces > 1, F.concat_ws("#", "group", piece.cast("string"))).otherwise(F.col("group")).alias("group"), F.ceil(F.col("size") / pieces).cast("long").alias("size"))
    members = common.materialise(members, "shard-members")
    start = common.materialise(numbered.select("uid", "doc_id", F.col("size").alias("bytes"), "text_crc32", (F.col("uid") % n).cast("int").alias("shard")), "shard-start")
    placed = propagate(start, members, rows, n, rounds)
    slotted = common.dense_index(placed, ["shard"], ["uid"], F.xxhash64("uid"), rows, "slot")
    return slotted.select("uid", "doc_id", F.col("bytes").alias("size"), "text_crc32", "shard", "slot"), members


def op4_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placement, _ = shard(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placement.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
