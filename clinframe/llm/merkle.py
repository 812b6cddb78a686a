"""Merkle manifest of a dataset: one tree per source, one tree over the sources' roots.

A leaf is the SHA-256 of a row's fields, each `-` if null, else its UTF-8 byte count, `:` and the value. In a group
leaves ascend by key (ties: by leaf, so that equal rows stand side by side); every `fanout` consecutive nodes, or what
is left of them, become their hash, until one is left. The groups' roots, in bytewise order of the group (null first),
make the root in the same way.

Ranks without a global sort: the order is cut into digits of 12 bits, first those of the key, then those of the leaf.
Histograms over the first d digits count the leaves before each bucket; d grows until no bucket holds more than
BUCKET different leaves, and only inside a bucket is anything sorted. Running sums are taken digit by digit, so that no
window is wider than 4,096 digits. Groups are ranked in the same way by the bytes of their names.

The trie: a node of level l is keyed by the digits of its rank in base `fanout` without the last l. Nodes that agree
in all but their last HEIGHT digits meet in one task as a small array, which is reduced by HEIGHT levels at once, the
longest prefixes first; so a tree over n leaves takes log n / (HEIGHT log fanout) shuffles. Proofs go the other way:
a leaf's siblings are those in its array, then those of its array's node, and so on.

Defined cases: null keys stand before all others, and null groups are a group of their own; repeated rows are leaves
of their own with equal hashes, counted before they are shuffled; an empty table gives no rows; a lone leaf is its
group's root and has an empty proof, if there is no other group; columns that are no fields aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinframe.llm import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Different leaves that a bucket holds at most (those of equal digits throughout excepted), and bits of a digit.
BUCKET, DIGIT = 4096, 12
#: Levels that one array of fanout ^ HEIGHT nodes is reduced by.
HEIGHT = 6
STEPS = "array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """The hash of a row; fields are read as strings."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def key_digits(key: Column, tie: Column) -> list[Column]:
    """Digits of a long key (null first, then negative numbers), then of a tie in hexadecimal."""
    held = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    signed = held.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    first = F.when(key.isNull(), 0).otherwise(F.shiftrightunsigned(signed, 60).cast("int") + 1)
    rest = [F.shiftrightunsigned(signed, s).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long")).cast("int") for s in range(60 - DIGIT, -1, -DIGIT)]
    return [first, *rest, *[F.conv(F.substring(tie, 3 * i + 1, 3), 16, 10).cast("int") for i in range(21)]]


def byte_digits(name: Column, length: int) -> list[Column]:
    """Digits of a string in bytewise order, null first."""
    spelled = F.hex(F.encode(name, "UTF-8"))
    return [F.when(name.isNull(), -1).otherwise(F.coalesce(F.conv(F.nullif(F.substring(spelled, 2 * i + 1, 2), F.lit("")), 16, 10).cast("int") + 1, F.lit(0))) for i in range(length)]


def ranks(rows: DataFrame, groups: list[str], digits: list[Column], order: list[str], n: str) -> DataFrame:
    """rows (different ones, n times each) with `rank`: how many stand before the first of them in its group."""
    depth, held, varying = 0, rows, None
    while True:
        biggest = held.groupBy(*groups, *[f"_d{i}" for i in range(depth)]).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
        if (biggest or 0) <= BUCKET:
            break
        if varying is None:  # digits that are the same in all rows split nothing
            spans = rows.agg(*[F.struct(F.min(d), F.max(d)) for d in digits]).first()
            varying = [d for d, (low, high) in zip(digits, spans) if low != high]
        if depth == len(varying):
            break
        held = held.withColumn(f"_d{depth}", varying[depth])
        depth += 1
    bucket = [f"_d{i}" for i in range(depth)]
    level, before = held.groupBy(*groups, *bucket).agg(F.sum(n).alias("_n")), None
    for i in reversed(range(depth)):
        # What stands before a digit among those with the same digits in front of it; then one digit less.
        among = Window.partitionBy(*groups, *bucket[:i]).orderBy(bucket[i]).rowsBetween(Window.unboundedPreceding, -1)
        here = level.withColumn(f"_b{i}", F.coalesce(F.sum("_n").over(among), F.lit(0)))
        level = level.groupBy(*groups, *bucket[:i]).agg(F.sum("_n").alias("_n"))
        before = here.drop("_n") if before is None else _natural(before, here.drop("_n"), [*groups, *bucket[: i + 1]])
    inside = Window.partitionBy(*groups, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn("rank", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    if before is None:
        return local
    joined = _natural(local, before, [*groups, *bucket])
    return joined.withColumn("rank", reduce(Column.__add__, [F.col("rank"), *[F.col(f"_b{i}") for i in range(depth)]])).drop(*bucket, *[f"_b{i}" for i in range(depth)])


def _natural(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns that match null-safely; right has one row for each key."""
    right = right.withColumnsRenamed({c: f"_r{c}" for c in on})
    return left.join(right, [left[c].eqNullSafe(right[f"_r{c}"]) for c in on]).drop(*[f"_r{c}" for c in on])


def parents(nodes: Column, fanout: int) -> Column:
    """The level above an array of hashes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), ""), 256))


def siblings(nodes: Column, at: Column, fanout: int) -> Column:
    """What stands beside node `at` in its run, left and right, each joined."""
    run = (at - at % fanout).cast("int")
    left = F.array_join(F.slice(nodes, run + 1, (at % fanout).cast("int")), "")
    right = F.array_join(F.slice(nodes, (at + 2).cast("int"), (F.lit(fanout - 1) - at % fanout).cast("int")), "")
    return F.struct(left.alias("left"), right.alias("right"))


def reduce_trie(nodes: DataFrame, groups: list[str], fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """(root of each group, the arrays of every storey) of nodes (groups, rank, hash, size, ...).

    A storey is HEIGHT levels: (groups, prefix, members, levels), with members in order of rank and one array of
    hashes for each level. All groups go up together; those whose tree has ended stay as they are.
    """
    width, storeys = fanout**HEIGHT, []
    carried = [c for c in nodes.columns if c not in groups]
    while True:
        keyed = nodes.withColumn("prefix", F.floor(F.col("rank") / width).cast("long"))
        arrays = keyed.groupBy(*groups, "prefix").agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("members"))
        arrays = arrays.withColumns({"size": F.col("members")[0]["size"], "hashes": F.col("members.hash")})
        # A tree of `size` nodes ends after so many levels; an array that isn't its last goes up by all of HEIGHT.
        tall = sum(F.when(F.col("size") > fanout**i, 1).otherwise(0) for i in range(HEIGHT))
        arrays = arrays.withColumn("tall", tall).withColumn("level0", F.col("hashes"))
        for i in range(HEIGHT):
            arrays = arrays.withColumn(f"level{i + 1}", F.when(F.col("tall") > i, parents(F.col(f"level{i}"), fanout)).otherwise(F.col(f"level{i}")))
        levels = F.slice(F.array(*[F.col(f"level{i}") for i in range(HEIGHT)]), F.lit(1), F.col("tall"))
        arrays = common.materialise(arrays.select(*groups, "prefix", "members", levels.alias("levels"), F.col(f"level{HEIGHT}")[0].alias("hash"), F.ceil(F.col("size") / width).cast("long").alias("size")), "merkle-storey")
        storeys.append(arrays)
        nodes = arrays.select(*groups, F.col("prefix").alias("rank"), "hash", "size")
        carried = ["rank", "hash", "size"]
        if (arrays.agg(F.max("size")).first()[0] or 1) <= 1:
            return nodes.select(*groups, "hash"), storeys


def climb(storeys: list[DataFrame], groups: list[str], fanout: int) -> DataFrame:
    """Members of the lowest storey with `steps`: their siblings, level by level."""
    above = None
    for arrays in reversed(storeys):
        joined = arrays.withColumn("upper", F.array().cast(STEPS)) if above is None else _natural(arrays, above, [*groups, "prefix"])
        # Inside the array, so that no row of a member has the whole storey beside it.
        at = lambda m, i: F.floor((m["rank"] - F.col("prefix") * fanout**HEIGHT) / F.pow(F.lit(fanout), i)).cast("long")
        beside = lambda m: F.concat(F.transform("levels", lambda level, i: siblings(level, at(m, i), fanout)), F.col("upper"))
        out = joined.select(*groups, F.explode(F.transform("members", lambda m: F.struct(m.alias("member"), beside(m).alias("steps")))).alias("one"))
        out = out.select(*groups, "one.member", "one.steps")
        above = out.select(*groups, F.col("member.rank").alias("prefix"), F.col("steps").alias("upper"))
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", fanout: int = 3, claims: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: key, group, position, leaf, steps, subroot, root and the claims.

    steps: the siblings of each level up to root, those on the left and those on the right joined. claims: further
    columns of docs that are carried along, such as a leaf that somebody else states.
    """
    claims = claims or {}
    hashed = docs.select(F.col(group).cast("string").alias("group"), F.col(key).cast("long").alias("key"), leaf([docs[f] for f in fields]).alias("hash"), *[c.alias(f"claim_{n}") for n, c in claims.items()])
    carried = [f"claim_{n}" for n in claims]
    leaves = common.materialise(hashed.groupBy("group", "key", "hash", *carried).agg(F.count(F.lit(1)).alias("n")), "merkle-leaves")
    ranked = ranks(leaves, ["group"], key_digits(F.col("key"), F.col("hash")), ["key", "hash", *carried], "n")
    totals = leaves.groupBy("group").agg(F.sum("n").alias("size"))
    each = ranked.withColumn("rank", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("n") - 1)))
    sized = common.bounded_join(each, totals, ["group"], F.xxhash64("hash"), totals.count(), 256, "inner")
    subroots, storeys = reduce_trie(sized.select("group", "rank", "hash", "size", "key", *carried), ["group"], fanout)
    common.discard(leaves)
    subroots = common.materialise(subroots, "merkle-subroots")
    n_groups, longest = subroots.agg(F.count(F.lit(1)), F.max(F.octet_length("group"))).first()
    named = subroots.withColumns({"n": F.lit(1).cast("long"), "all": F.lit(0)})
    placed = ranks(named, ["all"], byte_digits(F.col("group"), (longest or 0) + 1), ["group"], "n").withColumn("size", F.lit(n_groups).cast("long"))
    top, top_storeys = reduce_trie(placed.select("all", "rank", "hash", "size", "group"), ["all"], fanout)
    common.discard(subroots)
    root = top.first()
    tops = climb(top_storeys, ["all"], fanout).select(F.col("member.group").alias("group"), F.col("member.hash").alias("subroot"), F.col("steps").alias("top_steps"))
    joined = common.bounded_join(climb(storeys, ["group"], fanout), tops, ["group"], F.xxhash64("member"), n_groups, 2048, "inner")
    return joined.select(
        F.col("member.key").alias(key), F.col("group").alias(group), F.col("member.rank").alias("position"), F.col("member.hash").alias("leaf"), F.concat("steps", "top_steps").alias("steps"),
        "subroot", F.lit(root.hash if root else None).cast("string").alias("root"), *[F.col(f"member.claim_{n}").alias(n) for n in claims],
    )


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = manifest(docs, claims={"tampered": leaf([docs[f] for f in FIELDS[:-1]] + [cut])})
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    folded = made.withColumns({"proof_sha256": F.sha2(proof, 256), "folded_root": fold(F.col("tampered"), F.col("steps"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_fields(text: str) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in [*FIELDS[:-1], text])


def _sql_tree(name: str, start: str) -> str:
    """The levels of trees (g, lvl, idx, h, n), and the runs of each level."""
    return f"""
{name} AS ({start} UNION ALL SELECT g, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, idx // 3, n),
{name}_runs AS (SELECT g, lvl, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM {name} WHERE n > 1 GROUP BY g, lvl, idx // 3)"""


def _sql_walk(name: str, start: str, tree: str) -> str:
    """From (g, id, lvl, pos, h, proof) up to the root of the tree: left and right are what stands beside node pos."""
    left, right = "coalesce(array_to_string(hs[1:pos % 3], ''), '')", "coalesce(array_to_string(hs[pos % 3 + 2:], ''), '')"
    return f"""
{name} AS ({start} UNION ALL SELECT w.g, id, w.lvl + 1, pos // 3, sha256({left} || h || {right}), proof || {left} || {right}
  FROM {name} w JOIN {tree}_runs r ON w.g IS NOT DISTINCT FROM r.g AND w.lvl = r.lvl AND w.pos // 3 = r.run)"""


#: The checksum's table of 256 and its running value over the characters of doc_id.
_SQL_TABLE = "list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda h, z: xor(h >> 1, (h & 1) * 3988292384)))"
_SQL_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: xor(h >> 8, tab[((xor(h, c)) & 255)::INT + 1])), 4294967295)"

SQL_OP11 = f"""
WITH RECURSIVE crcs AS (SELECT d.*, {_SQL_CRC} AS crc FROM documents d, (SELECT {_SQL_TABLE} AS tab)),
leaves AS (SELECT doc_id, source, sha256({_sql_fields('text')}) AS leaf, sha256({_sql_fields('cut')}) AS claim FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM crcs)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves),
{_sql_tree('nodes', 'SELECT source AS g, 0 AS lvl, idx, leaf AS h, n FROM placed')},
subroots AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_sql_tree('tops', 'SELECT 0 AS g, 0 AS lvl, idx, subroot AS h, n FROM subroots')},
{_sql_walk('low', "SELECT source AS g, (source, doc_id, idx) AS id, 0 AS lvl, idx AS pos, claim AS h, '' AS proof FROM placed", 'nodes')},
{_sql_walk('high', "SELECT 0 AS g, w.id, 0 AS lvl, s.idx AS pos, w.h, w.proof FROM low w JOIN nodes e ON e.n = 1 AND e.g IS NOT DISTINCT FROM w.g AND e.lvl = w.lvl JOIN subroots s ON s.source IS NOT DISTINCT FROM w.g", 'tops')}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = root AS verified
FROM placed p JOIN (SELECT h.* FROM high h JOIN tops e ON e.n = 1 AND e.lvl = h.lvl) w ON w.id = (p.source, p.doc_id, p.idx)
JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source, (SELECT h AS root FROM tops WHERE n = 1)
"""
