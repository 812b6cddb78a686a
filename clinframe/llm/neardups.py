"""MinHash near-dedup by ProbMinHash.

A text is the distribution of its shingles (WORDS lower-cased words; fewer words are one shingle) with their counts
as weights. Each shingle is a Poisson process whose rate is its weight: its arrivals, made from its hash, fall into
random registers; a register keeps the shingle that arrived first. Processes end as soon as their next arrival comes
after every register's first. Two registers agree with the probability Jaccard similarity of the texts.

  1. One map over the texts gives each a digest and a sketch: a byte of each register. ROWS bytes of it are a band.
     Equal digests are one class, whose representative has the smallest doc_id.
  2. Representatives that share a band are candidates. They are not paired all with all: a bucket's members are compared
     with its pivot, the text that meets most others, first in FIRST_BANDS bands, then in all of them.
  3. What is left are buckets with members of several components that aren't similar to the pivot. Their texts get a
     second sketch of LONG_REGISTERS; a bucket of up to BLOCK members is compared where they meet. Of a larger one each member
     is shuffled once, into a file of its block in the shared folder, and tasks read the blocks two at a time. A task
     compares sketches of different components, in the first band that a pair shares, and gives out only those pairs that agree
     as often as a pair at the threshold can. Blocks of the bucket's largest component aren't put together with each other.
  4. Every pair is verified on the two whole texts: its exact probability Jaccard must reach the threshold.
  5. Verified links become components by minimum labels and pointer jumping, in joins.

A pair at the threshold shares no band with probability (1 - 0.8^7)^40 < 1e-4, and its second sketches agree less than step 3
asks for with 3e-7; no other link is lost. Texts are shuffled only where they have candidates; every join is between written
tables, so that AQE can split hot keys. Tables are in the shared folder; nothing per document reaches the driver. Step 3
compares bytes in memory, which is quadratic in what a bucket holds beyond its largest component (what is shuffled is not, and
blocks are read once for BLOCK members). Capping it would lose links.

What is compared, linked and labelled is a text. It is named by its smallest doc_id (pivots of low ids are good ones); where
that is null or is the name of several texts, by 63 bits of its digest, as a negative number. So rows with null or repeated
ids and different texts are judged apart.

Defined cases: null and empty texts have no shingles and only their exact copies (null counts as empty); rows with
one doc_id and different texts are different documents; a null doc_id counts as the smallest id; at equal ids the smaller
digest comes first; empty tables give empty tables; extra columns aren't read, or pass through keep_one().
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinframe.llm import common, textnum

WORDS, BANDS, ROWS = 5, 40, 7
REGISTERS = BANDS * ROWS
THRESHOLD = 0.8
NULL_ID = -(1 << 63)
#: The first round uses these bands only: they merge large groups of copies before all bands are looked at.
FIRST_BANDS = 6
#: Step 3: registers of the second sketch, and members of a block.
LONG_REGISTERS, BLOCK = 1024, 2048
#: Tasks that compare blocks, at most.
MOST_TASKS = 4096
TEXTS_A_TASK = 1000
#: A pair at the threshold whose registers agree less than this many standard deviations below it has a chance of 3e-7.
DEVIATIONS = 5
EDGES = "a long, b long"


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: text, hash and count of each, in order of text."""
    chunk = textnum.Chunk(texts)
    points = chunk.points + 32 * ((chunk.points >= 65) & (chunk.points <= 90)).astype(np.uint32)
    starts, ends = textnum.words(chunk)
    words = textnum.run_hashes(points, starts, ends)
    n_words = np.bincount(chunk.text_of(starts), minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    width = np.minimum(n_words, WORDS)
    per = np.where(n_words > 0, n_words - width + 1, 0)
    of = np.repeat(np.arange(len(texts)), per)
    at = textnum.ragged(first, per)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            more = k < width[of]
            h[more] = h[more] * textnum.BASE + words[at[more] + k]
        h = textnum.mix(h)
    order = np.argsort((of.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    of, h = of[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
    return of[new], h[new], np.diff(np.append(new, len(h)))


def registers(n_texts: int, of: np.ndarray, h: np.ndarray, weight: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: for each text, the shingle that came first into each of m registers (0 for texts without shingles)."""
    first = np.full(n_texts * m, np.inf)
    winner = np.zeros(n_texts * m, np.uint64)
    time, step = np.zeros(len(h)), 0
    live = np.arange(len(h))
    rate = weight.astype(np.float64)
    while len(live):
        step += 1
        with np.errstate(over="ignore"):
            x = textnum.mix(h[live] + np.uint64(step) * textnum.BASE)
        time = time + -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[live]
        register = ((x & np.uint64(0xFFFFF)) * np.uint64(m) >> np.uint64(20)).astype(np.int64)
        slot = of[live] * m + register
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        winner[slot[won]] = h[live[won]]
        last = first.reshape(n_texts, m).max(1) if n_texts else first
        going = time < last[of[live]]
        live, time = live[going], time[going]
    return winner.reshape(n_texts, m)


def _sign(m: int):
    """Batches whose last column is a text, with a sketch of m registers in its place (null for texts without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textnum.release()
        for batch in batches:
            for a, b, texts in textnum.pieces(batch.column(batch.num_columns - 1), most=(1 << 20) // m):
                of, h, count = shingles(texts)
                low = (textnum.mix(registers(b - a, of, h, count, m)) >> np.uint64(56)).astype(np.uint8)
                has = np.bincount(of, minlength=b - a) > 0
                sketches = pa.array([x.tobytes() if any_ else None for x, any_ in zip(low, has)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], sketches], [*batch.schema.names[:-1], "sketch"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal values in the first `keys` columns, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if held and tuple(values[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(values[a])
    if held:
        yield pa.Table.from_batches(held)


class Members:
    """Members of a bucket: name, label, band, and the bytes of both sketches."""

    def __init__(self, table: pa.Table):
        self.rep, self.label, self.band = (table.column(c).to_numpy() for c in ("rep", "label", "band"))
        self.bands, self.sketch = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(len(table), -1) for c in ("short", "long_sketch"))

    def close(self, other: "Members", least: float) -> np.ndarray:
        """Pairs of different labels whose long sketches agree in `least` registers.

        A pair that shares several bands is in as many buckets, which are all torn; only the first one looks at it.
        """
        found = [np.zeros((0, 2), np.int64)]
        for k in range(len(self.rep)):
            others = np.flatnonzero(other.label != self.label[k])
            if other is self:
                others = others[others > k]
            shared = (other.bands[others] == self.bands[k]).reshape(-1, BANDS, ROWS).all(2)
            others = others[shared.argmax(1) == self.band[k]]
            near = others[np.count_nonzero(other.sketch[others] == self.sketch[k], 1) >= least]
            found.append(np.stack([np.minimum(other.rep[near], self.rep[k]), np.maximum(other.rep[near], self.rep[k])], 1))
        return np.concatenate(found)


def least_agreement(threshold: float) -> float:
    return LONG_REGISTERS * threshold - DEVIATIONS * (LONG_REGISTERS * threshold * (1 - threshold)) ** 0.5


def _pairs_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def _close(least: float):
    """(a, b) of whole buckets, sorted by h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            members = Members(group)
            if len(pairs := members.close(members, least)):
                yield _pairs_batch(pairs)

    return run


def _write_blocks(folder: str):
    """Each block's members as a file in the shared folder; (h, block, inside, path). A task's retry writes files of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = common.filesystem(folder)
        for group in _groups(batches, 2):
            h, block, inside = (group.column(c)[0].as_py() for c in ("h", "block", "inside"))
            name = f"{h & ((1 << 64) - 1):016x}-{block}-{uuid.uuid4().hex[:8]}"
            with filesystem.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(pickle.dumps(Members(group)))
            yield pa.RecordBatch.from_pydict({"h": [h], "block": [block], "inside": [inside], "path": [f"{folder}/{name}"]}, BLOCKS)

    return run


BLOCKS = pa.schema([("h", pa.int64()), ("block", pa.int32()), ("inside", pa.bool_()), ("path", pa.string())])


def _close_between(least: float):
    """(a, b) of pairs of blocks (one, other), sorted by one: a block is read, not shuffled, for each block that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(path: str) -> Members:
            filesystem, file = common.filesystem(path)
            with filesystem.open_input_stream(file, compression=None) as f:
                return pickle.loads(f.read())

        at, left = None, None
        for batch in batches:
            for one, other in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if one != at:
                    at, left = one, read(one)
                if len(pairs := left.close(left if other == one else read(other), least)):
                    yield _pairs_batch(pairs)

    return run


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets, given as sorted hashes and counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    p, q = a[1][i] / a[1].sum(), b[1][j] / b[1].sum()
    # For a common d: sum over e of max(p_e / p_d, q_e / q_d); p_e decides where e's ratio p / q is no less than d's.
    order = np.argsort(-p / q, kind="stable")
    p, q = p[order], q[order]
    ratio = p / q
    end = np.searchsorted(-ratio, -ratio, "right")
    p_upto, q_upto = np.cumsum(p), np.cumsum(q)
    only_a, only_b = 1 - p_upto[-1], 1 - q_upto[-1]
    total = (only_a + p_upto[end - 1]) / p + (only_b + q_upto[-1] - q_upto[end - 1]) / q
    return float((1 / total).sum())


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}

        def of(texts: list[str]) -> None:
            new = [t for t in dict.fromkeys(texts) if t not in held]
            for a, b in textnum.chunks(new, most=4096):
                which, h, count = shingles(new[a:b])
                order = np.lexsort((h, which))
                bounds = np.searchsorted(which, np.arange(b - a + 1))
                for k in range(b - a):
                    part = order[bounds[k] : bounds[k + 1]]
                    held[new[a + k]] = (h[part], count[part])

        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            close = []
            for i in range(0, len(left), 256):
                held.clear()
                of(left[i : i + 256] + right[i : i + 256])
                close += [probability_jaccard(held[x], held[y]) >= threshold - 1e-9 for x, y in zip(left[i : i + 256], right[i : i + 256])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(close, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(doc, label): the smallest document of each one's component, for documents with links (a, b).

    A step takes the smallest label among a document's neighbours and itself, then that label's label.
    """
    both = common.materialise(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "near-graph")
    labels = common.materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc"), F.least("a", "m").alias("label")), "near-labels")
    while True:
        # Each document's own label goes into the minimum as if it were its own neighbour.
        said = both.join(labels, F.col("b") == F.col("doc")).select(F.col("a").alias("doc"), "label", F.lit(None).cast("long").alias("own"))
        near = said.unionByName(labels.withColumn("own", F.col("label"))).groupBy("doc").agg(F.min("label").alias("next"), F.max("own").alias("own"))
        # A label is a document of the component, so it has a label of its own.
        jump = labels.toDF("__via", "__far")
        now = common.materialise(near.join(jump, F.col("next") == F.col("__via")).select("doc", F.least("next", "__far").alias("label"), "own"), "near-labels")
        common.discard(labels)
        labels = now.select("doc", "label")
        if now.where("label <> own").isEmpty():
            common.discard(both)
            return labels


def extend(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: these are read as links between the components known so far."""
    if labels is None:
        return components(links)
    of_a, of_b = labels.toDF("da", "la"), labels.toDF("db", "lb")
    between = links.join(of_a, F.col("a") == F.col("da"), "left").join(of_b, F.col("b") == F.col("db"), "left")
    between = between.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    between = common.materialise(between, "near-between")
    if between.isEmpty():
        return labels
    roots = components(between).toDF("root", "smallest")
    old = labels.join(roots, F.col("label") == F.col("root"), "left").select("doc", F.coalesce("smallest", "label").alias("label"))
    new = roots.join(labels, F.col("root") == F.col("doc"), "left_anti").select("root", "smallest")
    return common.materialise(old.union(new), "near-labels")


def _bounded(df: DataFrame, rows: int, row_bytes: int = 48) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= common.BROADCAST_BYTES else df


def _labelled(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """df with the label of each rep, itself where it has no links yet."""
    if labels is None:
        return df.withColumn("label", F.col("rep"))
    known = labels.toDF("of_rep", "found")
    return df.join(_bounded(known, labels.count()), F.col("rep") == F.col("of_rep"), "left").withColumn("label", F.coalesce("found", "rep")).drop("of_rep", "found")


def _members(classes: DataFrame, n_bands: int, labels: DataFrame | None) -> DataFrame:
    """(h, rep, label, band): the texts of the buckets, of the first n_bands, whose texts are in several components."""
    keys = _labelled(classes, labels).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))))
    keys = keys.select("band", F.xxhash64("band", F.substring("sketch", F.col("band") * ROWS + 1, F.lit(ROWS))).alias("h"), "rep", "label")
    torn = keys.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    torn = common.materialise(torn.select(F.col("h").alias("bucket")), "near-torn")
    members = common.materialise(keys.join(_bounded(torn, torn.count()), F.col("h") == F.col("bucket")).select("h", "rep", "label", "band"), "near-members")
    common.discard(torn)
    return members


def _pivots(members: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's pivot, unless they are in one component.

    The pivot is in the bucket's largest component. It is the member that meets most others, over all buckets: the source
    of many copies meets more of them than they meet each other.
    """
    in_bucket = members.groupBy("h").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("h", "bucket")
    met = members.join(in_bucket, F.col("h") == F.col("bucket")).groupBy("rep").agg(F.sum("n").alias("met")).withColumnRenamed("rep", "met_by")
    sized = members.join(met, F.col("rep") == F.col("met_by")).join(_sizes(members), F.col("label") == F.col("sized"))
    best = F.max(F.struct("size", (-F.col("label")).alias("label"), "met", (-F.col("rep")).alias("rep")))
    best = sized.groupBy("h").agg(best.alias("best")).select(F.col("h").alias("bucket"), (-F.col("best.label")).alias("low"), (-F.col("best.rep")).alias("pivot"))
    beyond = members.join(best, (F.col("h") == F.col("bucket")) & (F.col("label") != F.col("low")))
    return beyond.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def _sizes(members: DataFrame) -> DataFrame:
    return members.select("rep", "label").distinct().groupBy(F.col("label").alias("sized")).agg(F.count(F.lit(1)).alias("size"))


def _left_over(members: DataFrame, classes: DataFrame, plain: DataFrame, owners: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of different components that share a bucket and whose second sketches agree (step 3)."""
    of_bucket = members.join(_sizes(members), F.col("label") == F.col("sized"))
    best = of_bucket.groupBy("h").agg(F.max(F.struct("size", (-F.col("label")).alias("label"))).alias("best"), F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    torn = best.where("least < most").select(F.col("h").alias("bucket"), (-F.col("best.label")).alias("low"), "n")
    left = common.materialise(members.join(torn, F.col("h") == F.col("bucket")).select("h", "rep", "label", "band", "n", (F.col("label") == F.col("low")).alias("inside")), "near-left-over")
    texts = _texts_of(left.select("rep").distinct(), plain, owners)
    # Long sketches are dear for their bytes, so texts are dealt to tasks by number.
    dealt = texts.select("rep", "text").repartition(max(1, -(-texts.count() // TEXTS_A_TASK)))
    sketches = dealt.mapInArrow(_sign(LONG_REGISTERS), "rep long, sketch binary").toDF("of", "long_sketch")
    sketches = common.materialise(sketches.join(classes, F.col("of") == F.col("rep")).select("of", F.col("sketch").alias("short"), "long_sketch"), "near-long")
    common.discard(texts)
    least, columns = least_agreement(threshold), ["rep", "label", "band", "short", "long_sketch"]
    held = left.join(sketches, F.col("rep") == F.col("of"))
    # A bucket of one block is compared where its members meet.
    small = held.where(F.col("n") <= BLOCK).select("h", *columns).repartition("h").sortWithinPartitions("h")
    pairs = small.mapInArrow(_close(least), EDGES)
    large = left.where(F.col("n") > BLOCK).groupBy("h").agg(F.count_if("inside").alias("n_in"), F.count_if(~F.col("inside")).alias("n_out"))
    large = common.materialise(large.withColumnRenamed("h", "bucket"), "near-large")
    if not large.isEmpty():
        # Of others each member goes once into a file of its block; after the blocks of the largest component come the rest.
        blocks = lambda n: F.greatest(F.ceil(F.col(n) / F.lit(BLOCK)), F.lit(1)).cast("int")
        number = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
        dealt = held.join(F.broadcast(large) if large.count() * 24 <= common.BROADCAST_BYTES else large, F.col("h") == F.col("bucket"))
        dealt = dealt.withColumn("block", F.when(F.col("inside"), number("n_in")).otherwise(blocks("n_in") + number("n_out"))).select("h", "block", "inside", *columns)
        folder = common.scratch_path(plain.sparkSession, "near-blocks")
        filesystem, base = common.filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        files = common.materialise(dealt.repartition("h", "block").sortWithinPartitions("h", "block").mapInArrow(_write_blocks(folder), "h long, block int, inside boolean, path string"), "near-files")
        one, other = files.toDF("h", "i", "in_i", "one"), files.toDF("k", "j", "in_j", "other")
        meet = one.join(other, (F.col("h") == F.col("k")) & (F.col("i") <= F.col("j")) & ~(F.col("in_i") & F.col("in_j"))).select("one", "other")
        meet = common.materialise(meet, "near-meet")
        tasks = meet.repartition(max(1, min(meet.count(), MOST_TASKS)), "one", "other").sortWithinPartitions("one", "other")
        pairs = pairs.unionByName(tasks.mapInArrow(_close_between(least), EDGES))
    pairs = common.materialise(pairs, "near-close")
    common.discard(large)
    for done in (left, sketches):
        common.discard(done)
    return pairs.distinct()


def _texts_of(reps: DataFrame, plain: DataFrame, owners: DataFrame) -> DataFrame:
    """(rep, text), written out, for a table of distinct reps."""
    ends = common.materialise(reps.join(owners, "rep").select("rep", F.col("doc").alias("owner"), F.col("digest").alias("form")), "near-ends")
    n_ends = ends.count()
    # Of a text's copies only those with its smallest id, which are seldom several.
    of_ends = (F.col("doc") == F.col("owner")) & (F.col("digest") == F.col("form"))
    texts = common.materialise(plain.join(_bounded(ends, n_ends, 96), of_ends).select("rep", "text"), "near-texts", compression="zstd")
    common.discard(ends)
    return texts if texts.count() == n_ends else texts.dropDuplicates(["rep"])


def _links(pairs: DataFrame, plain: DataFrame, owners: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar. Only the texts of these pairs move."""
    texts = _texts_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), plain, owners)
    one, two = texts.toDF("da", "left"), texts.toDF("db", "right")
    with_left = common.materialise(pairs.join(one, F.col("a") == F.col("da")).select("a", "b", "left"), "near-left", compression="zstd")
    sided = with_left.join(two, F.col("b") == F.col("db")).select("a", "b", "left", "right")
    links = common.materialise(sided.mapInArrow(_verify(threshold), EDGES), "near-links")
    for done in (texts, with_left):
        common.discard(done)
    return links


def _plain(docs: DataFrame) -> DataFrame:
    text = common.text_or_empty(docs)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))


def _named(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owners, classes): of each distinct text its name (rep), smallest doc and digest; and name and sketch, if it has shingles."""
    signed = common.materialise(plain.mapInArrow(_sign(REGISTERS), "doc long, digest binary, sketch binary"), "near-signed")
    firsts = signed.groupBy("digest").agg(F.min(F.struct("doc", "sketch")).alias("m")).select("digest", "m.doc", "m.sketch")
    firsts = common.materialise(firsts, "near-firsts")
    common.discard(signed)
    shared = firsts.where(F.col("doc") != NULL_ID).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc < 0")
    shared = common.materialise(shared.select(F.col("doc").alias("shared")), "near-shared")
    named = firsts.join(_bounded(shared, shared.count()), F.col("doc") == F.col("shared"), "left")
    by_digest = (F.col("doc") == NULL_ID) | F.col("shared").isNotNull()
    name = F.when(by_digest, F.xxhash64("digest").bitwiseOR(F.lit(NULL_ID))).otherwise(F.col("doc"))
    named = named.select(name.alias("rep"), "doc", "digest", "sketch")
    owners = common.materialise(named.drop("sketch"), "near-owners")
    classes = common.materialise(named.where("sketch IS NOT NULL").select("rep", "sketch"), "near-classes")
    for done in (firsts, shared):
        common.discard(done)
    return owners, classes


def _judge(docs: DataFrame, threshold: float) -> DataFrame:
    """Of each digest in docs its smallest doc and its class's head: the class's smallest (doc, digest)."""
    plain = _plain(docs)
    owners, classes = _named(plain)
    checked, labels, members = [], None, None

    def link(pairs: DataFrame) -> None:
        nonlocal labels
        for done in checked:
            pairs = pairs.join(done.toDF("ca", "cb"), (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")), "left_anti")
        pairs = common.materialise(pairs, "near-pairs")
        checked.append(pairs)
        if not pairs.isEmpty():
            links = _links(pairs, plain, owners, threshold)
            before, labels = labels, extend(labels, links)
            common.discard(links)
            if before is not None and before is not labels:
                common.discard(before)

    for n_bands in (FIRST_BANDS, BANDS):
        if members:
            common.discard(members)
        members = _members(classes, n_bands, labels)
        link(_pivots(members))
    # Buckets that were in one piece stay so: their members with the labels of now are all that is left.
    link(_left_over(_labelled(members.drop("label"), labels), classes, plain, owners, threshold))

    labels = labels if labels is not None else docs.sparkSession.createDataFrame([], "doc long, label long")
    linked = owners.join(labels.toDF("linked", "label"), F.col("rep") == F.col("linked"), "left").select("digest", "doc", "label")
    linked = common.materialise(linked, "near-linked")
    heads = linked.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc", "digest")).alias("head")).withColumnRenamed("label", "of")
    heads = common.materialise(heads, "near-heads")
    both = linked.join(_bounded(heads, heads.count(), 96), F.col("label") == F.col("of"), "left")
    judged = both.select("digest", "doc", F.coalesce("head.doc", "doc").alias("head_doc"), F.coalesce("head.digest", "digest").alias("head_digest"))
    judged = common.materialise(judged, "near-judged")
    for done in (owners, classes, members, linked, heads, labels, *checked):
        common.discard(done)
    return judged


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, copy_of (smallest id with the same text) and class_id (of its near-duplicates)."""
    classes = _judge(docs, threshold).toDF("of_digest", "first", "head", "head_digest")
    out = _plain(docs).select("doc", "digest").join(classes, F.col("digest") == F.col("of_digest"))
    plain_id = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(plain_id("doc").alias("doc_id"), plain_id("first").alias("copy_of"), plain_id("head").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: that with the smallest doc_id (one of its rows, if it has several)."""
    id_, digest, n = (common.free_name(docs, x) for x in ("kept_id", "kept_digest", "kept_n"))
    heads = _judge(docs, threshold).where("digest = head_digest").select(F.col("doc").alias(id_), F.col("digest").alias(digest))
    several = _plain(docs).groupBy(F.col("doc").alias(id_), F.col("digest").alias(digest)).agg(F.count(F.lit(1)).alias(n))
    found = common.materialise(heads.join(several, [id_, digest]), "near-kept")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col(id_)) & (F.unhex(F.md5(common.text_or_empty(docs))) == F.col(digest))
    kept = docs.join(found, same)
    if found.where(F.col(n) > 1).isEmpty():
        return kept.drop(id_, digest, n)
    return kept.where(F.col(n) == 1).unionByName(kept.where(F.col(n) > 1).dropDuplicates([id_, digest])).drop(id_, digest, n)


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
