"""Chat formatting of event logs: fold streamed deltas, edits and regenerations into messages, then render them.

A log has a row per event: conv_id, seq, turn (its place in the conversation), kind, role, text.

  open        the turn begins, with a role and perhaps text
  delta       text is added to the turn
  edit        the turn begins anew with this text; what followed it in the conversation is gone
  regenerate  the same, written when an answer is streamed again

So an event counts in the end if its turn is smaller than that of every later open, edit or regenerate, which is a
running minimum over a conversation's events in descending seq. Conversations are partitioned once; that minimum, the
order of the turns and the rendering all work in that partitioning. Events are folded as a stream in order of turn and
seq, so that a task holds the message it is at and one part of output; a conversation of any length passes through, its
sort on disk where it is large. Output is a table (conv_id, part, text, loss): a conversation is its parts in order, each
of whole turns and about PART_CHARS characters, and loss has the spans (start, length) in the part to be trained on.

The template marks turns with control strings; where texts hold one, a backslash after its first character hides it, and
one more for each that stood there before, so that taking one away restores every text. Digests of what a table holds
are made part after part by a stream too, as a SHA-256 of a conversation can't be put together from pieces.

Defined cases: null conv_ids are one conversation; a null text is empty, a null role too; events without turn or of an
unknown kind are left out; events of a conversation with the same seq are one, delivered again (the first by turn, kind,
role and text counts); deltas of a turn that isn't open are left out; numbers of turns may have gaps; a conversation
without turns has no row; an empty log gives an empty table; other columns aren't read. In a table of finished messages,
rows stand in order of turn, role and text, nulls first, and repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinframe.llm import common

LOG = "conv_id long, seq long, turn long, kind string, role string, text string"
FORMATTED = "conv_id long, part int, text string, loss array<struct<start:int,length:int>>"
RESETS = ("open", "edit", "regenerate")
PART_CHARS = 1 << 18
BEGIN = "<s>"
#: The control strings: first character, backslashes, rest.
_REST = r"/?s>|/?INST\]|ROLE [\w.~%-]*\]|/ROLE\]"
CONTROL = re.compile(rf"([<\[])(\\*)({_REST})", re.ASCII)
HIDDEN = re.compile(rf"([<\[])\\(\\*)({_REST})", re.ASCII)
TURN = re.compile(r"\[INST\] (.*?) \[/INST\]| (.*?) </s>|\[ROLE ([\w.~%-]*)\] (.*?) \[/ROLE\]", re.DOTALL | re.ASCII)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return HIDDEN.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where the text stands in it."""
    inner = escape(text)
    head, tail = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}.get(role) or (f"[ROLE {quote(role, safe='')}] ", " [/ROLE]")
    return head + inner + tail, len(head), len(inner)


def parse(part: str, at: int = 0) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns from `at` on."""
    while at < len(part):
        m = TURN.match(part, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        user, assistant, role, other = m.groups()
        yield ("user", unescape(user)) if user is not None else ("assistant", unescape(assistant)) if assistant is not None else (unquote(role), unescape(other))
        at = m.end()


def live(log: DataFrame) -> DataFrame:
    """Events that count, sorted within partitions by conversation, turn and seq."""
    events = log.select(*[F.col(c).cast(kind).alias(c) for c, kind in (x.split(" ") for x in LOG.split(", "))]).where(F.col("turn").isNotNull() & F.col("kind").isin("delta", *RESETS))
    last = Window.partitionBy("conv_id").orderBy(F.desc("seq"), "turn", "kind", "role", "text")
    # lag is null for the first row: a null seq then needs its row number to be told from it.
    events = events.withColumns({"at": F.row_number().over(last), "same": F.lag("seq").over(last).eqNullSafe(F.col("seq"))}).where("at = 1 OR NOT same")
    cut = F.min(F.when(F.col("kind") != "delta", F.col("turn"))).over(last.rowsBetween(Window.unboundedPreceding, -1))
    kept = events.withColumn("cut", cut).where("cut IS NULL OR turn < cut").drop("at", "same", "cut")
    return kept.sortWithinPartitions("conv_id", "turn", F.asc_nulls_first("seq"))


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(conv_id, role, text) of the turns in a sorted stream of live events."""
    at, role, held = None, "", None
    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "turn", "kind", "role", "text"))
        for conv, turn, kind, name, text in zip(*(c.to_pylist() for c in columns)):
            if kind != "delta":
                if held is not None:
                    yield at[0], role, "".join(held)
                at, role, held = (conv, turn), name or "", [text or ""]
            elif (conv, turn) == at:
                held.append(text or "")
    if held is not None:
        yield at[0], role, "".join(held)


def _rendered(trained: tuple[str, ...], part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])
        rows, ready, at, part, pieces, loss, size = [], 0, ..., 0, [], [], 0

        def close():
            if pieces:
                rows.append({"conv_id": at, "part": part, "text": "".join(pieces), "loss": loss})

        for conv, role, text in _messages(batches):
            if conv != at or size >= part_chars:
                close()
                ready += size
                part = part + 1 if conv == at else 0
                pieces, loss, size = ([] if conv == at else [BEGIN]), [], 0 if conv == at else len(BEGIN)
                at = conv
                if ready >= 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows.clear()
                    ready = 0
            piece, start, length = render(role, text)
            if role in trained:
                loss.append({"start": size + start, "length": length})
            pieces.append(piece)
            size += len(piece)
        close()
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def format_log(log: DataFrame, trained: tuple[str, ...] = ("assistant",), part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, text, loss) of the conversations in a log."""
    return live(log).mapInArrow(_rendered(trained, part_chars), FORMATTED)


def read_messages(formatted: DataFrame) -> DataFrame:
    """(conv_id, part, at, role, text, trained): the turns of each part, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("trained", pa.bool_())])
        for conv, part, text, loss in _parts(batches):
            spans, begun, rows = {s["start"] for s in loss}, len(BEGIN) if part == 0 else 0, []
            for i, (role, said) in enumerate(parse(text, begun)):
                piece, start, _ = render(role, said)
                rows.append(dict(zip(schema.names, (conv, part, i, role, said, begun + start in spans))))
                begun += len(piece)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return formatted.select("conv_id", "part", "text", "loss").mapInArrow(run, "conv_id long, part int, at int, role string, text string, trained boolean")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in range(4))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its parts say: turns, their digest, text under the loss mask, characters."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])))
        rows, at, n, said, n_loss, learnt, size = [], ..., 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        for conv, part, text, loss in _parts(batches):
            if conv != at:
                if at is not ...:
                    rows.append((at, n, said.hexdigest(), n_loss, learnt.hexdigest(), size))
                at, n, said, n_loss, learnt, size = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                    rows = []
            for role, words in parse(text, len(BEGIN) if part == 0 else 0):
                n += 1
                said.update(f"{role}\n{words}\n".encode())
            for span in loss:
                words = unescape(text[span["start"] : span["start"] + span["length"]])
                n_loss += len(words)
                learnt.update(words.encode())
            size += len(text)
        if at is not ...:
            rows.append((at, n, said.hexdigest(), n_loss, learnt.hexdigest(), size))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    ordered = formatted.select("conv_id", "part", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def log_of(conversations: DataFrame, piece: int = 512) -> DataFrame:
    """The log that a chat service would have kept of finished messages (conv_id, turn, role, text).

    By a hash of conversation and place, a message is streamed in deltas of `piece` characters; or half of it is
    streamed, a next turn opened, and all of it regenerated; or a draft is opened and edited; or it comes whole.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), common.text_or_empty(conversations).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") - 1
    rows = rows.withColumn("place", place).withColumns({"way": F.pmod(F.xxhash64("conv_id", "place"), F.lit(4)), "pieces": F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), 0)})
    event = lambda kind, text, after=0: F.struct(F.lit(kind).alias("kind"), (F.col("place") + after).alias("turn"), F.col("role").alias("role"), text.alias("text"))
    none, stream = F.lit(""), F.transform("pieces", lambda p: event("delta", p))
    broken = F.slice(stream, F.lit(1), F.ceil(F.size("pieces") / 2).cast("int"))
    ways = [
        F.concat(F.array(event("open", none)), stream),
        F.concat(F.array(event("open", none)), broken, F.array(event("open", F.lit("next"), 1), event("delta", F.lit(" turn"), 1), event("regenerate", none)), stream),
        F.array(event("open", F.concat(F.lit("draft of "), F.substring("text", 1, 40))), event("edit", F.col("text"))),
        F.array(event("open", F.col("text"))),
    ]
    events = F.when(F.col("way") == 0, ways[0]).when(F.col("way") == 1, ways[1]).when(F.col("way") == 2, ways[2]).otherwise(ways[3])
    each = rows.select("conv_id", "place", F.posexplode(events).alias("step", "event"))
    return each.select("conv_id", (F.shiftleft("place", 32) + F.col("step")).alias("seq"), "event.turn", "event.kind", "event.role", "event.text")


def op12_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    given = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = log_of(given.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string")))
    return digests(common.materialise(format_log(log), "chat-formatted"))


SQL_OP12 = rf"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
said AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)({_REST})', '\1\\\2\3', 'g')) AS inner_chars,
  CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 16 + length(url_encode(role)) END AS marks FROM given)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(inner_chars + marks))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
