"""Quality rules by tokeniser fertility.

Every whole text is cut into words ([^\\x20\\x09-\\x0D]+), and two public vocabularies are asked how they spell
them, each word on its own: a sentencepiece BPE with byte fallback (pieces) and a byte-level BPE for many
languages (ranks). Text of the languages a vocabulary was made for takes few tokens a character, hardly any
byte fallback, and many different tokens; encoded blobs, symbol runs, broken encodings and repeated boilerplate
do not. A text is rejected if a measure leaves the band of its language, or else of its script.

Bands of languages are fitted: FITTED has the means of clean prose, weighted by length, and the limit lies MARGIN below
them. A short text's mean scatters by the root of its length, so its limit gives way. The sample is the first 3,500
labelled rows of documents at scale 0.1; its rows with quality 1 that pass the base rule are the clean prose. Only the
low limits are fitted; prose of longer common words lies above the means and passes. A language without a fitted band
has its script's, wider one. Broken encodings are told by their fertility alone, so those of a text with few accents pass.

Measures: chars_per_piece and chars_per_rank (code points of words / tokens), byte_share (byte-fallback pieces /
pieces), piece_entropy (bits, of the text's own piece frequencies).

Defined cases: a null or empty text has no words, measures 0 and fails the base rule; repeated rows are measured
each; an empty table gives an empty table; all columns of the input pass through and the result is one struct
column, renamed by underscores if its name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clinframe.llm import common, textnum


@dataclass(frozen=True)
class Band:
    """What a text's measures must lie in. entropy: at least min(entropy, entropy_share x log2(tokens)).

    The low limits of chars_per_piece and chars_per_rank hold for the characters other than SYMBOLS.

    scatter, for the same two: a low limit is min(low, low + MARGIN - scatter / sqrt(word_chars)).
    """

    chars_per_piece: tuple[float, float]
    chars_per_rank: tuple[float, float]
    byte_share: float
    entropy: float = 3.5
    entropy_share: float = 0.5
    scatter: tuple[float, float] = (0.0, 0.0)


#: By script. The lower limits are about half of what prose takes with 32k to 50k entries, the upper ones
#: beyond the longest common words. Latin: random letters and encoded blobs take 1.5 characters a rank at most, prose
#: in Latin script 1.8 at least; pieces can't tell them, since they spell Vietnamese by single letters.
SCRIPT_BANDS = {
    "Latin": Band((1.15, 12.0), (1.7, 12.0), 0.20),
    "Cyrillic": Band((0.9, 10.0), (0.7, 10.0), 0.30),
    "Greek": Band((0.6, 8.0), (0.5, 8.0), 0.50),
    "Semitic": Band((0.5, 8.0), (0.5, 8.0), 0.60),
    "Indic": Band((0.3, 6.0), (0.3, 6.0), 0.95),
    "East Asian": Band((0.3, 4.0), (0.3, 4.0), 0.95),
    "Other": Band((0.2, 12.0), (0.2, 12.0), 1.0),
}
#: By language: mean chars_per_piece and chars_per_rank of clean prose in the sample.
FITTED = {"en": (2.218, 2.231), "de": (2.241, 2.309), "fr": (1.981, 2.041), "es": (1.940, 2.061)}
#: Below the means; of the sample's clean prose, 99.8 percent scatter by less than SCATTER / sqrt(word_chars).
MARGIN, SCATTER = 0.1, (7.0, 5.0)
LANGUAGE_BANDS = {lang: Band((a - MARGIN, 12.0), (b - MARGIN, 12.0), 0.20, scatter=SCATTER) for lang, (a, b) in FITTED.items()}
#: First code point of each range, and its script; read as a step function over letters.
SCRIPT_STEPS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Other"), (0x0590, "Semitic"), (0x0780, "Other"),
    (0x08A0, "Semitic"), (0x0900, "Indic"), (0x0E00, "Other"), (0x1100, "East Asian"), (0x1200, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2E80, "East Asian"), (0xA000, "Other"), (0xAC00, "East Asian"), (0xD7B0, "Other"),
    (0xF900, "East Asian"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFF21, "Latin"), (0xFF66, "East Asian"), (0x10000, "Other"),
    (0x20000, "East Asian"), (0x32000, "Other"),
]
SCRIPTS = list(SCRIPT_BANDS)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    piece_file: str = "piece_bpe_32k.model"
    rank_file: str = "byte_bpe_multi_50k.tiktoken"
    script_bands: dict[str, Band] = field(default_factory=lambda: SCRIPT_BANDS)
    #: Bands for values of the lang column; they come before the script's.
    language_bands: dict[str, Band] = field(default_factory=lambda: LANGUAGE_BANDS)
    least_words: int = 10
    repeat_percent: int = 20
    window: int = 5


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in ("chars_per_piece", "byte_share", "piece_entropy", "chars_per_rank")]
    + [T.StructField("script", T.StringType())]
)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def repeated_words(hashes: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Of each word of many texts: does a window that its text has twice or more cover it?"""
    n = len(hashes) - window + 1
    covered = np.zeros(len(hashes), bool)
    if n < 2:
        return covered
    with np.errstate(over="ignore"):
        key = text[:n].astype(np.uint64)
        for i in range(window):
            key = key * textnum.BASE + hashes[i : i + n]
    at = np.flatnonzero(text[:n] == text[window - 1 :])
    key = textnum.mix(key[at])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int32)
    edge[at[again]] += 1
    np.add.at(edge, at[again] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def scripts(chunk: textnum.Chunk, n: int) -> np.ndarray:
    """The script of most of each text's letters."""
    p = chunk.points
    if not len(p) or p.max() < 0x370:
        return np.zeros(n, np.int64)
    firsts = np.array([a for a, _ in SCRIPT_STEPS])
    kind = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STEPS])
    letters = np.flatnonzero(textnum.classes()[p] == textnum.LETTER)
    which = kind[np.searchsorted(firsts, p[letters], "right") - 1]
    counts = np.bincount(chunk.text_of(letters) * len(SCRIPTS) + which, minlength=n * len(SCRIPTS))
    return counts.reshape(n, -1).argmax(1)


def measure(texts: list[str], langs: list[str | None], rules: Rules) -> dict[str, np.ndarray | list]:
    import public_tokenizers

    n = len(texts)
    chunk = textnum.Chunk(texts)
    starts, ends = textnum.words(chunk)
    of = chunk.text_of(starts)
    sizes = ends - starts
    per = lambda weights=None: np.bincount(of, weights, minlength=n)
    n_words, word_chars = per(), per(sizes).astype(np.int64)
    is_symbol = np.zeros(128, bool)
    is_symbol[[ord(c) for c in SYMBOLS]] = True
    small = chunk.points < 128
    symbols = np.zeros(len(chunk.points) + 1, np.int64)
    np.cumsum(small & is_symbol[np.where(small, chunk.points, 0)], out=symbols[1:])
    repeated = np.bincount(of, repeated_words(textnum.run_hashes(chunk.points, starts, ends), of, rules.window), minlength=n).astype(np.int64)

    pieces, ranks = textnum.piece_bpe(public_tokenizers.path(rules.piece_file)), textnum.rank_bpe(public_tokenizers.path(rules.rank_file), " ")
    which = pieces.find(chunk, starts, ends)
    ids, lengths = pieces.gather(which), pieces.lengths[which]
    owner = np.repeat(of, lengths)
    n_pieces = np.bincount(owner, minlength=n)
    # Ids 3 to 258 of the model are its bytes.
    n_bytes = np.bincount(owner[(ids >= 3) & (ids < 259)], minlength=n)
    pairs, count = np.unique(owner * (1 << 20) + ids, return_counts=True)
    total = np.maximum(n_pieces, 1)
    # H = log2 N - sum c log2 c / N
    entropy = np.log2(total) - np.bincount(pairs >> 20, count * np.log2(count), minlength=n) / total
    n_ranks = per(ranks.count(chunk, starts, ends))

    out: dict = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": np.diff(symbols[chunk.bounds]),
        "n_dup_lines": np.fromiter(map(duplicate_lines, texts), np.int64, n), "n_repeat_words": repeated,
        "base_failed": (n_words < rules.least_words) | (100 * repeated > rules.repeat_percent * n_words),
        "chars_per_piece": word_chars / total, "byte_share": n_bytes / total, "piece_entropy": np.maximum(entropy, 0.0),
        "chars_per_rank": word_chars / np.maximum(n_ranks, 1), "script": [SCRIPTS[s] for s in scripts(chunk, n)],
    }
    bands = [rules.language_bands.get(lang) or rules.script_bands[s] for lang, s in zip(langs, out["script"])]
    limits = np.array([(*b.chars_per_piece, *b.chars_per_rank, b.byte_share, b.entropy, b.entropy_share, *b.scatter) for b in bands]).reshape(n, 9).T
    low, high, low_r, high_r, share, bits, bits_share, scatter, scatter_r = limits
    root = np.sqrt(np.maximum(word_chars, 1))
    low, low_r = np.minimum(low, low + MARGIN - scatter / root), np.minimum(low_r, low_r + MARGIN - scatter_r / root)
    # Runs of a symbol are long tokens; they would lift a low fertility, so the low limits count other characters only.
    plain = word_chars - out["n_symbols"]
    inside = (plain / total >= low) & (out["chars_per_piece"] <= high) & (plain / np.maximum(n_ranks, 1) >= low_r) & (out["chars_per_rank"] <= high_r)
    inside &= (out["byte_share"] <= share) & (out["piece_entropy"] >= np.minimum(bits, bits_share * np.log2(total)))
    out["kept"] = inside & ~out["base_failed"]
    return out


def annotate(docs: DataFrame, rules: Rules | None = None, out: str = "quality") -> DataFrame:
    """docs with a struct of base counts, measures and verdict; map-only."""
    rules, out = rules or Rules(), common.free_name(docs, out)
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else -1
    names = [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(lang_at).to_pylist() if lang_at >= 0 else [None] * len(batch)
            for a, b, texts in textnum.pieces(batch.column(at)):
                got = measure(texts, langs[a:b], rules)
                fields = [pa.array(got[f.name], {T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.StringType: pa.string()}[type(f.dataType)]) for f in RESULT]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.StructArray.from_arrays(fields, RESULT.names)], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, RESULT)]))


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    out = common.free_name(docs, "quality")
    return annotate(docs, rules).where(f"{out}.kept").drop(out)


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return annotate(docs).select("doc_id", "quality.*")
