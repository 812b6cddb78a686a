import random

import pytest
from clinframe.llm import chatlog

SCHEMA = chatlog.LOG + ", at string, same int, part string"
ROLES = ["user", "assistant", "system", "tool name]<s>", "", None]
TEXTS = ["hi", "", None, " ", "</s>", "a [INST] b\\", "[\\\\INST]", "<\\s>[/INST", " [/INST] x", "[ROLE user]", "[ROLE <s>] [/ROLE]", "é😀\n", "<<s>>", "[", "\\"]


def slow(log):
    """conv_id -> [(role, text)]: events applied one after the other to a dictionary of turns."""
    convs = {}
    key = lambda e: (e[1] is not None, e[1] or 0, e[2], e[3], e[4] is not None, e[4] or "", e[5] is not None, e[5] or "")
    for conv in {e[0] for e in log}:
        turns, seen = {}, set()
        for _, seq, turn, kind, role, text in sorted((e[:6] for e in log if e[0] == conv and e[2] is not None and e[3] in ("open", "delta", "edit", "regenerate")), key=key):
            if seq in seen:
                continue
            seen.add(seq)
            if kind == "delta":
                if turn in turns:
                    turns[turn][1] += text or ""
            else:
                turns = {t: m for t, m in turns.items() if t < turn} | {turn: [role or "", text or ""]}
        if turns:
            convs[conv] = [tuple(turns[t]) for t in sorted(turns)]
    return convs


@pytest.fixture(scope="module")
def log():
    rng = random.Random(9)
    rows = []
    for conv in [*range(60), None, -3]:
        for seq in rng.sample(range(200), rng.randrange(1, 40)) + [None]:
            rows.append((conv, seq, rng.choice([0, 1, 2, 3, 5, None]), rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "other", None]), rng.choice(ROLES), rng.choice(TEXTS)))
    rows += rng.sample(rows, 100) + [(r[0], r[1], 1, "open", "user", "again") for r in rng.sample(rows, 40)]
    return [(*r, "a", 1, "p") for r in rows]


def test_against_slow_version(spark, log):
    want = slow(log)
    for part_chars in (1 << 18, 1):
        made = chatlog.format_log(spark.createDataFrame(log, SCHEMA), part_chars=part_chars).cache()
        assert part_chars > 1 or made.agg({"part": "max"}).first()[0] > 2
        got = {}
        for r in chatlog.read_messages(made).orderBy("conv_id", "part", "at").collect():
            got.setdefault(r.conv_id, []).append((r.role, r.text))
            assert r.trained == (r.role == "assistant")
        assert got == want
        found = {r.conv_id: r for r in chatlog.digests(made).collect()}
        assert set(found) == set(want)
        for conv, turns in want.items():
            answers = "".join(t for role, t in turns if role == "assistant")
            assert (found[conv].n_turns, found[conv].loss_chars) == (len(turns), len(answers))
            assert found[conv].loss_sha256 == chatlog.hashlib.sha256(answers.encode()).hexdigest()
            assert found[conv].turns_sha256 == chatlog.hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert {k: v.formatted_chars for k, v in found.items()} == {r[0]: r[1] for r in made.selectExpr("conv_id", "length(text) AS n").groupBy("conv_id").sum("n").collect()}
        made.unpersist()


def test_escapes():
    rng = random.Random(2)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "ROLE ", "x]", "/ROLE]", " ", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        hidden = chatlog.escape(text)
        assert chatlog.unescape(hidden) == text
        assert all(m.group(2) for m in chatlog.CONTROL.finditer(hidden))
        for role in ("user", "assistant", "a b]"):
            piece, start, length = chatlog.render(role, text)
            assert list(chatlog.parse(piece)) == [(role, text)] and chatlog.unescape(piece[start : start + length]) == text


def test_log_of_messages_folds_back(spark):
    rows = [(i % 9 if i % 10 else None, i // 9 if i % 4 else None, ROLES[i % 6], TEXTS[i % 15] if i % 3 else "long é " * (i * 40), "x") for i in range(120)]
    rows += rows[:5] + [(77, 0, "user", "x" * 3_000_000, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    log = [tuple(r) for r in chatlog.log_of(table).collect()]
    assert {e[3] for e in log} == {"open", "delta", "edit", "regenerate"} and len(log) > 2 * len(rows)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    want = {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)] for c in {r[0] for r in rows}}
    assert slow(log) == want
    got = {}
    for r in chatlog.read_messages(chatlog.format_log(chatlog.log_of(table))).orderBy("conv_id", "part", "at").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == want


def test_partitioned_once_and_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = chatlog.format_log(chatlog.log_of(empty))
    assert made.collect() == [] and chatlog.digests(made).collect() == []
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1
