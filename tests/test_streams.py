"""Streams in several batches: the same results as in one, and tables and state that don't grow with the stream's age."""

import datetime
import os
import random
import shutil

import pytest
from clinframe.streaming import jobs
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = datetime.datetime(2024, 1, 1)


def files(spark, folder, parts):
    """A file of events for each list of (event_id, minute, user, type), in order of time of writing."""
    for i, rows in enumerate(parts):
        data = [(e, START + datetime.timedelta(minutes=m), u, t, 1.0, "{}") for e, m, u, t in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/events{i}.parquet")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(str(folder))


def plain(rows, now):
    """The transitions of events (event_id, minute, user, type) up to minute `now`, one event after the other."""
    out = []
    for user in {r[2] for r in rows}:
        state, since = None, 0
        for e, m, _, t in sorted((r for r in rows if r[2] == user and r[1] < now), key=lambda r: (r[1], r[0])) + [(None, now, user, None)]:
            if state in ("queued", "processing") and since + 60 < m:
                state = "stuck"
                out.append((user, None, "stuck", since + 60))
            said = jobs.MOVES.get(t)
            if said and (said == "queued" or state in jobs.UNDER_WAY):
                state, since = said, m
                out.append((user, e, said, m))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3])
def test_transitions(spark, tmp_path, batches):
    rng = random.Random(3)
    rows = [(i, i * 4 + rng.randint(-4, 4), rng.randrange(6), rng.choice(list(jobs.MOVES))) for i in range(5, 155)] + [(900, 5000, 99, "view")]
    parts = [rows[i * len(rows) // batches : (i + 1) * len(rows) // batches] for i in range(batches)]
    got = jobs.run_stateful(jobs.transitions(files(spark, tmp_path / "in", parts)), "transitions").collect()
    minutes = lambda t: (t - START).total_seconds() / 60
    assert sorted(((r.user_id, r.event_id, r.state, minutes(r.at)) for r in got), key=str) == sorted(((u, e, s, float(m)) for u, e, s, m in plain(rows, 4990)), key=str)
    assert {r.state for r in got} == {"queued", "processing", "done", "error", "stuck"}


def test_transitions_of_odd_events_in_another_time_zone(spark, tmp_path):
    """Ids beyond 2^53 beside events without an id (last among equals), and a session's time zone with summer time."""
    big, minute = 2**53, 60 * 24 * 70
    rows = [(big + 1, minute, 1, "signup"), (big + 3, minute + 1, 1, "view"), (None, minute + 1, 1, "error"), (None, minute, 2, "click"), (7, minute, 2, "signup")]
    rows += [(8, minute + 950, 3, "signup"), (9, minute + 1100, 3, "purchase"), (10, minute + 1489, 4, "signup"), (11, minute + 1490, 5, "signup"), (99, minute + 1500, 9, "view")]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        moves = jobs.run_stateful(jobs.transitions(files(spark, tmp_path / "in", [rows])), "odd").select("user_id", "event_id", "state", F.unix_millis("at").alias("at"))
        start = spark.sql("SELECT unix_millis(TIMESTAMP'2024-01-01 00:00:00 UTC')").first()[0]
        got = sorted(((r.user_id, r.event_id, r.state, (r.at - start) / 60_000 - minute) for r in moves.collect()), key=lambda r: (r[0], r[3], r[1] is None))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [
        (1, big + 1, "queued", 0), (1, big + 3, "processing", 1), (1, None, "error", 1), (2, 7, "queued", 0), (2, None, "processing", 0), (2, None, "stuck", 60),
        (3, 8, "queued", 950), (3, None, "stuck", 1010), (3, 9, "done", 1100), (4, 10, "queued", 1489),
    ]


def test_state_of_transitions_is_kept_by_buckets_of_users(spark, tmp_path):
    """300 users with three events each in four buckets: no more rows of state than a few for each bucket, and each user's own transitions."""
    rows = [(u * 3 + i, u % 7 + 50 * i, u, t) for u in range(300) for i, t in enumerate(["signup", "view", "purchase"])] + [(5000, 5000, 999, "view")]
    stream = files(spark, tmp_path / "in", [rows])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        q = jobs.transitions(stream, buckets=4).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4 * 4
    got = jobs.run_stateful(jobs.transitions(stream, buckets=4), "few").collect()
    assert sorted((r.user_id, r.event_id, r.state, (r.at - START).total_seconds() / 60) for r in got) == [(u, e, s, float(m)) for u, e, s, m in sorted(plain(rows, 4990))]


def test_events_are_read_from_files_and_folders(spark, tmp_path):
    """Spark writes a table as a folder of parts, whose names don't begin with events; another table's parts stay out."""
    for name, ids in {"events.parquet": [1, 2], "events-2.parquet": [3], "pages.parquet": [4]}.items():
        spark.createDataFrame([(i, START, i, "view", 1.0, "{}") for i in ids], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    part = next(p for p in (tmp_path / "in" / "pages.parquet").iterdir() if p.name.startswith("part"))
    shutil.copy(part, tmp_path / "in" / "events-3.parquet")
    got = jobs.run_append(jobs.read_events(spark, str(tmp_path / "in")).select("event_id"), "read")
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4]


def test_latest_states_in_versions(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.randrange(1000), rng.randrange(40), rng.choice(list(jobs.MOVES))) for i in range(200)]
    parts = [rows[:40], rows[40:42], rows[42:198], rows[198:199], rows[199:]]
    table = jobs.run_upsert(files(spark, tmp_path / "in", parts), "latest")
    want = {}
    for e, m, u, t in rows:
        n = want.get(u, (-1, -1, None, 0))
        want[u] = (*max(n[:3], (m, e, t)), n[3] + 1)
    assert {r.user_id: (r.event_id, r.state, r.n_events) for r in table.collect()} == {u: (e, t, n) for u, (m, e, t, n) in want.items()}
    home = os.path.dirname(os.path.dirname(os.path.dirname(table.inputFiles()[0].removeprefix("file://"))))
    # Batches of one event wrote one bucket each; versions that the last manifests don't name are gone.
    assert len([x for x in os.listdir(f"{home}/v4") if x.startswith("bucket=")]) == 1
    assert sorted(x for x in os.listdir(home) if x.startswith("v")) == ["v2", "v3", "v4"]


def test_no_batch(spark, tmp_path):
    assert jobs.run_upsert(files(spark, tmp_path / "in", [[]]).where(F.lit(False)), "none").collect() == []


def test_a_batch_again_changes_nothing(spark, tmp_path):
    rows = [(1, 1, 1, "view"), (2, 2, 1, "click"), (3, 1, 2, "error")]
    stream = files(spark, tmp_path / "in", [rows])
    first = sorted(map(tuple, jobs.run_upsert(stream, "a").collect()))
    assert first == sorted(map(tuple, jobs.run_upsert(stream, "b").collect())) and [r[-1] for r in first] == [2, 1]


def test_audit_batch_again_leaves_the_log_equal(spark, tmp_path):
    rows = [(1, 1, 1, "purchase"), (2, 2, 1, "click"), (3, 3, 2, "view"), (4, 4, 2, "error")]
    log = jobs.run_audit(files(spark, tmp_path / "in", [rows[:2], rows[2:]]), "audit")
    first = sorted(map(tuple, log.collect()))
    assert [(r[0], r[2], r[5]) for r in first] == [(1, "verified", 0), (2, "edited", 0), (4, "deleted", 1)]
    path = os.path.dirname(os.path.dirname(os.path.dirname(log.inputFiles()[0].removeprefix("file://"))))
    again = spark.createDataFrame([r[:5] for r in first if r[5] == 0], "document_id long, actor_id long, action string, at timestamp, detail string")
    jobs.append_batch(again, 0, path)
    assert sorted(map(tuple, jobs.read_audit(spark, path).collect())) == first
    assert jobs.read_audit(spark, str(tmp_path / "none")).collect() == []
