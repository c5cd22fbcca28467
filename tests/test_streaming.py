import datetime
import random

import pytest

from scholia.plans import flow_queries
from scholia.streaming import events, run


def at(s):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


def written(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"t.parquet/{i}.parquet"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t.parquet"))


def test_breaker_steps():
    s, seen = ("closed", 0, 0, 0.0), []
    for t, ok in [(i, False) for i in range(5)] + [(10, True), (70, True), (71, True), (72, True), (73, False)]:
        s, through = events.breaker_step(s, t, ok)
        seen.append((s[0], through))
    assert seen == [("closed", True)] * 4 + [("open", True), ("open", False), ("half_open", True), ("half_open", True), ("closed", True), ("closed", True)]


def test_recent_messages_expire(spark, tmp_path):
    rows = [[("u", at(0), "a"), ("u", at(5), "b"), ("v", at(6), "x")], [("u", at(10), "c"), ("u", at(11), "d")], [("u", at(5000), "e")]]
    out = run.settled(events.recent_messages(written(spark, tmp_path, rows, "k string, ts timestamp, m string"), "k", "ts", "m", keep=3), "update")
    got = sorted((r.key, r.messages) for r in out.collect())
    assert ("u", ["e"]) in got and ("v", ["x"]) in got and ("u", ["b", "c", "d"]) in got


def test_rates(spark, tmp_path):
    rows = [[("u", at(i)) for i in range(5)], [("u", at(70))]]
    out = run.settled(events.rates(written(spark, tmp_path, rows, "k string, ts timestamp"), "k", "ts", 3))
    assert sorted((r.n, r.rejected) for r in out.collect()) == [(1, 0), (5, 2)]


def test_sessions_in_batch(spark):
    df = spark.createDataFrame([("u", at(0)), ("u", at(60)), ("u", at(4000))], "k string, ts timestamp")
    assert sorted(r.n for r in events.sessions(df, "k", "ts").collect()) == [1, 2]


@pytest.fixture(scope="module")
def interleaved(spark, tmp_path_factory):
    """Events of twenty days in 110 files, each with times from all over; and the same rows in order of time."""
    rng = random.Random(4)
    seconds = rng.sample(range(20 * 86400), 1100)
    rows = [(at(s), rng.randrange(40), rng.choice("abc"), rng.random() * 70) for s in seconds]
    folder = tmp_path_factory.mktemp("interleaved")
    spark.sparkContext.parallelize(rows, 110).toDF("ts timestamp, user_id bigint, event_type string, value double").write.parquet(str(folder / "events.parquet"))
    return str(folder), sorted(rows)


def brute_breaker(rows):
    out = {}
    for t, _, kind, value in rows:
        state, n, rejected = out.get(kind, (("closed", 0, 0, 0.0), 0, 0))
        state, through = events.breaker_step(state, t.replace(tzinfo=datetime.timezone.utc).timestamp(), value < 50)
        out[kind] = state, n + 1, rejected + (not through)
    return sorted((k, s[0], n, rejected) for k, (s, n, rejected) in out.items())


def test_more_files_than_a_batch_takes(spark, interleaved):
    folder, rows = interleaved
    got = sorted((r.key, r.last_message) for r in flow_queries.stream_recent(spark, folder).collect())
    assert got == sorted((str(k), m) for k, m in {u: kind for _, u, kind, _ in rows}.items())
    got = sorted((r.key, r.state, r.calls, r.rejected) for r in flow_queries.stream_circuit_breaker(spark, folder).collect())
    assert got == brute_breaker(rows)


def test_batches_in_order_of_time(spark, interleaved):
    folder, rows = interleaved
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    calls = run.stream(spark, folder, "events", 1, "ts").selectExpr("event_type", "ts", "value < 50 as ok")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert run.settled(events.circuit_breaker(calls, "event_type", "ts", "ok"), "update").count() > 3
    batches = run.settled(events.circuit_breaker(calls, "event_type", "ts", "ok"), "update", "key")
    assert sorted((r.key, r.state, r.calls, r.rejected) for r in batches.collect()) == brute_breaker(rows)
