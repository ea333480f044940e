"""Streams against one query of the same rows, and the delta table against a plain dictionary."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sorrel.streaming import deltas, outcomes, watch

READING = "key string, ts timestamp, reading long, status string, content string"


def readings(seed):
    rng = random.Random(seed)
    t0 = datetime(2024, 5, 1)
    rows = []
    for k in ("a", "b", "hot", "hot", "hot", "gone"):
        at = t0
        for _ in range(25):
            at += timedelta(hours=rng.choice((0, 1, 2, 5, 6, 7, 30, 80)), minutes=rng.randrange(3))
            if k == "gone" and at > t0 + timedelta(days=2):
                break
            rows.append((k, at, len(rows), rng.choice(("ok", "ok", "unreachable", "blocked", "error")), rng.choice(("x", "y", None))))
    return sorted(rows, key=lambda r: (r[1], r[2]))


def plain(rows, late=timedelta(hours=1)):
    out, state = [], {}
    micro = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    end = micro(max(r[1] for r in rows) - late)
    H = 3_600_000_000
    for k, ts, _, status, content in sorted(rows, key=lambda r: (r[1], r[2])):
        at, content = micro(ts), content or ""
        last = state.get(k)
        if last and at - last["at"] > 6 * H:
            out.append((k, last["at"] + 6 * H, "overdue", last["status"], None))
        if last and at - last["at"] > 72 * H:
            last = None
        now = {"at": at, "status": status, "content": last["content"] if last else None}
        if status == "ok":
            if now["content"] is not None and now["content"] != content:
                out.append((k, at, "content", now["content"], content))
            now["content"] = content
        elif last and {status, last["status"]} <= set(outcomes.FAILURES):
            out.append((k, at, "unreachable", last["status"], status))
        state[k] = now
    return sorted(out + [(k, s["at"] + 6 * H, "overdue", s["status"], None) for k, s in state.items() if s["at"] + 6 * H <= end], key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_table(spark, seed):
    rows = readings(seed)
    got = outcomes.watch_table(spark.createDataFrame(rows, READING))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_table(spark, tmp_path, files):
    rows = readings(7)
    df = spark.createDataFrame(rows, READING)
    want = sorted(map(tuple, outcomes.watch_table(df).collect()), key=str)
    assert want == plain(rows) and {w[2] for w in want} == {"overdue", "content", "unreachable"}
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], READING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = []
    before = spark.conf.get(outcomes.STATE_STORE[0])
    spark.conf.set(*outcomes.STATE_STORE)
    try:
        stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        watch.run_available(outcomes.watch_stream(stream), lambda b, n: found.extend(map(tuple, b.collect())), str(tmp_path / "cp"))
    finally:
        spark.conf.set(outcomes.STATE_STORE[0], before)
    assert sorted(found, key=str) == want


def test_delta_table(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, ts long, v long").schema
    t = deltas.DeltaTable(spark, f"file://{tmp_path}/t", schema, "k", "ts", buckets=4)
    assert t.read().count() == 0 and t.compact().through == -1
    rng, kept = random.Random(6), {}

    def check():
        assert {r.k: (r.ts, r.v) for r in t.read().collect()} == kept

    for n in range(7):
        rows = [(rng.choice(("hot", "hot", *"abcdef", None)), rng.randrange(20), rng.randrange(9)) for _ in range(20)] if n != 3 else []
        if n == 6:
            rows = [("a", 99, 1)]  # touches one bucket
        t.append(spark.createDataFrame(rows, schema), n)
        for k, ts, v in rows:
            if k is not None:
                kept[k] = max(kept.get(k, (-1, -1)), (ts, v))
        if n in (2, 6):
            before = t.manifest()
            m = t.compact()
            assert m.through == n and (n == 2 or sum(before.base.get(b) != name for b, name in m.base.items()) >= 1)
        check()
    t.append(spark.createDataFrame([("a", 500, 1)], schema), 4)  # ran before the compaction: already in the base
    check()
    t.append(spark.createDataFrame([("z", 1, 1)], schema), 7)
    t.append(spark.createDataFrame([("z", 1, 2)], schema), 7)  # the batch runs again
    kept["z"] = (1, 2)
    check()
    only_a = t.manifest().base
    t.append(spark.createDataFrame([("a", 600, 1)], schema), 8)
    kept["a"] = (600, 1)
    changed = {b for b, n in t.compact().base.items() if only_a.get(b) != n}
    assert 1 <= len(changed) <= 2
    t.vacuum()
    check()
    assert t._names("deltas") == [] and len(t._names("manifest")) == 1
    with pytest.raises(Exception):
        t._commit(t.manifest())


def test_half_written_batches_and_bases_are_ignored(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, ts long, v long").schema
    t = deltas.DeltaTable(spark, f"file://{tmp_path}/t", schema, "k", "ts", buckets=2)
    t.append(spark.createDataFrame([("a", 1, 1)], schema), 0)
    torn = spark.createDataFrame([("a", 9, 9)], schema).withColumn("bucket", F.lit(0))
    torn.write.partitionBy("bucket").parquet(f"{tmp_path}/t/deltas/batch=1")
    (tmp_path / "t/deltas/batch=1/_SUCCESS").unlink()
    torn.write.partitionBy("bucket").parquet(f"{tmp_path}/t/base/through-000000000000-dead")
    assert [tuple(r) for r in t.read().collect()] == [("a", 1, 1)]


def test_delta_sink_of_a_stream(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, ts long, v long").schema
    for i in range(4):
        spark.range(50).selectExpr("id % 9 AS k", f"id + {i} AS ts", f"id * {i} AS v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = deltas.DeltaTable(spark, f"file://{tmp_path}/t", schema, "k", "ts")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch.run_available(stream, t.sink(compact_every=3), str(tmp_path / "cp"))
    want = spark.read.parquet(str(tmp_path / "in")).groupBy("k").agg(F.max(F.struct("ts", "v")).alias("m")).select("k", "m.*")
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, want.collect())) and t.manifest().through == 2
