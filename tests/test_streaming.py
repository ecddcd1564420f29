import math
import random

import pytest
from pyspark.sql import functions as F

from taskframe import streaming
from taskframe.operators import metrics


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, batches, schema, build, folder, mode="append"):
    """Every batch is a file and a micro-batch of its own; all rows that came out, in order of batches."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in{n:02d}")
    got = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in*")
    query = build(source).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(lambda df, n: got.extend((n, *r) for r in df.collect())).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return got


SCHEMA = "w string, ts timestamp"


def stamps(seconds):
    import datetime

    return [("a" if k % 3 else "b", datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)) for k, s in enumerate(seconds)]


def test_decayed_rate_equals_the_batch_form(rocks, tmp_path):
    rng = random.Random(5)
    rows = stamps(sorted(rng.uniform(0, 200) for _ in range(60)))
    got = run(rocks, [rows[:20], rows[20:45], rows[45:]], SCHEMA, lambda s: streaming.decayed_rate(s, "w", "ts"), f"{tmp_path}", "update")
    last = {k: (us, rate) for _, k, us, rate in got}
    df = rocks.createDataFrame(rows, SCHEMA)
    for key, (us, rate) in last.items():
        own = df.filter(F.col("w") == key)
        start = own.agg(F.min(F.unix_micros("ts"))).collect()[0][0]
        want = metrics.decayed_rate(own, ["w"], "ts", us, start).collect()[0].rate
        assert math.isclose(rate, want, rel_tol=1e-9)


def test_silences_equal_the_batch_form(rocks, tmp_path):
    rng = random.Random(6)
    at, rows = 0, []
    for _ in range(80):
        at += rng.choice([1, 5, 14, 20, 36, 90])
        rows.append(at)
    rows = stamps(rows)
    got = run(rocks, [rows[:25], rows[25:50], rows[50:]], SCHEMA, lambda s: streaming.silences(s, "w", "ts"), f"{tmp_path}")
    want = {(r.w, r.us) for r in metrics.silences(rocks.createDataFrame(rows, SCHEMA), "w", "ts").select("w", F.unix_micros("last_seen").alias("us")).collect()}
    found = [(k, us) for _, k, us in got]
    assert len(found) == len(set(found)) and want <= set(found)
    # beyond the closed ones only a worker's last ping, given up at the end
    last = {("a", max(t for k, t in rows if k == "a")), ("b", max(t for k, t in rows if k == "b"))}
    assert {k for k, _ in set(found) - want} <= {k for k, _ in last}


def test_limiter_equals_the_batch_form(rocks, tmp_path):
    rng = random.Random(7)
    rows = [("k", n, t, 3) for n, t in enumerate(sorted(rng.randrange(4 * 10**9) for _ in range(40)))]
    schema = "k string, n long, t long, r long"
    got = run(rocks, [rows[:15], rows[15:]], schema, lambda s: streaming.admissions(s, "k", "n", "t", "r"), f"{tmp_path}")
    want = {(r.n, r.admit_ns) for r in metrics.admissions(rocks.createDataFrame(rows, schema), ["k"], "t", ["n"], 3).collect()}
    assert {(n, a) for _, n, a in got} == want


def test_rate_changes(rocks, tmp_path):
    rows = [("k", n, 0, 1) for n in range(3)] + [("k", 3, 10**9, 0), ("k", 4, 5 * 10**9, 10)]
    got = {n: a for _, n, a in run(rocks, [rows], "k string, n long, t long, r long", lambda s: streaming.admissions(s, "k", "n", "t", "r"), f"{tmp_path}")}
    assert got == {0: 10**9, 1: 2 * 10**9, 2: 3 * 10**9, 3: 10**9, 4: 5 * 10**9}


def test_log_and_alert_streams(rocks, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"Backref": {"key": "x"}}\nnonsense\n{"Backref": {"key": "y"}}\n')
    (tmp_path / "log/b.json").write_text("job 7 FAILED\nfine\n")
    for build, want in ((lambda: streaming.log_records(rocks, f"{tmp_path}/log").select("key"), {"x", "y"}), (lambda: streaming.alert_lines(rocks, f"{tmp_path}/log"), {"job 7 FAILED"})):
        got = []
        q = build().writeStream.option("checkpointLocation", f"{tmp_path}/{len(want)}").foreachBatch(lambda df, n, got=got: got.extend(r[0] for r in df.collect())).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and set(got) == want
