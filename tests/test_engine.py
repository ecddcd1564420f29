import json
import random

import pytest
from pyspark.sql import functions as F

from taskframe.operators import graph, metrics, schedule, tasks
from taskframe.plans.queries import FOUND
from taskframe.sources import runlog

SF = "/root/testdata/sf0.001"


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_closure_levels_and_distances(spark):
    chain_ = [(i, i + 1) for i in range(30)]  # longer than the rounds between two compactions
    assert pairs(graph.closure(edges_of(spark, chain_))) == {(i, j) for j in range(31) for i in range(j)}
    e = edges_of(spark, [(0, 2), (2, 3), (0, 3), (3, 4)])
    assert pairs(graph.closure(e)) == {(0, 2), (0, 3), (0, 4), (2, 3), (2, 4), (3, 4)}
    assert {r.id for r in graph.at_distance(e, 0, 2).collect()} == {4} and graph.at_distance(e, 0, 5).count() == 0
    nodes = spark.range(6)
    assert pairs(graph.t_level(e, nodes)) == {(0, 0), (1, 0), (5, 0), (2, 1), (3, 2), (4, 3)}
    assert pairs(graph.b_level(e, nodes)) == {(0, 3), (1, 0), (5, 0), (2, 2), (3, 1), (4, 0)}
    with pytest.raises(graph.CycleError):
        graph.closure(edges_of(spark, [(1, 1), (1, 2)]))
    loop = edges_of(spark, [(0, 1), (1, 2), (2, 1)])
    for f in (lambda: graph.closure(loop).count(), lambda: graph.levels(loop, nodes).count()):
        with pytest.raises(graph.CycleError):
            f()
    assert graph.has_cycle(loop) and not graph.has_cycle(e)
    none = e.limit(0)
    assert graph.closure(none).count() == 0 and graph.t_level(none, nodes).count() == 6 and graph.levels(none, nodes.limit(0)).count() == 0


def test_random_graph_outcomes_match_a_plain_run(spark):
    rng = random.Random(3)
    deps = {i: [j for j in range(i) if rng.random() < 0.06] for i in range(80)}
    fails = {i for i in deps if rng.random() < 0.1}
    state = {}
    for i, d in deps.items():
        state[i] = "blocked" if any(state[j] != "success" for j in d) else "failed" if i in fails else "success"
    e, nodes = edges_of(spark, [(j, i) for i, d in deps.items() for j in d]), spark.range(80)
    assert dict(pairs(schedule.outcomes(e, nodes, nodes.filter(nodes.id.isin(list(fails)))))) == state
    order = spark.createDataFrame([(i, i) for i in range(80)], "id long, position long")
    assert graph.order_violations(e, order).count() == 0


def test_closure_of_a_random_graph_is_that_of_a_walk(spark):
    rng = random.Random(12)
    deps = {i: [j for j in range(i) if rng.random() < 0.08] for i in range(40)}
    reached: dict = {}
    for i, d in deps.items():
        reached[i] = set(d).union(*(reached[j] for j in d))
    level = {}
    for i, d in deps.items():
        level[i] = max((level[j] + 1 for j in d), default=0)
    e = edges_of(spark, [(j, i) for i, d in deps.items() for j in d])
    assert pairs(graph.closure(e)) == {(j, i) for i, r in reached.items() for j in r}
    assert dict(pairs(graph.t_level(e, spark.range(40)))) == level


def test_transactions_that_end(spark):
    from taskframe.operators import remote

    claims = spark.createDataFrame([(7, "a", "j1", 10), (8, "b", "j1", 10)], "transaction long, key string, job string, since long")
    asked = [(1, "end", 7, "j1", True), (11, "ping", 9, "j1", True), (12, "begun", 7, "j1", True), (13, "begun", 7, None, True), (14, "end", 7, None, True), (15, "end", 7, "j1", False), (16, "end", 7, "j1", True), (17, "end", 7, "j1", True), (18, "begun", 7, "j1", True), (19, "end", 8, "other", True), (20, "end", 8, "j1", True), (21, "ping", 8, None, True), (22, "ping", 8, "j1", False)]
    got = remote.transaction_replies(spark.createDataFrame(asked, "seq long, endpoint string, transaction long, job string, authorized boolean"), claims)
    assert {r.seq: (r.code, r.event) for r in got.collect()} == {1: (404, None), 11: (200, None), 12: (200, "Started"), 13: (400, None), 14: (400, None), 15: (401, None), 16: (200, "Finished"), 17: (404, None), 18: (404, None), 19: (404, None), 20: (404, None), 21: (200, None), 22: (401, None)}


def test_cancelled_jobs_and_settings(spark):
    from taskframe.operators import remote

    jobs = lambda *x: spark.createDataFrame([(j,) for j in x], "job string")
    reply, all_ = remote.mark_cancelled(jobs("a", "b", "c"), jobs("b"), jobs("z"))
    assert pairs(reply) == {("a",), ("c",)} and pairs(all_) == {("a",), ("c",), ("z",)}
    said = [(1, 5, "ratelimit", "3"), (2, 6, "ratelimit", "9"), (3, 7, "provisioner_info", "x"), (4, 9, "soft", None), (5, 8, "soft", None), (6, 9, "hard", None)]
    df = spark.createDataFrame([(0, *x) for x in said], "g int, seq long, at long, kind string, value string")
    assert remote.settings(df, "g").collect()[0] == (0, 9, "x", True, 8)


def test_queue_bits(spark):
    df = spark.createDataFrame([(-(2**63) + 5, 1), (0, 2)], "affinity long, id long")
    assert {r.id: r.q for r in df.select("id", schedule.queues(df.affinity).alias("q")).collect()} == {1: [0, 2, 63], 2: []}


def test_first_submission_wins(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "key string, id long, c string")
    assert pairs(tasks.first_by_key(df, "key", "id")) == {("a", 1, "y", 2), ("b", 2, "z", 1)}


def test_limiter_equals_a_retry_loop(spark):
    rng = random.Random(1)
    for rate in (1, 3, 50):
        times = sorted(rng.randrange(3 * 10**9) for _ in range(60))
        tau = 10**9 // rate
        tat, want = rate * tau, []
        for t in times:
            now = max(t, max(tat, t) + tau - 10**9)
            tat = max(tat, t) + tau
            want.append(now)
        df = spark.createDataFrame([(0, t, i) for i, t in enumerate(times)], "g long, t long, i long")
        got = sorted((r.i, r.admit_ns) for r in metrics.admissions(df, ["g"], "t", ["i"], rate).collect())
        assert [a for _, a in got] == want
    burst = spark.createDataFrame([(0, 0, i) for i in range(200)], "g long, t long, i long")
    assert max(r.admit_ns for r in metrics.admissions(burst, ["g"], "t", ["i"], 50).collect()) == 4 * 10**9


def header(n):
    return {"Header": {"version": 4, "time": {"secs_since_epoch": n, "nanos_since_epoch": 5}, "user": "u", "hostname": "h", "workflow_key": "k", "cmdline": [], "workdir": "/", "pid": 1, "upstreams": []}}


def ready(key, n=0):
    return {"Ready": {"time": {"secs_since_epoch": n, "nanos_since_epoch": 0}, "key": key, "runcount": n, "command": "c"}}


def lines(spark, rows):
    return spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(rows)], "seq long, value string")


def test_sessions_of_one_key(spark):
    start = {"Started": {"time": {"secs_since_epoch": 1, "nanos_since_epoch": 0}, "key": "a", "host": "h", "pid": 1}}
    end = {"Finished": {"time": {"secs_since_epoch": 1, "nanos_since_epoch": 0}, "key": "a", "status": 0}}
    log = runlog.parse_lines(lines(spark, [header(1), ready("a"), header(2), ready("a"), header(3), ready("a"), header(4), ready("a"), start, end]), strict=True)
    part = runlog.split(log).groupBy("part", "tag").count().collect()
    assert {(r.part, r.tag): r["count"] for r in part} == {("current", "Header"): 1, ("current", "Ready"): 1, ("current", "Started"): 1, ("current", "Finished"): 1, ("outdated", "Header"): 3, (None, "Ready"): 3}
    assert log.filter("tag = 'Ready'").select("Ready.r").distinct().collect()[0].r == 0


def test_unknown_lines(spark):
    rows = [header(1), ready("a"), {"Strange": {"key": "a"}}, "not json", ready("b")]
    assert runlog.parse_lines(lines(spark, rows)).count() == 3
    unversioned = {"Header": {k: v for k, v in header(1)["Header"].items() if k != "version"}}
    for bad in (rows, [unversioned], [header(1) | {}, {"Header": header(1)["Header"] | {"version": 3}}], [header(1), {"Header": header(1)["Header"] | {"workflow_key": "x"}}], [header(1), {"Finished": {"key": "a", "status": 0}}]):
        with pytest.raises(runlog.BadLog):
            runlog.parse_lines(lines(spark, bad), strict=True)


def test_log_without_header_is_current(spark):
    assert [r.part for r in runlog.split(runlog.parse_lines(lines(spark, [ready("a"), ready("b")]))).collect()] == ["current"] * 2


def test_written_log_reads_back(spark, tmp_path):
    log = runlog.parse_lines(lines(spark, [header(1), ready("a"), {"Backref": {"key": "b"}}]))
    runlog.write_log(log, f"{tmp_path}/log")
    runlog.write_log(log, f"{tmp_path}/log", mode="append")
    back = runlog.read_log(spark, f"{tmp_path}/log")
    assert back.count() == 6 and [r.tag for r in back.orderBy("seq").collect()] == ["Header", "Ready", "Backref"] * 2


@pytest.mark.parametrize("name", sorted(FOUND))
def test_queries_match_sql(spark, name):
    import duckdb

    query, sql = FOUND[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    if sql:
        con = duckdb.connect()
        for t in ("part", "orders", "lineitem", "customer", "supplier", "nation", "region", "events", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        ran = con.execute(sql)
        names = [c[0] for c in ran.description]
        want = sorted(str(tuple(dict(zip(names, r))[c] for c in columns)) for r in ran.fetchall())
        assert sorted(names) == columns and got == want


@pytest.mark.parametrize("block, ids", [(4_000_000, lambda i: i), (7, lambda i: (i - 20) << 58)])
def test_closure_sends_a_set_once_along_each_edge(spark, monkeypatch, block, ids):
    """In blocks, with sets that span batches, and with ids that fill 64 bits."""
    monkeypatch.setattr(graph, "BLOCK", block)
    read, distinct = spark.sparkContext.accumulator(0), graph._unions

    def unions(whole):
        run = distinct(whole)

        def counting(batches):
            def seen():
                for batch in batches:
                    read.add(batch.column(2).null_count)
                    yield batch

            return run(seen())

        return counting

    monkeypatch.setattr(graph, "_unions", unions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(5)
        deps = {i: [j for j in range(i) if rng.random() < 0.1 or i == 39] for i in range(40)}  # 39 needs all
        reached: dict = {}
        for i, d in deps.items():
            reached[i] = set(d).union(*(reached[j] for j in d))
        e = edges_of(spark, [(ids(j), ids(i)) for i, d in deps.items() for j in d])
        assert pairs(graph.ancestor_counts(e)) == {(ids(i), len(r)) for i, r in reached.items() if r}
        assert block == 7 or read.value == sum(map(len, deps.values()))
        got = graph.closure(e)
        assert pairs(got) == {(ids(j), ids(i)) for i, r in reached.items() for j in r} and got.count() == sum(map(len, reached.values()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_levels_broadcast_no_large_table_and_stop_at_cycles(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST", 2)  # larger fronts are shuffled, though Spark takes the files to be small
    hints = []
    followed = graph._followed
    monkeypatch.setattr(graph, "_followed", lambda front, n, edges: hints.append((n, "BroadcastHashJoin" in (j := followed(front, n, edges))._jdf.queryExecution().executedPlan().toString())) or j)
    edges = [(0, i) for i in range(1, 6)] + [(i, 6) for i in range(1, 6)] + [(6, 7), (0, 7), (7, 3000)]
    e, nodes = edges_of(spark, edges), spark.createDataFrame([(i,) for i in [*range(8), 3000, 9]], "id long")
    assert pairs(graph.t_level(e, nodes)) == {(0, 0), (9, 0), *((i, 1) for i in range(1, 6)), (6, 2), (7, 3), (3000, 4)}
    assert hints == [(2, True), (5, False), (1, True), (1, True), (1, True)]
    assert not graph.has_cycle(e) and graph.has_cycle(edges_of(spark, [*edges, (7, 6)])) and graph.has_cycle(edges_of(spark, [(3, 3)]))


@pytest.mark.parametrize("ask", [lambda e, nodes: pairs(graph.b_level(e, nodes)) == {(0, 2), (7, 0), *((i, 1) for i in range(1, 7))}, lambda e, nodes: not graph.has_cycle(e)])
def test_blevel_and_cycle_check_broadcast_no_large_front(spark, monkeypatch, ask):
    monkeypatch.setattr(graph, "BROADCAST", 2)
    hints, followed = [], graph._followed
    monkeypatch.setattr(graph, "_followed", lambda front, n, edges: hints.append((n, "BroadcastHashJoin" in (j := followed(front, n, edges))._jdf.queryExecution().executedPlan().toString())) or j)
    assert ask(edges_of(spark, [(0, i) for i in range(1, 7)] + [(i, 7) for i in range(1, 7)]), spark.range(8))
    assert hints == [(1, True), (6, False), (1, True)]


def test_levels_count_no_paths_from_unknown_nodes(spark):
    for relabel in (lambda i: i, lambda i: (i * 7) % 11):  # edges in the order of ids, and in none
        e = edges_of(spark, [(relabel(a), relabel(b)) for a, b in [(9, 10), (0, 2), (9, 2), (2, 3), (10, 3)]])
        nodes = spark.createDataFrame([(relabel(i),) for i in (0, 2, 3, 10)], "id long")
        assert pairs(graph.t_level(e, nodes)) == {(relabel(0), 0), (relabel(2), 1), (relabel(3), 2)}


def test_roundtrip_is_one_pass_and_counts_what_differs(spark, monkeypatch):
    import taskframe.fixtures as fx

    log = fx.log(spark, SF)
    bags = []
    bag = type(log).exceptAll
    monkeypatch.setattr(type(log), "exceptAll", lambda a, b: bags.append(1) or bag(a, b))
    n = log.count()
    assert runlog.roundtrip(log) == (n, 0, 0) and not bags
    rows = log.filter("tag <> 'Header'").withColumn("Finished", log.Finished.dropFields("key"))  # a record without its key is read with one that is null
    assert runlog.roundtrip(rows) == (rows.count(), 0, 0) and not bags
    empty = log.select("seq", "tag", "key", "session", *[F.when(F.col("seq") % 5 > 0, F.col(t)).alias(t) for t in ("Header", "Ready", "Started", "Finished", "Backref")])
    gone = empty.filter("seq % 5 = 0").count()
    assert gone and runlog.roundtrip(empty) == (n, gone, 0) and len(bags) == 2
    parse = runlog._parsed
    monkeypatch.setattr(runlog, "_parsed", lambda lines: parse(lines).withColumn("Backref", F.when(F.col("Backref").isNotNull(), F.struct(F.concat(F.col("Backref.key"), F.lit("x")).alias("key")))))
    refs = log.filter("tag = 'Backref'").count()
    assert refs and runlog.roundtrip(log) == (n, refs, refs)
