"""As-of and interval joins, quantile sketches and tables of patterns against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskflow.operators import auth, pattern_table, sketch, temporal

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("slice_seconds", [7, 1000, 10**7])
def test_as_of(spark, slice_seconds):
    rng = random.Random(3)
    at = lambda n: T0 + timedelta(seconds=rng.randrange(n))
    versions = [(rng.choice(["hot"] * 5 + ["a", "b"]), at(900), i, "x") for i in range(80)] + [(None, T0, 1, "x"), ("a", None, 2, "x")]
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "c", None]), None if i % 50 == 0 else at(1000), "clash") for i in range(400)]
    rows += rows[:3]
    v = spark.createDataFrame(versions, "token string, since timestamp, no int, _t string").repartition(3)
    r = spark.createDataFrame(rows, "id int, token string, ts timestamp, version string").repartition(3)
    got = temporal.as_of(r, v, "token", F.col("ts"), slice_seconds=slice_seconds)
    assert got.columns == ["id", "token", "ts", "version"]

    def holds(token, ts):
        own = [(s, n) for t, s, n, _ in versions if t is not None and t == token and s is not None and ts is not None and s <= ts]
        return max(own)[1] if own else None

    assert sorted((x.id, x.version.no if x.version else -1) for x in got.collect()) == sorted((i, n if (n := holds(t, ts)) is not None else -1) for i, t, ts, _ in rows)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert temporal.as_of(r, v.where("false"), "token", F.col("ts")).where("version is not null").count() == 0
    assert temporal.as_of(r.where("false"), v, "token", F.col("ts")).count() == 0


def test_as_of_takes_more_tasks_for_more_rows(spark, monkeypatch):
    """However few parts the versions come in, no task puts all of them in order."""
    monkeypatch.setattr(temporal, "TASK_ROWS", 500, raising=False)
    keys = spark.range(0, 2000, 1, 1).withColumnRenamed("id", "k")
    versions = keys.select("k", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("no")).withColumn("since", F.timestamp_seconds(F.col("no") * 5_000_000))
    got = temporal.as_of(keys.withColumn("ts", F.timestamp_seconds(F.lit(12_000_000) + F.col("k"))), versions, "k", F.col("ts"))
    assert got.where("version.no = 2").count() == 2000
    plan = got._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    exchanges = [(i, depth(line)) for i, line in enumerate(plan) if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" in line]
    sorts = [i for i, line in enumerate(plan) if "Aggregate(" in line or "Window" in line]
    # every aggregate and window stands above a deal by number, and none below the first of its branch
    assert len(exchanges) == 3 and all("28" in plan[i] for i, _ in exchanges)
    assert all(any(i < j and depth(plan[i]) < d for j, d in exchanges) for i in sorts) and sorts


def test_tokens_as_of_a_lag(spark):
    versions = [("t", T0, False), ("t", T0 + timedelta(minutes=10), True), ("t", T0 + timedelta(minutes=20), False)]
    v = spark.createDataFrame(versions, "token string, since timestamp, revoked boolean")
    asked = [("t", -1), ("t", 0), ("t", 1), ("t", 10), ("t", 11), ("t", 21), ("u", 5), ("", 5), (None, 5)]
    r = spark.createDataFrame([(i, k, T0 + timedelta(minutes=m)) for i, (k, m) in enumerate(asked)], "i int, token string, ts timestamp")
    got = {x.i: x.error_code for x in auth.token_status_as_of(r, v, lag_seconds=60).collect()}
    assert [got[i] for i in range(9)] == ["E_TOKEN_INVALID", "E_TOKEN_INVALID", None, None, "E_TOKEN_REVOKED", None, "E_TOKEN_INVALID", "E_MISSING_TOKEN", "E_MISSING_TOKEN"]


@pytest.mark.parametrize("width", [1, 16, 10_000])
def test_overlapping_intervals(spark, width):
    rng = random.Random(4)
    make = lambda n: [(rng.choice(["hot", "hot", "hot", "a", None]), a := rng.randrange(300), a + rng.choice([0, 1, 3, 40, 200]), i) for i in range(n)] + [("hot", None, 5, -1), ("hot", 9, 4, -2)]
    left, right = make(120), make(120)
    schema = "k string, start int, stop int, left int"
    d = temporal.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", width=width)
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] is not None and x[0] == y[0] and None not in (x[1], y[1]) and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    assert sorted((r.left.left, r.right.left) for r in d.collect()) == want and len(want) > 500


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_quantiles_stay_within_their_error(spark, error):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i % 7, rng.choice([rng.expovariate(0.01), rng.lognormvariate(3, 2), 0.0, float(rng.randrange(50))])) for i in range(5000)] + [("c", 0, -1.0), ("a", 0, None), ("a", 0, float("nan"))]
    df = spark.createDataFrame(rows, "status string, day int, ms double")
    parts = [sketch.sketched(df.where(F.col("day") % 2 == k), ["status", "day"], "ms", error) for k in (0, 1)]
    whole = sketch.merged(parts[0].union(parts[1]), ["status"])
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.status: r for r in sketch.quantiles(whole, ["status"], shares, error).collect()}
    for status in "ab":
        own = sorted(v for s, _, v in rows if s == status and v is not None and v == v)
        assert got[status].n == len(own)
        for name, q in shares.items():
            exact = own[int(q * (len(own) - 1))]
            assert abs(got[status][name] - exact) <= error * exact + 1e-9
    assert got["c"].p50 == 0 and whole.count() < 900


@pytest.mark.parametrize("most", [None, 0])
def test_tables_of_patterns(spark, monkeypatch, most):
    monkeypatch.setattr(pattern_table, "FILTER_BITS", 1 << 10)  # a full filter loses nothing
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc.*é😀") for _ in range(n))
    patterns = [(rng.choice(["t1", "t2"]), i, word(rng.randrange(1, 14))) for i in range(300)]
    patterns += [("t1", 900, ""), ("t1", 901, None), (None, 902, "a"), ("t1", 903, "secret word"), ("t1", 904, "secret word"), ("t2", 905, "x" * 500)]
    texts = [(i, rng.choice(["t1", "t2", "t3"]), word(rng.randrange(200))) for i in range(120)] + [(900, "t1", "a secret word, a secret word"), (900, "t1", "a secret word"), (901, "t2", "x" * 5000), (902, "t1", None), (903, "t1", ""), (904, None, "abc")]
    t = spark.createDataFrame(texts, "k long, team_id string, text string").withColumn("_no", F.lit(1))
    p = spark.createDataFrame(patterns, "team_id string, pattern_no int, pattern string")
    got = pattern_table.hits(t, p, "k", most=most)
    assert [f.simpleString() for f in got.schema] == ["k:bigint", "pattern_no:int"]
    want = {(k, n) for k, team, x in texts for u, n, y in patterns if team is not None and team == u and x and y and y in x}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 1000
    assert pattern_table.hits(t, p.where("false"), "k", most=most).count() == 0 and pattern_table.hits(t.where("false"), p, "k", most=most).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_keyed_patterns_send_no_texts(spark, repeated):
    """What travels to a pattern is a piece of its length; what is found is not shuffled unless keys or numbers repeat."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdé😀 ") for _ in range(n))
    texts = [(i, rng.choice(["t1", "t2"]), word(2000) + "a common line" * (i % 3)) for i in range(60)]
    patterns = [("t1", i, "a common line") for i in range(300)] + [(team, 1000 + i, x[a : a + n]) for i, (_, team, x) in enumerate(texts) for a, n in [(rng.randrange(1500), rng.choice([3, 8, 12, 17, 40, 400]))]]
    if repeated:
        texts += [(3, "t1", "one a common line"), (3, "t1", "two a common line")]
        patterns += [("t1", 7, "one")]
    t = spark.createDataFrame(texts, "k long, team_id string, text string").repartition(3)
    p = spark.createDataFrame(patterns, "team_id string, pattern_no int, pattern string").repartition(3)
    got = pattern_table.hits(t, p, "k", most=0)
    rows = [tuple(r) for r in got.collect()]
    want = {(k, n) for k, team, x in texts for u, n, y in patterns if team == u and y in x}
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 3000
    moved = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x or "Aggregate" in x]
    assert any("Join Inner" in x for x in moved) and not any("_text" in x for x in moved)
    assert repeated or not any("_key" in x for x in moved if "Aggregate" in x)


def _moved(spark) -> int:
    """Rows that all stages so far have written for shuffles."""
    jvm = spark.sparkContext._gateway.jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_patterns_that_many_texts_hold_do_not_travel(spark, request, monkeypatch):
    """Twice the texts and the patterns are four times the hits, but twice what is shuffled."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    moved = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    for n in (300, 600):
        common = [word(10 + i % 5) for i in range(n // 10)]
        texts = [(i, "t1", word(60) + "|".join(common)) for i in range(n)] + [(n + i, "t2", common[0]) for i in range(n)]
        patterns = [("t1", i, x) for i, x in enumerate(common)] + [("t1", n + i, x[:15]) for i, (_, _, x) in enumerate(texts[:n])] + [("t1", 3 * n, common[0]), ("t2", 3 * n + 1, common[0][1:])]
        t = spark.createDataFrame(texts, "k long, team_id string, text string").repartition(3)
        p = spark.createDataFrame(patterns, "team_id string, pattern_no int, pattern string").repartition(3)
        before = _moved(spark)
        got = [tuple(r) for r in pattern_table.hits(t, p, "k", most=0).collect()]
        moved.append(_moved(spark) - before)
        want = {(k, no) for k, team, x in texts for u, no, y in patterns if team == u and y in x}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > n * n / 10
    assert moved[1] < 2.5 * moved[0], moved
    monkeypatch.setattr(pattern_table, "BROADCAST_CHARS", 400)  # too little for all of them
    assert sorted(tuple(r) for r in pattern_table.hits(t, p, "k", most=0).collect()) == sorted(want)


def test_rows_of_a_pattern_of_many_numbers_take_little_room(spark, tmp_path):
    """Where many texts hold a pattern of many numbers, a row takes a small part of a byte in a file."""
    t = spark.range(90).selectExpr("id * 7 as k", "'t1' as team_id", "concat('text ', id, ' of a common line, and more') as text").coalesce(1)
    p = spark.range(30_000).selectExpr("'t1' as team_id", "id * 10 as pattern_no", "'a common line' as pattern").union(spark.range(90).selectExpr("'t1'", "id * 10 + 1", "concat('text ', id, ' of')"))
    pattern_table.hits(t, p, "k", most=0).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    rows = got.count()
    assert rows == got.distinct().count() == 90 * 30_000 + 90 and got.where("pattern_no % 10 = 1 and k * 10 <> (pattern_no - 1) * 7").isEmpty()
    assert sum(x.stat().st_size for x in tmp_path.rglob("*.parquet")) < 0.3 * rows


def test_sessions(spark):
    rows = [("a", 0), ("a", 59), ("a", 119), ("a", 180), ("b", 5), (None, 1)]
    d = spark.createDataFrame([(k, T0 + timedelta(minutes=m)) for k, m in rows], "k string, ts timestamp")
    got = sorted((r.k, int((r.start - T0).seconds / 60), int((r.stop - T0).seconds / 60), r.n) for r in temporal.sessions(d, "k", "ts").collect())
    assert got == [("a", 0, 179, 3), ("a", 180, 240, 1), ("b", 5, 65, 1)]


def test_cumulative_buckets(spark):
    from maskflow.operators import audit

    d = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 70.0), ("b", 900.0), (None, 2.0)], "status string, latency_ms double")
    got = {(r.status, r.le): r.n for r in audit.cumulative(audit.latency_histogram(d, (5, 50)), (5, 50)).collect()}
    assert got == {("a", "5.0"): 2, ("a", "50.0"): 2, ("a", "+Inf"): 3, ("b", "5.0"): 0, ("b", "50.0"): 0, ("b", "+Inf"): 1, (None, "5.0"): 1, (None, "50.0"): 1, (None, "+Inf"): 1}
