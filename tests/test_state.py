"""Sinks that survive repeated batches, allocation in a stream, quotas over runs, retention carried out."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from maskflow.operators import mask, policy, quota
from maskflow.sources import sinks
from maskflow.streaming import store


def records(spark, n):
    rows = [(f"r{i}", "ok", json.dumps({"request_id": f"r{i}"}), f"team{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "request_id string, status string, record string, team_id string")


def receiver(folder, most):
    """Takes envelopes into files, at most ``most`` of a task's, then fails once the folder says so."""

    def post(body):
        if os.path.exists(f"{folder}/down") and len(os.listdir(f"{folder}/got")) >= most:
            raise OSError("down")
        with open(f"{folder}/got/{time.time_ns()}-{os.getpid()}-{random.random()}", "w") as f:
            json.dump(body, f)
        return 200, ""

    return post


def taken(folder):
    bodies = [json.load(open(f"{folder}/got/{x}")) for x in os.listdir(f"{folder}/got")]
    return sorted(json.dumps(e, sort_keys=True) for b in bodies for e in b["batch"]), bodies


def test_a_batch_that_fails_half_way_sends_nothing_twice(spark, tmp_path):
    os.makedirs(tmp_path / "got")
    batch = records(spark, 60).repartition(3)
    sink = sinks.http_once(receiver(str(tmp_path), 9), f"{tmp_path}/ledger", size=5, parts=4)
    (tmp_path / "down").touch()
    with pytest.raises(Exception, match="transport error"):
        sink(batch, 7)
    partly, _ = taken(tmp_path)
    assert 0 < len(partly) < 120
    os.remove(tmp_path / "down")
    sink(batch.repartition(5), 7)  # the replay has the same rows in other tasks
    want = sorted(json.dumps({"trace_id": f"r{i}", "type": k}, sort_keys=True) for i in range(60) for k in ("trace-create", "generation-create"))
    events, bodies = taken(tmp_path)
    assert sorted(json.dumps({"trace_id": e["trace_id"], "type": e["type"]}, sort_keys=True) for e in map(json.loads, events)) == want
    assert all(len(b["batch"]) <= 5 for b in bodies) and any(b.get("retry") for b in bodies)
    # done batches are skipped whole, and their entries are gone
    sink(batch, 7)
    sink(batch, 3)
    assert len(taken(tmp_path)[0]) == 120 and os.listdir(tmp_path / "ledger") == ["done"]
    sink(batch.limit(1), 8)
    assert len(taken(tmp_path)[0]) == 122


def test_a_replay_with_other_rows_is_refused(spark, tmp_path):
    os.makedirs(tmp_path / "got")
    sink = sinks.http_once(receiver(str(tmp_path), 1), f"{tmp_path}/ledger", size=5, parts=1)
    (tmp_path / "down").touch()
    with pytest.raises(Exception, match="transport error"):
        sink(records(spark, 20), 1)
    os.remove(tmp_path / "down")
    with pytest.raises(Exception, match="other events"):
        sink(records(spark, 20).where("request_id <> 'r0'").union(records(spark, 25).where("request_id = 'r21'")), 1)


def test_objects_are_dealt_to_files(spark, tmp_path):
    rows = records(spark, 200).withColumns({"timestamp": F.lit("2024-01-01").cast("timestamp"), "team_id": F.lit("t")}).repartition(8)
    sinks.objects(rows, f"{tmp_path}/out", files=3)
    names = [x for x in os.listdir(f"{tmp_path}/out/team_id=t/dt=2024-01-01") if x.endswith(".gz")]
    assert 1 <= len(names) <= 3 and spark.read.text(f"{tmp_path}/out").count() == 200


def test_allocation_in_a_stream(spark, tmp_path):
    """Over micro-batches and a restart the pairs are those of the batch allocator."""
    rng = random.Random(2)
    rows, seen = [], {}
    for c in ("c1", "c2", "c3"):
        lits = [f"[NAME_{i:03d}]" for i in rng.sample(range(1, 8), 3)]
        for seq in range(40):
            rows.append((c, seq, rng.choice([f"p{i}" for i in range(15)]), rng.choice(["[NAME_001]", "[NAME_002]", "[MAIL_001]", "odd"]), lits if seq == 0 else None))
            seen[c] = lits
    schema = "conversation_id string, seq long, original string, wanted string, literals array<string>"
    leaves = spark.createDataFrame([(c, s, [(o, w)], " ".join(lits or [])) for c, s, o, w, lits in rows], f"c string, leaf long, pairs {mask.PAIRS}, text string")
    want = {(r.c, r.leaf): (r.original, r.placeholder) for r in mask.allocate(leaves, "c", "leaf").collect()}
    asks = [("c1", 100, None, want["c1", 0][1], None), ("c1", 101, None, "[NOBODY_001]", None)]
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in ([r for r in rows if r[1] < 15], [r for r in rows if r[1] >= 15] + asks):
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            n = len([r for r in rows + asks if os.path.exists(f"{tmp_path}/out") or r[1] < 15])
            s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            q = store.allocated(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
            deadline, got = time.time() + 90, []
            while len(got) < n and time.time() < deadline:
                time.sleep(1)
                try:
                    got = spark.read.schema("conversation_id string, seq long, original string, placeholder string").parquet(f"{tmp_path}/out").collect()
                except Exception:  # the sink's folder is made by the first batch
                    continue
            q.stop()
    finally:
        spark.conf.set(name, old)
    assert {(r.conversation_id, r.seq): (r.original, r.placeholder) for r in got if r.seq < 100} == want and len(got) == len(rows) + 2
    assert {r.seq: r.original for r in got if r.seq >= 100} == {100: want["c1", 0][0], 101: None}


@pytest.mark.parametrize("limit", [0, 1, 37, 1000, 10**6])
def test_quota_over_runs(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice(["hot"] * 8 + [None] * 6 + ["a", "b"]), i, rng.choice([0, 1, 2, 3, 5, 8, 30, 400, 999, None]), "x") for i in range(700)]
    rows += [("hot", 5, 7, "x"), ("hot", 5, 7, "x")]
    df = spark.createDataFrame(rows, "team string, n int, size int, _team string").repartition(4)
    used, want = {}, []
    for team, n, size, _ in sorted(rows, key=lambda r: (r[0] or "", r[1], -1 if r[2] is None else r[2])):
        ok = used.get(team, 0) + (size or 0) <= limit
        used[team] = used.get(team, 0) + (size or 0) * ok
        want.append((team or "", n, -1 if size is None else size, ok))
    for runs in (40, 10**6):
        got = quota.quota(df, "team", "n", "size", limit, run_rows=runs)
        assert got.columns == ["team", "n", "size", "_team", "admitted"]
        assert sorted((r.team or "", r.n, -1 if r.size is None else r.size, r.admitted) for r in got.collect()) == sorted(want)
    assert quota.quota(df.where("false"), "team", "n", "size", limit).count() == 0


def test_retention_is_carried_out(spark, tmp_path):
    days = ["2024-01-01", "2024-01-20", "2024-01-30"]
    rows = [(t, d, f"{t} {d} {i}") for t in ("a", "b", "zz") for d in days for i in range(3)]
    spark.createDataFrame(rows, "team_id string, dt string, value string").write.partitionBy("team_id", "dt").text(f"{tmp_path}/audit")
    teams = spark.createDataFrame([("a", 5, 0), ("b", 10, 1)], "team_id string, retention_hot_days int, retention_cold_years int")
    found = policy.partitions(spark, f"{tmp_path}/audit")
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "length" in scan and "content" not in scan  # names and sizes only
    plan = policy.retention_plan(found, teams, "2024-02-01")
    got = {(r.team_id, str(r.dt)): r.action for r in plan.collect()}
    assert got == {("a", days[0]): "expire", ("a", days[1]): "expire", ("a", days[2]): "keep", ("b", days[0]): "archive", ("b", days[1]): "archive", ("b", days[2]): "keep", **{("zz", d): "keep" for d in days}}
    assert policy.carried_out(spark, plan, f"{tmp_path}/audit", f"{tmp_path}/cold") == {"expire": 2, "archive": 2}
    left = {(r.team_id, str(r.dt)) for r in policy.partitions(spark, f"{tmp_path}/audit").collect()}
    assert left == {k for k, v in got.items() if v == "keep"} and spark.read.text(f"{tmp_path}/cold").count() == 6
    again = spark.createDataFrame([(*k, v) for k, v in got.items()], "team_id string, dt string, action string")
    assert policy.carried_out(spark, again, f"{tmp_path}/audit", f"{tmp_path}/cold") == {"expire": 0, "archive": 0}
