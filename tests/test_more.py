"""Profiles on disk, oversize texts, the mapping store and the entry without its optional part."""

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from maskflow.operators import audit, gazetteer, mask, ner
from maskflow.operators.policy import PolicyError, seal
from maskflow.sources import cached, files, profiles, sinks
from maskflow.streaming import store


def test_profiles(tmp_path):
    for name, toml, rule, term in (("core", 'name = "core"\ndetectors = ["regex_checksum"]', "- a = [A_001]", "Vega"), ("div", 'name = "div"\nextends = ["core"]\ndetectors = ["gazetteer", "regex_checksum"]\n[policy]\ndlp_guard = true', "- b = [B_001]", "Orion")):
        d = tmp_path / name
        d.mkdir()
        (d / "profile.toml").write_text(toml)
        (d / "replace.md").write_text("# rules\n" + rule)
        (d / "products.txt").write_text(term + "\n")
    (tmp_path / "div" / "markings.txt").write_text("Vega\n")
    (tmp_path / "div" / "allowlist.txt").write_text("# c\nok@x.org\n")
    b = profiles.load(str(tmp_path), ["div"])
    assert (b.layers, b.detectors, b.rules) == (["core", "div"], ["regex_checksum", "gazetteer"], [("a", "[A_001]"), ("b", "[B_001]")])
    assert b.terms == {"Vega": "CONFIDENTIAL_MARK", "Orion": "PRODUCT"} and b.allow == {"ok@x.org"} and b.policies[1] == {"dlp_guard": True}
    assert profiles.load(str(tmp_path), ["div"]).fingerprint() == b.fingerprint() != profiles.load(str(tmp_path), ["core"]).fingerprint()
    assert profiles.lint(str(tmp_path), "div") == [] and profiles.lint(str(tmp_path), "none")
    files = {p.name: p.read_bytes() for p in (tmp_path / "core").iterdir() if p.name != "profile.toml"}
    (tmp_path / "core" / "profile.toml").write_text(f'name = "core"\ncontent_hash = "{seal(files)}"')
    profiles.load(str(tmp_path), ["core"])
    (tmp_path / "core" / "replace.md").write_text("- z = [Z_001]")
    with pytest.raises(PolicyError):
        profiles.load(str(tmp_path), ["core"])


def test_oversize_and_clamp(spark):
    df = spark.createDataFrame([("x" * 102_400,), ("x" * 102_401,), ("é" * 51_201,), (None,)], "t string")
    assert [r.block_reason for r in mask.oversize(df, "t").collect()] == [None, "oversize:blocked", "oversize:blocked", None]
    assert [r.block_reason for r in mask.oversize(df, "t", deliver=F.lit(True), clean=F.lit(True)).collect()][1] == "oversize:delivered"
    assert [r.c for r in spark.createDataFrame([(5,), (50,), (None,)], "n int").select(mask.clamped(F.col("n"), 10).alias("c")).collect()] == [5, 10, None]


def test_requests_rules_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"request_id":"q","messages":[]}\n\nno json\n')
    got = files.requests(spark, f"{tmp_path}/in").collect()
    assert {r.body for r in got} == {'{"request_id":"q","messages":[]}', "no json"} and "q" in {r.request_id for r in got}
    (tmp_path / "t1.md").write_text("- a = [A_001]\nbad line\n- b = [B_001]")
    loaded = files.rules(spark, str(tmp_path))
    rows = {r.team_id: [tuple(x) for x in r.rules] for r in files.rules_of(spark.createDataFrame([("t1",), ("t2",)], "team_id string"), loaded).collect()}
    assert rows == {"t1": [("a", "[A_001]"), ("b", "[B_001]")], "t2": []}
    records = spark.createDataFrame([(f"r{i}", "t", "openai", 1, 2, '{"x":1}' if i else '{"pairs":[]}') for i in range(5)], "request_id string, team_id string, provider string, prompt_token_count long, completion_token_count long, record string").coalesce(1)

    def post(envelope):
        import json
        import uuid

        with open(f"{tmp_path}/posted-{uuid.uuid4().hex}", "w") as f:
            json.dump(envelope, f)
        return 207, ""

    sinks.sink("http")(post, size=3)(records)
    import json

    posted = [json.loads(p.read_text())["batch"] for p in tmp_path.glob("posted-*")]
    assert sorted(map(len, posted)) == [2, 3, 3] and {e["trace_id"] for b in posted for e in b} == {"r1", "r2", "r3", "r4"}
    with pytest.raises(Exception, match="ingestion 500"):
        sinks.http(lambda e: (500, "no"))(records)


def test_refreshed():
    now, loads = [0.0], []
    c = cached.Refreshed(lambda k: loads.append(k) or len(loads), 300, lambda: now[0])
    assert [c.get("a"), c.get("a"), c.get("b")] == [1, 1, 2]
    now[0] = 299.9
    assert c.get("a") == 1
    now[0] = 300.0
    assert c.get("a") == 3 and loads == ["a", "b", "a"]
    c.drop("a")
    assert c.get("a") == 4
    bad = cached.Refreshed(lambda k: 1 / 0)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            bad.get("x")


def test_fan_out_to_gated_sinks(spark, tmp_path):
    """Every sink of a batch is gated on its own."""
    store: list = []
    records = spark.createDataFrame([("r1", '{"x":1}'), ("r2", '{"a":{"pairs":[]}}')], "request_id string, record string")
    sinks.fan_out(sinks.sink("memory")(store), lambda b: sinks.lines(b, f"{tmp_path}/second"))(records, 3)
    assert store == ['{"x":1}'] and [r.value for r in spark.read.text(f"{tmp_path}/second").collect()] == store


def test_time_to_live_of_results(spark):
    rows = [(i, "a", t) for i, t in enumerate([0, 5, 9, 10, 19, 20, 100])] + [(9, "b", 3)]
    df = spark.createDataFrame(rows, "k int, h string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = mask.dedup_by_hash(df, "h", lambda x: x.select("h", F.lit(1).alias("one")), ["ts", "k"], ttl_seconds=10)
    assert {r.k: r.cache_a_hit for r in out.collect()} == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 9: False}
    out = mask.dedup_by_hash(df, "h", lambda x: x.select("h", F.lit(1).alias("one")), ["ts", "k"])
    assert {r.k for r in out.collect() if not r.cache_a_hit} == {0, 9}
    # rows without a hash stay, and share nothing
    df = df.union(spark.createDataFrame([(20, None, 1), (21, None, 2), (22, None, 3)], "k int, h string, s long").withColumn("ts", F.timestamp_seconds("s")))
    for ttl in (None, 10):
        out = mask.dedup_by_hash(df, "h", lambda x: x.select("h", F.lit(1).alias("one")), ["ts", "k"], ttl_seconds=ttl).collect()
        assert len(out) == df.count() and [(r.cache_a_hit, r.one) for r in out if r.k >= 20] == [(False, None)] * 3


def test_long_terms_and_lemmas(spark):
    term = "one two three four five six seven eight"
    table = gazetteer.term_table(spark.createDataFrame([(1, term, "LONG"), (2, "cats", "PLURAL")], "term_no int, term string, label string"), lemma=lambda w: F.regexp_replace(F.lower(w), "s$", ""))
    d = spark.createDataFrame([(1, f"x {term.upper()}! Cat myCats"), (1, f"x {term.upper()}! Cat myCats"), (2, None)], "k int, text string")
    got = sorted(tuple(r) for r in gazetteer.hits(d, "k", table, lemma=lambda w: F.regexp_replace(F.lower(w), "s$", "")).collect())
    one = [(1, "LONG", 2, 2 + len(term), "term"), (1, "PLURAL", 4 + len(term), 7 + len(term), "term"), (1, "PLURAL", 10 + len(term), 14 + len(term), "identifier")]
    assert got == sorted(2 * one)


@pytest.mark.parametrize("most", [0, 50_000])
def test_many_terms_are_joined_by_a_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(gazetteer, "BROADCAST_TERMS", most)
    table = gazetteer.term_table(spark.createDataFrame([(1, "big red box", "A"), (2, "red", "B")], "term_no int, term string, label string"))
    d = spark.createDataFrame([(1, "a Big, red  box"), (2, "RED red-ish"), (3, "")], "k int, text string")
    assert sorted(tuple(r) for r in gazetteer.hits(d, "k", table).collect()) == [(1, "A", 2, 15, "term"), (1, "B", 7, 10, "term"), (2, "B", 0, 3, "term"), (2, "B", 4, 7, "term")]


def test_models_that_are_missing(spark):
    d = spark.createDataFrame([(1, "Ann in Rome"), (2, "  "), (3, None)], "k int, text string")

    def model():
        return lambda texts: [[("PER", 0, 3), ("LOC", 7, 11), ("DATE", 0, 1)] for _ in texts]

    def missing():
        raise RuntimeError("none")

    d = ner.entities(ner.entities(d, model, ner.RUSSIAN, out="a"), missing, ner.ENGLISH, out="b")
    rows = {r.k: r for r in d.select("k", ner.united(F.col("a"), F.col("b")).alias("u"), ner.united(F.col("a"), F.col("b"), required=True).alias("r")).collect()}
    assert [(f.label, f.start, f.stop, f.text, f.score) for f in rows[1].u] == [("PERSON", 0, 3, "Ann", 0.8), ("LOCATION", 7, 11, "Rome", 0.8)]
    assert rows[1].r is None and rows[2].u == [] and rows[2].r == [] and rows[3].u == []


def test_mapping_store(spark, tmp_path):
    rows = [("c1", 1, "alice", "[N_001]"), ("c1", 2, "alice", None), ("c2", 1, "alice", None)]
    spark.createDataFrame(rows, "conversation_id string, seq long, original string, placeholder string").coalesce(1).write.parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = spark.readStream.schema("conversation_id string, seq long, original string, placeholder string").parquet(f"{tmp_path}/in")
        # state with a time to live keeps the query going, so it is stopped once all rows are through
        q = store.stored(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
        deadline = time.time() + 60
        while time.time() < deadline and not (q.lastProgress and q.lastProgress["numInputRows"] == 0 and q.lastProgress["batchId"] > 0):
            time.sleep(0.5)
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert {(r.conversation_id, r.placeholder) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("c1", "[N_001]"), ("c2", None)}


def test_entry_without_the_optional_part(tmp_path):
    """The engine stands without the training-data subpackage and the pipeline."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/maskflow", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/maskflow/llm"], check=True)
    code = "import __spark_entry__ as e\nassert 'mask_documents' in e.queries() and 'pipeline' not in e.queries() and not any(k[:2] == 'op' and k[2].isdigit() for k in e.queries())"
    alone = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=alone, check=True)
    # a library that only the optional part needs is missing
    subprocess.run(["mkdir", f"{tmp_path}/maskflow/llm"], check=True)
    (tmp_path / "maskflow" / "llm" / "__init__.py").write_text("")
    (tmp_path / "maskflow" / "llm" / "catalog.py").write_text("import a_library_that_nobody_has")
    for env in (alone, {**alone, "PYTHONPATH": root}):  # with the whole engine elsewhere on the path, too
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    (tmp_path / "maskflow" / "llm" / "catalog.py").write_text("import maskflow.nothing")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=alone, capture_output=True).returncode


def test_forbidden_keys_at_any_depth(spark):
    rows = {
        '{"a":[{"b":{"Set-Cookie":1}}]}': True, '{"p\\u0061irs":1}': True, '{"a":"\\"pairs\\": 1"}': False, '{"a":"x\\\\","pairs":2}': True, '{"a":"x\\\\\\",\\"pairs\\":2"}': False, '{"pa\\"irs":1, "b":"pairs"}': False,
        '{"a":1,"a":2,"mapping":3}': True, '{"corp_token" : null}': True, '["pairs", ":"]': False, "no json": False, '{"a":"' + '\\"' * 20_000 + '","cookie":1}': True, '{"a":"' + "x" * 50_000 + '"}': False,
    }
    df = spark.createDataFrame([*[(k, r, w) for k, (r, w) in enumerate(rows.items())], (99, None, False)], "k int, record string, want boolean")
    out = df.withColumn("got", audit.never_field(F.col("record")))
    assert "Python" not in out._jdf.queryExecution().toString() and [r.k for r in out.collect() if r.got != r.want] == []
