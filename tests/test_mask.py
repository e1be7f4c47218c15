"""Masking, allocation, policies, audit, payloads and streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from maskflow.operators import audit, auth, detect, leaves, mask, oracle, policy, quota, rules
from maskflow.sources import files, sinks
from maskflow.streaming import reverse


def test_mask_and_back(spark):
    t = "10.0.0.1 a@b.org 10.0.0.1, 10.0.0.23 and x.a@b.org"
    r = mask.mask(detect.detect(spark.createDataFrame([(t,)], "text string"))).withColumn("back", mask.reversed_(F.col("masked"), F.col("pairs"))).first()
    assert r.back == t and r.masked == "[IP_ADDRESS_002] [EMAIL_002] [IP_ADDRESS_002], [IP_ADDRESS_001] and [EMAIL_001]"


def test_rules_number_on_and_allow_lists(spark):
    df = detect.detect(spark.createDataFrame([("Orion at 10.0.0.1 with pwd=abcd1234",)], "text string"))
    r = mask.mask(df, rules=[("Orion", "[IP_ADDRESS_007]"), ("gone", "[X_001]")], allow=["10.0.0.1", "abcd1234"]).first()
    assert [tuple(p) for p in r.pairs] == [("Orion", "[IP_ADDRESS_007]"), ("abcd1234", "[PASSWORD_001]")]
    r = mask.mask(df, rules=[("Orion", "[IP_ADDRESS_007]")]).first()
    assert ("10.0.0.1", "[IP_ADDRESS_008]") in [tuple(p) for p in r.pairs]


def test_allocator_is_one_to_one(spark):
    rows = [(1, 0, "typed [T_001]", [("a", "[T_001]"), ("b", "[T_001]")]), (1, 1, "x", [("a", "[T_009]"), ("c", "[NOTE]"), ("d", "[NOTE]")]), (2, 0, None, [("a", "[T_001]")])]
    df = spark.createDataFrame(rows, "r int, l int, text string, pairs array<struct<original:string,placeholder:string>>")
    got = {(r.r, r.l, r.original): r.placeholder for r in mask.allocate(df, "r", "l").collect()}
    assert got == {(1, 0, "a"): "[T_002]", (1, 0, "b"): "[T_003]", (1, 1, "a"): "[T_002]", (1, 1, "c"): "[NOTE]", (1, 1, "d"): "[REDACTED_001]", (2, 0, "a"): "[T_001]"}


def test_chunks_cover(spark):
    for n in (0, 5, 10, 11, 17, 24, 25):
        t = "".join(chr(97 + i % 26) for i in range(n))
        c = spark.createDataFrame([(t,)], "t string").select(mask.chunks(F.col("t"), 10, 3).alias("c")).first().c
        want, start = [], 0
        while True:
            want.append(t[start : start + 10])
            if start + 10 >= n:
                break
            start += 7
        assert c == want


def test_quota_refusals_use_nothing(spark):
    df = spark.createDataFrame([("a", 1, 60), ("a", 2, 50), ("a", 3, 40), ("b", 1, 101)], "team string, n int, size int")
    got = {(r.team, r.n): r.admitted for r in quota.quota(df, "team", "n", "size", 100).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 1): False}


def test_policies():
    tree = {"x": ["ru", "core"], "ru": ["core"], "core": [], "a": ["b"], "b": ["a"]}
    assert policy.expand_layers(["x"], tree.get) == ["core", "ru", "x"]
    with pytest.raises(policy.PolicyError):
        policy.expand_layers(["a"], tree.get)
    chain = {f"p{i}": [f"p{i + 1}"] for i in range(10)} | {"p10": []}
    with pytest.raises(policy.PolicyError):
        policy.expand_layers(["p0"], chain.get)
    assert policy.expand_layers(["p2"], chain.get)[0] == "p10"
    assert policy.seal({"a": b"1", "b": b"2"}) == policy.seal({"b": b"2", "a": b"1"}) != policy.seal({"a": b"2", "b": b"1"})


def test_rule_lines(spark):
    lines = ["- `a b` = c", "* x = y", "# head", "", "- p → q r ", "- p -> q", "<!-- c -->", "- x = "]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines)], "team_id string, line_no int, line string")
    got = {r.line_no: (r.pattern, r.replacement, r.error) for r in rules.parse_rules(df).collect()}
    assert got == {0: ("a b", "c", None), 1: (None, None, "not a rule"), 4: ("p", "q r", None), 5: (None, None, "ascii arrow"), 7: (None, None, "not a rule")}


def test_tokens(spark):
    tokens = spark.createDataFrame([("t1", "u", "x", "2030-01-01", None), ("t2", "u", "x", "2000-01-01", "1999-01-01"), ("t3", "v", "x", "2000-01-01", None)], "token string, user_id string, team_id string, e string, r string").selectExpr("token", "user_id", "team_id", "cast(e as timestamp) expires_at", "cast(r as timestamp) revoked_at")
    reqs = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",), (None,)], "token string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert {r.token: r.error_code for r in auth.token_status(reqs, tokens).collect()} == {"t1": None, "t2": "E_TOKEN_REVOKED", "t3": "E_TOKEN_EXPIRED", "t4": "E_TOKEN_INVALID", None: "E_MISSING_TOKEN"}
    assert auth.revoked(tokens, "u", "2024-01-01").where("revoked_at is not null").count() == 2
    changes = tokens.where("token = 't1'").withColumn("team_id", F.lit("new")).withColumn("_no", F.lit(1)).union(tokens.where("token = 't1'").withColumn("_no", F.lit(0)))
    assert {r.token: r.team_id for r in auth.upserted(tokens, changes, "token").collect()} == {"t1": "new", "t2": "x", "t3": "x"}


def test_oracle_answers():
    ok = [{"original": "a", "placeholder": "b"}]
    call = json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"arguments": json.dumps({"pairs": [{"original": "a", "replacement": "b"}]})}}]}}]})
    assert oracle.answer_pairs(call) == ok
    assert oracle.answer_pairs('x {"pairs": [{"original": "a", "replacement": "b"}], "n": "}"} y') == ok
    assert oracle.answer_pairs("- `a` → `b`\nrest") == ok
    assert oracle.answer_pairs("nothing") is None and oracle.answer_pairs(None) is None
    assert oracle.first_object('a {"x": "{\\"}"} b') == '{"x": "{\\"}"}'


BODY = {
    "model": "m", "system": [{"type": "text", "text": "s1"}], "messages": [
        {"role": "user", "content": "u1"}, {"role": "user", "content": None}, {"role": "user", "content": ""},
        {"role": "assistant", "content": [{"type": "text", "text": "t1"}, {"type": "thinking", "thinking": "no"}, {"type": "tool_use", "input": {"k": ["i1", 2, {"z": "i2"}]}}, {"type": "tool_result", "content": [{"type": "text", "text": "r1"}]}, "bare"],
         "tool_calls": [{"function": {"arguments": "{\"q\": \"a1\", \"n\": 1}"}}, {"function": {"arguments": "not json"}}]},
        {"role": "user", "content": {"type": "document", "title": "d1", "context": "d2", "source": {"type": "text", "data": "d3"}}},
    ],
}


def test_leaves(spark):
    deep = {"messages": [{"content": [{"type": "tool_use", "input": None}]}]}
    ok, bad = "x", "x"
    for _ in range(64):
        ok = [ok]
    for _ in range(65):
        bad = [bad]
    rows = [("a", json.dumps(BODY)), ("b", "no json"), ("c", None)]
    for name, v in (("ok", ok), ("bad", bad)):
        deep["messages"][0]["content"][0]["input"] = v
        rows.append((name, json.dumps(deep)))
    got = leaves.request_leaves(spark.createDataFrame(rows, "request_id string, body string")).collect()
    assert [r.text for r in got if r.request_id == "a"] == ["u1", "t1", "i1", "i2", "r1", "a1", "not json", "d1", "d2", "d3", "s1"]
    assert [(r.request_id, r.error) for r in got if r.error] == [("b", "E_BAD_REQUEST"), ("bad", "E_BAD_REQUEST")]
    df = spark.createDataFrame([(json.dumps(BODY), [("1", "[N_001]")])], "body string, pairs array<struct<original:string,placeholder:string>>")
    masked = leaves.mask_messages(df)
    assert "u[N_001]" in masked.first().masked_body and json.loads(leaves.unmask_messages(masked, "masked_body").first().unmasked_body) == BODY


def test_bad_payloads_end_no_job(spark):
    deep = "[" * 70 + '"1"' + "]" * 70
    call = lambda x: '{"messages":[{"role":"user","tool_calls":[{"function":{"arguments":%s}}]}]}' % x
    rows = [("a", "no json"), ("b", "[1]"), ("c", '{"messages":5}'), ("d", '{"messages":[{"content":[{"type":"tool_use","input":%s}]}]}' % deep), ("e", call("7")), ("f", call("null")), ("g", call('"{}"')), ("h", None), ("i", "[" * 5000), ("j", "{}")]
    df = spark.createDataFrame([(k, t, [("1", "[N_001]")], "x") for k, t in rows], "k string, body string, pairs array<struct<original:string,placeholder:string>>, MASKED_BODY string")
    got = {r.k: r for r in leaves.mask_messages(df).collect()}
    assert {k for k, r in got.items() if r.masked_body_error == "E_BAD_REQUEST"} == {"a", "b", "c", "d", "e", "i"} and all(r.masked_body is None for r in got.values() if r.masked_body_error)
    assert got["h"].masked_body is None and got["h"].masked_body_error is None and got["j"].masked_body == "{}" and json.loads(got["f"].masked_body) == json.loads(call("null"))
    back = {r.k: r.unmasked_body for r in leaves.unmask_messages(df.withColumn("body", F.replace("body", F.lit("1"), F.lit("[N_001]")))).collect()}
    assert back["a"] == "no json" and json.loads(back["d"])["messages"][0]["content"][0]["input"] is not None and back["h"] is None


def test_responses(spark):
    pairs = [("alice", "[NAME_001]"), ('b"ob', "[NAME_002]")]
    call = {"function": {"name": "f", "arguments": json.dumps({"to": "[NAME_002]"})}}
    rows = [
        {"choices": [{"message": {"content": "Hi [NAME_001]", "tool_calls": [call]}}, {"message": {"content": [{"type": "text", "text": "[NAME_002]"}, {"type": "image", "data": "[NAME_001]"}]}}, 5]},
        {"content": [{"type": "text", "text": "[NAME_001]"}], "usage": {"note": "[NAME_001]"}},
        {"choices": [{"message": {"content": None, "function_call": {"arguments": "not json [NAME_001]"}}}]},
        {"content": "[NAME_001]", "id": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(x), pairs) for i, x in enumerate(rows)] + [(9, "plain [NAME_001]", pairs), (10, None, pairs), (11, "3", None)], "k int, response string, pairs array<struct<original:string,placeholder:string>>")
    got = {r.k: r.unmasked_response for r in leaves.unmask_responses(df).collect()}
    first = json.loads(got[0])["choices"]
    assert first[0]["message"]["content"] == "Hi alice" and json.loads(first[0]["message"]["tool_calls"][0]["function"]["arguments"]) == {"to": 'b"ob'}
    assert first[1]["message"]["content"] == [{"type": "text", "text": 'b"ob'}, {"type": "image", "data": "[NAME_001]"}] and first[2] == 5
    assert json.loads(got[1]) == {"content": [{"type": "text", "text": "alice"}], "usage": {"note": "[NAME_001]"}}
    assert json.loads(got[2])["choices"][0]["message"]["function_call"]["arguments"] == "not json alice"
    assert json.loads(got[3]) == {"content": "alice", "id": 1} and got[9] == "plain alice" and got[10] is None and got[11] == "3"


def _text_of(chunks):
    out = {"text": "", "call": "", "function": ""}
    for c in chunks:
        delta = c["choices"][0]["delta"] if "choices" in c else c["delta"]
        out["text"] += delta.get("content") or delta.get("text") or ""
        for t in delta.get("tool_calls", []):
            out["call"] += t["function"].get("arguments", "")
        out["function"] += delta.get("function_call", {}).get("arguments", "")
    return out


def test_object_chunks(spark):
    text, args = "Hi [NAME_001]!", '{"to":"[NAME_001]"}'
    chunks = [{"choices": [{"delta": {"content": text[i : i + 3]}}]} for i in range(0, len(text), 3)]
    chunks += [{"choices": [{"delta": {"tool_calls": [{"index": "1", "function": {"arguments": args[i : i + 4]}}, {"index": [], "function": {"arguments": "kept"}}][: 1 + (i == 0)]}}]} for i in range(0, len(args), 4)]
    chunks += [{"choices": [{"delta": {"function_call": {"arguments": args[i : i + 5]}}}]} for i in range(0, len(args), 5)] + [{"other": 1}, {"choices": []}, {"choices": [{"delta": {"content": ""}, "finish_reason": "stop"}]}]
    r = reverse.ObjectReverser([('a"l', "[NAME_001]")])
    sent = [x for c in chunks if (x := r.feed(c)) is not None] + r.flush()
    got = _text_of([c for c in sent if c.get("choices")])
    assert got["text"] == 'Hi a"l!' and got["call"].replace("kept", "") == '{"to":"a\\"l"}' and got["function"] == '{"to":"a\\"l"}'
    assert {"other": 1} in sent and {"choices": []} in sent and any(c.get("choices") and c["choices"][0].get("finish_reason") for c in sent)
    r = reverse.ObjectReverser([("alice", "[NAME_001]")])
    assert [r.feed({"delta": {"text": "[NAME_"}}), r.feed({"delta": {"text": "001] x"}})][0] is None and r.flush()
    df = spark.createDataFrame([("s", i, json.dumps(c), [("alice", "[NAME_001]")]) for i, c in enumerate(chunks)] + [("s", 99, "no json", None), ("t", 0, None, None)], "stream_id string, seq long, payload string, pairs array<struct<original:string,placeholder:string>>")
    rows = sorted((r for r in reverse.unmask_objects(df).collect() if r.stream_id == "s"), key=lambda r: r.seq)
    assert _text_of([x for x in (json.loads(r.payload) for r in rows if r.payload != "no json") if x.get("choices")])["text"] == "Hi alice!"


def test_audit(spark):
    assert [r.v for r in spark.createDataFrame([('{"a":[{"Set-Cookie":1}]}',), ('{"a":"pairs"}',), ("{",), (None,), ('{"pairs":1}',)], "r string").select(audit.never_field(F.col("r")).alias("v")).collect()] == [True, False, False, False, True]
    p = spark.createDataFrame([("r1", "a", "[EMAIL_001]"), ("r1", "a", "[EMAIL_001]"), ("r1", "b", "[NOTE]"), ("r1", "c", "[A_B_002]")], "request_id string, original string, placeholder string")
    r = audit.redactions(p).first()
    assert (r.redaction_count, r.finding_label_counts, r.placeholder_list) == (3, {"EMAIL": 1, "UNKNOWN": 1, "A_B": 1}, ["[A_B_002]", "[EMAIL_001]", "[NOTE]"])
    one = lambda *up: audit.health(spark.createDataFrame([(u,) for u in up], "healthy boolean")).first().status
    assert [one(), one(True), one(False, False), one(True, False)] == ["ok", "ok", "unhealthy", "degraded"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "team-a.md").write_text("# rules\n- Orion = [P_001]\n")
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "products.txt").write_text("# c\nVega\n")
    (tmp_path / "g" / "other.txt").write_text("no\n")
    assert [(r.team_id, r.pattern) for r in files.rules(spark, f"{tmp_path}/r").collect()] == [("team-a", "Orion")]
    assert [(r.term, r.label) for r in files.terms(spark, f"{tmp_path}/g").collect()] == [("Vega", "PRODUCT")]
    assert {r.original for r in files.allow_list(spark, " a, b,").collect()} == {"a", "b"}
    rec = spark.createDataFrame([("t", '{"request_id":"1"}'), ("t", '{"pairs":[]}')], "team_id string, record string").withColumn("timestamp", F.lit("2024-01-02").cast("timestamp"))
    sinks.fan_out(lambda b: sinks.sink("objects")(b, f"{tmp_path}/o"), lambda b: sinks.sink("lines")(b, f"{tmp_path}/l"))(rec, 1)
    assert [r.value for r in spark.read.text(f"{tmp_path}/l").collect()] == ['{"request_id":"1"}']
    assert [(r.team_id, str(r.dt)) for r in spark.read.text(f"{tmp_path}/o").collect()] == [("t", "2024-01-02")]
    with pytest.raises(ValueError):
        sinks.sink("nowhere")


PAIRS = [("alice", "[NAME_001]"), ("bob@x.org", "[EMAIL_001]"), ("b", "[NAME_0012]")]


def test_reverser_equals_batch_for_every_split():
    text = "Hi [NAME_001], [NAME_0012] [EMAIL_001][NAME_001] [NAME"
    want = text
    for o, p in sorted(PAIRS, key=lambda x: -len(x[1])):
        want = want.replace(p, o)
    for cut in range(len(text)):
        r = reverse.Reverser(PAIRS)
        assert r.feed(text[:cut]) + r.feed(text[cut:]) + r.flush() == want
    r = reverse.Reverser(PAIRS)
    assert "".join(map(r.feed, text)) + r.flush() == want
    with pytest.raises(RuntimeError):
        r.feed("x")


def _events(kind):
    d = lambda x: b"data: " + json.dumps(x).encode() + b"\n\n"
    parts = ["Hi [NA", "ME_0", "01]!"]
    if kind == "blocks":
        out = [b": ping\n\n", d({"type": "content_block_start", "index": 0})]
        out += [b"event: content_block_delta\n" + d({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": p}}) for p in parts]
        return b"".join([*out, d({"type": "content_block_stop", "index": 0}), d({"type": "message_stop"})])
    return b"".join([*[d({"choices": [{"index": 0, "delta": {"content": p}}]}) for p in parts], d({"choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]}), b"data: [DONE]\n\n"])


@pytest.mark.parametrize("kind", ["blocks", "deltas"])
def test_events_at_every_byte(kind):
    def text(data):
        out = ""
        for e in data.replace(b"\r\n", b"\n").split(b"\n\n"):
            for line in e.split(b"\n"):
                if line.startswith(b"data:") and line[5:].strip() != b"[DONE]":
                    x = json.loads(line[5:])
                    out += x.get("delta", {}).get("text", "") if "type" in x else (x["choices"][0]["delta"].get("content") or "")
        return out

    data = _events(kind)
    for cut in range(0, len(data), 7):
        r = reverse.EventReverser(PAIRS)
        assert text(r.feed(data[:cut]) + r.feed(data[cut:]) + r.flush()) == "Hi alice!"
    r = reverse.EventReverser(PAIRS)
    two = data.find(b"\n\n", data.find(b"ME_0")) + 2
    assert text(r.feed(data[:two]) + r.flush()) == "Hi [NAME_0"


def test_unmask_stream(spark, tmp_path):
    text = "Hi [NAME_001] and [EMAIL_001]!"
    chunks = [("s1", i, text[i * 4 : i * 4 + 4], i * 4 + 4 >= len(text)) for i in range(-(-len(text) // 4))] + [("s2", 0, "plain [NAME_001]", True)]
    random.Random(1).shuffle(chunks)
    for k in range(2):
        spark.createDataFrame(chunks[k::2], "stream_id string, seq long, payload string, is_end boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.1)
    maps = spark.createDataFrame([("s1", json.dumps(PAIRS))], "stream_id string, pairs string")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("stream_id string, seq long, payload string, is_end boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = reverse.unmask_stream(stream, maps).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    rows = sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r.stream_id, r.seq))
    assert "".join(r.text for r in rows if r.stream_id == "s1") == "Hi alice and bob@x.org!"
    assert "".join(r.text for r in rows if r.stream_id == "s2") == "plain [NAME_001]"


def test_cut_off_streams_end(spark, tmp_path):
    """A stream without an end gives what was held back once it was idle, chunks after a gap included."""
    chunks = [("s1", 0, "Hi [NAME_001] [NAM", False), ("s2", 0, "a [NA", False), ("s2", 2, "tail", False), ("s3", 0, "[NAME_001]", True)]
    spark.createDataFrame(chunks, "stream_id string, seq long, payload string, is_end boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    maps = spark.createDataFrame([(k, json.dumps(PAIRS)) for k in ("s1", "s2", "s3")], "stream_id string, pairs string")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("stream_id string, seq long, payload string, is_end boolean").parquet(f"{tmp_path}/in")
        q = reverse.unmask_stream(stream, maps, idle_ms=500).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
        want, deadline = {"s1": "Hi alice [NAM", "s2": "a [NAtail", "s3": "alice"}, time.time() + 90
        while time.time() < deadline:
            time.sleep(1)
            got = {}
            if q.lastProgress:
                try:
                    for r in sorted(spark.read.schema("stream_id string, seq long, text string").parquet(f"{tmp_path}/out").collect(), key=lambda r: r.seq):
                        got[r.stream_id] = got.get(r.stream_id, "") + r.text
                except Exception:  # the sink's folder is made by the first batch
                    continue
            if got == want:
                break
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert got == want
