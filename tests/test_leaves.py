"""The native walk of payloads gives the leaves that the rewriting walk puts."""

import json
import random

from pyspark.sql import functions as F

from maskflow.operators import leaves


def walked(body):
    """[(path, text)] of the rewriting walk, or None where it refuses."""
    found = []
    try:
        leaves.rewrite(leaves._parsed(body), lambda p, t: found.append((p, t)) or t)
    except leaves.BadPayload:
        return None
    return found


def check(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "k long, body string").withColumn("path", F.lit("clash")).repartition(4)
    out = leaves.request_leaves(df, "k")
    assert "Arrow" not in out._jdf.queryExecution().toString() and "Python" not in out._jdf.queryExecution().toString()
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.k, r.leaf_no or 0)):
        got.setdefault(r.k, []).append((r.path, r.text) if r.error is None else None)
    for k, body in enumerate(bodies):
        want = walked(body or "{}")
        assert got.get(k, []) == ([None] if want is None else want), body


def nested(rng, depth, strings):
    x = rng.random()
    if depth > 4 or x < 0.35:
        return rng.choice([*strings, 1, 0, -1.5, True, False, None, "", 12345678901234567890])
    if x < 0.65:
        return [nested(rng, depth + 1, strings) for _ in range(rng.randrange(4))]
    return {rng.choice("zyxabc.[é") + str(i): nested(rng, depth + 1, strings) for i in range(rng.randrange(4))}


def block(rng, depth, strings):
    kind = rng.choice(["text", "tool_result", "tool_use", "document", "image", 7, None])
    out = {"type": kind}
    for name in rng.sample(["text", "content", "input", "title", "context", "source", "other"], rng.randrange(1, 7)):
        if name == "source":
            out[name] = rng.choice([{"type": "text", "data": rng.choice(strings)}, {"type": "content", "content": content(rng, depth + 1, strings)}, {"type": "base64", "data": "zz"}, "s", {"data": "none"}])
        elif name == "content":
            out[name] = content(rng, depth + 1, strings)
        elif name == "input":
            out[name] = nested(rng, 0, strings)
        else:
            out[name] = rng.choice([*strings, "", 5, None, ["x"]])
    return out


def content(rng, depth, strings):
    x = rng.random()
    if depth > 4 or x < 0.3:
        return rng.choice([*strings, "", None, 3, []])
    return [rng.choice([block(rng, depth, strings), block(rng, depth, strings), "loose", 4]) for _ in range(rng.randrange(4))] if x < 0.85 else block(rng, depth, strings)


def call(rng, strings):
    args = rng.choice([json.dumps(nested(rng, 0, strings), ensure_ascii=False), "no {json", '"just text"', nested(rng, 0, strings), None, 7, "", " [1, \"a\"] "])
    return rng.choice([{"function": {"arguments": args, "name": "f"}}, {"function": {"name": "f"}}, {"function": 3}, 4, {}])


def test_walks_agree(spark):
    rng = random.Random(12)
    strings = ["a", "ÿ😀", '{"x": "y"}', "[1]", "null", "12", 'q"\\ \n', " lead", "true"]
    bodies = []
    for _ in range(400):
        message = lambda: rng.choice([{"role": "user", "content": content(rng, 0, strings), **({"tool_calls": rng.choice([[call(rng, strings) for _ in range(2)], "x", None])} if rng.random() < 0.4 else {}), **({"function_call": rng.choice([{"arguments": rng.choice(strings)}, {"arguments": {"z": "1", "a": "2"}}, "x", {}])} if rng.random() < 0.2 else {})}, "text", None, 3, [1]]) if rng.random() < 0.9 else 1
        body = {"model": "m", "messages": [message() for _ in range(rng.randrange(4))]}
        if rng.random() < 0.5:
            body["system"] = content(rng, 0, strings)
        if rng.random() < 0.1:
            body["messages"] = rng.choice([None, "", 0, False, {}, "x", 5, True, {"a": 1}, 0.0])
        bodies.append(json.dumps(body, ensure_ascii=rng.random() < 0.5))
    bodies += ["", "no json", "[]", "3", '"x"', "null", "{}", None, '{"messages": [', '{"system": "s", "messages": [{"content": "c"}]}']
    check(spark, bodies)


def test_walks_agree_at_the_deepest(spark):
    bodies = []
    for n in (1, 62, 63, 64, 65, 66, 90):
        bodies.append(json.dumps({"messages": [{"content": [{"type": "tool_use", "input": json.loads("[" * n + '"x"' + "]" * n)}]}]}))
        bodies.append(json.dumps({"messages": [{"function_call": {"arguments": "[" * n + "7" + "]" * n}}]}))
        inner = "end"
        for _ in range(n):
            inner = [{"type": "tool_result", "content": inner}]
        bodies.append(json.dumps({"system": inner}))
        inner = "end"
        for _ in range(n):
            inner = [{"type": "document", "title": "t", "source": {"type": "content", "content": inner}}]
        bodies.append(json.dumps({"system": inner}))
    check(spark, bodies)
    assert walked(bodies[-1]) is None and walked(bodies[0])


def test_keys_that_stand_twice_are_refused(spark):
    df = spark.createDataFrame([(1, '{"messages": [], "system": "a", "system": "b"}')], "k int, body string")
    assert [r.error for r in leaves.request_leaves(df, "k").collect()] == ["E_BAD_REQUEST"]


def by_key(df):
    return sorted(tuple(r) for r in df.select("k", F.coalesce("leaf_no", F.lit(-1)), "path", "text", "error").fillna("").collect())


def test_collected_leaves_are_those_of_the_native_walk(spark):
    rng = random.Random(13)
    strings = ["a", "ÿ😀", '{"x": "y"}', "[1]", "null", "NaN", "1e999", 'q"\\ \n', "true"]
    bodies = [json.dumps({"messages": [{"content": content(rng, 0, strings), "tool_calls": [call(rng, strings)]}], "system": content(rng, 0, strings)}, ensure_ascii=rng.random() < 0.5) for _ in range(150)]
    deep = lambda n: '{"messages": [], "other": ' + "[" * n + "]" * n + ', "system": "s"}'
    bodies += ["", None, "no json", "[]", "null", deep(500), deep(998), deep(999), deep(1000), deep(1500), '{"system": "s", "n": NaN}', '{"system": "s", "n": -Infinity}', '{"system": "s", "n": 1e999}']
    bodies += ['{"system": "s", "n": ' + "1" * n + "}" for n in (800, 1001, 5000)] + ['{"system": "s", "' + "k" * n + '": 1}' for n in (30_000, 49_000, 60_000)]
    bodies += ['{"system": "a", "system": "b"}', '{"system": "a", "o": {"p": 1, "p": 2}}', '{"system": "\\ud83d\\ude00"}', '{"system": "\\ud83d"}', '{"system": "s"} trailing', '{"system": "s"} {}', '\ufeff{"system": "s"}', "{'system': 's'}", '{"system": "a\tb"}', '{"system": "s",}', '{"n": 01, "system": "s"}', '{"system": "\\u0000x"}']
    bodies += [json.dumps({"messages": [{"function_call": {"arguments": a}}]}) for a in ('{"a": "x", "a": "y"}', '["x"] y', "NaN", '{"z": "1", "a": ["2"]}', "plain", '"s"')]
    df = spark.createDataFrame(list(enumerate(bodies)), "k long, body string").repartition(4)
    assert by_key(leaves.collected_leaves(df, "k")) == by_key(leaves.request_leaves(df, "k"))


def test_ordinary_payloads_need_no_native_walk(spark, monkeypatch):
    """The native walk parses each level anew, about 0.7 ms for a payload of four leaves."""
    from maskflow.plans import catalog

    monkeypatch.setattr(leaves, "leaf_nodes", lambda body: F.raise_error(F.concat(F.lit("walked natively: "), body)).cast("array<struct<state:string,path:string,depth:int,raw:string,kind:string>>"))
    assert catalog.QUERIES["json_leaves"](spark, "/root/testdata/sf0.001").where("text is not null").collect()
