"""Texts of nested chat payloads as rows, and payloads rewritten leaf by leaf."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, substitute

MOST_DEPTH = 64
LEAVES = "leaf_no int, path string, text string"


class BadPayload(ValueError):
    """A payload that can't be masked whole: nested too deeply, or with tool arguments of no known form."""


#: Where each type of block holds text, and of what kind that is: a plain text, content (a text or blocks), a JSON
#: tree whose strings are all texts, or a source, which has a table of its own. Other types pass through.
BLOCKS = {"text": {"text": "plain"}, "tool_result": {"content": "content"}, "tool_use": {"input": "tree"}, "document": {"title": "plain", "context": "plain", "source": "source"}}
SOURCES = {"text": {"data": "plain"}, "content": {"content": "content"}}


class Walk:
    """Rewrites the texts of a payload by ``put(path, text)``; keys and other values stay. A ``strict`` walk raises
    BadPayload where it can't reach a text; the other leaves what lies there as it is."""

    def __init__(self, put: Callable[[str, str], str], strict: bool = True):
        self.put, self.strict = put, strict

    def _refuse(self, value, path: str):
        if self.strict:
            raise BadPayload(path)
        return value

    def plain(self, value, path: str, depth: int):
        return self.put(path, value) if isinstance(value, str) else value

    def tree(self, value, path: str, depth: int = 0):
        if depth > MOST_DEPTH:
            return self._refuse(value, path)
        if isinstance(value, str):
            return self.put(path, value)
        if isinstance(value, list):
            return [self.tree(x, f"{path}[{i}]", depth + 1) for i, x in enumerate(value)]
        if isinstance(value, dict):
            return {k: self.tree(x, f"{path}.{k}", depth + 1) for k, x in value.items()}
        return value

    def content(self, value, path: str, depth: int = 0):
        if depth > MOST_DEPTH:
            return self._refuse(value, path)
        if isinstance(value, str):
            return self.put(path, value) if value else value
        if isinstance(value, list):
            return [self.block(x, f"{path}[{i}]", depth) if isinstance(x, dict) else x for i, x in enumerate(value)]
        return self.block(value, path, depth) if isinstance(value, dict) else value

    def source(self, value, path: str, depth: int):
        return self.fields(value, SOURCES, path, depth) if isinstance(value, dict) else value

    def block(self, value: dict, path: str, depth: int) -> dict:
        return self.fields(value, BLOCKS, path, depth)

    def fields(self, value: dict, table: dict, path: str, depth: int) -> dict:
        kind = value.get("type")
        places = table.get(kind, {}) if isinstance(kind, str) else {}
        out = dict(value)
        for name, how in places.items():
            if name in value:
                deeper = depth if how == "source" else 0 if how == "tree" else depth + 1
                out[name] = getattr(self, how)(value[name], f"{path}.{name}", deeper)
        return out

    def arguments(self, value, path: str):
        """Arguments of a tool call: JSON in a string is walked and written back as JSON, other strings are one
        text, trees are walked, null is none. Anything else has no known form."""
        if isinstance(value, str):
            try:
                tree = json.loads(value)
            except (ValueError, RecursionError):
                return self.put(path, value)
            return json.dumps(self.tree(tree, path), ensure_ascii=False) if isinstance(tree, (dict, list, str)) else value
        if isinstance(value, (dict, list)):
            return self.tree(value, path)
        return value if value is None else self._refuse(value, path)

    def calls(self, message: dict, path: str) -> dict:
        """A message with the arguments of its tool calls, and of its function call, rewritten."""
        out = dict(message)
        if isinstance(message.get("tool_calls"), list):
            out["tool_calls"] = [self._called(c, "function", f"{path}.tool_calls[{j}]") if isinstance(c, dict) else c for j, c in enumerate(message["tool_calls"])]
        return self._called(out, "function_call", f"{path}.function_call")

    def _called(self, holder: dict, name: str, path: str) -> dict:
        call = holder.get(name)
        if not isinstance(call, dict) or "arguments" not in call:
            return holder
        return {**holder, name: {**call, "arguments": self.arguments(call["arguments"], f"{path}.arguments")}}

    def message(self, value, path: str):
        if not isinstance(value, dict):
            return value
        out = {**value, "content": self.content(value["content"], f"{path}.content")} if value.get("content") else value
        return self.calls(out, path)


def rewrite(body: dict, put: Callable[[str, str], str], strict: bool = True) -> dict:
    """A request with ``put(path, text)`` in place of each leaf: messages in order (content, then tool calls), then
    the system text. Unknown blocks pass through."""
    walk, out = Walk(put, strict), dict(body)
    if isinstance(body.get("messages"), list):
        out["messages"] = [walk.message(m, f"messages[{i}]") for i, m in enumerate(body["messages"])]
    if body.get("system"):
        out["system"] = walk.content(body["system"], "system")
    return out


def rewrite_response(response, put: Callable[[str, str], str]):
    """A response with its texts rewritten: a bare string; the message of each choice, with its tool calls; or, where
    there are no choices, the content on top. Whatever else there is stays."""
    walk = Walk(put, strict=False)
    if isinstance(response, str):
        return put("", response)
    if not isinstance(response, dict):
        return response
    if isinstance(response.get("choices"), list):
        return {**response, "choices": [{**c, "message": walk.message(c["message"], f"choices[{i}].message")} if isinstance(c, dict) and "message" in c else c for i, c in enumerate(response["choices"])]}
    return {**response, "content": walk.content(response["content"], "content")} if "content" in response else response


def _parsed(text: str) -> dict:
    try:
        body = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise BadPayload(str(e)) from None
    if not isinstance(body, dict) or not isinstance(body.get("messages") or [], list):
        raise BadPayload("not a request")
    return body


NODE = "struct<state:string,path:string,depth:int,raw:string,kind:string>"
KID = "struct<key:string,raw:string,kind:string>"
#: Steps within which every payload that is not refused is walked: a level of content takes three, a tree's level one.
STEPS = 4 * MOST_DEPTH + 16
ROUND = 16


def _kind(v: Column) -> Column:
    """s, o, a, n or x: a string, object, array, null or other scalar."""
    schema = F.schema_of_variant(v)
    return F.when(schema == "STRING", "s").when(schema.startswith("OBJECT"), "o").when(schema.startswith("ARRAY"), "a").when(v.isNull() | F.is_variant_null(v), "n").otherwise("x")


def _kids(raw: Column, kind: Column) -> Column:
    """Members of an object or elements of an array, in their order: strings as they are, anything else as JSON. The
    values are parsed twice, as text, which keeps the order of what is nested in them, and as variants for their kind."""
    empty = F.array().cast(f"array<{KID}>")
    one = lambda key, text, v: F.struct(key.alias("key"), text.alias("raw"), _kind(v).alias("kind"))
    entries = spans.let(F.map_entries(F.from_json(raw, "map<string,variant>")), lambda vs: F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e, i: one(e["key"], e["value"], F.get(vs, i)["value"])))
    elements = spans.let(F.from_json(raw, "array<variant>"), lambda vs: F.transform(F.from_json(raw, "array<string>"), lambda e, i: one(F.lit(None).cast("string"), e, F.get(vs, i))))
    return F.coalesce(F.when(kind == "o", entries).when(kind == "a", elements), empty)


def _field(kids: Column, name: str) -> Column:
    """A member by name, null if there is none; of several the last."""
    return F.try_element_at(F.filter(kids, lambda k: k["key"] == name), F.lit(-1))


def _node(state: str, path: Column, depth: Column, kid: Column) -> Column:
    return F.struct(F.lit(state).alias("state"), path.alias("path"), depth.cast("int").alias("depth"), kid["raw"].alias("raw"), kid["kind"].alias("kind"))


def _nodes(*some: tuple[Column, Column]) -> Column:
    """The nodes whose condition holds."""
    none = F.array().cast(f"array<{NODE}>")
    return F.concat(*[F.when(F.coalesce(cond, F.lit(False)), F.array(node)).otherwise(none) for cond, node in some])


def _numbered(path: Column, i: Column) -> Column:
    return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))


def _called(path: Column, holder: Column, name: str) -> Column:
    """The arguments of the call under ``name`` in a holder's members."""
    call = _field(holder, name)
    inner = F.when(call["kind"] == "o", _kids(call["raw"], call["kind"]))
    return spans.let(_field(inner, "arguments"), lambda a: _nodes((a.isNotNull(), _node("arguments", F.concat(path, F.lit(".arguments")), F.lit(0), a))))


def _step(n: Column) -> Column:
    """What takes a node's place: the nodes below it, a leaf, a refusal, or nothing."""
    none = F.array().cast(f"array<{NODE}>")
    path, depth, kind = n["path"], n["depth"], n["kind"]
    leaf, bad = _nodes((F.lit(True), _node("leaf", path, depth, n))), _nodes((F.lit(True), _node("bad", path, depth, n)))
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    under = lambda kids, name, state, d: (_field(kids, name).isNotNull(), _node(state, at(name), d, _field(kids, name)))

    def message(kids):
        content = _field(kids, "content")
        calls = F.when(_field(kids, "tool_calls")["kind"] == "a", _kids(_field(kids, "tool_calls")["raw"], F.lit("a")))
        called = F.flatten(F.transform(F.coalesce(calls, F.array().cast(f"array<{KID}>")), lambda c, j: _called(_numbered(at("tool_calls"), j), _kids(c["raw"], c["kind"]), "function")))
        return F.concat(_nodes((content.isNotNull(), _node("content", at("content"), F.lit(0), content))), called, _called(at("function_call"), kids, "function_call"))

    def typed(kids, table):
        kind_of = _field(kids, "type")
        out = None
        for name, places in table.items():
            deeper = {"source": depth, "tree": F.lit(0), "content": depth + 1, "plain": depth + 1}
            nodes = _nodes(*[under(kids, f, how, deeper[how]) for f, how in places.items()])
            hit = F.coalesce((kind_of["kind"] == "s") & (kind_of["raw"] == name), F.lit(False))
            out = F.when(hit, nodes) if out is None else out.when(hit, nodes)
        return out.otherwise(none)

    def content(kids):
        blocks = F.transform(F.filter(F.transform(kids, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: x["k"]["kind"] == "o"), lambda x: _node("block", _numbered(path, x["i"]), depth, x["k"]))
        return F.when(depth > MOST_DEPTH, bad).when(kind == "s", F.when(n["raw"] != "", leaf).otherwise(none)).when(kind == "a", blocks).when(kind == "o", _nodes((F.lit(True), _node("block", path, depth, n)))).otherwise(none)

    def tree(kids):
        below = F.transform(kids, lambda k, i: _node("tree", F.when(kind == "a", _numbered(path, i)).otherwise(F.concat(path, F.lit("."), k["key"])), depth + 1, k))
        return F.when(depth > MOST_DEPTH, bad).when(kind == "s", leaf).when(kind.isin("a", "o"), below).otherwise(none)

    def arguments():
        parsed = F.try_parse_json(n["raw"])
        inner = lambda p: F.struct(F.when(_kind(p) == "s", F.try_variant_get(p, "$", "string")).otherwise(n["raw"]).alias("raw"), _kind(p).alias("kind"))
        text = F.when(parsed.isNull(), leaf).otherwise(spans.let(inner(parsed), lambda k: _nodes((k["kind"].isin("s", "a", "o"), _node("tree", path, F.lit(0), k)))))
        return F.when(kind == "s", text).when(kind.isin("a", "o"), _nodes((F.lit(True), _node("tree", path, F.lit(0), n)))).when(kind == "n", none).otherwise(bad)

    state = n["state"]

    def below(kids):
        return (
            F.when(state == "tree", tree(kids)).when(state == "content", content(kids)).when(kind != "o", none)
            .when(state == "message", message(kids)).when(state == "block", typed(kids, BLOCKS)).otherwise(typed(kids, SOURCES))
        )

    simple = F.when(state.isin("leaf", "bad"), F.array(n)).when(state == "plain", F.when(kind == "s", leaf).otherwise(none)).when(state == "arguments", arguments())
    return simple.otherwise(spans.let(_kids(n["raw"], kind), below))


def leaf_nodes(body: Column) -> Column:
    """array<struct<state,path,depth,raw,kind>> of a request: its leaves (state leaf, text in raw) in the order in which
    they are masked; with a node of the state bad it can't be masked whole. Null for what is no request.

    The walk is a loop in one expression: each step puts the nodes below it in a node's place, which keeps the order,
    until only leaves are left. Nothing is exploded or shuffled, and no Python runs."""
    v = F.try_parse_json(body)
    zero = lambda k: (k["kind"] == "x") & ((k["raw"] == "false") | (k["raw"].try_cast("double") == 0))

    def begin(kids):
        ms, system = _field(kids, "messages"), _field(kids, "system")
        absent = ms.isNull() | (ms["kind"] == "n") | ((ms["kind"] == "s") & (ms["raw"] == "")) | zero(ms) | ((ms["kind"] == "o") & (F.size(_kids(ms["raw"], ms["kind"])) == 0))
        messages = F.transform(_kids(ms["raw"], ms["kind"]), lambda m, i: _node("message", _numbered(F.lit("messages"), i), F.lit(0), m))
        rest = _nodes((system.isNotNull(), _node("content", F.lit("system"), F.lit(0), system)))
        none = F.array().cast(f"array<{NODE}>")
        return F.when(F.coalesce(ms["kind"] == "a", F.lit(False)), F.concat(messages, rest)).when(F.coalesce(absent, F.lit(False)), F.concat(none, rest))

    first = F.when(_kind(v) == "o", spans.let(_kids(body, F.lit("o")), begin))
    walked = lambda acc: F.exists(acc, lambda n: ~n["state"].isin("leaf", "bad"))
    def steps(n, start, step):
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda acc, _: F.when(walked(acc), step(acc)).otherwise(acc))

    # in rounds, as a payload that is done is looked at again in each step that is left of them
    return steps(STEPS // ROUND, first, lambda acc: steps(ROUND, acc, lambda a: F.flatten(F.transform(a, _step))))


def _row(n: Column, i: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(i.cast("int").alias("leaf_no"), n["path"].alias("path"), n["raw"].alias("text"), none.alias("error"))


def _rows(nodes: Column) -> Column:
    """A row per leaf, or the one of an error."""
    none = F.lit(None).cast("string")
    bad = nodes.isNull() | F.exists(nodes, lambda n: n["state"] == "bad")
    refused = F.struct(F.lit(None).cast("int").alias("leaf_no"), none.alias("path"), none.alias("text"), F.lit("E_BAD_REQUEST").alias("error"))
    return F.when(bad, F.array(refused)).otherwise(F.transform(nodes, _row))


def _exploded(d: DataFrame, key: str) -> DataFrame:
    # an outer explode, as for an inner one the planner would walk every payload once more to filter on the size
    return d.select(F.col(f"`{key}`"), F.explode_outer("_rows").alias("_leaf")).where("_leaf is not null").select(F.col(f"`{key}`"), "_leaf.*")


def request_leaves(requests: DataFrame, key: str = "request_id", body: str = "body") -> DataFrame:
    """key, leaf_no, path, text, error: the texts of JSON payloads in the order in which they are masked. A payload
    that is no JSON object, nested too deeply, with a key that stands twice, or with tool arguments of no known form
    gives one row with an error; a null or empty one has no leaves. Native; see ``leaf_nodes``."""
    d = requests.select(F.col(f"`{key}`").alias(key), leaf_nodes(F.coalesce(F.nullif(F.col(f"`{body}`"), F.lit("")), F.lit("{}"))).alias("_nodes"))
    return _exploded(d.select(F.col(f"`{key}`"), _rows(F.col("_nodes")).alias("_rows")), key)


class Undecided(ValueError):
    """A text of which a JSON parser may say one thing and the engine's another."""


#: Longer payloads, numbers and names, and deeper ones, meet limits of the engine's parser.
MOST_CHARS, MOST_DIGITS, MOST_NAME, MOST_NESTED = 2_000_000, 900, 40_000, 900


def _number(kind):
    def parsed(text):
        if len(text) > MOST_DIGITS:
            raise Undecided("number")
        return kind(text)

    return parsed


def _constant(text):
    raise Undecided(text)


def _members(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Undecided("a key twice")
    return out


_DECODE = json.JSONDecoder(object_pairs_hook=_members, parse_int=_number(int), parse_float=_number(float), parse_constant=_constant).decode


def _plain_json(text: str):
    """A JSON text that every parser takes, and takes alike; Undecided for any other."""
    if len(text) > MOST_CHARS or "\\ud" in text or "\\uD" in text:
        raise Undecided("size or surrogates")
    try:
        value = _DECODE(text)
    except (ValueError, RecursionError) as e:
        raise Undecided(str(e)) from None
    if len(text) > MOST_NAME or text.count("[") + text.count("{") > MOST_NESTED:
        level, depth = [value], 0
        while level and depth <= MOST_NESTED:
            if any(len(k) > MOST_NAME for x in level if isinstance(x, dict) for k in x):
                raise Undecided("name")
            level, depth = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)], depth + 1
        if level:
            raise Undecided("depth")
    return value


class Collect(Walk):
    """Notes the leaves that Walk would rewrite."""

    def __init__(self):
        self.paths, self.texts = [], []
        super().__init__(self._note)

    def _note(self, path: str, text: str) -> str:
        self.paths.append(path)
        self.texts.append(text)
        return text

    def arguments(self, value, path: str):
        if not isinstance(value, str):
            return super().arguments(value, path)
        self.tree(_plain_json(value), path)
        return value

    def request(self, text: str) -> None:
        body = _plain_json(text)
        if not isinstance(body, dict) or not isinstance(body.get("messages") or [], list):
            raise Undecided("no request")
        for i, m in enumerate(body.get("messages") or []):
            self.message(m, f"messages[{i}]")
        if body.get("system"):
            self.content(body["system"], "system")


def _collected(batches):
    """Key, the payload where it is undecided, and the leaves of the others."""
    for b in batches:
        walk, stops, left = Collect(), [0], []
        for text in b.column(1).to_pylist():
            own = len(walk.paths)
            left.append(None)
            try:
                if text:
                    walk.request(text)
            except (Undecided, BadPayload, RecursionError):
                del walk.paths[own:], walk.texts[own:]
                left[-1] = text
            stops.append(len(walk.paths))
        leaves = pa.StructArray.from_arrays([pa.array(walk.paths, pa.string()), pa.array(walk.texts, pa.string())], names=["path", "raw"])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string()), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), leaves)], names=["_key", "_body", "_found"])


def collected_leaves(requests: DataFrame, key: str = "request_id", body: str = "body") -> DataFrame:
    """The rows of ``request_leaves`` in a fraction of its time, for large tables: ordinary payloads are walked in Arrow
    batches. Whatever is refused there, or might be read otherwise by the engine's parser, is left to the native walk,
    which decides."""
    d = requests.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{body}`").cast("string").alias("_body"))
    d = d.mapInArrow(_collected, f"_key {dict(d.dtypes)['_key']}, _body string, _found array<struct<path:string,raw:string>>")
    native = spans.let(leaf_nodes(F.col("_body")), _rows)
    return _exploded(d.select(F.col("_key").alias(key), F.when(F.col("_body").isNull(), F.transform("_found", _row)).otherwise(native).alias("_rows")), key)


def _put(pairs: list | None, reverse: bool) -> Callable[[str, str], str]:
    """All pairs applied to a text, the longest first."""
    ordered = substitute.in_turn(((p["placeholder"], p["original"]) if reverse else (p["original"], p["placeholder"]) for p in pairs or []), by_text=reverse)
    return lambda _, text: substitute.replaced(text, ordered)


def _masked(text: str, put) -> tuple[str | None, str | None]:
    try:
        return json.dumps(rewrite(_parsed(text), put), ensure_ascii=False), None
    except BadPayload:
        return None, "E_BAD_REQUEST"


def _reversed(text: str, put, walk) -> tuple[str, None]:
    try:
        return json.dumps(walk(json.loads(text), put), ensure_ascii=False), None
    except (ValueError, RecursionError):
        return put("", text), None


def _replaced(df: DataFrame, body: str, pairs: str, reverse: bool, out: str, how: Callable) -> DataFrame:
    error = f"{out}_error"
    names = [c for c in df.columns if c.lower() not in (out.lower(), error.lower())]
    kinds = dict(df.dtypes)

    def run(batches):
        for b in batches:
            kept = [b.column(i) for i, c in enumerate(columns) if c in names]
            rows = [how(t, _put(ps, reverse)) if t is not None else (None, None) for t, ps in zip(b.column(at).to_pylist(), b.column(of).to_pylist())]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=[*names, out, error])

    columns = df.columns
    at, of = columns.index(body), columns.index(pairs)
    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{out}` string, `{error}` string")


def mask_messages(df: DataFrame, body: str = "body", pairs: str = "pairs", out: str = "masked_body") -> DataFrame:
    """``df`` plus the masked request and its error: one that can't be masked whole is null, with E_BAD_REQUEST, so
    that nothing of it leaves. A null request stays null. Columns named like the added ones give way to them."""
    return _replaced(df, body, pairs, False, out, _masked)


def unmask_messages(df: DataFrame, body: str = "body", pairs: str = "pairs", out: str = "unmasked_body") -> DataFrame:
    """The reverse. What is nested too deeply stays as it is, and what is no JSON is reversed as one text."""
    return _replaced(df, body, pairs, True, out, lambda t, put: _reversed(t, put, lambda v, p: rewrite(v, p, strict=False) if isinstance(v, dict) else v))


def unmask_responses(df: DataFrame, body: str = "response", pairs: str = "pairs", out: str = "unmasked_response") -> DataFrame:
    """Whole responses of either wire format with their originals back; see ``rewrite_response``."""
    return _replaced(df, body, pairs, True, out, lambda t, put: _reversed(t, put, rewrite_response))


def token_usage(body: Column) -> Column:
    """struct<prompt,completion> of a response; a 0 that is there counts, a missing one is 0."""
    v = F.try_parse_json(body)
    get = lambda p: F.try_variant_get(v, p, "long")
    return F.struct(F.coalesce(get("$.usage.prompt_tokens"), get("$.usage.input_tokens"), F.lit(0)).alias("prompt"), F.coalesce(get("$.usage.completion_tokens"), get("$.usage.output_tokens"), F.lit(0)).alias("completion"))


def scrubbed_headers(headers: Column, more: tuple[str, ...] = ()) -> Column:
    """Headers without the credentials of this hop; Authorization stays."""
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin("x-corp-auth", *more))
