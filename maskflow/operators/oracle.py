"""Answers of an external model as pairs, and the call itself as an injected function."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a line that states a pair
LINE = re.compile(r"^\s*[-*]?\s*`?(?P<a>[^`]+?)`?\s*(?:→|->)\s*`?(?P<b>[^`]+?)`?\s*$")
PAIRS = "array<struct<original:string,placeholder:string>>"


def _pairs(value) -> list | None:
    items = value.get("pairs") if isinstance(value, dict) else None
    if not isinstance(items, list) or not all(isinstance(x, dict) and isinstance(x.get("original"), str) and isinstance(x.get("replacement"), str) for x in items):
        return None
    return [{"original": x["original"], "placeholder": x["replacement"]} for x in items]


def _message(raw) -> dict:
    choices = raw.get("choices") if isinstance(raw, dict) else None
    message = choices[0].get("message") if choices and isinstance(choices[0], dict) else None
    return message if isinstance(message, dict) else {}


def _loads(text):
    try:
        return json.loads(text)
    except (ValueError, TypeError):
        return None


def first_object(text: str) -> str | None:
    """The first balanced JSON object of a text; braces inside strings do not count."""
    at = text.find("{")
    if at < 0:
        return None
    depth = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}]', text[at:], re.S):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[at : at + m.end()]
    return None


def answer_pairs(answer: str | None) -> list | None:
    """Pairs of a tool call, else of a JSON object in the text, else of lines 'a -> b'; None if there are none."""
    if answer is None:
        return None
    raw = _loads(answer)
    message = _message(raw)
    for call in message.get("tool_calls") or []:
        arguments = (call.get("function") or {}).get("arguments") if isinstance(call, dict) else None
        if (found := _pairs(_loads(arguments) if isinstance(arguments, str) else arguments)) is not None:
            return found
        break
    content = message.get("content")
    text = content if isinstance(content, str) else "".join(str(x.get("text", "")) for x in content if isinstance(x, dict) and x.get("type") == "text") if isinstance(content, list) else "" if isinstance(raw, dict) and "choices" in raw else answer
    if (snippet := first_object(text)) and (found := _pairs(_loads(snippet))) is not None:
        return found
    lines = [(m["a"].strip(), m["b"].strip()) for line in text.splitlines() if (m := LINE.match(line))]
    return [{"original": a, "placeholder": b} for a, b in lines if a and b] or None


def oracle_pairs(df: DataFrame, answer: str = "answer", out: str = "oracle_pairs") -> DataFrame:
    """``df`` plus the pairs of each answer and error_code E_CORP_LLM_DOWN where no form of answer was found."""
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", `{out}` {PAIRS}"
    at = df.columns.index(answer)
    kind = pa.list_(pa.struct([("original", pa.string()), ("placeholder", pa.string())]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([answer_pairs(x) for x in b.column(at).to_pylist()], kind)], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema).withColumn("oracle_error", F.when(F.col(out).isNull(), "E_CORP_LLM_DOWN"))


def asked(df: DataFrame, ask: Callable[[list[str]], list[str]], text: str = "text", out: str = "answer") -> DataFrame:
    """Answers of ``ask`` (texts of a batch -> answers), a function that workers import; one client per task."""
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ask(b.column(at).to_pylist()), pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", `{out}` string")


def uncovered_labels(pairs: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Labels of oracle pairs whose original no local finding of the same text covers, counted."""
    left = pairs.join(findings.select(key, F.col("text").alias("original")).distinct(), [key, "original"], "left_anti")
    label = F.regexp_extract("placeholder", r"^\[([A-Z_]+)_[0-9]+\]$", 1)
    return left.groupBy(F.when(label == "", "UNKNOWN").otherwise(label).alias("label")).agg(F.count("*").alias("n"))
