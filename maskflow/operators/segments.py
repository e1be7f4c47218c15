"""Prose, code and comments of a text, and detection by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from .detect import raw_findings

# Forms of fences and comments
FENCE = r"(?s)```[^\n`]*\n.*?```"
FENCE_HEAD = r"^```[^\n`]*\n"
BLOCK_COMMENT, LINE_COMMENT = r"(?s)/\*.*?\*/", r"(?://|#)[^\n]*"
SEGMENT = "array<struct<kind:string,start:int,stop:int>>"


def _segment(kind: str, a: Column, b: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("start"), b.cast("int").alias("stop"))


def _code(body: Column, at: Column) -> Column:
    """Code and comments of a fence's body. Block comments come first; a line comment that starts inside one is
    none; what overlaps an earlier comment is clipped."""
    blocks = spans.matches(body, BLOCK_COMMENT, 0, body.contains("/*"))
    lines = F.filter(spans.matches(body, LINE_COMMENT, 0, body.rlike("//|#")), lambda x: ~F.exists(blocks, lambda b: (b["start"] <= x["start"]) & (x["start"] < b["stop"])))
    comments = F.array_sort(F.transform(F.concat(blocks, lines), lambda c: F.struct(c["start"].alias("a"), c["stop"].alias("b"))))
    none = F.array().cast(SEGMENT)
    code = lambda a, b: F.when(a < b, F.array(_segment("CODE", at + a, at + b))).otherwise(none)

    def clipped(cs):
        """What comments leave of each other, with the code before each; ``reach`` is where those before it end."""
        one = lambda c, reach: F.when(c["b"] > reach, F.concat(code(reach, F.greatest(c["a"], reach)), F.array(_segment("COMMENT", at + F.greatest(c["a"], reach), at + c["b"])))).otherwise(none)
        own = spans.let(spans.reach(F.transform(cs, lambda c: c["b"])), lambda r: F.flatten(F.transform(cs, lambda c, i: one(c, F.get(r, i)))))
        return F.concat(own, code(F.array_max(F.transform(cs, lambda c: c["b"])), F.length(body)))

    return spans.let(comments, lambda cs: F.when(F.size(cs) > 0, clipped(cs)).otherwise(code(F.lit(0), F.length(body))))


def segments(text: Column) -> Column:
    """array<struct<kind,start,stop>> that tile the text: fenced bodies are CODE and COMMENT, all else, the fences
    included, is PROSE. An unclosed fence is prose."""
    fences = spans.matches(text, FENCE, 0, text.contains("```"))
    none = F.array().cast(SEGMENT)
    prose = lambda a, b: F.when(a < b, F.array(_segment("PROSE", a, b))).otherwise(none)

    def fenced(m, before):
        head = F.length(F.regexp_extract(m["text"], FENCE_HEAD, 0))
        body = F.call_function("substring", m["text"], head + 1, F.length(m["text"]) - head - 3)
        return F.concat(prose(before, m["start"]), F.array(_segment("PROSE", m["start"], m["start"] + head)), _code(body, m["start"] + head), F.array(_segment("PROSE", m["stop"] - 3, m["stop"])))

    def tiled(ms):
        own = F.flatten(F.transform(ms, lambda m, i: fenced(m, F.coalesce(F.get(ms, i - 1)["stop"], F.lit(0)))))
        return F.concat(own, prose(F.coalesce(F.get(ms, F.size(ms) - 1)["stop"], F.lit(0)), F.length(text)))

    return spans.let(fences, tiled)


def detect_by_segment(df: DataFrame, text_col: str = "text", code_labels: list[str] | None = None, out: str = "findings") -> DataFrame:
    """As ``detect``, but no match crosses a segment's border; code may use some labels only. Overlaps are resolved
    over the whole text. All of it stays within the row, so no key is needed and nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.transform(segments(text), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("at"), F.call_function("substring", text, s["start"] + 1, s["stop"] - s["start"]).alias("part")))

    def found(s):
        raw = raw_findings(s["part"])
        if code_labels is not None:
            raw = F.when(s["kind"] == "CODE", raw_findings(s["part"], code_labels)).otherwise(raw)
        return F.transform(raw, lambda f: f.withField("start", f["start"] + s["at"]).withField("stop", f["stop"] + s["at"]))

    return df.withColumn(out, spans.without_overlaps(F.flatten(F.transform(parts, found))))
