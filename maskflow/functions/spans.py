"""Spans of regular-expression matches and their reduction, in native expressions.

Offsets are code points, as Spark's length() counts them; regexp_instr would count UTF-16 units."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW = "array<struct<start:int,stop:int,text:string>>"
#: Matches whose offsets are added up at once.
STRIDE = 64
FINDING = "array<struct<label:string,start:int,stop:int,score:double,ord:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0, gate: Column | None = None) -> Column:
    """array<struct<start,stop,text>> of the leftmost non-overlapping matches of a pattern that never matches the
    empty string. A capture group other than 0 must end where the match ends, as all of the rule table do. Texts that
    the gate refuses are not searched, and those without a match are searched once."""
    return F.get(all_matches(text, [(pattern, group, gate)]), F.lit(0))


def all_matches(text: Column, patterns: Sequence[tuple[str, int, Column | None]]) -> Column:
    """The matches of each (pattern, group, gate), in their order; see ``matches``. Offsets are added up by one
    expression for all of them, as building one costs more than most texts do.

    They are added up in strides, first over the strides and then within each, as an array grows by copying: a
    text with many matches costs no more per match than one with few."""
    none, zero = F.array().cast(RAW), F.lit(0)
    width = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), zero)

    def pieces(pattern, group, gate):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        zipped = F.arrays_zip(F.split(text, F.lit(pattern), -1).alias("p"), whole.alias("m"), own.alias("g"))
        return F.when(text.rlike(pattern) if gate is None else gate & text.rlike(pattern), zipped)

    def step(acc, x):
        stop = acc["at"] + width(x)
        one = F.struct((stop - F.length(x["g"])).alias("start"), stop.alias("stop"), x["g"].alias("text"))
        return F.struct(stop.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    def first(acc, stride):
        return F.struct((acc["at"] + F.aggregate(stride, zero, lambda n, x: n + width(x))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def counted(strides):
        starts = F.aggregate(strides, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), first, lambda acc: acc["out"])
        return let(starts, lambda at: F.flatten(F.transform(strides, lambda stride, i: F.aggregate(stride, F.struct(F.get(at, i).alias("at"), none.alias("out")), step, lambda acc: acc["out"]))))

    strided = lambda z: F.transform(F.sequence(zero, F.greatest(F.size(z) - 1, zero), F.lit(STRIDE)), lambda at: F.slice(z, at + 1, STRIDE))
    return F.transform(F.array(*[pieces(*p) for p in patterns]), lambda z: F.when(z.isNull(), none).otherwise(let(strided(z), counted)))


def findings(raw: Column, label: str, score: float | Column, order: int) -> Column:
    return F.transform(raw, lambda x: F.struct(F.lit(label).alias("label"), x["start"].alias("start"), x["stop"].alias("stop"), (F.lit(score) if not isinstance(score, Column) else score).cast("double").alias("score"), F.lit(order).alias("ord"), x["text"].alias("text")))


def by_priority(found: Column) -> Column:
    """Highest score first, then the longest, then the first; ties keep the order of rules."""
    keyed = F.transform(found, lambda f: F.struct((-f["score"]).alias("a"), (f["start"] - f["stop"]).alias("b"), f["start"].alias("c"), f["ord"].alias("d"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def reach(stops: Column) -> Column:
    """For each place of an array of numbers the largest before it, 0 at first; in strides, as ``matches`` does."""
    strides = F.transform(F.sequence(F.lit(0), F.size(stops) - 1, F.lit(STRIDE)), lambda at: F.slice(stops, at + 1, STRIDE))
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    grown = lambda most: lambda acc, x: F.struct(F.greatest(acc["at"], most(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    within = lambda s: F.aggregate(s, zero(F.lit(0)), grown(F.array_max), lambda acc: acc["out"])
    return let(strides, lambda s: let(within(s), lambda at: F.flatten(F.transform(s, lambda own, i: F.aggregate(own, zero(F.get(at, i)), grown(lambda x: x), lambda acc: acc["out"])))))


def _chains(found: Column) -> Column:
    """Findings by start, in groups that no other group's finding overlaps: array<array<finding>>. A group begins
    where a finding starts at or after the end of all before it, so groups are slices and nothing is copied twice."""
    ordered = F.transform(F.array_sort(F.transform(found, lambda f: F.struct(f["start"].alias("s"), f.alias("f")))), lambda k: k["f"])

    def cut(o):
        firsts = let(reach(F.transform(o, lambda f: f["stop"])), lambda ends: F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | (F.get(o, i)["start"] >= F.get(ends, i))))
        return let(firsts, lambda at: F.transform(at, lambda a, k: F.slice(o, a + 1, F.coalesce(F.get(at, k + 1), F.size(o)) - a)))

    return let(ordered, lambda o: F.when(F.size(o) > 0, cut(o)).otherwise(F.array().cast(f"array<{FINDING}>")))


def _greedy(found: Column) -> Column:
    kept = F.aggregate(by_priority(found), F.array().cast(FINDING), lambda acc, f: F.when(F.exists(acc, lambda k: (f["start"] < k["stop"]) & (k["start"] < f["stop"])), acc).otherwise(F.concat(acc, F.array(f))))
    return F.transform(F.array_sort(F.transform(kept, lambda f: F.struct(f["start"].alias("s"), f.alias("f")))), lambda k: k["f"])


def without_overlaps(found: Column) -> Column:
    """Greedy: each finding in order of priority stays unless one that stayed overlaps it. Result by start. Findings
    are compared within chains of overlapping ones only, so a text with many findings costs no square of them."""
    return F.flatten(F.transform(_chains(found), lambda c: F.when(F.size(c) < 2, c).otherwise(_greedy(c))))
