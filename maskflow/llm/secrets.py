"""Secret scans: fixed rules plus sliding-window entropy, in native expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, table, unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same with the least length inside; finds the same spans, as runs are maximal and a failing one holds no other.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Candidate strings of the entropy method: runs of these characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: ... that hold letters and a digit
MIXED = r"^(?=.*[0-9])(?=.*[A-Za-z])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Least characters of what a base span leaves of an entropy span.
LEAST_PART = 8
#: Matches whose offsets are counted up together.
STRIDE = 128
#: Least bits of a window by character class of the candidate.
LEAST_BITS = {"^[0-9a-fA-F]+$": 3.0, "^[A-Za-z0-9]+$": 3.7, "": 3.9}
#: Candidates that are no secrets as a whole: UUIDs, paths and dashed or underscored words, repetitions.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[a-z]*([/_-]+([a-z]+|[0-9]{1,4}))+[/_=-]*$|^(.{1,4})\1+$"
#: Counting sequences and known dummies; windows that touch one are no secrets, the rest of the candidate may be.
DUMMIES = ("0123456789", "abcdefghij", "deadbeef", "example", "placeholder", "x{8}")

SPAN = "struct<start:int,ord:int,stop:int,kind:string>"


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strides(values: Column) -> Column:
    return _let(values, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(STRIDE)), lambda at: F.slice(v, at + 1, STRIDE)))


def found(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start,stop,m>>: leftmost non-overlapping matches with code-point offsets, in one pass over the
    pieces between matches and one over the matches; texts that the cheap gate refuses skip both. Offsets are
    counted up in strides, first over them and then within each, as an array grows by copying: a very long text
    full of matches costs little more per match than a short one."""
    pieces = F.split(text, F.lit(pattern), -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,stop:int,m:string>>")
    zero = F.lit(0).cast("int")
    width = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), zero)

    def step(acc, x):
        at = acc["at"] + F.length(x["p"])
        stop = acc["at"] + width(x)
        return F.struct(stop.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(at.alias("start"), stop.alias("stop"), x["m"].alias("m"))))).alias("out"))

    def base(acc, stride):
        return F.struct((acc["at"] + F.aggregate(stride, zero, lambda n, x: n + width(x))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def counted(strides):
        bases = F.aggregate(strides, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), base, lambda acc: acc["out"])
        return _let(bases, lambda b: F.flatten(F.transform(strides, lambda stride, i: F.aggregate(stride, F.struct(F.get(b, i).alias("at"), none.alias("out")), step, lambda acc: acc["out"]))))

    zipped = F.arrays_zip(pieces.alias("p"), matches.alias("m"))
    return F.when(gate, _let(_strides(zipped), counted)).otherwise(none)


def spans_of(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), x["stop"].alias("stop"), F.lit(kind).alias("kind")))


def entropy_spans(s: Column) -> Column:
    """array<struct<lo,hi>> in characters of s: each run of overlapping or adjacent windows of WINDOW characters whose
    Shannon entropy reaches the least bits of s's class, and which touch none of DUMMIES.

    H = log2(W) - sum(c * log2 c) / W; the sum is kept up by the character that enters and the one that leaves."""
    gain = F.array(*[F.lit((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)) for c in range(WINDOW)])
    bits = F.lit(LEAST_BITS[""])
    for pattern, least in reversed([x for x in LEAST_BITS.items() if x[0]]):
        bits = F.when(s.rlike(pattern), F.lit(least)).otherwise(bits)
    most = (F.lit(math.log2(WINDOW)) - bits) * WINDOW + 1e-9
    shown = s
    for d in DUMMIES:
        shown = F.regexp_replace(shown, "(?i)" + d, " " * (8 if d == "x{8}" else len(d)))
    symbols = ALPHABET + " "
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    zero = F.struct(F.array_repeat(F.lit(0), len(symbols)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("blank"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), none.alias("out"))
    last = lambda acc: F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))

    def spans(shown):
        place = lambda i: F.call_function("locate", F.call_function("substring", shown, i, F.lit(1)), F.lit(symbols))

        def fold(acc, i):
            new, old = place(i), F.when(i > WINDOW, place(i - WINDOW)).otherwise(F.lit(0))
            n_old = F.when(old > 0, F.get(acc["n"], old - 1)).otherwise(F.lit(0))
            less = F.when(old > 0, acc["sum"] - F.get(gain, n_old - 1)).otherwise(acc["sum"])
            n_new = F.get(acc["n"], new - 1) - F.when(old == new, F.lit(1)).otherwise(F.lit(0))
            total = less + F.get(gain, n_new)
            counts = F.when(old == new, acc["n"]).otherwise(F.transform(acc["n"], lambda v, k: v + F.when(k == new - 1, F.lit(1)).when(k == old - 1, F.lit(-1)).otherwise(F.lit(0))))
            # place of the last blank: windows from there on hold none
            blank = F.when(new == len(symbols), i).otherwise(acc["blank"])
            hit = (i - WINDOW >= blank) & (total <= most)
            apart = hit & (acc["lo"] >= 0) & (i - WINDOW > acc["hi"])
            return F.struct(
                counts.alias("n"), total.alias("sum"), blank.alias("blank"), F.when(hit & ((acc["lo"] < 0) | apart), i - WINDOW).otherwise(acc["lo"]).alias("lo"),
                F.when(hit, i).otherwise(acc["hi"]).alias("hi"), F.when(apart, F.concat(acc["out"], last(acc))).otherwise(acc["out"]).alias("out"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.length(shown)), zero, fold, lambda acc: F.when(acc["lo"] < 0, acc["out"]).otherwise(F.concat(acc["out"], last(acc))))

    return _let(shown, spans)


def entropy_hull(s: Column) -> Column:
    """struct<lo,hi>: from the first to the end of the last of the entropy spans; -1 if there is none."""
    return _let(entropy_spans(s), lambda x: F.struct(F.coalesce(F.array_min(x["lo"]), F.lit(-1)).alias("lo"), F.coalesce(F.array_max(x["hi"]), F.lit(-1)).alias("hi")))


def outside(span: Column, spans: Column) -> Column:
    """The parts of a span, as structs of start and stop, that none of ``spans`` (sorted by start) covers."""
    part = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc, b):
        out = F.when(b["start"] > acc["at"], F.concat(acc["out"], part(acc["at"], b["start"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), out.alias("out"))

    over = F.filter(spans, lambda b: (b["start"] < span["stop"]) & (span["start"] < b["stop"]))
    return F.aggregate(over, F.struct(span["start"].alias("at"), none.alias("out")), step, lambda acc: F.when(acc["at"] < span["stop"], F.concat(acc["out"], part(acc["at"], span["stop"]))).otherwise(acc["out"]))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus _base and _extra, arrays of struct<start,ord,stop,kind> in code points, end exclusive, sorted
    by start and kind.

    _base holds the three fixed rules, each leftmost and non-overlapping, failing matches dropped. _extra holds
    the parts outside base spans, of LEAST_PART characters or more, of the entropy spans of candidates that are not
    allow-listed. Null text counts as empty; empty texts and tables give no spans; repeated rows are scanned one by one; other columns pass through, but one that is
    named like an added column gives way to it."""
    docs = plain(docs, "_base", "_extra")
    t_, likely_, high_ = unused(docs, "_t", "_likely", "_high")
    d = docs.withColumn(t_, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    t = F.col(t_)
    assign = F.filter(found(t, ASSIGN, t.rlike(r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]")), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8)
    access = found(t, ACCESS_LONG, t.contains("AKIA"))
    hexes = found(t, HEX_LONG, t.rlike("[0-9a-f]{32}"))
    d = d.withColumn("_base", F.array_sort(F.concat(spans_of(assign, "assign"), spans_of(access, "access"), spans_of(hexes, "hex"))))
    likely = F.filter(found(t, CANDIDATE, t.rlike(CANDIDATE)), lambda x: x["m"].rlike(MIXED) & ~x["m"].rlike(ALLOWED))
    d = d.withColumn(likely_, likely)
    high = F.flatten(F.transform(likely_, lambda x: F.transform(entropy_spans(x["m"]), lambda h: F.struct((x["start"] + h["lo"]).alias("start"), (x["start"] + h["hi"]).alias("stop")))))
    d = d.withColumn(high_, high)
    parts = F.filter(F.flatten(F.transform(high_, lambda x: outside(x, F.col("_base")))), lambda x: x["stop"] - x["start"] >= LEAST_PART)
    d = d.withColumn("_extra", F.transform(parts, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("ord"), x["stop"].alias("stop"), F.lit("entropy").alias("kind"))))
    return d.drop(t_, likely_, high_)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mask``; overlapping spans give one mask; null stays null.
    Spans are taken in strides, each with its own part of the text. All columns come back as they were, whatever
    their names; repeated rows are masked one by one, and an empty table stays empty."""
    d = scan(docs.toDF(*[c if c == text_col else f"other{i}" for i, c in enumerate(docs.columns)]), text_col)
    t = F.col(text_col)
    zero = F.lit(0).cast("int")
    cut = lambda s, at, n: F.call_function("substring", s, at + 1, n)

    def base(acc, stride):
        last = F.coalesce(F.array_max(F.transform(stride, lambda x: x["stop"])), zero)
        return F.struct(F.greatest(acc["at"], last).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def stride_of(part, start, stride):
        def step(acc, x):
            kept = F.concat(acc["out"], cut(part, acc["at"] - start, x["start"] - acc["at"]), F.lit(mask))
            return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(x["start"] < acc["at"], acc["out"]).otherwise(kept).alias("out"))

        return F.aggregate(stride, F.struct(start.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def masked(strides):
        # where each stride starts, and where the last one ends
        bases = F.aggregate(strides, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), base, lambda acc: F.concat(acc["out"], F.array(acc["at"])))
        parts = lambda b: F.transform(strides, lambda stride, i: _let(cut(t, F.get(b, i), F.get(b, i + 1) - F.get(b, i)), lambda part: stride_of(part, F.get(b, i), stride)))
        return _let(bases, lambda b: F.concat(F.array_join(parts(b), ""), cut(t, F.element_at(b, -1), F.length(t))))

    new = _let(_strides(F.array_sort(F.concat("_base", "_extra"))), masked)
    return d.withColumn(text_col, F.when((F.size("_base") == 0) & (F.size("_extra") == 0), t).otherwise(new)).drop("_base", "_extra").toDF(*docs.columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long")
    return d.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("_base", "_extra"))).alias("spans"))
