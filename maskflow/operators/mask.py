"""Placeholders, substitution and its reverse, allow lists, content hashes, sampling and the oversize path."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, spans, substitute
from .detect import raw_findings

PAIRS = "array<struct<original:string,placeholder:string>>"
# Windows of an oversize text, in code points
WINDOW, OVERLAP = 4 * 8320, 8320
# Placeholders that a text holds literally, those that number a label, and any family with a number
LITERAL, NUMBERED, FAMILY = r"\[[A-Z][A-Z0-9_]*_[0-9]{3,}\]", r"^\[([A-Z_]+)_([0-9]+)\]$", r"^\[(.+)_([0-9]+)\]$"


def pair(original: Column, placeholder: Column) -> Column:
    return F.struct(original.alias("original"), placeholder.alias("placeholder"))


def rule_pairs(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Pairs of the rules whose pattern stands in the text, in file order."""
    all_ = F.array(*[pair(F.lit(a), F.lit(b)) for a, b in rules]).cast(PAIRS)
    return F.filter(all_, lambda p: text.contains(p["original"]))


def base_pairs(rules: Column, oracle: Column) -> Column:
    """The rules' pairs, then those of the oracle whose original no rule has."""
    return F.concat(rules, F.filter(F.coalesce(oracle, F.array().cast(PAIRS)), lambda o: ~F.exists(rules, lambda r: r["original"] == o["original"])))


def merged_pairs(base: Column, findings: Column) -> Column:
    """Base pairs, then a new numbered placeholder for each finding's text that has none: best score and longest
    first, numbers going on after the largest of the label. Texts that stand twice meet by a sort, and each label is
    numbered by itself, so time grows with the findings and not with their square."""
    ordered = F.transform(F.array_sort(F.transform(findings, lambda f, i: F.struct((-f["score"]).alias("a"), (f["start"] - f["stop"]).alias("b"), i.alias("c"), f["text"].alias("text"), f["label"].alias("label")))), lambda k, i: F.struct(k["text"].alias("text"), i.alias("rank"), k["label"].alias("label")))

    def largest(pairs, label):
        own = F.filter(pairs, lambda p: F.regexp_extract(p["placeholder"], NUMBERED, 1) == label)
        return F.coalesce(F.array_max(F.transform(own, lambda p: F.regexp_extract(p["placeholder"], NUMBERED, 2).try_cast("long"))), F.lit(0))

    def token(label, n):
        return F.concat(F.lit("["), label, F.lit("_"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")), F.lit("]"))

    def numbered(pairs, new):
        one = lambda label, n: F.transform(F.filter(new, lambda x: x["label"] == label), lambda x, i: F.struct(x["rank"].alias("rank"), pair(x["text"], token(label, n + i + 1)).alias("p")))
        by_label = F.transform(F.array_distinct(F.transform(new, lambda x: x["label"])), lambda label: spans.let(largest(pairs, label), lambda n: one(label, n)))
        return F.concat(pairs, F.transform(F.array_sort(F.flatten(by_label)), lambda x: x["p"]))

    def merged(pairs):
        known = F.transform(pairs, lambda p: F.struct(p["original"].alias("text"), F.lit(-1).alias("rank"), F.lit("").alias("label")))
        first = spans.let(F.array_sort(F.concat(known, ordered)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["text"] != x["text"])))
        new = F.array_sort(F.transform(F.filter(first, lambda x: x["rank"] >= 0), lambda x: F.struct(x["rank"].alias("rank"), x["text"].alias("text"), x["label"].alias("label"))))
        return spans.let(new, lambda own: numbered(pairs, own))

    return spans.let(base, merged)


def allowed(pairs: Column, originals: Column) -> Column:
    """Pairs without those that are allow-listed, unless their label is a secret's."""
    return F.filter(pairs, lambda p: ~F.array_contains(originals, p["original"]) | F.regexp_extract(p["placeholder"], NUMBERED, 1).isin(*patterns.SECRET_LABELS))


def _longest_first(pairs: Column, by: str) -> Column:
    keyed = F.transform(pairs, lambda p, i: F.struct((-F.length(p[by])).alias("n"), (p[by] if by == "placeholder" else F.lit("")).alias("t"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda k: k["p"])


def _replaced(text: Column, pairs: Column, what: str, by: str) -> Column:
    few = F.size(pairs) <= substitute.FEW
    one_by_one = F.aggregate(_longest_first(F.when(few, pairs), what), text, lambda t, p: F.replace(t, p[what], p[by]))
    return F.when(few, one_by_one).otherwise(substitute.dense(what, by)(F.when(~few, text), F.when(~few, pairs)))


def applied(text: Column, pairs: Column) -> Column:
    """Every occurrence of each original gives way to its placeholder, longest originals first. Texts with many pairs
    go through an automaton in an Arrow function, which says the same; the others stay with native expressions. To
    work ``pairs`` out once, give it as a column of its own."""
    return _replaced(text, pairs, "original", "placeholder")


def reversed_(text: Column, pairs: Column) -> Column:
    return _replaced(text, pairs, "placeholder", "original")


def mask(df: DataFrame, text_col: str = "text", findings: str = "findings", rules: Iterable[tuple[str, str]] = (), allow: Iterable[str] = (), oracle: str | None = None) -> DataFrame:
    """``df`` plus ``pairs`` and ``masked``: rules first, then the oracle's pairs (a column of pairs, if any), then the
    findings; null texts stay null."""
    text = F.col(text_col)
    base = rule_pairs(F.coalesce(text, F.lit("")), rules)
    pairs = merged_pairs(base_pairs(base, F.col(oracle)) if oracle else base, F.col(findings))
    allow = list(allow)
    if allow:
        pairs = allowed(pairs, F.array(*map(F.lit, allow)))
    return df.withColumn("pairs", pairs).withColumn("masked", applied(text, F.col("pairs")))


def literals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0))


def family(placeholder: Column) -> Column:
    f = F.regexp_extract(placeholder, FAMILY, 1)
    return F.when(f == "", "UNKNOWN").otherwise(f)


def content_hash(team: Column, rules: Iterable[tuple[str, str]], text: Column, fingerprint: Column | None = None) -> Column:
    parts = [team, F.lit("\x1f"), *[F.lit(f"{a}\x1e{b}\x1f") for a, b in rules], F.lit("\x1d"), text]
    if fingerprint is not None:
        parts.append(F.when(fingerprint.isNull(), "").otherwise(F.concat(F.lit("\x1c"), fingerprint)))
    return F.sha2(F.concat(*parts), 256)


def sampled(conversation: Column, text: Column, percent: int) -> Column:
    """The same share of all seeds every time: the first 64 bits of the seed's SHA-256, modulo 100."""
    if percent <= 0 or percent >= 100:
        return F.lit(percent >= 100)
    bits = F.conv(F.substring(F.sha2(F.concat(conversation, F.lit("\x1f"), text), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return bits % 100 < percent


def oracle_trigger(trigger: str, gazetteer_hit: Column, local_hit: Column, conversation: Column, text: Column) -> Column:
    """Whether the external oracle is asked: always after a gazetteer hit, else as the trigger says."""
    head, _, rest = trigger.strip().lower().partition(":")
    if head == "sampled":
        more = sampled(conversation, text, int(rest))
    else:
        more = {"always": F.lit(True), "any_local_finding": local_hit, "gazetteer_hit": F.lit(False)}[head]
    return gazetteer_hit | more


def chunks(text: Column, window: int, overlap: int) -> Column:
    """Windows of ``window`` code points, each ``overlap`` before the end of the one before it."""
    step = window - overlap
    if step <= 0:
        raise ValueError("a window must exceed its overlap")
    last = F.ceil(F.greatest(F.lit(0), F.length(text) - window) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.call_function("substring", text, i * step + 1, F.lit(window)))


def _folded(df: DataFrame, by: list[str], order: list[str], fold, name: str) -> DataFrame:
    """``df`` plus a boolean column ``name`` from fold(state, row) -> (state, value), run over each group of ``by`` in
    the given order. What a row gets depends on all before it, so a group is one task's; but it is sorted by Spark,
    which spills, and runs through batch by batch, so no group has to fit into memory."""
    columns = [c for c in df.columns if c.lower() != name.lower()]
    kinds, need = dict(df.dtypes), list(dict.fromkeys([*by, *order]))
    d = df.select(*columns).repartition(*by).sortWithinPartitions(*by, *order)
    at = [columns.index(c) for c in need]

    def run(batches):
        group, state = None, None
        for b in batches:
            out = []
            for values in zip(*(b.column(i).to_pylist() for i in at)):
                row = dict(zip(need, values))
                own = tuple(row[c] for c in by)
                if own != group:
                    group, state = own, None
                state, value = fold(state, row)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*columns, name])

    return d.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{name}` boolean")


def dedup_by_hash(df: DataFrame, hash_col: str, compute, keys: list[str], ttl_seconds: int | None = None) -> DataFrame:
    """Run ``compute`` (DataFrame -> DataFrame with hash_col) once per distinct hash and join its result back, with
    cache_a_hit for all rows but the first by ``keys``, which tell rows apart. With a time to live, ``keys`` starts
    with a time: a result is good for so long from the row that made it, and the first row after that makes it anew.

    Every row of ``df`` comes out. A row without a hash (of a null text, say) shares its result with no other: it is
    no hit, is not computed, and has nulls where the result's columns are. What ``compute`` leaves out has nulls too.

    Without a time to live, the first row of a hash is a minimum, which combines before the shuffle, so a hot text
    is no hot task."""
    result = compute(df.where(F.col(hash_col).isNotNull()).dropDuplicates([hash_col]))
    if ttl_seconds is None:
        first = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("_hash")).agg(F.min(F.struct(*keys)).alias("_first"))
        d = df.join(first, F.col(hash_col) == F.col("_hash"), "left").withColumn("cache_a_hit", F.coalesce(F.struct(*keys) != F.col("_first"), F.lit(False))).drop("_hash", "_first")
        return d.join(result, hash_col, "left")

    def fold(made, row):
        now = row[keys[0]]
        hit = made is not None and row[hash_col] is not None and now < made + timedelta(seconds=ttl_seconds)
        return (made if hit else now), hit

    return _folded(df, [hash_col], keys, fold, "cache_a_hit").join(result, hash_col, "left")


class Allocator:
    """Placeholders of one request, one to one: a known original keeps its own; a wanted placeholder that is taken
    or forbidden gives way to the family's lowest free number."""

    def __init__(self, forbidden: Iterable[str] = ()):
        self.of: dict[str, str] = {}
        self.taken = set(forbidden)
        self.next: dict[str, int] = {}

    def get(self, original: str, wanted: str) -> str:
        if original not in self.of:
            if wanted in self.taken:
                m = re.match(r"^\[(.+)_(\d+)\]$", wanted)
                name = m[1] if m else "REDACTED"
                n = self.next.get(name, 1)
                while f"[{name}_{n:03d}]" in self.taken:
                    n += 1
                wanted, self.next[name] = f"[{name}_{n:03d}]", n + 1
            self.of[original] = wanted
            self.taken.add(wanted)
        return self.of[original]


def allocate(leaves: DataFrame, request: str, leaf: str, pairs: str = "pairs", text: str = "text") -> DataFrame:
    """request, leaf, original, placeholder: each leaf's pairs made one to one over its request, in leaf order, with
    the placeholders that the request's texts hold literally forbidden. The fold is sequential by nature, so a
    request is one group; a request is one chat payload."""
    kinds = dict(leaves.dtypes)

    def fold(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r[leaf])
        a = Allocator(x for r in rows for x in r["_literals"])
        out = [(r[request], r[leaf], p["original"], a.get(p["original"], p["placeholder"])) for r in rows for p in r[pairs]]
        cols = list(zip(*out)) or [[]] * 4
        return pa.table({request: pa.array(cols[0], t.schema.field(request).type), leaf: pa.array(cols[1], t.schema.field(leaf).type), "original": pa.array(cols[2], pa.string()), "placeholder": pa.array(cols[3], pa.string())})

    slim = leaves.select(request, leaf, pairs, F.coalesce(literals(F.col(text)), F.array().cast("array<string>")).alias("_literals"))
    return slim.groupBy(request).applyInArrow(fold, f"`{request}` {kinds[request]}, `{leaf}` {kinds[leaf]}, original string, placeholder string")


def oversize(df: DataFrame, text: str, threshold: int = 102_400, deliver: Column | None = None, clean: Column | None = None, out: str = "block_reason") -> DataFrame:
    """``df`` plus oversize:blocked for texts of more than ``threshold`` bytes, or oversize:delivered where the team
    takes flagged texts (``deliver``) and the full rescan was clean; null for others. By default none is delivered."""
    passes = (deliver if deliver is not None else F.lit(False)) & (clean if clean is not None else F.lit(False))
    return df.withColumn(out, F.when(F.octet_length(text) > threshold, F.when(passes, "oversize:delivered").otherwise("oversize:blocked")))


def chunked(df: DataFrame, key: str, text: str = "text", rules: Iterable[tuple[str, str]] = (), window: int = WINDOW, overlap: int = OVERLAP, extra=None) -> DataFrame:
    """key, pairs, masked of oversize texts. Rules of the table run over the whole text first, as some match without
    bound; then rules, table and ``extra`` (a function from a text column to findings, of models with a bounded
    input, say) run over overlapping windows. All pairs go through one allocator per text, and an original counts
    once. ``key`` tells the texts apart."""
    d = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    none = F.array().cast(PAIRS)
    whole = d.select(key, F.lit(-1).alias("_leaf"), merged_pairs(none, spans.without_overlaps(raw_findings(F.col("_text")))).alias("_pairs"), "_text")
    parts = d.select(key, F.posexplode_outer(chunks(F.col("_text"), window, overlap)).alias("_leaf", "_text"))
    found = raw_findings(F.col("_text"))
    found = F.concat(found, extra(F.col("_text"))) if extra is not None else found
    parts = parts.select(key, "_leaf", merged_pairs(rule_pairs(F.col("_text"), rules), spans.without_overlaps(found)).alias("_pairs"), "_text")
    alloc = allocate(whole.union(parts), key, "_leaf", "_pairs", "_text")
    pairs = alloc.groupBy(key, "original", "placeholder").agg(F.min("_leaf").alias("_leaf")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_leaf", "original", "placeholder"))).alias("_p"))
    pairs = pairs.select(key, F.transform("_p", lambda p: pair(p["original"], p["placeholder"])).alias("pairs"))
    out = d.join(pairs, key, "left").withColumn("pairs", F.coalesce("pairs", none))
    return out.select(key, "pairs", applied(F.col("_text"), F.col("pairs")).alias("masked"))


def clamped(requested: Column, most: int) -> Column:
    """Requested tokens up to the cap; null stays null."""
    return F.when(requested.isNotNull(), F.least(requested, F.lit(most)))
