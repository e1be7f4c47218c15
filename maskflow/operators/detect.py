"""Detection of identifiers, credentials and addresses as one Column of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums, patterns, spans


def _rule(order: int, found: Column) -> Column:
    r = patterns.RULES[order]
    return spans.findings(F.filter(found, lambda x: r.check(x["text"])) if r.check else found, r.label, r.score, order)


def rule_findings(text: Column, order: int) -> Column:
    """The findings of one rule."""
    r = patterns.RULES[order]
    return _rule(order, spans.matches(text, r.pattern, r.group, r.gate(text)))


def _formatted_snils(found: Column) -> Column:
    return spans.findings(F.filter(found, lambda x: checksums.snils(F.regexp_replace(x["text"], r"[^0-9]", ""))), "SNILS", 1.0, len(patterns.RULES))


def _bank_accounts(found: Column, biks: Column, order: int) -> Column:
    """Accounts score 1.0 where a bank code within reach satisfies their key, else 0.7."""
    near = lambda a, b: F.least(F.abs(a["start"] - b["stop"]), F.abs(b["start"] - a["stop"])) < patterns.BIK_REACH
    return F.transform(
        found,
        lambda a: F.struct(
            F.lit("BANK_ACCOUNT").alias("label"), a["start"].alias("start"), a["stop"].alias("stop"),
            F.when(F.exists(biks, lambda b: near(a, b) & checksums.account_key(a["text"], b["text"])), F.lit(1.0)).otherwise(F.lit(0.7)).alias("score"),
            F.lit(order).alias("ord"), a["text"].alias("text"),
        ),
    )


def raw_findings(text: Column, labels: Sequence[str] | None = None) -> Column:
    """All findings of the rule table (or of some labels) before overlaps are resolved."""
    text = F.coalesce(text, F.lit(""))
    n = len(patterns.RULES)
    rules = [(i, r) for i, r in enumerate(patterns.RULES) if labels is None or r.label in labels]
    sought = [(r.pattern, r.group, r.gate(text)) for _, r in rules]
    parts = [lambda ms, at=at, i=i: _rule(i, F.get(ms, F.lit(at))) for at, (i, _) in enumerate(rules)]
    if labels is None or "SNILS" in labels:
        parts.append(lambda ms, at=len(sought): _formatted_snils(F.get(ms, F.lit(at))))
        sought.append((patterns.SNILS_FORMATTED, 0, text.rlike("[0-9]{3}-[0-9]{3}-[0-9]{3}")))
    if labels is None or "BANK_ACCOUNT" in labels:
        at, gate = len(sought), text.rlike("[0-9]{20}")
        sought += [(patterns.BIK_ANY, 0, gate), (patterns.ACCOUNT_KEYWORD, 1, gate), (patterns.ACCOUNT_BARE, 0, gate)]
        parts += [lambda ms, k=k: _bank_accounts(F.get(ms, F.lit(at + 1 + k)), F.get(ms, F.lit(at)), n + 1 + k) for k in (0, 1)]
    if not sought:
        return F.array().cast(spans.FINDING)
    return spans.let(spans.all_matches(text, sought), lambda ms: F.concat(*[p(ms) for p in parts]))


def detect(df: DataFrame, text_col: str = "text", labels: Sequence[str] | None = None, out: str = "findings") -> DataFrame:
    """``df`` plus the non-overlapping findings of its text. Null counts as empty. The raw findings are
    used once, so that no plan searches the text twice."""
    return df.withColumn(out, spans.without_overlaps(raw_findings(F.col(text_col), labels)))


def exploded(df: DataFrame, keys: Sequence[str], findings: str = "findings") -> DataFrame:
    """One row per finding. An outer explode, as for an inner one the planner infers a filter on the array's size and
    pushes it down, which would detect everything once more."""
    return df.select(*keys, F.explode_outer(findings).alias("f")).where("f is not null").select(*keys, "f.label", "f.start", "f.stop", "f.score", "f.text")


def disagreement(canonical: DataFrame, shadow: DataFrame, key: str) -> DataFrame:
    """Per key: findings (label, start, stop) of one detector that the other lacks, both ways, and label sets."""
    cols = [key, "label", "start", "stop"]
    a, b = canonical.select(*cols).distinct().withColumn("a", F.lit(1)), shadow.select(*cols).distinct().withColumn("b", F.lit(1))
    both = a.join(b, cols, "full_outer")
    return both.groupBy(key).agg(F.count(F.when(F.col("b").isNull(), 1)).alias("only_canonical"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_shadow")).where("only_canonical + only_shadow > 0")
