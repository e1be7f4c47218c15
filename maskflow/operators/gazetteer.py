"""Terms in texts, by lower-cased word sequences and by parts of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans

# Parts of identifiers
IDENTIFIER = r"[A-Z]{2,}(?=[A-Z][a-z]|\d|[_\-]|$)|[A-Z][a-z\d]*|[a-z\d]+"
SCORE = 0.95
#: Terms of a few words each, so some megabytes at most.
BROADCAST_TERMS = 50_000


def tokens(text: Column) -> Column:
    """Words with offsets: array<struct<start,stop,text>>."""
    return spans.matches(text, r"(?U)\w+")


def identifier_parts(name: Column) -> Column:
    return spans.matches(name, IDENTIFIER)


def term_table(terms: DataFrame, lemma=F.lower) -> DataFrame:
    """terms (term_no, term, label) -> (seq array<string>, n, label, term_no); the first of equal sequences counts.
    ``lemma`` turns a word into what is compared; texts must use the same."""
    seq = F.transform(F.regexp_extract_all("term", F.lit(r"(?U)\w+"), F.lit(0)), lambda w: lemma(w))
    t = terms.select(seq.alias("seq"), "label", "term_no").where("size(seq) > 0")
    return t.groupBy("seq").agg(F.min_by("label", "term_no").alias("label"), F.min("term_no").alias("term_no")).withColumn("n", F.size("seq"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def hits(df: DataFrame, key: str, terms: DataFrame, text_col: str = "text", longest: int | None = None, lemma=F.lower) -> DataFrame:
    """key, label, start, stop, how: each occurrence of a term, overlaps included. ``key`` is carried along; it need
    not tell rows apart.

    Words get their offsets once, and each goes on with as many words after it as the longest term has, not with its
    text. Words that no term begins with are dropped next; those that stay are joined to the terms by equality, so
    cost does not grow with the number of terms, and a text costs as much as it has words. Up to BROADCAST_TERMS terms
    are broadcast, and then a row is not moved; more are joined by a shuffle of the words. A caller may leave out terms
    of more than ``longest`` words."""
    table = terms.select("seq", "label", F.size("seq").alias("n"))
    table = table if longest is None else table.where(F.col("n") <= longest)
    most = int(table.agg(F.max("n")).first()[0] or 1)
    hint = F.broadcast if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else lambda t: t.hint("merge")
    firsts = hint(table.groupBy(F.get("seq", F.lit(0)).alias("_x")).agg(F.collect_set("n").alias("_lengths")))
    names, single = hint(table.select(F.col("seq").alias("_seq"), "label")), hint(table.where("n = 1").select(F.get("seq", F.lit(0)).alias("_x"), "label"))
    slim = lambda ws: F.transform(ws, lambda w: F.struct(w["stop"].alias("stop"), lemma(w["text"]).alias("x")))
    runs = lambda ws: spans.let(slim(ws), lambda xs: F.transform(ws, lambda w, i: F.struct(w.alias("w"), F.slice(xs, i + 1, most).alias("run"))))
    d = df.select(key, spans.let(tokens(F.coalesce(F.col(text_col), F.lit(""))), runs).alias("_r"))
    each = d.select(key, F.explode_outer("_r").alias("_r")).where("_r is not null").select(key, "_r.w", "_r.run", F.get("_r.run", F.lit(0))["x"].alias("_x"))  # outer: see detect.exploded
    begun = each.join(firsts, "_x").select(key, "w", "run", F.explode("_lengths").alias("_n")).where(F.col("_n") <= F.size("run"))
    begun = begun.select(key, F.col("w.start").alias("start"), F.get("run", F.col("_n") - 1)["stop"].alias("stop"), F.transform(F.slice("run", F.lit(1), F.col("_n")), lambda w: w["x"]).alias("_seq"))
    found = begun.join(names, "_seq").select(key, "label", "start", "stop", F.lit("term").alias("how"))
    # only words that hold a change of case, a digit, a dash or an underscore can have parts
    parts = each.where(F.col("w.text").rlike("[a-z0-9][A-Z]|[A-Z]{2}[a-z0-9]|[^A-Za-z]")).select(key, "w", identifier_parts(F.col("w.text")).alias("_q")).where("size(_q) > 1")
    parts = parts.select(key, "w", F.explode_outer("_q").alias("_q")).select(key, lemma(F.col("_q.text")).alias("_x"), (F.col("w.start") + F.col("_q.start")).alias("start"), (F.col("w.start") + F.col("_q.stop")).alias("stop"))
    return found.union(parts.join(single, "_x").select(key, "label", "start", "stop", F.lit("identifier").alias("how")))
