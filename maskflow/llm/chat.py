"""Chat formatting by prefix-target expansion, in native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: One turn: OPEN role CLOSE text END. Control strings inside roles and texts get one more '!' after their first
#: character, so none is left bare; unescaping takes one '!' away.
OPEN, CLOSE, END = "<s>[ROLE]", "[/ROLE]", "</s>"
CONTROL = r"([<\[])(!*)(/?(?:s>|ROLE\]|INST\]))"
ESCAPED = r"([<\[])!(!*)(/?(?:s>|ROLE\]|INST\]))"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "$1!$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per turn: conv, turn, role, text, _segment (the formatted turn), _start and _stop (its place in the
    formatted conversation, in code points), and for each target turn an example: _example long (from 0),
    _loss_start and _loss_stop (the reply's text, the only trainable part). The example's text is the formatted
    conversation up to _stop: all preceding turns are its context. Contexts are given by place, since to copy them
    into each example would square a long conversation's size; ``examples`` copies them where that is wanted.

    Turns are ordered by turn, role, text (nulls first); repeated rows stay. Null roles and texts count as empty,
    rows with a null conversation id form one conversation. A conversation without a target turn has no example.
    Extra columns are dropped."""
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    body = escape(F.col("text"))
    t = t.withColumn("_head", F.length(head).cast("long")).withColumn("_body", F.length(body).cast("long")).withColumn("_segment", F.concat(head, body, F.lit(END)))
    w = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    is_target = F.col("role") == target
    t = t.withColumn("_start", F.coalesce(F.sum(F.length("_segment").cast("long")).over(w), F.lit(0).cast("long")))
    t = t.withColumn("_example", F.when(is_target, F.coalesce(F.sum(is_target.cast("long")).over(w), F.lit(0).cast("long"))))
    t = t.withColumn("_stop", F.col("_start") + F.length("_segment"))
    t = t.withColumn("_loss_start", F.when(is_target, F.col("_start") + F.col("_head")))
    return t.withColumn("_loss_stop", F.col("_loss_start") + F.col("_body")).drop("_head", "_body")


def rendered(expanded: DataFrame) -> DataFrame:
    """One row per conversation: conv, formatted, examples array<struct<example,start,stop,loss_start,loss_stop,segment>>
    in order. A conversation is one training document, so its turns meet in one row; those of a null id are one
    conversation, repeated rows repeat their turns, other columns are dropped, and no rows give no rows."""
    rows = F.array_sort(F.collect_list(F.struct("_start", "_stop", "_example", "_loss_start", "_loss_stop", "_segment")))
    g = expanded.groupBy("conv").agg(rows.alias("rows"))
    return g.select(
        "conv",
        F.array_join(F.transform("rows", lambda r: r["_segment"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["_example"].isNotNull()), lambda r: F.struct(r["_example"].alias("example"), r["_start"].alias("start"), r["_stop"].alias("stop"), r["_loss_start"].alias("loss_start"), r["_loss_stop"].alias("loss_stop"), r["_segment"].alias("segment"))).alias("examples"),
    )


def exploded(rows: DataFrame) -> DataFrame:
    """One row per example of rendered conversations, other columns of ``rows`` kept: example, context (the code
    points of the formatted conversation before the reply, as a place: from 0 to context), reply_segment, and _loss,
    the text under the example's loss mask, unescaped. A conversation without a target turn keeps one row, with nulls.

    The rows stay where their conversation is, so that a later grouping by conversation moves nothing."""
    e = rows.select("*", F.explode_outer("examples").alias("_e")).drop("examples")
    trainable = F.call_function("substring", F.col("_e.segment"), (F.col("_e.loss_start") - F.col("_e.start")).cast("int") + 1, (F.col("_e.loss_stop") - F.col("_e.loss_start")).cast("int"))
    return e.select(*[c for c in e.columns if c != "_e"], F.col("_e.example").alias("example"), F.col("_e.start").alias("context"), F.col("_e.segment").alias("reply_segment"), F.col("_e.loss_start").alias("loss_start"), F.col("_e.loss_stop").alias("loss_stop"), unescape(trainable).alias("_loss"))


def examples(expanded: DataFrame) -> DataFrame:
    """Each example with its context copied: conv, example, context, reply_segment, loss_start, loss_stop (code
    points of context + reply_segment)."""
    e = exploded(rendered(expanded)).where("example is not null")
    return e.select("conv", "example", F.call_function("substring", F.col("formatted"), F.lit(1), F.col("context").cast("int")).alias("context"), "reply_segment", "loss_start", "loss_stop")


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role,text>>."""
    turns = F.filter(F.split(formatted, F.lit(END), -1), lambda s: s != "")
    return F.transform(turns, lambda s: F.struct(unescape(F.call_function("substring", s, F.lit(len(OPEN) + 1), F.call_function("locate", F.lit(CLOSE), s) - len(OPEN) - 1)).alias("role"), unescape(F.call_function("substring", s, F.call_function("locate", F.lit(CLOSE), s) + len(CLOSE), F.length(s))).alias("text")))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    r = rendered(expand(turns)).withColumn("turns", parsed(F.col("formatted")))
    digests = r.select(
        "conv",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "examples",
    )
    losses = F.array_sort(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "_loss"))))
    each = exploded(digests).groupBy("conv").agg(*[F.first(c).alias(c) for c in ("n_turns", "turns_sha256", "formatted_chars")], losses.alias("losses"))
    each = each.withColumn("_loss", F.array_join(F.transform("losses", lambda x: x["_loss"]), ""))
    return each.select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars", F.size("losses").cast("long").alias("n_examples"))


#: The same rows by another path; escapes are counted, not made.
OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
             sum(20 + length(regexp_replace(role, '([<\[])(!*)(/?(?:s>|ROLE\]|INST\]))', '\1!\2\3', 'g')) + length(regexp_replace(text, '([<\[])(!*)(/?(?:s>|ROLE\]|INST\]))', '\1!\2\3', 'g'))) AS f,
             count(*) FILTER (role = 'assistant') AS e FROM c GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, f::BIGINT AS formatted_chars, e AS n_examples FROM g"""
