"""Replacement rules in Markdown: one bullet per rule, original = replacement."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the form of a rule; back-quoted or bare, '=' or an arrow between
RULE = r"^\s*-\s*(?:`([^`]+)`|([^\s=→`][^=→]*?))\s*[=→]\s*(?:`([^`]+)`|([^\s].*?))\s*$"


def parse_rules(lines: DataFrame, team: str = "team_id", number: str = "line_no", line: str = "line") -> DataFrame:
    """team, line number, pattern, replacement, error (null where the line is a rule). Blank lines, headings and
    comments give no row; an ASCII arrow, another form or an empty side is an error."""
    t = F.trim(F.col(line))
    d = lines.where(~(t == "") & ~t.startswith("#") & ~t.startswith("<!--"))
    g = lambda i: F.regexp_extract(F.rtrim(F.col(line)), RULE, i)
    original = F.trim(F.when(g(1) != "", g(1)).otherwise(g(2)))
    replacement = F.trim(F.when(g(3) != "", g(3)).otherwise(g(4)))
    error = F.when(t.contains("->") & ~t.contains("=") & ~t.contains("→"), "ascii arrow").when(~F.rtrim(F.col(line)).rlike(RULE), "not a rule").when((original == "") | (replacement == ""), "empty side")
    return d.select(team, number, F.when(error.isNull(), original).alias("pattern"), F.when(error.isNull(), replacement).alias("replacement"), error.alias("error"))


def layered(team: DataFrame, profile: Iterable[tuple[str, str]], key: str = "team_id", at: str = "line_no") -> DataFrame:
    """A team's rules in file order, then those of its profile (a few, as ``Bundle.rules`` holds them): key, rule_no
    (from 1), pattern, replacement. Profiles only add. ``team`` has a row with a null pattern for a team without
    rules of its own."""
    own = team.where("pattern is not null").select(key, F.struct(F.lit(0).alias("l"), F.col(at).cast("long").alias("n"), "pattern", "replacement").alias("r"))
    shared = F.array(*[F.struct(F.lit(1).alias("l"), F.lit(i).cast("long").alias("n"), F.lit(a).alias("pattern"), F.lit(b).alias("replacement")) for i, (a, b) in enumerate(profile)]).cast("array<struct<l:int,n:bigint,pattern:string,replacement:string>>")
    every = team.select(key).distinct().select(key, F.explode(shared).alias("r"))
    rows = own.union(every).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return rows.select(key, F.posexplode("rs").alias("i", "r")).select(key, (F.col("i") + 1).alias("rule_no"), "r.pattern", "r.replacement")
