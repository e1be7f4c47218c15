"""Rules, terms, allow lists and logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import parse_rules

# Label of each term file
TERM_FILES = {"products.txt": "PRODUCT", "regulated.txt": "REGULATED", "markings.txt": "CONFIDENTIAL_MARK"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """One file <team>.md per team; a team without a file has no rows and so no rules."""
    lines = _lines(spark, f"{folder}/*.md").select(F.regexp_extract("file", r"^(.*)\.md$", 1).alias("team_id"), (F.col("line_no") + 1).alias("line_no"), "line")
    return parse_rules(lines)


def rules_of(teams: DataFrame, loaded: DataFrame, key: str = "team_id") -> DataFrame:
    """``teams`` plus ``rules`` array<struct<pattern,replacement>> in file order; empty for a team without a file."""
    good = loaded.where("pattern is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "pattern", "replacement"))).alias("_r"))
    kind = "array<struct<pattern:string,replacement:string>>"
    listed = F.transform("_r", lambda r: F.struct(r["pattern"].alias("pattern"), r["replacement"].alias("replacement")))
    return teams.join(good, key, "left").withColumn("rules", F.coalesce(listed, F.array().cast(kind)).cast(kind)).drop("_r")


def requests(spark: SparkSession, path: str, key: str = "request_id") -> DataFrame:
    """Chat requests from lines of JSON: key (see ``audit.request_id``) and body, the line as it is."""
    from ..operators.audit import request_id

    return spark.read.text(path).where("trim(value) <> ''").select(request_id(F.col("value")).alias(key), F.col("value").alias("body"))


def terms(spark: SparkSession, folder: str) -> DataFrame:
    """term_no, term, label; lines that start with # are comments. Files count in name order."""
    d = _lines(spark, f"{folder}/*.txt").withColumn("term", F.trim("line")).where("term <> '' and not startswith(term, '#')")
    label = F.create_map(*[F.lit(x) for p in TERM_FILES.items() for x in p])
    names = F.array(*map(F.lit, sorted(TERM_FILES)))
    return d.where(F.array_contains(names, F.col("file"))).select((F.array_position(names, F.col("file")) * 1_000_000 + F.col("line_no")).alias("term_no"), "term", label[F.col("file")].alias("label"))


def allow_list(spark: SparkSession, listed: str = "", path: str | None = None) -> DataFrame:
    """Originals of a comma-separated list and of a file's lines."""
    d = spark.createDataFrame([(x.strip(),) for x in listed.split(",") if x.strip()], "original string")
    if path:
        d = d.union(spark.read.text(path).select(F.trim("value")).where("trim(value) <> ''"))
    return d.distinct()


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)
