"""A training corpus from raw documents: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.llm import decontam, secrets, simhash, tokens, toxicity
from maskflow.llm.common import table, written
from maskflow.session import ship


def any_names(stage):
    """The stage on rows whose other columns have plain names while it runs, so that theirs may clash with names
    that operators use, or hold dots. The columns come back as they were, in their order."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in ("doc_id", "text") else f"other{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

    return run


@any_names
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples vote toxic go; all others stay as they are."""
    index = toxicity.fit_on_training_rows(ship(spark), docs, sf_dir)
    return toxicity.scored(docs, index).where("_score < 0.5").drop("_score")


@any_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays, once; a group without ids
    keeps one row."""
    ship(spark)
    fps = written(simhash.with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "_fp"), "simhash")
    stay = fps.join(simhash.near_duplicates(fps), "_fp").where(F.col("doc_id").eqNullSafe(F.col("component")))
    # of fingerprints in a group that share the smallest id, and of repeated rows, one stays
    stay = stay.groupBy("doc_id", "component").agg(F.min("_fp").alias("_fp2")).select(F.col("doc_id").alias("_id2"), "_fp2")
    kept = simhash.with_fingerprints(docs).join(stay, (F.col("_fp") == F.col("_fp2")) & F.col("doc_id").eqNullSafe(F.col("_id2")))
    return kept.dropDuplicates(["doc_id", "_fp"]).select(*docs.columns)


@any_names
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(docs, table(ship(spark), sf_dir, "benchmark"))
    return found.where(~decontam.contaminated()).select(*docs.columns)


@any_names
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mask; every document stays."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return tokens.packed(written(tokens.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack)]

#: Fingerprints, neighbours and tokens have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
