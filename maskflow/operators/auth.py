"""Token checks and latest-version tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import temporal


def token_status(requests: DataFrame, tokens: DataFrame, at: str = "ts", lag_seconds: int = 0) -> DataFrame:
    """Requests with status and error code of their token, in this order: missing, unknown, revoked, expired, ok.
    Where lookups are cached for ``lag_seconds``, a revocation counts from when every cache has seen it."""
    t = tokens.select(F.col("token").alias("_token"), "user_id", "team_id", "expires_at", "revoked_at")
    d = requests.join(t, F.col("token") == F.col("_token"), "left")
    code = (
        F.when(F.col("token").isNull() | (F.col("token") == ""), "E_MISSING_TOKEN")
        .when(F.col("_token").isNull(), "E_TOKEN_INVALID")
        .when(F.col("revoked_at") + F.make_dt_interval(secs=F.lit(lag_seconds)) <= F.col(at), "E_TOKEN_REVOKED")
        .when(F.col("expires_at") <= F.col(at), "E_TOKEN_EXPIRED")
    )
    return d.withColumn("error_code", code).withColumn("status", F.when(code.isNull(), "ok").otherwise("failed")).drop("_token")


def token_status_as_of(requests: DataFrame, versions: DataFrame, at: str = "ts", lag_seconds: int = 0) -> DataFrame:
    """Requests with ``version``, status and error code by the version of their token that held ``lag_seconds`` before
    them, as a cached lookup still sees it. ``versions`` (token, since, revoked, ..) has a row per change; a token
    before its first version, or unknown, is invalid. See ``temporal.as_of``."""
    d = temporal.as_of(requests, versions, "token", F.col(at) - F.make_dt_interval(secs=F.lit(lag_seconds)))
    code = F.when(F.col("token").isNull() | (F.col("token") == ""), "E_MISSING_TOKEN").when(F.col("version").isNull(), "E_TOKEN_INVALID").when(F.col("version.revoked"), "E_TOKEN_REVOKED")
    return d.withColumn("error_code", code).withColumn("status", F.when(code.isNull(), "ok").otherwise("failed"))


def revoked(tokens: DataFrame, user: str, now: str) -> DataFrame:
    return tokens.withColumn("revoked_at", F.when((F.col("user_id") == user) & F.col("revoked_at").isNull(), F.lit(now).cast("timestamp")).otherwise(F.col("revoked_at")))


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` in place of those of ``table`` with the same key; of several changes the last (by _no)."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*table.columns), "_no").alias("r")).select("r.*")
    return table.join(last.select(key), key, "left_anti").select(*table.columns).union(last)
