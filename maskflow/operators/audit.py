"""Audit records, the gate against originals, fan-out to sinks and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns
from .leaves import token_usage
from .mask import family

# Component of each error code
COMPONENTS = {
    "E_CORP_LLM_DOWN": "corp_llm", "E_NER_UNAVAILABLE": "ner", "E_PROFILE_UNAVAILABLE": "profile", "E_MISSING_TOKEN": "auth", "E_TOKEN_EXPIRED": "auth",
    "E_TOKEN_REVOKED": "auth", "E_TOKEN_INVALID": "auth", "E_AUTH": "auth", "E_PROVIDER_BLOCKED": "provider", "E_POLICY_BLOCKED": "policy",
    "E_OVERSIZE_BLOCKED": "oversize", "E_DLP_BLOCKED": "dlp", "E_BAD_REQUEST": "request",
}
# Keys of a record
ALWAYS = ("timestamp", "request_id", "user_id", "team_id", "provider", "model", "latency_ms", "prompt_token_count", "completion_token_count", "redaction_count", "finding_label_counts", "cache_a_hit", "gateway_version", "status")
CONDITIONAL = ("placeholder_list", "error_code", "block_reason", "corp_llm_latency_ms", "pre_pass_latency_ms", "audit_buffer_full", "profile_ids", "jurisdiction")


def component(error_code: Column) -> Column:
    out = F.lit("other")
    for code, name in COMPONENTS.items():
        out = F.when(error_code == code, name).otherwise(out)
    return out


def redactions(placeholders: DataFrame, request: str = "request_id", original: str = "original", placeholder: str = "placeholder") -> DataFrame:
    """Per request: distinct redactions, their label histogram as a map, and the sorted placeholders. Two levels of
    aggregation, the first of which combines before the shuffle; no originals come out."""
    d = placeholders.select(request, placeholder).distinct().withColumn("label", family(F.col(placeholder)))
    labels = d.groupBy(request, "label").agg(F.count("*").cast("int").alias("n"), F.collect_list(placeholder).alias("p"))
    return labels.groupBy(request).agg(F.sum("n").alias("redaction_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("finding_label_counts"), F.array_sort(F.flatten(F.collect_list("p"))).alias("placeholder_list"))


def events(requests: DataFrame, state: DataFrame, placeholders: DataFrame, version: str) -> DataFrame:
    """Audit records of requests: one per request_id, the first by its end.

    requests (request_id, model, start, stop, response, status, error_code) are what was handled; state (request_id,
    user_id, team_id, provider, model, cache_a_hit, error_code, block_reason, profile_ids) is what masking knew, one
    row per request; placeholders (request_id, original, placeholder) are its pairs, of which no original comes out.
    A request without state has an unknown user and team; one without pairs has no redactions. The error of the
    response goes before that of masking."""
    first = requests.groupBy("request_id").agg(F.min_by(F.struct("model", "start", "stop", "response", "status", "error_code"), F.struct("stop", "start")).alias("r"))
    known = state.select("request_id", F.struct("user_id", "team_id", "provider", "model", "cache_a_hit", "error_code", "block_reason", "profile_ids").alias("s"))
    d = first.join(known, "request_id", "left").join(redactions(placeholders), "request_id", "left")
    tokens = token_usage(F.col("r.response"))
    return d.select(
        F.col("r.stop").alias("timestamp"), "request_id",
        F.coalesce("s.user_id", F.lit("unknown")).alias("user_id"), F.coalesce("s.team_id", F.lit("unknown")).alias("team_id"), F.coalesce("s.provider", F.lit("anthropic")).alias("provider"),
        F.coalesce("s.model", F.nullif("r.model", F.lit("")), F.lit("unknown")).alias("model"), latency_ms(F.col("r.start"), F.col("r.stop")).alias("latency_ms"),
        tokens["prompt"].alias("prompt_token_count"), tokens["completion"].alias("completion_token_count"),
        F.coalesce("redaction_count", F.lit(0).cast("long")).alias("redaction_count"), F.coalesce("finding_label_counts", F.create_map().cast("map<string,int>")).alias("finding_label_counts"),
        F.coalesce("s.cache_a_hit", F.lit(False)).alias("cache_a_hit"), F.lit(version).alias("gateway_version"), F.col("r.status").alias("status"), "placeholder_list",
        F.coalesce("r.error_code", "s.error_code").alias("error_code"), F.col("s.block_reason").alias("block_reason"), F.coalesce("s.profile_ids", F.array().cast("array<string>")).alias("profile_ids"),
    )


def latency_histogram(records: DataFrame, edges: tuple[float, ...], latency: str = "latency_ms", by: str = "status") -> DataFrame:
    """Requests per status and bucket (le: the least edge that is not below the latency, null above all)."""
    le = F.lit(None).cast("double")
    for e in sorted(edges, reverse=True):
        le = F.when(F.col(latency) <= e, F.lit(float(e))).otherwise(le)
    return records.groupBy(by, le.alias("le")).agg(F.count("*").alias("n"))


def cumulative(histogram: DataFrame, edges: tuple[float, ...], by: str = "status") -> DataFrame:
    """A histogram as scrapers expect it: for each group a row per edge, empty ones included, and one for all (le +Inf),
    with the number of requests up to the edge. A group has as many rows as there are edges, whatever it counts."""
    les = F.array(*[F.lit(float(e)) for e in sorted(edges)], F.lit(float("inf")))
    every = histogram.select(by).distinct().select(by, F.explode(les).alias("le"))
    known = histogram.select(F.col(by).alias("_by"), F.coalesce("le", F.lit(float("inf"))).alias("_le"), "n")
    up_to = Window.partitionBy(by).orderBy("le").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = every.join(known, F.col(by).eqNullSafe(F.col("_by")) & (F.col("le") == F.col("_le")), "left")
    return joined.select(by, F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")).alias("le"), F.sum(F.coalesce("n", F.lit(0))).over(up_to).alias("n"))


def failure_windows(records: DataFrame, failed: Column, ts: str = "timestamp", minutes: int = 5) -> DataFrame:
    """Windows in which there was a failure, with their number."""
    return records.where(failed).groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def completeness(requests: DataFrame, stored: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per month: requests that did not fail, those of them that have a stored record, and their share."""
    d = requests.where("status <> 'failed'").select("request_id", F.date_trunc("month", ts).alias("month")).join(stored.select("request_id", F.lit(1).alias("_s")).distinct(), "request_id", "left")
    return d.groupBy("month").agg(F.count("*").alias("requests"), F.count("_s").alias("stored")).withColumn("share", F.col("stored") / F.col("requests"))


def latency_ms(start: Column, stop: Column) -> Column:
    return F.greatest(F.lit(0), (F.unix_micros(stop) - F.unix_micros(start)) / 1000).cast("long")


def record_json(columns: list[str]) -> Column:
    """One line of JSON; conditional keys that are null or empty are left out, the others stay."""
    have = [c for c in (*ALWAYS, *CONDITIONAL) if c in columns]
    return F.to_json(F.struct(*[F.when(F.size(c) > 0, F.col(c)).alias(c) if c == "profile_ids" else F.col(c) for c in have]))


def flat_never(record: Column) -> Column:
    """True if a top-level key of a JSON record must never be audited."""
    keys = F.transform(F.json_object_keys(record), lambda k: F.regexp_replace(F.lower(k), "-", "_"))
    return F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, patterns.NEVER_FIELDS))), F.lit(False))


def never_field(record: Column) -> Column:
    """As flat_never at any depth. The record is written anew from its parsed form, in which only quotes, backslashes
    and control characters are escaped; with escapes masked, every quoted string is a token, and those before a colon
    are keys. A record that does not parse (a key that stands twice, say) is read as it is."""
    plain = F.regexp_replace(F.coalesce(F.to_json(F.try_parse_json(record)), record), r"\\.", "\x01")
    tokens = F.regexp_extract_all(plain, F.lit(r'"[^"]*"\s*:?'), F.lit(0))
    keys = F.transform(F.filter(tokens, lambda t: t.endswith(":")), lambda t: F.regexp_replace(F.lower(F.regexp_extract(t, r'"([^"]*)"', 1)), "-", "_"))
    names = "|".join(n.replace("_", "[-_]") for n in patterns.NEVER_FIELDS)
    likely = F.coalesce(record.rlike(rf'(?i)"(?:{names})"\s*:') | record.contains("\\u"), F.lit(False))
    return F.when(likely, F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, patterns.NEVER_FIELDS))), F.lit(False))).otherwise(F.lit(False))


def gated(records: DataFrame, record: str) -> tuple[DataFrame, DataFrame]:
    """(passing, quarantined) records."""
    d = records.withColumn("_never", never_field(F.col(record)))
    return d.where(~F.col("_never")).drop("_never"), d.where("_never").select(F.sha2(record, 256).alias("record_sha256"))


def parsed_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Log lines to audit records: JSON objects with a request id and a redaction count and no forbidden key; lines
    that are no JSON keep a mark and no content."""
    v = F.try_parse_json(F.col(line))
    d = lines.withColumn("unparsable", v.isNull()).withColumn("request_id", F.try_variant_get(v, "$.request_id", "string")).withColumn("redaction_count", F.try_variant_get(v, "$.redaction_count", "long"))
    shaped = F.col("request_id").isNotNull() & F.col("redaction_count").isNotNull()
    return d.withColumn("audit", ~F.col("unparsable") & F.coalesce(shaped, F.lit(False)) & ~flat_never(F.col(line)))


def trace_events(records: DataFrame) -> DataFrame:
    """Each record as two ingestion events: a trace, and the generation below it. The generation's id derives from
    the request's, so that a second attempt makes the same events."""
    has = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    trace = F.struct(F.lit("trace-create").alias("type"), F.col("request_id").alias("trace_id"), F.lit("maskflow").alias("name"), F.array(F.concat(F.lit("team:"), has("team_id", "string")), F.concat(F.lit("provider:"), has("provider", "string"))).alias("tags"), F.lit(None).cast("long").alias("tokens"))
    total = F.coalesce(has("prompt_token_count", "long"), F.lit(0)) + F.coalesce(has("completion_token_count", "long"), F.lit(0))
    generation = F.struct(F.lit("generation-create").alias("type"), F.col("request_id").alias("trace_id"), F.concat(has("provider", "string"), F.lit("-call")).alias("name"), F.array().cast("array<string>").alias("tags"), total.cast("long").alias("tokens"))
    return records.select(F.explode(F.array(trace, generation)).alias("event")).select("event.*")


def once(records: DataFrame, order: str = "timestamp") -> DataFrame:
    """One record per request, the first by time."""
    return records.groupBy("request_id").agg(F.min_by(F.struct(*[c for c in records.columns if c != "request_id"]), order).alias("r")).select("request_id", "r.*")


def request_id(body: Column, *paths: str) -> Column:
    """The first id at the given paths of a JSON payload that is not empty, else a hash of the payload (a random id
    would differ between attempts of a task)."""
    v = F.try_parse_json(body)
    tries = [F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths or ("$.litellm_call_id", "$.litellm_params.litellm_call_id", "$.metadata.request_id", "$.litellm_metadata.request_id", "$.request_id")]
    return F.coalesce(*tries, F.sha2(body, 256))


def health(checks: DataFrame, *by: str) -> DataFrame:
    """ok if there is no check or all are healthy, unhealthy if none is, else degraded; of all, or by some columns."""
    return checks.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("healthy").alias("up")).select(*by, F.when((F.col("n") == 0) | (F.col("up") == F.col("n")), "ok").when(F.col("up") == 0, "unhealthy").otherwise("degraded").alias("status"))
