"""Block reasons of configuration files and log dumps, and the egress check, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns

# Patterns and thresholds
FENCES = (("config:env", r"env|dotenv|\.env"), ("log:dump", r"log|logs|access_?log|syslog"), ("config:nginx", r"nginx|nginx\.conf"), ("config:ini", r"ini|toml|cfg|conf"))
ENV_LINE = r"(?U)^[A-Z_][A-Z0-9_]*\s*="
KUBE_API, KUBE_KIND = r"(?U)\bapiVersion\s*:\s*\S+", r"(?U)\bkind\s*:\s*[A-Z][A-Za-z]+\b"
KUBE_CLUSTERS, KUBE_CONTEXTS = r"(?mdU)^clusters\s*:", r"(?mdU)^contexts\s*:"
NGINX_SERVER, NGINX_LOCATION = r"(?U)\bserver\s*\{", r"(?U)\blocation\s+[/~\w]"
INI_SECTION, INI_PAIR = r"(?U)^\s*\[[A-Za-z0-9_.\-]+\]\s*$", r"(?U)^\s*[A-Za-z_][A-Za-z0-9_.\-]*\s*[=:]\s*\S"
LOG_TIME = r"(?U)(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}|\[\d{2}/[A-Za-z]{3}/\d{4})"
LOG_LEVEL = r"(?U)\b(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE|FATAL|CRITICAL)\b"
FRAMES = r"(?U)\bat \w[\w.]+\.\w+\(|File \"[^\"]+\", line \d+|\s+at \w[\w.]*\s+\("
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines_of(text: Column) -> Column:
    """Lines as Python's splitlines() gives them: a line end at the end opens no further line."""
    parts = F.split(text, F.lit(LINE_END), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _count(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def block_reason(text: Column, lines: Column) -> Column:
    """The first reason that holds, or null."""
    out = None
    for code, tags in FENCES:
        hit = text.contains("```") & text.rlike(rf"(?imd)^```[ \t]*(?:{tags})[ \t]*$")
        out = F.when(hit, code) if out is None else out.when(hit, code)
    blank = lambda x: x.rlike(r"(?U)^\s*$")
    env = F.filter(lines, lambda x: ~blank(x) & ~x.rlike(r"(?U)^\s*#"))
    n_env = _count(env, ENV_LINE)
    ini = F.filter(lines, lambda x: ~blank(x) & ~x.rlike(r"(?U)^\s*[#;]"))
    times, levels, frames = _count(lines, LOG_TIME), _count(lines, LOG_LEVEL), _count(lines, FRAMES)
    return (
        out.when((F.size(env) >= 3) & (n_env >= 3) & (n_env > 0.5 * F.size(env)), "config:env")
        .when((text.rlike(KUBE_API) & text.rlike(KUBE_KIND)) | (text.rlike(KUBE_CLUSTERS) & text.rlike(KUBE_CONTEXTS)), "config:kube")
        .when(text.rlike(NGINX_SERVER) & text.rlike(NGINX_LOCATION), "config:nginx")
        .when((_count(lines, INI_SECTION) >= 2) & (F.size(ini) > 0) & (_count(ini, INI_PAIR) > 0.4 * F.size(ini)), "config:ini")
        .when((F.size(lines) >= 5) & (((times >= 5) & (levels >= 4)) | ((times >= 8) & (times > 0.6 * F.size(lines))) | (frames >= 5)), "log:dump")
    )


def classify(df: DataFrame, text_col: str = "text", out: str = "block_reason") -> DataFrame:
    """``df`` plus its block reason; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("_lines", lines_of(text)).withColumn(out, block_reason(text, F.col("_lines"))).drop("_lines")


def egress_reason(text: Column, canaries: list[str]) -> Column:
    """dlp:canary if a canary pattern is found, else dlp:secret_leak if a secret is, else null."""
    canary = F.lit(False)
    for p in canaries:
        canary = canary | text.rlike(p)
    secret = F.lit(False)
    for p in patterns.EGRESS:
        secret = secret | text.rlike(p)
    return F.when(canary, "dlp:canary").when(secret, "dlp:secret_leak")
