"""The rule table: labels, patterns, scores and cheap gates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checksums


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    score: float
    gate: Callable[[Column], Column]
    group: int = 0
    check: Callable[[Column], Column] | None = None


def _has(*literals: str) -> Callable[[Column], Column]:
    def gate(t):
        out = F.lit(False)
        for x in literals:
            out = out | t.contains(x)
        return out

    return gate


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda t: t.rlike(pattern)


# Patterns, in Java's syntax, with their labels and scores, in the order that breaks ties
RULES: tuple[Rule, ...] = (
    Rule("PEM_PRIVATE_KEY", r"(?U)-----BEGIN (?:[\w]+ )?PRIVATE KEY-----[\s\S]{1,8192}?-----END (?:[\w]+ )?PRIVATE KEY-----", 1.0, _has("PRIVATE KEY-----")),
    Rule("DB_URL", r"(?iU)(?:postgres(?:ql)?|mysql|mongodb|redis)://[^\s\"'<>]{3,}", 1.0, _has("://")),
    Rule("JWT", r"(?U)\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]*\b", 0.95, _has("eyJ")),
    Rule("API_KEY", r"(?U)\bsk-[A-Za-z0-9]{32,}\b", 1.0, _has("sk-")),
    Rule("API_KEY", r"(?U)\bAKIA[A-Z0-9]{16}\b", 1.0, _has("AKIA")),
    Rule("API_KEY", r"(?U)\bghp_[A-Za-z0-9]{36}\b", 1.0, _has("ghp_")),
    Rule("API_KEY", r"(?iU)(?:token|secret|api[_\-]?key|access[_\-]?key|private[_\-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9+/\-_]{20,}={0,2})", 0.85, _like("(?i)(?:token|secret|key)"), 1),
    Rule("TOKEN", r"(?iU)\bBearer\s+([A-Za-z0-9\-._~+/]{20,}={0,2})", 0.9, _like("(?i)bearer"), 1),
    Rule("PASSWORD", r"(?iU)(?:password|passwd|pwd|pass)\s*[=:]\s*[\"']?([^\s\"',;]{4,})", 0.9, _like("(?i)pass|pwd"), 1),
    Rule("CIDR", r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}/\d{1,2}\b", 1.0, _like(r"[0-9]/[0-9]"), 0, checksums.cidr),
    Rule("IP_ADDRESS", r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 1.0, _like(r"[0-9]\.[0-9]"), 0, checksums.ipv4),
    # any match of this pattern is an address
    Rule("IP_ADDRESS", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}|::)(?![0-9A-Fa-f:])", 0.9, _like("::|(?::[0-9A-Fa-f]{1,4}){7}")),
    Rule("HOSTNAME", r"(?iU)\b[\w][\w.\-]*\.(?:corp\.internal|corp\.lan|local|lan)\b", 0.7, _like(r"(?i)\.(?:corp|local|lan)")),
    Rule("OGRN", r"(?U)\b(?:[1-9]\d{12}|[1-9]\d{14})\b", 1.0, _like("[0-9]{13}"), 0, checksums.ogrn),
    Rule("RU_INN", r"(?U)\b(?:\d{10}|\d{12})\b", 1.0, _like("[0-9]{10}"), 0, checksums.inn),
    Rule("SNILS", r"(?U)СНИЛС\s+(\d{11})", 1.0, _has("СНИЛС"), 1, checksums.snils),
    Rule("BIK", r"(?U)\b04\d{7}\b", 0.95, _like("04[0-9]{7}"), 0, checksums.bik),
    Rule("KPP", r"(?U)\b\d{4}[0-9A-Z]{2}\d{3}\b", 0.9, _like("[0-9]{4}[0-9A-Z]{2}[0-9]{3}"), 0, checksums.kpp),
    Rule("EMAIL", r"(?U)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", 0.95, _has("@")),
    Rule("PHONE_NUMBER", r"(?U)(?<!\d)(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)", 0.9, _like(r"(?:\+7|8)[^A-Za-z]{9}")),
    Rule("PHONE_NUMBER", r"(?U)(?<!\d)\+[2-9]\d{6,14}(?!\d)", 0.85, _like(r"\+[2-9][0-9]{6}")),
)
# Patterns that need more than a rule, and how near a bank code has to be
SNILS_FORMATTED = r"(?U)\d{3}-\d{3}-\d{3}\s+\d{2}"
ACCOUNT_KEYWORD = r"(?iU)(?:р/?с(?:чёт|чет|ч)?[.\s]*№?\s*|(?:расчётный|расчетный)\s+счёт?\s*)(\d{20})"
ACCOUNT_BARE = r"(?U)\b(?:30|40|42|43|45)\d{18}\b"
BIK_ANY = r"(?U)\b04\d{7}\b"
BIK_REACH = 300
# Labels that an allow list can never free
SECRET_LABELS = ("API_KEY", "TOKEN", "PASSWORD", "JWT", "PEM_PRIVATE_KEY", "SECRET")
# Secrets that must not leave after masking
EGRESS = tuple(r.pattern for r in RULES[:1] + RULES[2:6])
# Keys that must never stand in an audit record
NEVER_FIELDS = ("mapping", "mapping_table", "pairs", "original_content", "unredacted_content", "pre_sanitization", "replace_md", "rule_values", "x_corp_auth", "corp_token", "authorization", "cookie", "set_cookie")
