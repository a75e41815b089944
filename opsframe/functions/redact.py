"""Redaction and withholding of secrets, and cuts that come after them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns whose whole match is replaced.
SECRETS = (
    r"(?i)\b(password|passwd|pwd)\b\s*[:=]\s*\S+",
    r"(?i)\b(api[_-]?key|apikey)\b\s*[:=]\s*\S+",
    r"(?i)\b(secret|token|access[_-]?key|client[_-]?secret)\b\s*[:=]\s*\S+",
    r"(?i)authorization:\s*bearer\s+\S+",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)jdbc:\S*password=\S+",
)
# Further patterns that withhold a value.
MORE_SECRETS = (
    r"(?i)\b(aws[_-]?secret[_-]?access[_-]?key)\b\s*[:=]\s*\S+",
    r"(?i)\b(aws[_-]?session[_-]?token)\b\s*[:=]\s*\S+",
    r"\bhvs\.[A-Za-z0-9]{20,}\b",
    r"\b[sb]\.[A-Za-z0-9]{24,}\b",
    r"(?i)authorization:\s*basic\s+\S+",
    r"(?i)\b(postgres|postgresql|redis|amqp|mongodb|mysql)://[^\s:@/]*:[^\s@]+@\S+",
    r"-----BEGIN(?:\s+\S+)?\s+PRIVATE KEY-----[\s\S]*?-----END(?:\s+\S+)?\s+PRIVATE KEY-----",
)
# Pattern and replacement of each sanitising rule, in order.
SANITISE = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", "[[REDACTED] PRIVATE KEY]"),
    (r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA|AIPA)[A-Z0-9]{16}\b", "[[REDACTED] AWS KEY ID]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", "[[REDACTED] JWT]"),
    (r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 [REDACTED]"),
    (r"(?i)\b(set-cookie|cookie)\s*:\s*[^\r\n]+", "$1: [REDACTED]"),
    (r"(://[^/\s:@]+:)([^@\s/]+)(@)", "$1[REDACTED]$3"),
    (r"(?i)\b([\w.-]*(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization)[\w.-]*)([\"']?\s*[:=]\s*[\"']?)([^\s\"'&,;}]+)", "$1$2[REDACTED]"),
)
SENSITIVE_NAME = "KEY|SECRET|TOKEN|PASSWORD|PWD|CREDENTIAL|AUTH"


def _any(patterns: tuple[str, ...]) -> str:
    """One pattern for all, each with its own flags: a text is looked through once."""
    return "|".join(f"(?:{p})" for p in patterns)


def redact_secrets(text: Column) -> Column:
    return F.when(text.rlike(_any(SECRETS)), reduce(lambda c, p: F.regexp_replace(c, p, "<redacted>"), SECRETS, text)).otherwise(text)


def cap_text(text: Column, n: int, marker: str = "...[truncated]") -> Column:
    """At most ``n`` characters and a marker; to be used after redaction only, or a secret's start could survive."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def sanitize_text(text: Column, max_chars: int | None = None) -> Column:
    """Values go, keys and separators stay; then the text is cut and the number of characters left out is added."""
    s = reduce(lambda c, rule: F.regexp_replace(c, *rule), SANITISE, text)
    if max_chars is None:
        return s
    cut = F.concat(F.substring(s, 1, max_chars), F.lit("...[truncated "), (F.length(s) - max_chars).cast("string"), F.lit(" chars]"))
    return F.when(F.length(s) > max_chars, cut).otherwise(s)


def sanitize_nested(value: Column, kind: T.DataType, max_chars: int | None = None) -> Column:
    """``sanitize_text`` on every string inside structs, arrays and map values."""
    if isinstance(kind, T.StringType):
        return sanitize_text(value, max_chars)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sanitize_nested(x, kind.elementType, max_chars))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: sanitize_nested(x, kind.valueType, max_chars))
    if isinstance(kind, T.StructType):
        fields = [sanitize_nested(value[f.name], f.dataType, max_chars).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def has_secret(text: Column) -> Column:
    return text.rlike(_any(SECRETS + MORE_SECRETS))


def looks_high_entropy(text: Column) -> Column:
    """A run of 32 or more token characters with three or more of lower, upper, digit, symbol."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_=-]{32,}"), F.lit(0))
    kinds = lambda t: reduce(Column.__add__, [t.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")])
    return F.exists(runs, lambda t: kinds(t) >= 3)


def withhold_if_secret(text: Column) -> Column:
    return F.when(~(has_secret(text) | looks_high_entropy(text)), text)


def redact_by_name(values: Column) -> Column:
    """Map values whose key names a secret are hidden."""
    return F.transform_values(values, lambda k, v: F.when(F.upper(k).rlike(SENSITIVE_NAME), F.lit("[REDACTED]")).otherwise(v))


def redact_env(containers: Column) -> Column:
    """Containers with ``env`` and ``envFrom`` replaced; all other fields stay."""
    return F.transform(containers, lambda c: c.withField("env", F.lit("[REDACTED]")).withField("envFrom", F.lit("[REDACTED]")))


def redact_secret_data(data: Column) -> Column:
    return F.transform_values(data, lambda _, v: F.lit("<redacted>"))
