"""Classification of log lines, severities, normalised messages and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe.functions.match import term_keys

# Categories in the order in which they are tried, and their patterns.
RULES = (
    ("oom_killed", r"(?i)\bOOMKilled\b"),
    ("crash_loop", r"(?i)\bCrashLoopBackOff\b"),
    ("readiness_liveness_failure", r"(?i)\b(readiness|liveness)\s+probe\s+(failed|error)\b"),
    ("scheduling_failure", r"(?i)\b(FailedScheduling|Insufficient\s+(cpu|memory)|no\s+nodes\s+available)\b"),
    ("redis_error", r"(?i)\bredis\b.*\b(error|exception|timeout|refused)\b|\bNOAUTH\b|\bWRONGTYPE\b"),
    ("search_error", r"(?i)\b(solr|elasticsearch|elastic\s*search).*\b(error|exception|failed|timeout)\b"),
    ("database_error", r"(?i)\b(sqlexception|sql\s+error|deadlock\s+detected|ora-\d{4,5}|db2\s?\d{4,5}|connection\s+pool\s+exhausted|jdbc\S*\s*(error|exception))\b"),
    ("authentication_failure", r"(?i)\b(authentication\s+failed|unauthorized|401|invalid\s+credentials|access\s+denied|login\s+failed)\b"),
    ("connection_failure", r"(?i)\b(connection\s+refused|connection\s+reset|connection\s+closed|unable\s+to\s+connect|no\s+route\s+to\s+host|could\s+not\s+connect)\b"),
    ("timeout", r"(?i)\b(timeout|timed\s+out)\b"),
    ("upstream_downstream_failure", r"(?i)\b(upstream|downstream|backend)\b.*\b(error|unavailable|failed|refused)\b"),
    ("http_5xx", r"\"\s*5\d{2}\b|status(?:Code)?[=:\s]+5\d{2}\b"),
    ("http_4xx", r"\"\s*4\d{2}\b|status(?:Code)?[=:\s]+4\d{2}\b"),
    ("stack_trace", r"^\s*at\s+[\w.$]+\(.*\)\s*$"),
    ("jvm_application_error", r"\b(OutOfMemoryError|StackOverflowError|NoClassDefFoundError|FATAL|SEVERE)\b"),
    ("exception", r"\b[\w.$]*Exception\b"),
    ("generic_error", r"\bERROR\b"),
)
UNCLASSIFIED = "unclassified"
# Categories by severity; all others are medium.
HIGH = ("oom_killed", "crash_loop", "scheduling_failure", "readiness_liveness_failure", "connection_failure", "database_error", "redis_error", "search_error")
LOW = ("generic_error", "http_4xx")
EXCEPTION_LIKE = ("exception", "jvm_application_error", "database_error", "redis_error", "search_error")
# What varies between lines of one message, and its mark.
VARIABLE = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\[\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\]", "<TS>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b\d{4,}\b", "<NUM>"),
)
# Words in a free description that name a component.
COMPONENT_HINTS = {
    "ts-app": ("ts-app", "transaction server", "transaction"), "crs-app": ("crs-app", "crs", "store server", "rest api"),
    "ts-web": ("ts-web",), "store-web": ("store-web", "storefront", "store front"), "search-app": ("search", "solr", "elastic"),
    "cache-app": ("cache-app", "dynacache"), "nginx": ("nginx", "ingress", "4xx", "5xx", " http "), "redis": ("redis", "session store"),
    "tooling-web": ("tooling",), "wcbd": ("wcbd",), "utils": (" utils",),
}
DEFAULT_COMPONENTS = ("ts-app", "crs-app", "ts-web", "store-web")


def strip(text: Column) -> Column:
    """Without white space at both ends; SQL's trim takes spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def classify_line(line: Column) -> Column:
    """Category of the first rule that the stripped line fits; ``unclassified`` for others, null for blank lines."""

    def first(s: Column) -> Column:
        out = F.when(s == "", F.lit(None).cast("string"))
        for category, pattern in RULES:
            out = out.when(s.rlike(pattern), category)
        return out.otherwise(F.when(s.isNotNull(), UNCLASSIFIED))

    # The stripped line is bound once: written out for each rule it would outgrow a generated method.
    return F.get(F.transform(F.array(strip(line)), first), F.lit(0))


def severity_rank(category: Column) -> Column:
    return F.when(category.isin(*HIGH), 0).when(category.isin(*LOW), 2).otherwise(1)


def severity_of(category: Column) -> Column:
    return F.when(category.isin(*HIGH), "high").when(category.isin(*LOW), "low").otherwise("medium")


def normalize_message(line: Column) -> Column:
    for pattern, mark in VARIABLE:
        line = F.regexp_replace(line, pattern, mark)
    return line


def exception_class(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"([\w.$]*(?:Exception|Error))\b", 1), F.lit(""))


def frame_signature(line: Column) -> Column:
    """A stack frame without its file and line."""
    return strip(F.regexp_replace(line, r"\([^)]*\)", ""))


def stack_fingerprint(category: Column, exception: Column, message: Column, signature: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    seed = F.when(category == "stack_trace", F.concat_ws("|", F.lit("stack_trace"), empty(signature)))
    return F.substring(F.sha2(seed.otherwise(F.concat_ws("|", category, empty(exception), empty(message))), 256), 1, 16)


def infer_components(text: Column) -> Column:
    """Components that a free text hints at, in table order; the default ones if none."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    default = F.array(*map(F.lit, DEFAULT_COMPONENTS))
    # Bound once: a condition and its value would search the text twice.
    return F.get(F.transform(F.array(term_keys(low, COMPONENT_HINTS)), lambda found: F.when(F.size(found) > 0, found).otherwise(default)), F.lit(0))


def confidence(pods_total: Column, pods_running: Column, n_categories: Column) -> Column:
    # The grades, in the order in which they are tried.
    return (
        F.when(pods_total == 0, "none - no matching pods found for this component")
        .when(pods_running == 0, "low - no pods currently Running; only cluster-state evidence available, no live logs")
        .when(n_categories == 0, "low - pods running, no error patterns matched in the scanned log window")
        .when(n_categories >= 2, "medium - multiple error categories observed")
        .otherwise("low")
    )


def pod_state(phase: Column, waiting: Column, restarts: Column) -> Column:
    return (
        F.when(waiting == "CrashLoopBackOff", "crash_looping").when(waiting.isin("ImagePullBackOff", "ErrImagePull"), "image_pull_backoff")
        .when(waiting.isNotNull(), F.concat(F.lit("waiting:"), waiting)).when((phase == "Running") & (restarts > 0), "running_with_restarts")
        .when(phase == "Running", "running_stable").otherwise(F.coalesce(F.lower(phase), F.lit("unknown")))
    )


def event_type_name(code: Column) -> Column:
    names = {1: "Error", 2: "Warning", 4: "Information", 8: "Audit Success", 16: "Audit Failure"}
    out = F.coalesce(*[F.when(code == k, v) for k, v in names.items()])
    return F.coalesce(out, code.cast("string"))


def fmt_bytes(n: Column) -> Column:
    out = None
    for i, unit in enumerate(("B", "KiB", "MiB", "GiB", "TiB")):
        # exact halves go to the even digit, which the format alone would round up
        text = F.format_string("%d B", n) if i == 0 else F.format_string(f"%.2f {unit}", F.bround(n / float(1024**i), 2))
        out = F.when(n < 1024 ** (i + 1), text) if out is None else out.when(n < 1024 ** (i + 1), text) if i < 4 else out.otherwise(text)
    return out


def price(n_bytes: Column, per_gb: float) -> Column:
    return F.round(n_bytes / 1e9 * per_gb, 6)
