"""Message matching: presets, literals, status codes, term filters, name globs."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Preset names and their patterns.
PRESETS = {
    "errors": r"(?i)(error|exception|fatal|severe)",
    "exceptions": r"(?i)(exception|stack ?trace|traceback|caused by)",
    "timeouts": r"(?i)(timeout|timed out|deadline exceeded)",
    "connection_problems": r"(?i)(connection refused|connection reset|broken pipe|unable to connect|no route to host)",
    "http_4xx": r"\b(400|401|403|404|405|408|409|410|413|414|429)\b",
    "http_5xx": r"\b(500|501|502|503|504)\b",
    "oom": r"(?i)(out ?of ?memory|oomkilled|oom-killed|java heap space|cannot allocate memory)",
    "auth_failures": r"(?i)(unauthorized|forbidden|authentication failed|access denied|invalid credentials|login failed)",
    "tls_errors": r"(?i)(handshake failure|certificate (expired|verify failed)|ssl error|tls error)",
    "dns_errors": r"(?i)(unknownhost|unknown host|name or service not known|nxdomain|dns resolution)",
}
_LITERAL = re.compile(r"[A-Za-z0-9 _.:=@\-]{1,64}")


@dataclass(frozen=True)
class Match:
    """What a message must hold: the preset, any literal or any status code; and none of the excluded literals.

    Literals are case-sensitive substrings.
    """

    preset: str | None = None
    contains: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    status_codes: tuple[int, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.preset is not None and self.preset not in PRESETS:
            raise ValueError(f"unknown preset {self.preset!r}")
        if not (self.preset or self.contains or self.status_codes):
            raise ValueError("at least one criterion is needed")
        if len(self.contains) > 3 or len(self.exclude) > 3:
            raise ValueError("at most three literals of a kind")
        if len(self.status_codes) > 8 or len(set(self.status_codes)) != len(self.status_codes):
            raise ValueError("at most eight different status codes")
        if any(not 100 <= c <= 599 for c in self.status_codes):
            raise ValueError("status codes lie between 100 and 599")
        for text in (*self.contains, *self.exclude):
            if not _LITERAL.fullmatch(text):
                raise ValueError(f"literal not allowed: {text!r}")

    def on(self, message: Column) -> Column:
        some = [message.rlike(PRESETS[self.preset])] if self.preset else []
        some += [message.contains(t) for t in self.contains]
        if self.status_codes:
            some.append(message.rlike(status_pattern(self.status_codes)))
        wanted = reduce(Column.__or__, some)
        return reduce(lambda c, t: c & ~message.contains(t), self.exclude, wanted)


def status_pattern(codes: tuple[int, ...]) -> str:
    return r"\b(" + "|".join(str(c) for c in codes) + r")\b"


def extract_status_code(message: Column, codes: tuple[int, ...]) -> Column:
    """The first of the asked codes in a message, else null."""
    return F.nullif(F.regexp_extract(message, status_pattern(codes), 1), F.lit(""))


def term_filter(message: Column, pattern: str) -> Column:
    """``ERROR``: contains the term; ``?timeout ?refused``: contains any of them; other forms are refused."""
    terms = pattern.split()
    if len(terms) == 1 and not terms[0].startswith("?"):
        return message.contains(terms[0])
    if terms and all(t.startswith("?") and len(t) > 1 for t in terms):
        return reduce(Column.__or__, [message.contains(t[1:]) for t in terms])
    raise ValueError(f"filter form not supported: {pattern!r}")


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored Java pattern."""
    return "^" + re.sub(r"\(\?s:(.*)\)\\[zZ]", r"(?s:\1)", fnmatch.translate(glob)) + "$"


def name_allowlist(name: Column, globs: tuple[str, ...]) -> Column:
    """Whether a name fits any glob, by case; without globs every name does."""
    return reduce(Column.__or__, [name.rlike(glob_pattern(g)) for g in globs]) if globs else F.lit(True)


def term_keys(text: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """The keys that have a term in a text, in the order of ``terms``; a null text has none.

    The text is bound once, so what it is computed from runs once for a row; each
    term is then a plain search for its bytes.
    """

    def own(s: Column) -> Column:
        found = [F.when(reduce(Column.__or__, [s.contains(t) for t in some]), key).otherwise("") for key, some in terms.items()]
        return F.array_remove(F.array(*found), "")

    return F.get(F.transform(F.array(F.coalesce(text, F.lit(""))), own), F.lit(0))
