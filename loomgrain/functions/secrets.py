"""Secret scanner: ten rules, byte offsets, redacted previews. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import redact

#: Name and pattern of each rule, earlier ones first. Group 1 stands before the secret, group 2 is the secret.
RULES = [
    ("AWS Access Key", r"(\A|[^A-Z0-9])(AKIA[0-9A-Z]{16})(?:[^A-Z0-9]|\z)"),
    ("AWS Secret Key", r"(?i)((?:aws_secret_access_key|secret_key)\s*[=:]\s*)([A-Za-z0-9/+=]{40})"),
    ("GitHub Token", r"()((?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,255})"),
    ("OpenAI/OpenRouter Key", r"()(sk-(?:or-v1-)?[A-Za-z0-9]{20,})"),
    ("API Key / Bearer Token", r"""(?i)((?:api[_-]?key|bearer|authorization|token|secret)\s*[=:]\s*['"]?)([A-Za-z0-9_\-]{20,})['"]?"""),
    ("Slack Token", r"()(xox[bporas]-[0-9]{10,}-[A-Za-z0-9\-]+)"),
    ("Private Key", r"()(-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----)"),
    ("JWT Token", r"()(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_\-]+)"),
    ("Connection String", r"()((?:postgres|mysql|mongodb|redis)://[^\s@]+:[^\s@]+@[^\s]+)"),
    ("Password", r"""(?i)((?:password|passwd|pwd)\s*[=:]\s*['"]?)([^\s'"]{8,})['"]?"""),
]

#: For each rule, strings of which every match has one. A plain search for them spares most texts the pattern.
HINTS = [("AKIA",), ("=", ":"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("sk-",), ("=", ":"), ("xox",), ("PRIVATE",), ("eyJ",), ("://",), ("=", ":")]


def _hinted(text: Column, order: int) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in HINTS[order]])


def _has(text: Column, order: int) -> Column:
    return _hinted(text, order) & text.rlike(RULES[order][1])


def has_secret(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [_has(text, k) for k in range(len(RULES))])


def _matches(text: Column, order: int, kind: str, pattern: str) -> Column:
    """Struct array (offset, order, kind, preview) of one rule: lengths of the pieces between matches give the offsets.

    The text is searched for the matches and for what lies between them; the groups are taken from the matches.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    rows = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("whole"))
    none = F.array().cast("array<struct<offset: bigint, order: int, kind: string, preview: string>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, row: Column) -> Column:
        at = acc["at"] + F.octet_length(row["gap"])
        before, secret = (F.regexp_extract(row["whole"], pattern, g) for g in (1, 2))
        found = F.struct((at + F.octet_length(before)).cast("bigint").alias("offset"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), redact(secret).alias("preview"))
        return F.struct((at + F.octet_length(row["whole"])).cast("bigint").alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    return F.when(_hinted(text, order), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(none)


def secrets(text: Column) -> Column:
    """Array of (kind, preview, offset) by byte offset; of two rules at one offset the earlier rule counts."""
    found = F.array_sort(F.flatten(F.array(*(_matches(text, k, kind, p) for k, (kind, p) in enumerate(RULES)))))
    first = F.filter(found, lambda x, i: (i == 0) | (x["offset"] != F.get(found, i - 1)["offset"]))
    return F.transform(first, lambda x: F.struct(x["kind"].alias("kind"), x["preview"].alias("preview"), x["offset"].alias("offset")))
