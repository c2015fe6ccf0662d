"""Text expressions: lines, paths, keywords, redaction, chat marks. All built-in functions, no UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP_WORDS = (
    "what where when why how who which this that these those from with about the and but for nor yet has have "
    "function class method variable code file does doing find search show tell explain"
).split()

#: What counts as a greeting, the whole text being one.
GREETING = (
    r"(?i)\A\s*(hi|hello|hey|howdy|sup|yo|hola|greetings|good\s*(morning|afternoon|evening|day)|what'?s?\s*up|hii+)\s*[!?.]*\s*\z"
)
#: The heading before follow-up suggestions, in its four spellings.
FOLLOW_UP_HEADING = r"(?i)(?:\n|\A)\s*(?:FOLLOW_UP_SUGGESTIONS|Follow-up suggestions|Follow up suggestions|Follow-up question)s?\s*:?\s*(?:\n|\z)"
FOLLOW_UP_MARK = "FOLLOW_UP_SUGGESTIONS:"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it, also from inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column) -> Column:
    """Lines of a text: split at LF or CRLF, without the empty one after a last line end; an empty text has none."""
    return bound(F.split(text, r"\r?\n"), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def extension(path: Column) -> Column:
    """Lower-case extension; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)\z", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def slug(path: Column) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, at most 80 characters."""
    return F.substring(F.regexp_replace(F.lower(path), r"[^\p{IsAlphabetic}\p{N}]+", "_"), 1, 80)


def keywords(query: Column, most: int = 20, chars: int = 1000) -> Column:
    """Words of more than three bytes in the first ``chars`` characters that are no stop words; order and repeats stay."""
    words = F.regexp_extract_all(F.substring(query, 1, chars), F.lit(r"[^\s\p{Punct}]+"), 0)
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.slice(F.filter(words, lambda w: (F.octet_length(w) > 3) & ~F.array_contains(stop, F.lower(w))), 1, most)


def redact(secret: Column) -> Column:
    """First and last few characters of a secret."""
    n = F.char_length(secret)
    show = F.least(F.lit(4), F.floor(n / 3)).cast("int")
    return F.when(n <= 8, F.concat(F.left(secret, F.lit(3)), F.lit("***"))).otherwise(
        F.concat(F.left(secret, show), F.lit("…"), F.right(secret, show))
    )


def is_greeting(text: Column) -> Column:
    return text.rlike(GREETING)


def cut_follow_ups(text: Column) -> Column:
    """The text before the first follow-up heading, right-trimmed; without a heading the text as it is."""
    found = F.regexp_instr(text, F.lit(FOLLOW_UP_HEADING))
    return F.when(found > 0, F.regexp_replace(F.substring(text, F.lit(1), found - 1), r"\s+\z", "")).otherwise(text)


def follow_ups(answer: Column, most: int = 3) -> Column:
    """Up to three suggestions after the mark: numbering and brackets stripped, those of up to five bytes dropped."""
    after = F.substring(answer, F.instr(answer, FOLLOW_UP_MARK) + len(FOLLOW_UP_MARK), F.lit(2**30))
    bare = F.transform(
        lines(after),
        lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"\A[0-9. ]+", ""), r"\A\[+|\]+\z", "")),
    )
    found = F.slice(F.filter(bare, lambda x: F.octet_length(x) > 5), 1, most)
    return F.when(F.contains(answer, F.lit(FOLLOW_UP_MARK)), found).otherwise(F.array().cast("array<string>"))


def think_segments(text: Column) -> Column:
    """Array of (type, content, complete): text outside and inside think tags, in order.

    Closed thoughts are trimmed; an unclosed one runs to the end, is left-trimmed
    and not complete.
    """
    pieces = F.split(text, "<think>")
    segment = lambda kind, content, complete: F.struct(F.lit(kind).alias("type"), content.alias("content"), complete.alias("complete"))
    whole = F.lit(None).cast("boolean")

    def of(piece: Column, i: Column) -> Column:
        end = F.instr(piece, "</think>")
        inside = segment("think", F.regexp_replace(F.substring(piece, F.lit(1), end - 1), r"\A\s+|\s+\z", ""), F.lit(True))
        after = segment("text", F.substring(piece, end + 8, F.lit(2**30)), whole)
        opened = segment("think", F.regexp_replace(piece, r"\A\s+", ""), F.lit(False))
        return F.when(i == 0, F.array(segment("text", piece, whole))).when(end > 0, F.array(inside, after)).otherwise(F.array(opened))

    return F.filter(F.flatten(F.transform(pieces, of)), lambda s: (s["type"] == "think") | (s["content"] != ""))


def fuzzy(text: Column, query: str) -> Column:
    """Whether the characters of ``query`` occur in ``text`` in order, whatever their case."""
    pattern = ".*".join(f"\\Q{c}\\E" for c in query.lower())
    return F.lower(text).rlike(f"(?s){pattern}")


def apply_edit(content: Column, original: Column, new: Column) -> Column:
    """``new`` where ``original`` is empty or there is no content, else all occurrences of ``original`` replaced."""
    return F.when(content.isNull() | (original == ""), new).otherwise(F.replace(content, original, new))


def read_slice(content: Column, start: int, end: int) -> Column:
    """(content, total_lines): lines from ``start`` up to ``end``, counted from 0; nothing if start is not below end."""
    own = lines(content)
    return F.struct(F.array_join(F.slice(own, start + 1, max(end - start, 0)), "\n").alias("content"), F.size(own).alias("total_lines"))
