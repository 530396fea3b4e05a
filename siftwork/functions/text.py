"""Small text expressions: lines, redaction, entropy, excerpts.

Functions ending in ``_sql`` take and give SQL expressions; they are used inside larger
expressions that are parsed in one piece, which plans far faster than thousands of Column calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalogues as cat
from .regex import let_sql, sql_literal

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lines_sql(text: str) -> str:
    parts = let_sql(
        "parts",
        f"split({text}, {sql_literal(LINE_BREAK)}, -1)",
        "CASE WHEN element_at(parts, -1) = '' THEN slice(parts, 1, size(parts) - 1) ELSE parts END",
    )
    return f"CASE WHEN {text} = '' THEN cast(array() AS array<string>) ELSE {parts} END"


def lines(text: str) -> Column:
    """Lines of a text: every Unicode line boundary ends one, a final boundary opens none."""
    return F.expr(lines_sql(text))


def content_hash(text: str) -> Column:
    return F.sha2(F.expr(text), 256)


def content_length(text: str) -> Column:
    return F.char_length(F.expr(text))


def redact_sql(secret: str) -> str:
    return (
        f"CASE WHEN char_length({secret}) <= 8 THEN '****' "
        f"ELSE concat(left({secret}, 4), '****', right({secret}, 4)) END"
    )


def redact(secret: str) -> Column:
    return F.expr(redact_sql(secret))


def shannon_entropy_sql(text: str) -> str:
    p = f"(char_length({text}) - char_length(replace({text}, c, ''))) / double(char_length({text}))"
    return (
        f"CASE WHEN char_length({text}) = 0 THEN 0D ELSE aggregate(transform(array_distinct("
        f"split({text}, '')), c -> {p}), 0D, (acc, p) -> acc - p * log2(p)) END"
    )


def shannon_entropy(text: str) -> Column:
    """Bits per character; 0 for the empty text.  Frequencies come from native string
    replacement per distinct character, so the cost is linear in the text."""
    return F.expr(shannon_entropy_sql(text))


def excerpt(text: str, chars: int = cat.EXCERPT_CHARS) -> Column:
    return F.substring(F.expr(text), 1, chars)


def tags_csv(tags: str) -> Column:
    return F.array_join(F.expr(tags), ",")
