"""Rules in Python's own regex syntax, for patterns that Java's does not know.

Such a rule runs in an Arrow stage, with Python's `re`, on every line of every text: there is no
cheap test that could leave texts out.  Its matches come back in the form in which the expressions of
:mod:`siftwork.functions.secrets` keep those of the other rules, and go through the same masking,
redaction and order."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogues import SecretRule
from .text import LINE_BREAK

HITS_TYPE = (
    "array<struct<line:int,found:struct<rule_pos:int,"
    "hits:array<struct<text:string,chars:int,keep:boolean>>,gaps:array<string>>>>"
)
_HIT = pa.struct([("text", pa.string()), ("chars", pa.int32()), ("keep", pa.bool_())])
_FOUND = pa.struct([("rule_pos", pa.int32()), ("hits", pa.list_(_HIT)), ("gaps", pa.list_(pa.string()))])
_LINES = pa.list_(pa.struct([("line", pa.int32()), ("found", _FOUND)]))
_BREAK = re.compile(LINE_BREAK)

# Constructs that Java refuses or reads in another way: named groups and references to them, groups
# that depend on another one, comments, flags other than i, m and s, quantifiers without a lower end,
# long escapes, named characters, octal zero.
_OTHER = re.compile(r"\(\?P|\(\?\(|\(\?#|\(\?[a-zA-Z-]*[aLux]|\{,\d|\\U|\\N|\\0")


def python_only(pattern: str) -> bool:
    """Whether a pattern has to be run by Python: it holds a construct that Java lacks, or a class
    that Java would read as a union or an intersection of classes."""
    plain = re.sub(r"\\[^UN0]", "..", pattern)
    if _OTHER.search(plain):
        return True
    classes = re.findall(r"\[\^?\]?([^\]]*)\]", plain)
    return any("[" in c or "&&" in c for c in classes)


def compiled(rule: SecretRule) -> re.Pattern:
    pattern = re.compile(rule.pattern, re.IGNORECASE if rule.ignore_case else 0)
    if pattern.match(""):
        raise ValueError(f"rule {rule.name!r} matches the empty text")
    return pattern


def _entropy(text: str) -> float:
    shares = [n / len(text) for n in Counter(text).values()]
    return -sum(p * math.log2(p) for p in shares)


def line_hits(text: str | None, rules: Sequence[tuple[int, re.Pattern, float]]) -> list[dict]:
    """Lines with matches, by rule: what matched, whether it counts, and the text between."""
    out = []
    for number, line in enumerate(_BREAK.split(text or "")):
        for position, pattern, threshold in rules:
            hits, gaps, end = [], [], 0
            for match in pattern.finditer(line):
                found = match[0]
                if not found:  # a place between characters is no credential
                    continue
                hits.append({"text": found, "chars": len(found), "keep": threshold <= 0 or _entropy(found) >= threshold})
                gaps.append(line[end : match.start()])
                end = match.end()
            if hits:
                out.append({"line": number, "found": {"rule_pos": position, "hits": hits, "gaps": [*gaps, line[end:]]}})
    return out


def hits(text: str, rules: Sequence[tuple[int, SecretRule]], slack: float) -> Column:
    """The matches of rules at the given positions, as an array of HITS_TYPE."""
    active = [(position, compiled(rule), max(rule.min_entropy - slack, 0.0)) for position, rule in rules]

    @F.arrow_udf(HITS_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([line_hits(t, active) for t in texts.to_pylist()], _LINES)

    return found(F.expr(text))
