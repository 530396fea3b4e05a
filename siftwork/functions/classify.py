"""Rule-table classification: pattern hits per platform, arg-max, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalogues as cat
from .regex import contains_any_sql, java_pattern, literal_of, lower_folded_sql, sql_literal


def haystack(text: str, url: str) -> Column:
    """Lower-cased address and text in one string; NUL keeps a match from spanning both."""
    return F.expr(lower_folded_sql(f"concat({url}, '\\0', {text})"))


def haystack_of_folded(folded_text: str, url: str) -> Column:
    """The same of a text that is lower-cased and folded already: NUL is neither a letter nor a mark,
    so that the case of a letter never depends on what lies behind it."""
    return F.expr(f"concat({lower_folded_sql(url)}, '\\0', {folded_text})")


def _stem(pattern: str) -> str:
    """A literal that every match of the pattern holds (its text before the first operator)."""
    literal = literal_of(pattern)
    if literal is None:
        literal = pattern[: next(i for i, c in enumerate(pattern) if not c.isalnum())]
    return literal.lower()


def _found(hay: str, pattern: str) -> str:
    found = f"contains({hay}, {sql_literal(_stem(pattern))})"
    if literal_of(pattern) is None:
        found += f" AND rlike({hay}, {sql_literal(java_pattern(pattern, ignore_case=True))})"
    return f"int({found})"


def platform_scores(hay: str) -> Column:
    """Array of (platform, score, rules) in rule order, one element per platform.

    One pass looks for all stems together; a platform's patterns are tried only on texts that
    hold one of its stems."""

    def score(patterns) -> str:
        some = contains_any_sql(hay, [_stem(p) for p in patterns])
        return f"CASE WHEN {some} THEN {' + '.join(_found(hay, p) for p in patterns)} ELSE 0 END"

    def scores(score_of) -> str:
        entries = (
            f"named_struct('platform', {sql_literal(name)}, 'score', {score_of(patterns)}, 'rules', {len(patterns)})"
            for name, patterns in cat.PLATFORM_PATTERNS.items()
        )
        return f"array({', '.join(entries)})"

    stems = [_stem(p) for patterns in cat.PLATFORM_PATTERNS.values() for p in patterns]
    counted = scores(score)
    return F.expr(
        f"CASE WHEN {contains_any_sql(hay, stems)} THEN {counted} ELSE {scores(lambda patterns: '0')} END"
    )


def hit_scores(scores: str) -> Column:
    return F.expr(f"filter({scores}, s -> s.score > 0)")


def best_platform(scores: str) -> Column:
    """(platform, confidence) of the highest score; the earlier platform wins a tie."""
    start = f"named_struct('platform', {sql_literal(cat.UNKNOWN_PLATFORM)}, 'score', 0, 'rules', 1)"
    confidence = "round(least(best.score / double(best.rules), 1D), 2)"
    return F.expr(
        f"aggregate({scores}, {start}, (best, s) -> CASE WHEN s.score > best.score THEN s ELSE best END,"
        f" best -> named_struct('platform', best.platform, 'confidence', {confidence}))"
    )
