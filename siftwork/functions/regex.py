"""From Python patterns to Spark patterns, and the string helpers that go with them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python counts the four information separators as white space, Java does not.
SPACE = r"\s\x1c-\x1f"


def java_pattern(pattern: str, *, ignore_case: bool = False, dotall: bool = False) -> str:
    """Java form of a Python pattern: same white space, line ends, case folding and anchors."""
    flags = "dU" + ("iu" if ignore_case else "") + ("s" if dotall else "")
    changed = {r"\Z": r"\z", r"\s": f"[{SPACE}]"}
    # Escape by escape, so that an escaped backslash before a letter stays what it is.
    body = re.sub(r"(?s)\\.", lambda m: changed.get(m[0], m[0]), pattern)
    return f"(?{flags}){body}"


def literal_of(pattern: str) -> str | None:
    """The plain text a pattern stands for, or None if it holds real regex operators."""
    bare = re.sub(r"\\[^A-Za-z0-9]", "", pattern)
    if re.search(r"[\\.^$*+?{}\[\]|()]", bare):
        return None
    return re.sub(r"\\(.)", r"\1", pattern)


def sql_literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def let_sql(name: str, value: str, body: str) -> str:
    """Bind an intermediate value inside one expression, so that it is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


EMPTY_STRINGS = "cast(array() AS array<string>)"


def strip_sql(text: str) -> str:
    """Remove Unicode white space at both ends (`trim` only removes blanks)."""
    return f"regexp_replace({text}, {sql_literal(f'(?U)^[{SPACE}]+|[{SPACE}]+$')}, '')"


def strip(text: str) -> Column:
    return F.expr(strip_sql(text))


def _folded_sql(lowered: str) -> str:
    return f"replace(replace({lowered}, 'ſ', 's'), 'ı', 'i')"


def lower_folded_sql(text: str) -> str:
    """Lower-cased text in which the two letters that equal ASCII ones when case is ignored
    (long s, dotless i) are spelled in ASCII, so that substring tests can replace
    case-insensitive searches."""
    return _folded_sql(f"lower({text})")


def folded(lowered: str) -> Column:
    """The same of a text that is in lower case already."""
    return F.expr(_folded_sql(lowered))


def _needles_sql(folded_text: str) -> str:
    return f"replace({folded_text}, 'i̇', 'i')"


def needle_text(text: str) -> Column:
    """Text in which every case-insensitive ASCII literal of `text` is a plain substring.
    Used only to skip work early: it may find more than the pattern, never less."""
    return F.expr(_needles_sql(lower_folded_sql(text)))


def needles_of_folded(folded_text: str) -> Column:
    """The same of a text that is lower-cased and folded already."""
    return F.expr(_needles_sql(folded_text))


def minimal_needles(needles) -> list[str]:
    """Needles without those that hold another one: if any occurs, one of the rest does."""
    distinct = list(dict.fromkeys(needles))
    return [n for n in distinct if not any(o != n and o in n for o in distinct)]


def _ahead(words) -> str:
    """Look-ahead that holds where one of the words can start: a class of letters for each of the
    first places (up to four) that all words have.  Few places of a text pass it, and a class of
    single letters is one table look-up."""
    places = zip(*(w[:4] for w in words))
    return "(?=" + "".join("[" + "".join(map(re.escape, sorted(set(letters)))) + "]" for letters in places) + ")"


def _branches(words) -> str:
    """Pattern of several words, none the start of another, in which common beginnings stand once."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(c) + (_branches(rest) if all(rest) else "") for c, rest in groups.items()]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def contains_any_sql(haystack: str, needles) -> str:
    """Whether one of the literals occurs.  A few are plain substring tests, and so are a few short
    ones among many; from five on, one regex pass whose look-ahead rejects most positions is cheaper."""
    needles = minimal_needles(needles)
    plain = needles if len(needles) < 5 else [n for n in needles if len(n) < 3]
    if len(plain) >= 5:
        plain = []
    tests = [f"contains({haystack}, {sql_literal(n)})" for n in plain]
    others = [n for n in needles if n not in plain]
    if others:
        tests.append(f"rlike({haystack}, {sql_literal(_ahead(others) + _branches(others))})")
    return "(" + " OR ".join(tests) + ")"


# Letters that equal these ASCII ones when case is ignored, besides the capitals.
_FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def starting_with(pattern: str, starts) -> str:
    """A Java pattern, tried only where one of the given lower-case texts starts, in any case.  Every
    match has to start with one of them, so that the matches stay the same."""
    places = ({form for c in letters for form in (c, c.upper(), *_FOLDED.get(c, ""))} for letters in zip(*starts))
    ahead = "(?=" + "".join("[" + "".join(map(re.escape, sorted(p))) + "]" for p in places) + ")"
    # In front of the pattern's flags: a class that ignores case would fold the letter of every position.
    return ahead + pattern
