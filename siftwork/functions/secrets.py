"""Credential detection inside one row: no shuffle, and no Python worker unless a user's rule needs one.

A document is split into lines only if one of its rules can match at all.  Findings carry the
redacted form and a context in which every character that belongs to any finding is masked; the
matched text itself never leaves the expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogues as cat
from ..catalogues import SecretRule
from . import pyrules
from .regex import contains_any_sql, java_pattern, let_sql, sql_literal
from .text import LINE_BREAK, redact_sql, shannon_entropy_sql

# Entropies that equal a threshold up to rounding pass it.
_EPS = 1e-12
_CHUNK = 256
#: Column with the matches of rules that only Python can run.
PYTHON_HITS = "_python_hits"

FINDINGS_TYPE = (
    "array<struct<rule_pos:int,line:int,start:int,rule:string,redacted:string,context:string>>"
)
_NO_FINDINGS = f"cast(array() AS {FINDINGS_TYPE})"
LINE_HITS_TYPE = (
    "array<struct<line:int,text:string,found:array<struct<rule_pos:int,"
    "hits:array<struct<text:string,chars:int,keep:boolean>>,gaps:array<string>>>>>"
)
_NO_HITS = f"cast(array() AS {LINE_HITS_TYPE})"
# Line ends other than the newline.
_OTHER_BREAK = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _python_rules(rules: Sequence[SecretRule]) -> list[tuple[int, SecretRule]]:
    return [(p, rule) for p, rule in enumerate(rules) if pyrules.python_only(rule.pattern)]


def with_python_hits(docs: DataFrame, text: str, rules: Sequence[SecretRule] = cat.SECRET_RULES) -> DataFrame:
    """The rows, with a column of matches if any rule needs Python; the functions below expect it.

    (The optimizer copies no expression out of a generator: each text goes to Python once.)"""
    special = _python_rules(rules)
    if not special:
        return docs
    return docs.select("*", F.explode_outer(F.array(pyrules.hits(text, special, _EPS))).alias(PYTHON_HITS))


def _letters(members: str) -> str | None:
    """A class of ASCII characters with all of them spelled out, which Java tests by one table look-up,
    a class with ranges range by range; None if it may hold others."""
    if not members.isascii() or re.search(r"\\[A-Za-z0-9]", members):
        return None
    return "".join(re.escape(c) for c in map(chr, range(128)) if re.match(members, c))


def _run(rule: SecretRule) -> tuple[str, str] | None:
    """(letters, least length) of a pattern that is a plain run of ASCII characters."""
    run = re.fullmatch(r"(\[(?!\^)[^\[\]]+\])\{(\d+),\}", rule.pattern)
    letters = run and not rule.ignore_case and _letters(run[1])
    return (letters, run[2]) if letters else None


def _java(rule: SecretRule) -> str:
    if re.compile(rule.pattern).match(""):
        raise ValueError(f"rule {rule.name!r} matches the empty text")
    if run := _run(rule):
        return java_pattern(f"[{run[0]}]{{{run[1]},}}")
    return java_pattern(rule.pattern, ignore_case=rule.ignore_case)


def _existence(text: str, rule: SecretRule) -> str:
    """Whether the rule's pattern is found in a text.

    For a run of at least n characters only its start is tried, at the head of the text or behind
    another character: a fifth of the time of the pattern itself on prose."""
    if not (run := _run(rule)):
        return f"rlike({text}, {sql_literal(_java(rule))})"
    letters, n = run
    first, later = (java_pattern(p) for p in (f"^[{letters}]{{{n}}}", f"[^{letters}][{letters}]{{{n}}}"))
    return f"(rlike(left({text}, {n}), {sql_literal(first)}) OR rlike({text}, {sql_literal(later)}))"


def _document_level(rule: SecretRule) -> bool:
    """Whether a match in a line is also a match in the whole text (no anchors, no look-around)."""
    plain = re.sub(r"\\[^A-Za-z]|\[\^", "", rule.pattern)
    return not re.search(r"[\^$]|\(\?[=!<]|\\[bBAZ]", plain)


def _gate(text: str, haystack: str, rule: SecretRule) -> str:
    """Necessary condition for a rule to match somewhere in the document."""
    if pyrules.python_only(rule.pattern):
        return f"(size({PYTHON_HITS}) > 0)"
    conditions = []
    if rule.needles:
        conditions.append(contains_any_sql(haystack, rule.needles))
    if _document_level(rule):
        conditions.append(_existence(text, rule))
    return "(" + " AND ".join(conditions or ["true"]) + ")"


def rule_gates(text: str, haystack: str, rules: Sequence[SecretRule] = cat.SECRET_RULES) -> Column:
    """Array of gates, one per rule.  One pass looks for all literals together; most documents
    hold none, and only rules without a literal are tried on them.

    `haystack` is the :func:`~siftwork.functions.regex.needle_text` of the text.  Give the result
    a name in a projection of its own and hand that to :func:`line_hits`."""
    special = {p for p, _ in _python_rules(rules)}
    needles = [n for p, rule in enumerate(rules) for n in rule.needles if p not in special]
    every = "array(" + ", ".join(_gate(text, haystack, rule) for rule in rules) + ")"
    if not needles:
        return F.expr(every)
    bare = "array(" + ", ".join("false" if r.needles and p not in special else _gate(text, haystack, r) for p, r in enumerate(rules)) + ")"
    return F.expr(f"CASE WHEN {contains_any_sql(haystack, needles)} THEN {every} ELSE {bare} END")


def _running_totals(chunk: str, first: str) -> str:
    return (
        f"aggregate({chunk}, named_struct('total', {first}, 'sums', cast(array() AS array<int>)),"
        " (acc, n) -> named_struct('total', acc.total + n, 'sums', concat(acc.sums, array(acc.total + n))),"
        " acc -> acc.sums)"
    )


def _prefix_sums(steps: str) -> str:
    """Running totals; in chunks, because appending to one long array copies it every time."""
    totals = _running_totals("transform(chunks, k -> aggregate(k, 0, (acc, n) -> acc + n))", "0")
    in_chunks = let_sql(
        "chunks",
        f"transform(sequence(1, size({steps}), {_CHUNK}), at -> slice({steps}, at, {_CHUNK}))",
        let_sql(
            "firsts",
            f"concat(array(0), {totals})",
            f"flatten(transform(chunks, (k, o) -> {_running_totals('k', 'firsts[o]')}))",
        ),
    )
    return f"CASE WHEN size({steps}) <= {_CHUNK} THEN {_running_totals(steps, '0')} ELSE {in_chunks} END"


def _rule_hits(line: str, position: int, rule: SecretRule) -> str:
    """Matches of one rule in a line: texts, which of them count, and the gaps around them."""
    pattern = sql_literal(_java(rule))
    keep = f"{shannon_entropy_sql('m')} >= {rule.min_entropy - _EPS!r}D" if rule.min_entropy > 0 else "true"
    return (
        f"named_struct('rule_pos', {position}, 'hits', transform(regexp_extract_all({line}, {pattern}, 0),"
        f" m -> named_struct('text', m, 'chars', char_length(m), 'keep', {keep})),"
        f" 'gaps', split({line}, {pattern}, -1))"
    )


def _hits_per_rule(line: str, gates: str, rules: Sequence[SecretRule]) -> str:
    """What the rules find in line number `i`."""
    special = {p for p, _ in _python_rules(rules)}
    cases = ", ".join(
        f"CASE WHEN {gates}[{p}] AND {_existence(line, rule)}"
        f" THEN {_rule_hits(line, p, rule)} END"
        for p, rule in enumerate(rules)
        if p not in special
    )
    by_python = f"transform(filter({PYTHON_HITS}, h -> h.line = i), h -> h.found)"
    if not cases:
        return by_python
    found = f"array_compact(array({cases}))"
    return f"concat({found}, {by_python})" if special else found


def _masked_chars(line: str, found: str) -> str:
    """Characters of the line; those of any counted match are stars."""
    starred = (
        "array_join(zip_with(r.gaps, r.hits, (gap, h) -> concat(gap, CASE WHEN h IS NULL THEN ''"
        " WHEN h.keep THEN repeat('*', h.chars) ELSE h.text END)), '')"
    )
    return (
        f"aggregate({found}, split({line}, ''), (acc, r) -> zip_with(acc, split({starred}, ''),"
        " (a, b) -> CASE WHEN b = '*' THEN b ELSE a END))"
    )


def _line_findings(line: str, rules: Sequence[SecretRule], mask_context: bool) -> str:
    """Findings of one line of :func:`line_hits`."""
    names = "array(" + ", ".join(sql_literal(rule.name) for rule in rules) + ")"
    around = cat.CONTEXT_CHARS
    middle = redact_sql("q.hit.text") if mask_context else "q.hit.text"
    one = (
        f"named_struct('rule_pos', r.rule_pos, 'line', {line}.line + 1, 'start', q.start,"
        f" 'rule', {names}[r.rule_pos], 'redacted', {redact_sql('q.hit.text')}, 'context', concat("
        f"array_join(slice(chars, q.start - least(q.start, {around}) + 1, least(q.start, {around})), ''),"
        f" {middle}, array_join(slice(chars, q.start + q.hit.chars + 1, {around}), '')))"
    )
    steps = (
        "transform(r.hits, (h, j) -> char_length(r.gaps[j])"
        " + CASE WHEN j > 0 THEN r.hits[j - 1].chars ELSE 0 END)"
    )
    starts = let_sql("steps", steps, _prefix_sums("steps"))
    of_rule = (
        f"transform(filter(zip_with({starts}, r.hits, (s, h) -> named_struct('start', s, 'hit', h)),"
        f" q -> q.hit.keep), q -> {one})"
    )
    return let_sql("chars", f"split({line}.text, '')", f"flatten(transform({line}.found, r -> {of_rule}))")


def _split_lines(text: str) -> str:
    """Lines of a text, an empty one behind a final line end; most texts have no line end but the
    newline, at which a text is cut without a regex."""
    return (
        f"CASE WHEN rlike({text}, {sql_literal(_OTHER_BREAK)}) THEN split({text}, {sql_literal(LINE_BREAK)}, -1)"
        f" ELSE split({text}, '\\n', -1) END"
    )


def line_hits(
    text: str, gates: str, rules: Sequence[SecretRule] = cat.SECRET_RULES, masked: bool = True
) -> Column:
    """The lines in which a rule matches, in order, as an array of LINE_HITS_TYPE: number from 0, text
    (`masked`: with every counted match starred out) and matches by rule.

    Findings and the masked document are both made of it, so that the rules run once."""
    if not rules:
        return F.expr(_NO_HITS)
    each = f"named_struct('line', i, 'text', ln, 'found', {_hits_per_rule('ln', gates, rules)})"
    hits = f"filter(transform({_split_lines(text)}, (ln, i) -> {each}), x -> size(x.found) > 0)"
    if masked:
        starred = f"array_join({_masked_chars('x.text', 'x.found')}, '')"
        hits = f"transform({hits}, x -> named_struct('line', x.line, 'text', {starred}, 'found', x.found))"
    return F.expr(f"CASE WHEN array_contains({gates}, true) THEN {hits} ELSE {_NO_HITS} END")


def findings(hits: str, rules: Sequence[SecretRule] = cat.SECRET_RULES, mask_context: bool = True) -> Column:
    """Findings as an array in (rule, line, offset) order.

    `hits` names the column made by :func:`line_hits` from the same rules.  With ``mask_context=False``
    (and lines that are not masked) the context is the raw surrounding text, secret included; never
    write that to a table.
    """
    if not rules:
        return F.expr(_NO_FINDINGS)
    one = _line_findings("x", rules, mask_context)
    return F.expr(
        f"CASE WHEN size({hits}) > 0 THEN array_sort(flatten(transform({hits}, x -> {one}))) ELSE {_NO_FINDINGS} END"
    )


def has_secrets(found: str) -> Column:
    return F.size(F.expr(found)) > 0


def mask_document(text: str, hits: str) -> Column:
    """The text with every finding starred out, length and line ends kept: the form to export.

    `hits` names the column made by :func:`line_hits`, with masked lines.  Only these lines are put in
    the place of the text's own; those between them are taken as they are."""
    before = f"CASE WHEN k > 0 THEN {hits}[k - 1].line ELSE -1 END"
    up_to = f"concat(slice(lns, {before} + 2, x.line - {before} - 1), array(x.text))"
    last = f"element_at({hits}, -1).line"
    rest = f"slice(lns, {last} + 2, size(lns) - {last} - 1)"
    replaced = f"flatten(concat(transform({hits}, (x, k) -> {up_to}), array({rest})))"
    line_break = sql_literal(LINE_BREAK)
    ends = f"regexp_extract_all({text}, {line_break}, 0)"
    by_newline = let_sql("lns", f"split({text}, '\\n', -1)", f"array_join({replaced}, '\\n')")
    by_any = let_sql(
        "lns",
        f"split({text}, {line_break}, -1)",
        f"array_join(zip_with({replaced}, {ends}, (ln, line_end) -> concat(ln, coalesce(line_end, ''))), '')",
    )
    return F.expr(
        f"CASE WHEN size({hits}) > 0 THEN CASE WHEN rlike({text}, {sql_literal(_OTHER_BREAK)})"
        f" THEN {by_any} ELSE {by_newline} END ELSE {text} END"
    )
