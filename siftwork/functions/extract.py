"""Prompt blocks, persona, technologies and constraints of a text.

Functions take the text and its :func:`~siftwork.functions.regex.needle_text` as SQL expressions
(usually column names) and give a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalogues as cat
from .markup import element_texts
from .regex import EMPTY_STRINGS, contains_any_sql, java_pattern, sql_literal, starting_with, strip_sql


def _all(text: str, haystack: str, pattern: str, needles, group: int = 0) -> str:
    """All matches of a pattern; the regex runs only on texts that hold one of the needles."""
    return (
        f"CASE WHEN {contains_any_sql(haystack, needles)} THEN"
        f" regexp_extract_all({text}, {sql_literal(pattern)}, {group}) ELSE {EMPTY_STRINGS} END"
    )


def _prompt(text: str, haystack: str, pattern: str, needles) -> str:
    return _all(text, haystack, java_pattern(pattern, ignore_case=True, dotall=True), needles)


def _assign_sql(text: str, haystack: str) -> str:
    return _prompt(text, haystack, cat.PROMPT_ASSIGN, ("prompt",))


def _section_sql(text: str, haystack: str) -> str:
    return _prompt(text, haystack, cat.PROMPT_SECTION, ("#",))


def _system_tag_sql(text: str, haystack: str) -> str:
    return _prompt(text, haystack, cat.PROMPT_SYSTEM_TAG, ("<system>",))


def _persona_span_sql(text: str, haystack: str) -> str:
    return _prompt(text, haystack, cat.PROMPT_PERSONA_SPAN, ("you are", "act as", "assistant is"))


def prompt_assign(text: str, haystack: str) -> Column:
    return F.expr(_assign_sql(text, haystack))


def prompt_section(text: str, haystack: str) -> Column:
    return F.expr(_section_sql(text, haystack))


def prompt_system_tag(text: str, haystack: str) -> Column:
    return F.expr(_system_tag_sql(text, haystack))


def prompt_persona_span(text: str, haystack: str) -> Column:
    return F.expr(_persona_span_sql(text, haystack))


def prompt_html_tags(text: str, haystack: str) -> Column:
    """Inner text of the prompt elements: text pieces stripped and joined without separator."""
    held = contains_any_sql(haystack, tuple(f"<{name}" for name in cat.PROMPT_ELEMENTS))
    return element_texts(F.expr(f"CASE WHEN {held} THEN {text} END"))


def prompt_blocks(text: str, haystack: str) -> Column:
    """All prompt blocks in rule order, stripped, without empty ones and repeats."""
    kinds = (_assign_sql, _section_sql, _system_tag_sql, _persona_span_sql)
    matched = "concat(" + ", ".join(kind(text, haystack) for kind in kinds) + ")"
    found = F.concat(F.expr(f"transform({matched}, m -> {strip_sql('m')})"), prompt_html_tags(text, haystack))
    return F.array_distinct(F.filter(found, lambda b: b != ""))


def persona(text: str, haystack: str) -> Column:
    """First line that starts with the persona marker; null if there is none."""
    line = f"nullif(regexp_extract({text}, {sql_literal(java_pattern(cat.PERSONA, ignore_case=True))}, 1), '')"
    return F.expr(
        f"CASE WHEN contains({haystack}, 'you are') THEN substring({strip_sql(line)}, 1, {cat.PERSONA_CHARS}) END"
    )


def tech_stack(lowered: str) -> Column:
    """Keywords found in the lower-cased text, in catalogue order."""
    tests = ", ".join(f"CASE WHEN contains({lowered}, '{k}') THEN '{k}' END" for k in cat.TECH_KEYWORDS)
    return F.expr(f"array_compact(array({tests}))")


def constraints(text: str, haystack: str) -> Column:
    pattern = starting_with(java_pattern(cat.CONSTRAINT, ignore_case=True), cat.CONSTRAINT_STARTS)
    found = _all(text, haystack, pattern, ("not", "never", "avoid", "refus", "prohibit"))
    return F.expr(f"transform({found}, m -> substring({strip_sql('m')}, 1, {cat.CONSTRAINT_CHARS}))")


def model_dna(persona_col: str, tech: str, constraint_list: str) -> Column:
    """Traits of a document, with the flags derived from them."""
    return F.expr(
        f"named_struct('persona', {persona_col}, 'tech_stack', {tech}, 'constraints', {constraint_list},"
        f" 'raw_traits', named_struct('persona_found', {persona_col} IS NOT NULL,"
        f" 'tech_stack_count', size({tech}), 'constraint_count', size({constraint_list})))"
    )


def tags(platform: str, dna: str, blocks: str) -> Column:
    """Sorted set of platform, technologies and trait markers."""
    return F.expr(
        f"array_sort(array_distinct(concat(array({platform}), {dna}.tech_stack, array_compact(array("
        f"CASE WHEN coalesce({dna}.persona, '') <> '' THEN '{cat.TAG_PERSONA}' END,"
        f"CASE WHEN size({dna}.constraints) > 0 THEN '{cat.TAG_CONSTRAINTS}' END,"
        f"CASE WHEN size({blocks}) > 0 THEN '{cat.TAG_PROMPT}' END)))))"
    )
