"""Document enrichment: one scan, one stage, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogues as cat
from ..functions import classify, extract, secrets, text, urls
from ..functions.regex import folded, needle_text, needles_of_folded
from ..sources.tables import valid_docs


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is evaluated once per row, whatever is built on it.

    The optimizer copies the expression behind a plain column into every filter on it; it does
    not look through a generator, and one element per row changes nothing else."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def classify_docs(docs: DataFrame) -> DataFrame:
    """Valid documents with platform, confidence, traits (`model_dna`) and tags."""
    return _classified(docs).drop("_needles")


def _classified(docs: DataFrame) -> DataFrame:
    """The same with the text for literal tests (`_needles`) still in place.

    Shared intermediate texts get projections of their own, so that each is computed once."""
    raw, hay = "raw_content", "_needles"
    lowered = valid_docs(docs).withColumn("_lower", F.lower(raw)).withColumn("_folded", folded("_lower"))
    texts = lowered.withColumns({hay: needles_of_folded("_folded"), "_signals": classify.haystack_of_folded("_folded", "url")})
    scored = texts.withColumn("_scores", classify.platform_scores("_signals"))
    return (
        once(scored, "_best", classify.best_platform("_scores"))
        .withColumns(
            {
                "content_hash": text.content_hash(raw),
                "metadata": F.struct(
                    urls.to_raw_url(F.col("url")).alias("raw_url"), text.content_length(raw).alias("length")
                ),
                "system_prompt_blocks": extract.prompt_blocks(raw, hay),
                "_persona": extract.persona(raw, hay),
                "_tech": extract.tech_stack("_lower"),
                "_constraints": extract.constraints(raw, hay),
                "platform": F.col("_best.platform"),
                "confidence": F.col("_best.confidence"),
            }
        )
        .withColumn("model_dna", extract.model_dna("_persona", "_tech", "_constraints"))
        .withColumn("tags", extract.tags("platform", "model_dna", "system_prompt_blocks"))
        .drop("_lower", "_folded", "_signals", "_persona", "_tech", "_constraints", "_scores", "_best")
    )


def scan_secrets(
    docs: DataFrame,
    rules: Sequence[cat.SecretRule] = cat.SECRET_RULES,
    text_column: str = "raw_content",
    mask_context: bool = True,
) -> DataFrame:
    """Rows with `findings` and `has_secrets`; each document is scanned once."""
    return _scanned(docs.withColumn("_needles", needle_text(text_column)), rules, text_column, mask_context)


def _scanned(
    needled: DataFrame, rules: Sequence[cat.SecretRule], text_column: str, mask_context: bool, masked: bool = False
) -> DataFrame:
    tested = secrets.with_python_hits(needled, text_column, rules)
    gated = tested.withColumn("_gates", secrets.rule_gates(text_column, "_needles", rules))
    matched = once(gated, "_hits", secrets.line_hits(text_column, "_gates", rules, mask_context or masked))
    found = once(matched, "findings", secrets.findings("_hits", rules, mask_context))
    found = found.withColumn("has_secrets", secrets.has_secrets("findings"))
    if masked:
        found = found.withColumn("masked_content", F.when(F.col("has_secrets"), secrets.mask_document(text_column, "_hits")))
    return found.drop("_needles", "_gates", "_hits", secrets.PYTHON_HITS)


def mask_secrets(
    docs: DataFrame, rules: Sequence[cat.SecretRule] = cat.SECRET_RULES, text_column: str = "raw_content"
) -> DataFrame:
    """Rows whose text has every finding starred out."""
    tested = secrets.with_python_hits(docs.withColumn("_needles", needle_text(text_column)), text_column, rules)
    gated = tested.withColumn("_gates", secrets.rule_gates(text_column, "_needles", rules))
    return (
        once(gated, "_hits", secrets.line_hits(text_column, "_gates", rules))
        .withColumn(text_column, secrets.mask_document(text_column, "_hits"))
        .drop("_needles", "_gates", "_hits", secrets.PYTHON_HITS)
    )


def enrich(docs: DataFrame, rules: Sequence[cat.SecretRule] = cat.SECRET_RULES, masked: bool = False) -> DataFrame:
    """Classification and secret scan of the valid documents; with `masked` also the text with its
    findings starred out (`masked_content`, null where there are none)."""
    return _scanned(_classified(docs), rules, "raw_content", True, masked)


def explode_findings(docs: DataFrame, *keys: str) -> DataFrame:
    """One row per finding.  (The outer form keeps the optimizer from evaluating the scan a
    second time to filter empty arrays.)"""
    return (
        docs.select(*keys, F.inline_outer("findings"))
        .filter(F.col("rule").isNotNull())
        .withColumnsRenamed({"rule": "rule_name", "line": "line_number"})
    )


def secret_report(docs: DataFrame, *keys: str) -> DataFrame:
    """Per document: number of findings, flag, and the findings themselves."""
    return docs.select(
        *keys,
        F.size("findings").alias("secret_count"),
        "has_secrets",
        F.transform(
            "findings",
            lambda f: F.struct(
                f["rule"].alias("rule"), f["line"].alias("line"), f["redacted"].alias("redacted"), f["context"].alias("context")
            ),
        ).alias("findings"),
    )
