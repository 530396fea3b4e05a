"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A budget, a multiple of all words, is shared among the sources by weight; no source gets more than
`epochs` times its words, and what it can't use is shared among the others by weight.  A source's
target is then met by complete epochs over all its documents first, and for the rest by documents in
ascending order of -ln(u) / q: u is a number in (0, 1) drawn from a hash, q the document's quality
weight.  That order samples without replacement with odds proportional to q.  A document is taken if
its middle lies within the target, so a source misses its target by half a document at most.

The order is cut at one key per source, so whether a document is taken needs that small table only:
texts are never shuffled, and a rerun draws the same documents.

A null text, like one without words, has size 0.  Null is a source of its own and the last.  Rows
equal in doc_id and text have the same key and are taken together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, text_of
from .order import running_sums

WEIGHTS = (3, 1, 2)
BUDGET, EPOCHS, SEED = 1.5, 2, 20240229
_SYMBOLS = r"[#*$%&|<>]"


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """From 1 for text without symbols down to 0.1."""
    whole = text_of(text)
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, _SYMBOLS, ""))
    return F.greatest(F.lit(0.1), 1 - 10.0 * symbols / F.greatest(F.length(whole), F.lit(1)))


def sampling_key(weight: Column, seed: int = SEED) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + 0.5) / float(1 << 53)
    return -F.ln(u) / weight


def targets(sizes: DataFrame, work: Workspace, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Weights repeat along the sources in code point order.  The shares are those of water poured
    into vessels of width weight and volume epochs x source_size: below one level for all that are
    not full.  Sorted by the level at which they are full, the vessels before the final level are
    the full ones; running sums of volume and width give the level."""
    place = running_sums(
        sizes.withColumn("_last", F.col("source").isNull()), work, [], ["_last", "source"], {"_place": F.lit(1)}
    )
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    vessels = work.keep(
        place.select(
            "source",
            "source_size",
            F.get(cycle, ((F.col("_place") - 1) % len(weights)).cast("int")).alias("weight"),
            (epochs * F.col("source_size")).cast("double").alias("cap"),
        ).withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    poured, width = vessels.agg(F.sum("source_size") * F.lit(float(budget)), F.sum("weight")).first()
    ordered = running_sums(
        vessels, work, [], ["full_at", "source"], {"_caps": F.col("cap"), "_widths": F.col("weight")}
    )
    # The level if exactly the vessels before this one are full; the first that is high enough holds.
    level = (F.lit(poured or 0.0) - (F.col("_caps") - F.col("cap"))) / (F.lit(width or 1.0) - (F.col("_widths") - F.col("weight")))
    holds = ordered.withColumn("_level", level).filter(F.col("_level") <= F.col("full_at"))
    found = holds.agg(F.min_by("_level", F.struct("full_at", "source"))).first()[0]
    target = F.col("cap") if found is None else F.least("cap", F.lit(found) * F.col("weight"))
    return vessels.select("source", "source_size", target.alias("target"))


def plan(
    docs: DataFrame, work: Workspace, weight: Column | None = None, budget=BUDGET, weights=WEIGHTS, epochs=EPOCHS, seed=SEED
) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, source, size, key; per source: size, target, full epochs, last key taken)."""
    narrow = work.keep(
        docs.select(
            "doc_id", "source", size_of().alias("size"),
            sampling_key(quality_weight() if weight is None else weight, seed).alias("key"),
        )
    )
    sizes = work.keep(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    wanted = targets(sizes, work, weights, budget, epochs)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    wanted = wanted.withColumn("epochs", full).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    wanted = work.keep(wanted)
    along = running_sums(narrow.select("source", "size", "key"), work, ["source"], ["key"], {"_upto": F.col("size")})
    rest = wanted.select(F.col("source").alias("_source"), "rest").filter("rest > 0")
    cut = (
        along.join(rest, along["source"].eqNullSafe(rest["_source"]))
        .filter(F.col("_upto") - F.col("size") / 2 <= F.col("rest"))
        .groupBy("_source")
        .agg(F.max("key").alias("last_key"), F.count("*").alias("_n"))
        .drop("_n")
    )
    per_source = wanted.join(cut, wanted["source"].eqNullSafe(cut["_source"]), "left").drop("_source", "rest")
    return narrow, work.keep(per_source)


def copies() -> Column:
    return F.col("epochs") + F.coalesce((F.col("key") <= F.col("last_key")).cast("int"), F.lit(0))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document (doc_id, text, source): size, source_size, target and taken words."""
    narrow, per_source = plan(docs, Workspace(docs.sparkSession), **options)
    per_source = per_source.withColumnRenamed("source", "_source")
    return narrow.join(per_source, narrow["source"].eqNullSafe(per_source["_source"]), "left").select(
        "doc_id", "source", "size", "source_size", "target", copies().alias("copies"), (copies() * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, each as many times as the mix takes it.

    The key is computed from the row again, so nothing but the table of sources is joined."""
    work = Workspace(docs.sparkSession)
    _, per_source = plan(docs, work, **options)
    seed, weight = options.get("seed", SEED), options.get("weight")
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("source").alias("_own"),
        sampling_key(quality_weight() if weight is None else weight, seed).alias("key"),
    )
    joined = rows.join(per_source, rows["_own"].eqNullSafe(per_source["source"]))
    times = F.sequence(F.lit(1), copies())
    return joined.filter(copies() > 0).select("row", F.explode(times)).select("row.*")
