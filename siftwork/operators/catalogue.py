"""The catalogue: one table of files with their findings, written batch by batch.

A batch is one part (see :mod:`siftwork.sources.versions`), written by one job in which findings travel
inside their file row, so a file and its findings appear together or not at all.  It counts from the
moment the pointer names it; a batch that is run again replaces itself then, and until then, also if
the new run fails, the earlier rows stay readable.  Rows that cannot be stored because their address
is taken by other content are kept beside the accepted ones as rejects.

Beside its files a batch writes its decisions, one narrow row (hash, key, address, outcome) per new
content; later batches are compared with these alone.  `compact` merges the small parts of many batches
into sized ones, decisions and files alike, so the number of files that a read lists stays level.

A file with findings carries its text with these starred out, made while the batch was scanned: exports
need no second scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalogues as cat
from ..functions import text
from ..functions.secrets import FINDINGS_TYPE
from ..sources import versions
from ..sources.tables import valid_docs
from .enrich import enrich, explode_findings, mask_secrets

_FILE_COLUMNS = {
    "seq": "bigint",
    "url": "string",
    "content_hash": "string",
    "indexed_at": "timestamp",
    "raw_content": "string",
    "masked_content": "string",
    "system_prompt_blocks": "array<string>",
    "tags": "array<string>",
    "confidence": "double",
    "has_secrets": "boolean",
    "n_findings": "int",
    "findings": FINDINGS_TYPE,
    "outcome": "string",
    "batch": "int",
    "platform": "string",
}
FILES_SCHEMA = ", ".join(f"{n} {t}" for n, t in _FILE_COLUMNS.items())

# Hashes and addresses have no useful order, so point lookups skip row groups by Bloom filter.
_POINT_LOOKUPS = {
    f"parquet.bloom.filter.{setting}#{column}": value
    for column in ("content_hash", "url")
    for setting, value in (("enabled", "true"), ("expected.ndv", "100000"))
}

_KEYS_SCHEMA = "content_hash string, seq bigint, url string, copies bigint, outcome string, batch int"

ACCEPTED, REJECTED = "accepted", "rejected"


def _stored(spark: SparkSession, root: str, batch: int | None) -> DataFrame:
    parts = versions.current(spark, root).holding(batch)
    files = versions.read_parts(spark, f"{root}/files", FILES_SCHEMA, parts).drop("part")
    return files if batch is None else files.filter(F.col("batch") == batch)


def read_files(spark: SparkSession, root: str, batch: int | None = None) -> DataFrame:
    """Stored files; the partition column `platform` and the parts that hold `batch` prune the scan."""
    return _stored(spark, root, batch).filter(F.col("outcome") == ACCEPTED).drop("outcome")


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Documents refused because their address already holds other content."""
    return _stored(spark, root, None).filter(F.col("outcome") == REJECTED).select("seq", "url", "content_hash", "batch")


def read_findings(spark: SparkSession, root: str) -> DataFrame:
    """Stored findings.  They are a view of the files, so they vanish with their file."""
    return explode_findings(read_files(spark, root), "content_hash", "url").select(
        "content_hash", "url", "rule_name", "line_number", "redacted", "context"
    )


# ------------------------------------------------------------------------------- decisions


def _keys(spark: SparkSession, root: str, parts: list[versions.Part]) -> DataFrame:
    return versions.read_parts(spark, f"{root}/keys", _KEYS_SCHEMA, parts).drop("part")


def read_keys(spark: SparkSession, root: str) -> DataFrame:
    """Decisions of all batches."""
    return _keys(spark, root, list(versions.current(spark, root).parts))


def _merge(spark: SparkSession, root: str, before: versions.Version, parts: list[versions.Part], key_files: int) -> None:
    """Write the rows of several parts as one, in files of even size, and make it theirs."""
    whole = versions.merged(parts)
    files = versions.read_parts(spark, f"{root}/files", FILES_SCHEMA, parts).select(*_FILE_COLUMNS)
    _write_files(files, f"{root}/files/part={whole.name}", sort=["indexed_at", "seq"])
    if whole.rows is None:
        whole = _counted(spark, root, whole)
    keys = _keys(spark, root, parts).repartition(key_files, "content_hash").sortWithinPartitions("content_hash")
    keys.write.options(**_POINT_LOOKUPS).parquet(f"{root}/keys/part={whole.name}")
    versions.commit(spark, root, before, [p for p in before.parts if p not in parts] + [whole])


def compact(spark: SparkSession, root: str, fanout: int = versions.FANOUT, key_files: int = 8) -> int:
    """Merge small parts until no level has `fanout` of them; returns the number of merges.

    Every row is rewritten once a level, and a level's parts are `fanout` times as large as those of
    the one below: the parts of n batches are at most fanout * log(n) / log(fanout)."""
    merges = 0
    while parts := versions.tiers(before := versions.current(spark, root), fanout):
        _merge(spark, root, before, parts, key_files)
        merges += 1
    return merges


def compact_keys(spark: SparkSession, root: str, upto: int, files: int = 8) -> None:
    """Merge all batches up to `upto` into one part; its decisions are laid out by hash in `files` files."""
    before = versions.current(spark, root)
    parts = [p for p in before.parts if p.hi <= upto]
    if len(parts) > 1:
        _merge(spark, root, before, parts, files)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the folders of failed, replaced and merged parts; returns how many."""
    return versions.vacuum(spark, root, "files", "keys")


def first_keys(hashed: DataFrame) -> DataFrame:
    """(content_hash, seq, url, copies) of the first document per hash; copies counts the rows that
    agree in all three.  Partial aggregations: a hash that holds a third of all rows is one row per
    task."""
    rows = hashed.groupBy("content_hash", "seq", "url").agg(F.count("*").alias("copies"))
    first = rows.groupBy("content_hash").agg(F.min(F.struct("seq", "url", "copies")).alias("k"))
    return first.select("content_hash", "k.*")


def decide(first: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome of the contents that are not stored yet: (content_hash, seq, url, copies, outcome).

    New content is accepted if it is the first with its address, by (seq, hash), and the address is
    free.  Content without an address is refused.  Everything is narrow and keyed by values that
    occur once per side; the optimizer picks the joins by the sizes it measures."""
    unknown = first.join(stored.select("content_hash"), "content_hash", "left_anti")
    holder = unknown.groupBy("url").agg(F.min(F.struct("seq", "content_hash")).alias("_holder"))
    taken = stored.select("url", F.lit(True).alias("_taken"))
    judged = unknown.join(holder, "url", "left").join(taken, "url", "left")
    free = F.col("_taken").isNull() & (F.col("_holder") == F.struct("seq", "content_hash"))
    outcome = F.when(F.coalesce(free, F.lit(False)), ACCEPTED).otherwise(REJECTED)
    return judged.select("content_hash", "seq", "url", "copies", outcome.alias("outcome"))


def upsert(
    docs: DataFrame,
    stored: DataFrame,
    rules=cat.SECRET_RULES,
    keys_folder: str | None = None,
    batch: int = 0,
    spread: bool = False,
) -> DataFrame:
    """Enriched new documents with their outcome; known content is dropped before any of the
    expensive work.  `stored` has the (content_hash, url) that are taken.

    With `keys_folder` the decisions are written there first and read back.  They are joined to the
    texts once, on (hash, seq, url): two contents under one (seq, url) are two decisions.  The texts
    stay on the probe side, so they are never broadcast and, if the decisions are few, never moved; `spread`
    deals the new ones out evenly, for documents that lie in fewer splits than there are cores."""
    hashed = valid_docs(docs).select(
        "seq", "url", "raw_content", "error", text.content_hash("raw_content").alias("content_hash")
    )
    decisions = decide(first_keys(hashed), stored)
    if keys_folder:
        decisions.withColumn("batch", F.lit(batch)).write.parquet(keys_folder)
        decisions = docs.sparkSession.read.schema(_KEYS_SCHEMA).parquet(keys_folder)
    keys = ["content_hash", "seq", "url"]
    right = decisions.select(*(F.col(k).alias(f"_{k}") for k in keys), "copies", "outcome")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    fresh = hashed.join(right, same[0] & same[1] & same[2]).drop(*(f"_{k}" for k in keys))
    if spread:
        fresh = fresh.repartition(*keys)
    if keys_folder and decisions.filter("copies > 1").isEmpty():
        return enrich(fresh.drop("copies", "content_hash"), rules, masked=True)
    repeated = fresh.filter("copies > 1").dropDuplicates(keys)
    return enrich(fresh.filter("copies = 1").unionByName(repeated).drop("copies", "content_hash"), rules, masked=True)


def _write_files(rows: DataFrame, folder: str, sort: list[str] | None = None) -> None:
    """`rebalance` cuts the output into files of even size per platform, however many rows the most
    frequent platform has."""
    even = rows.hint("rebalance", "platform")
    if sort:
        even = even.sortWithinPartitions("platform", *sort)
    even.write.options(**_POINT_LOOKUPS).partitionBy("platform").parquet(folder)


def _counted(spark: SparkSession, root: str, part: versions.Part) -> versions.Part:
    """The part with what paging has to know of it, from its narrow columns."""
    rows = versions.read_parts(spark, f"{root}/files", FILES_SCHEMA, [part]).filter(F.col("outcome") == ACCEPTED)
    about = rows.agg(F.count("*").alias("rows"), F.min("indexed_at").alias("oldest"), F.max("indexed_at").alias("newest"))
    return part._replace(**about.first().asDict())


def save_batch(
    spark: SparkSession,
    docs: DataFrame,
    root: str,
    batch: int,
    as_of: datetime,
    rules=cat.SECRET_RULES,
    spread: bool = False,
) -> None:
    """Store a batch of documents (seq, url, raw_content, error); one batch at a time.

    Every attempt writes folders of its own.  The pointer is moved last: running a batch again
    replaces its rows, and a run that fails changes nothing."""
    before = versions.current(spark, root)
    others = before.without(batch)
    stored = _keys(spark, root, others).filter(F.col("outcome") == ACCEPTED)
    part = versions.Part(versions.new_name(batch, batch), batch, batch)
    rows = upsert(docs, stored, rules, f"{root}/keys/part={part.name}", batch, spread)
    rows = rows.withColumns({
        "indexed_at": F.lit(as_of).cast("timestamp"), "batch": F.lit(batch), "n_findings": F.size("findings"),
    })
    _write_files(rows.select(*_FILE_COLUMNS), f"{root}/files/part={part.name}")
    versions.commit(spark, root, before, [*others, _counted(spark, root, part)])


# ------------------------------------------------------------------------------- queries


def by_url(files: DataFrame, url: str) -> DataFrame:
    return files.filter(F.col("url") == url)


def by_hash(files: DataFrame, content_hash: str) -> DataFrame:
    return files.filter(F.col("content_hash") == content_hash)


def _newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("indexed_at"), F.desc("seq"))


def _sorted_once(files: DataFrame) -> DataFrame:
    """All files, newest first.  A sort samples its input before it moves it, which would classify and
    scan every text twice; it samples the moved rows instead, of which there are only those kept."""
    return _newest_first(files.repartition("seq"))


def by_platform(files: DataFrame, platform: str) -> DataFrame:
    return _sorted_once(files.filter(F.col("platform") == platform))


def with_secrets(files: DataFrame) -> DataFrame:
    return _sorted_once(files.filter("has_secrets"))


def page(files: DataFrame, limit: int = cat.DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    return _newest_first(files).offset(offset).limit(limit)


def page_after(
    spark: SparkSession, root: str, limit: int = cat.DEFAULT_PAGE, after: tuple[datetime, int] | None = None
) -> DataFrame:
    """The stored files that follow a place (indexed_at, seq) in the order newest first; the first
    page without one.  The last row of a page is the place the next one starts from.

    Only parts that can hold rows of the page are read: newest first, until those that lie wholly
    behind the place, and before all parts not chosen, have enough rows.  A deep page so reads no more
    than the first."""
    parts = versions.current(spark, root).parts
    unknown = [p for p in parts if p.rows is None or p.dropped]
    known = sorted((p for p in parts if p not in unknown and p.rows), key=lambda p: p.newest, reverse=True)
    if after is not None:  # a time without a zone is one of the session
        at = after[0] if after[0].tzinfo is None else after[0].astimezone().replace(tzinfo=None)
        known = [p for p in known if p.oldest <= at]
    chosen: list[versions.Part] = []
    for k, p in enumerate(known):
        behind = [c for c in chosen if c.oldest > p.newest and (after is None or c.newest < at)]
        if sum(c.rows for c in behind) >= limit:
            break
        chosen = known[: k + 1]
    files = versions.read_parts(spark, f"{root}/files", FILES_SCHEMA, chosen + unknown).drop("part")
    files = files.filter(F.col("outcome") == ACCEPTED).drop("outcome")
    if after is not None:
        time = F.lit(after[0])
        files = files.filter((F.col("indexed_at") <= time) & ((F.col("indexed_at") < time) | (F.col("seq") < after[1])))
    return _newest_first(files).limit(limit)


def count_rows(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))


def findings_of_file(files: DataFrame, url: str) -> DataFrame:
    return explode_findings(by_url(files, url), "url", "content_hash")


def run_summary(docs: DataFrame) -> DataFrame:
    """Per platform: documents, mean confidence and findings after content deduplication.

    Only the narrow verdicts are shuffled, never the texts."""
    narrow = enrich(docs).select(
        "content_hash",
        F.struct(
            "seq", "platform", "confidence", F.size("findings").alias("n_findings"),
            F.size("system_prompt_blocks").alias("n_blocks"),
        ).alias("row"),
    )
    first = narrow.groupBy("content_hash").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    return first.groupBy(F.col("row.platform").alias("platform")).agg(
        F.count("*").alias("n_files"),
        F.sum("copies").alias("n_documents"),
        F.round(F.avg("row.confidence"), 6).alias("mean_confidence"),
        F.count_if(F.col("row.n_findings") > 0).alias("n_with_secrets"),
        F.sum("row.n_findings").alias("n_findings"),
        F.sum("row.n_blocks").alias("n_blocks"),
    )


def skip_report(docs: DataFrame) -> DataFrame:
    """Totals: documents seen, usable ones, skipped ones per reason."""
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.coalesce("raw_content", F.lit("")) == "", F.lit("empty"))
        .otherwise("ok")
    )
    return docs.groupBy(reason.alias("status")).agg(F.count("*").alias("n"))


# -------------------------------------------------------------------------------- export


def export_files(files: DataFrame) -> DataFrame:
    """Files as they leave the engine: tags as text, flag as 0/1, time as ISO text."""
    return files.select(
        "url",
        "content_hash",
        F.coalesce("platform", F.lit(cat.UNKNOWN_PLATFORM)).alias("platform"),
        F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("indexed_at"),
        "raw_content",
        text.tags_csv("tags").alias("tags"),
        F.col("has_secrets").cast("int").alias("has_secrets"),
    )


def export_manifest(files: DataFrame, as_of: datetime) -> DataFrame:
    return files.agg(
        F.lit(as_of.isoformat()).alias("exported_at"),
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("n_findings"), F.lit(0)).alias("total_findings"),
    )


def export_json(
    spark: SparkSession, root: str, folder: str, as_of: datetime, raw: bool = False, rules=None
) -> None:
    """Dump the catalogue as JSON lines: `files`, `secret_findings` and a one-row `manifest`.

    Texts leave with every finding starred out, as the batches have stored them; `rules` stars out the
    findings of another rule list instead, which scans the texts; only `raw` exports them as they are."""
    files = read_files(spark, root)
    masked = mask_secrets(files, rules) if rules else files.withColumn("raw_content", F.coalesce("masked_content", "raw_content"))
    outputs = {
        "files": export_files(files if raw else masked),
        "secret_findings": read_findings(spark, root),
        "manifest": export_manifest(files, as_of),
    }
    for name, table in outputs.items():
        table.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")
