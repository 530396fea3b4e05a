"""Vector collections and exact cosine search.

A collection is a table of parts (see :mod:`siftwork.sources.versions`) with rows and parts with
deletions; a row is live unless its hash was deleted in a later batch.  Deleting therefore costs the
size of the deletion; `compact_in_place` writes the live rows as one part and so does away with all
deletions, and readers see either the parts before or the one after.

Beside a collection there may be postings: for each bucket of the embedding the rows that have it, by
number, and the ids of the numbers.  A query reads its own buckets only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalogues as cat
from ..functions import embedding as em
from ..functions import text
from ..sources import versions
from .dedup import first_per_value
from .enrich import once

_INDEX_SCHEMA = (
    "id string, document string, embedding array<float>, url string, platform string, tags string,"
    " has_secrets int"
)
_STORED_SCHEMA = _INDEX_SCHEMA + ", batch int"
_DELETED_SCHEMA = "id string, batch int"
_POSTING_SCHEMA = "number bigint, weight float, bucket int"
_NUMBER_SCHEMA = "number bigint, id string"
#: Level of parts that hold deletions.
_DELETIONS = -1

Embedder = Callable[[str], Column]

#: Vectors of one side of a grid cell of the batch search.
GRID_BLOCK = 8192


_ROW_COLUMNS = ("id", "document", "embedding", "url", "platform", "tags", "has_secrets")


def index_documents(files: DataFrame) -> DataFrame:
    """Enriched files as bounded documents with flat metadata, ready to be embedded."""
    return files.select(
        "seq",
        F.col("content_hash").alias("id"),
        em.build_document("system_prompt_blocks", "raw_content").alias("document"),
        "url",
        "platform",
        text.tags_csv("tags").alias("tags"),
        F.col("has_secrets").cast("int").alias("has_secrets"),
    )


def index_rows(files: DataFrame, embed: Embedder = em.hash_embed) -> DataFrame:
    """Index rows of enriched files."""
    return once(index_documents(files), "embedding", embed("document")).select(*_ROW_COLUMNS)


# ---------------------------------------------------------------------------- collections


def _folder(root: str, collection: str) -> str:
    return f"{root}/vectors/{collection}"


def _live(spark: SparkSession, folder: str, parts: tuple[versions.Part, ...]) -> DataFrame:
    rows = versions.read_parts(spark, f"{folder}/rows", _STORED_SCHEMA, [p for p in parts if p.level != _DELETIONS])
    deletions = [p for p in parts if p.level == _DELETIONS]
    rows = rows.drop("part")
    if not deletions:
        return rows
    gone = versions.read_parts(spark, f"{folder}/deletions", _DELETED_SCHEMA, deletions).alias("d")
    return rows.alias("r").join(gone, F.expr("r.id = d.id AND d.batch > r.batch"), "left_anti")


def read_index(spark: SparkSession, root: str, collection: str = cat.DEFAULT_COLLECTION) -> DataFrame:
    """Live rows of a collection; empty if the collection is new."""
    folder = _folder(root, collection)
    return _live(spark, folder, versions.current(spark, folder).parts)


def index_batch(
    spark: SparkSession,
    files: DataFrame,
    root: str,
    batch: int,
    collection: str = cat.DEFAULT_COLLECTION,
    embed: Embedder = em.hash_embed,
) -> int:
    """Add files whose hash is not in the collection; returns how many were added.

    Known content is dropped before anything is moved or embedded.  What is left (documents of at
    most DOCUMENT_CHARS) is spread by (hash, key): embedding is the costly step, and files may be
    uneven.  A batch that is run again replaces itself."""
    folder = _folder(root, collection)
    before = versions.current(spark, folder)
    deletions = [p for p in before.parts if p.level == _DELETIONS]
    others = versions.Version(0, tuple(p for p in before.parts if p.level != _DELETIONS)).without(batch)
    live = _live(spark, folder, (*others, *deletions))
    first = first_per_value(files.select("content_hash", "seq"), "content_hash", "seq")
    fresh = first.join(live.select(F.col("id").alias("content_hash")), "content_hash", "left_anti")
    keys = fresh.select(F.col("content_hash").alias("id"), "seq")
    documents = index_documents(files).join(keys, ["id", "seq"], "left_semi").repartition("id", "seq")
    part = versions.Part(versions.new_name(batch, batch), batch, batch)
    target = f"{folder}/rows/part={part.name}"
    rows = once(documents, "embedding", embed("document")).select(*_ROW_COLUMNS, F.lit(batch).alias("batch"))
    rows.write.parquet(target)
    versions.commit(spark, folder, before, [*others, *deletions, part])
    return spark.read.schema(_STORED_SCHEMA).parquet(target).count()


def delete_from_index(ids: DataFrame, root: str, batch: int, collection: str = cat.DEFAULT_COLLECTION) -> None:
    """Delete rows by id; `batch` orders the deletion among the batches of additions."""
    spark, folder = ids.sparkSession, _folder(root, collection)
    part = versions.Part(versions.new_name(batch, batch), batch, batch, _DELETIONS)
    ids.select("id", F.lit(batch).alias("batch")).distinct().write.parquet(f"{folder}/deletions/part={part.name}")
    before = versions.current(spark, folder)
    versions.commit(spark, folder, before, [*before.parts, part])


def reset_index(spark: SparkSession, root: str, collection: str = cat.DEFAULT_COLLECTION) -> None:
    """Empty a collection."""
    folder = _folder(root, collection)
    versions.commit(spark, folder, versions.current(spark, folder), [])


def _write_live(spark: SparkSession, rows: DataFrame, folder: str, lo: int, hi: int, level: int) -> versions.Part:
    """One part with the given rows in files of even size, in order of id: a lookup of a few ids skips
    the others' row groups."""
    part = versions.Part(versions.new_name(lo, hi), lo, hi, level)
    rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/rows/part={part.name}")
    return part


def compact_in_place(spark: SparkSession, root: str, collection: str = cat.DEFAULT_COLLECTION) -> None:
    """Write the live rows as one part; the deletions made so far are then no longer read."""
    folder = _folder(root, collection)
    before = versions.current(spark, folder)
    if not before.parts:
        return
    whole = versions.merged(list(before.parts))
    part = _write_live(spark, _live(spark, folder, before.parts), folder, whole.lo, whole.hi, max(whole.level, 1))
    versions.commit(spark, folder, before, [part])


def compact_index(
    spark: SparkSession, root: str, target_root: str, batch: int = 0, collection: str = cat.DEFAULT_COLLECTION
) -> None:
    """Copy the live rows into one batch under another root."""
    folder = _folder(target_root, collection)
    rows = read_index(spark, root, collection).withColumn("batch", F.lit(batch))
    before = versions.current(spark, folder)
    versions.commit(spark, folder, before, [*before.without(batch), _write_live(spark, rows, folder, batch, batch, 0)])


def vacuum_index(spark: SparkSession, root: str, collection: str = cat.DEFAULT_COLLECTION) -> int:
    """Delete the folders of parts that are no longer read; returns how many."""
    return versions.vacuum(spark, _folder(root, collection), "rows", "deletions")


# -------------------------------------------------------------------------------- postings


def _postings_folder(spark: SparkSession, root: str, collection: str) -> str:
    folder = _folder(root, collection)
    return f"{folder}/postings/of={versions.current(spark, folder).number}"


def _numbers_folder(spark: SparkSession, root: str, collection: str) -> str:
    folder = _folder(root, collection)
    return f"{folder}/numbers/of={versions.current(spark, folder).number}"


def build_postings(spark: SparkSession, root: str, collection: str = cat.DEFAULT_COLLECTION) -> None:
    """Write, for the collection as it is, the rows (number, weight) of each bucket in a folder of its own.

    An id is a long text that does not compress and has an entry in every bucket of its row, so ids are
    numbered first, in their order, and only numbers are moved and stored by bucket.  `rebalance` cuts a
    bucket that most rows have (a frequent token's) into files of even size."""
    index = read_index(spark, root, collection)
    ordered = index.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
    numbers = _numbers_folder(spark, root, collection)
    ordered.select(F.monotonically_increasing_id().alias("number"), "id").write.mode("overwrite").parquet(numbers)
    numbered = spark.read.schema(_NUMBER_SCHEMA).parquet(numbers)
    vectors = index.select("id", "embedding").join(numbered, "id")
    entries = vectors.select("number", F.posexplode("embedding").alias("bucket", "weight")).filter("weight <> 0")
    rows = entries.select("number", "weight", "bucket").hint("rebalance", "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(_postings_folder(spark, root, collection))


def search_postings(
    spark: SparkSession,
    root: str,
    query: str,
    n: int = cat.DEFAULT_TOP_K,
    collection: str = cat.DEFAULT_COLLECTION,
    embed: Embedder = em.hash_embed,
) -> DataFrame:
    """What `semantic_search` finds in the collection, read from its postings: the folders of the
    query's buckets and the documents of the n best rows.

    The query's entries (as many as the embedding is wide, at most) and the n best come to the driver.
    Numbers follow the order of the ids, so ties fall as by id.  Rows that share no bucket with the query have the distance 1, by id; they are only looked for if
    fewer than n share one."""
    entries = spark.range(1).select(F.lit(query).alias("q")).select(embed("q").alias("v")).select(F.inline(em.sparse("v"))).collect()
    index = read_index(spark, root, collection)
    numbered = spark.read.schema(_NUMBER_SCHEMA).parquet(_numbers_folder(spark, root, collection))
    weights = {row["bucket"]: row["weight"] for row in entries}
    best: list[tuple[int, float]] = []
    others = numbered.select("number")
    if weights:
        postings = spark.read.schema(_POSTING_SCHEMA).parquet(_postings_folder(spark, root, collection))
        own = postings.filter(F.col("bucket").isin(*weights))
        weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
        shared = own.withColumn("part", F.col("weight") * F.element_at(weight, F.col("bucket")))
        scored = shared.groupBy("number").agg(F.round(1.0 - F.sum("part"), 9).alias("_exact"))
        best = [tuple(r) for r in scored.orderBy("_exact", "number").limit(n).collect()]
        others = others.join(scored.select("number"), "number", "left_anti")
    if len(best) < n:
        best += [(r["number"], 1.0) for r in others.orderBy("number").limit(n - len(best)).collect()]
    named = dict(numbered.filter(F.col("number").isin(*(i for i, _ in best))).collect())
    found = spark.createDataFrame([(named[i], x) for i, x in best], "id string, _exact double")
    rows = index.filter(F.col("id").isin(*named.values())).join(F.broadcast(found), "id")
    return _shown(rows.orderBy("_exact", "id"))


# --------------------------------------------------------------------------------- search


def _top(df: DataFrame, n: int, where: Column | None, distance: Column, with_query: DataFrame | None = None) -> DataFrame:
    kept = df if where is None else df.filter(where)
    if with_query is not None:
        kept = kept.select("*", with_query.scalar().alias("_query"))
    # Ties are decided on nine decimals, below any meaningful difference.
    return (
        kept.withColumn("_exact", F.round(distance, 9)).orderBy("_exact", "id").limit(n)
    )


def semantic_search(
    index: DataFrame,
    query: str,
    n: int = cat.DEFAULT_TOP_K,
    where: Column | None = None,
    embed: Embedder = em.hash_embed,
) -> DataFrame:
    """Nearest documents to a query text, exact.

    The query is embedded once by the same expression as the documents (a one-row scalar
    subquery), and each document's product touches the query's buckets only.  Every task keeps its
    own top n; nothing else is shuffled."""
    spark = index.sparkSession
    vector = spark.range(1).select(F.lit(query).alias("q")).select(embed("q").alias("v"))
    return _shown(_top(index, n, where, em.distance_to_sparse("embedding", "_query"), vector.select(em.sparse("v").alias("s"))))


def _shown(found: DataFrame) -> DataFrame:
    """A search result as it leaves the engine."""
    return found.select(
        "id",
        text.excerpt("document").alias("document"),
        F.round("_exact", 4).alias("distance"),
        "url",
        "platform",
        "tags",
        F.col("has_secrets").cast("boolean").alias("has_secrets"),
    )


def knn(vectors: DataFrame, query: DataFrame, n: int = cat.DEFAULT_TOP_K, where: Column | None = None) -> DataFrame:
    """Nearest rows of (id, embedding) to one given vector (`query`: one row, one column)."""
    found = _top(vectors, n, where, em.cosine_distance("embedding", "_query"), query)
    return found.drop("_query").withColumn("distance", F.round("_exact", 4)).drop("_exact")


def _cell_top(n: int):
    """Best n rows per query inside one cell of the grid.

    Helpers are nested, so executors do not have to import this package."""

    def unit(vectors: pd.Series) -> np.ndarray:
        matrix = np.stack(vectors.to_numpy()).astype(np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norms > 0, norms, 1.0)

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            rows = rows.sort_values("id", kind="stable")  # ties go to the smaller identifier
            ids, columns, query_ids = rows["id"].to_numpy(), unit(rows["embedding"]).T, queries["query_id"].to_numpy()
            for lo in range(0, len(queries), 256):
                distance = np.round(1.0 - unit(queries["embedding"].iloc[lo : lo + 256]) @ columns, 9)
                if len(ids) > n:
                    limit = np.partition(distance, n - 1, axis=1)[:, n - 1 : n]
                    query, near = np.nonzero(distance <= limit)
                else:
                    query, near = np.divmod(np.arange(distance.size), len(ids))
                order = np.lexsort((near, distance[query, near], query))
                query, near = query[order], near[order]
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                query, near = query[rank < n], near[rank < n]
                found.append(pd.DataFrame({"query_id": query_ids[lo + query], "id": ids[near], "distance": distance[query, near]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "distance": []})

    return run


def _ranked(queries: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Both sides have (cell, part); only a cell's best n per query leave it."""
    id_type = rows.schema["id"].dataType.simpleString()
    found = (
        queries.groupBy("cell", "part")
        .cogroup(rows.groupBy("cell", "part"))
        .applyInPandas(_cell_top(n), f"query_id {id_type}, id {id_type}, distance double")
    )
    return _best(found, n)


def _best(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
        .withColumn("distance", F.round("distance", 4))
    )


def _dealt(parts: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


def _every(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def knn_batch(vectors: DataFrame, queries: DataFrame, n: int = cat.DEFAULT_TOP_K, block: int = GRID_BLOCK) -> DataFrame:
    """Nearest rows of (id, embedding) for many queries (id, embedding), exact.

    Queries and rows are cut into blocks of about `block` vectors, and every block of the one meets
    every block of the other in a task of its own.  The plan is the same for any number of queries;
    only counts come to the driver, and pairs are never materialised."""
    across, down = (max(1, -(-side.count() // block)) for side in (queries, vectors))
    asked = queries.select(F.col("id").alias("query_id"), "embedding", _dealt(across).alias("cell"), _every(down).alias("part"))
    rows = vectors.select("id", "embedding", _dealt(down).alias("part"), _every(across).alias("cell"))
    return _ranked(asked, rows, n)


def knn_batch_bounded(
    vectors: DataFrame, queries: DataFrame, n: int = cat.DEFAULT_TOP_K, cells: int = 64, probes: int = 12, block: int = GRID_BLOCK
) -> DataFrame:
    """The same with bounded work per query, approximate: rows belong to the nearest of `cells`
    pivots, and a query is compared, exactly, with the rows of its `probes` nearest pivots.

    Pivots are rows of the table that a hash of the identifier picks: as many at any size.  A cell
    is cut into parts of about `block` rows if it is that large on average."""
    picked = vectors.select("embedding").orderBy(F.xxhash64("id"), "id").limit(cells).toPandas()
    if not len(picked):
        return knn_batch(vectors, queries, n)
    pivots = np.stack(picked["embedding"].to_numpy()).astype(np.float64)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)

    @F.pandas_udf("array<int>")
    def nearest(embedding: pd.Series) -> pd.Series:
        order = np.argsort(-(np.stack(embedding.to_numpy()).astype(np.float64) @ pivots.T), axis=1, kind="stable")
        return pd.Series(list(order[:, :probes].astype(np.int32)))

    parts = max(1, -(-vectors.count() // (block * cells)))
    asked = queries.select(F.col("id").alias("query_id"), "embedding", F.explode(nearest("embedding")).alias("cell"))
    rows = vectors.select("id", "embedding", F.get(nearest("embedding"), F.lit(0)).alias("cell"), _dealt(parts).alias("part"))
    return _ranked(asked.select("*", _every(parts).alias("part")), rows, n)


def _projections(size: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Random directions, `bits` for each table: (size, tables, bits)."""
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((size, tables, bits))


def _buckets(directions: np.ndarray, probes: int) -> Column:
    """The buckets of a vector in all tables (table * 2^bits + the signs of its projections).  With
    more than one probe also those it would be in if the projections nearest to zero had the other sign:
    one or two of them, the smallest sums of magnitudes first."""
    _, tables, bits = directions.shape
    flips = np.array([[]] + [[i] for i in range(bits)] + [[i, j] for i in range(bits) for j in range(i)], dtype=object)
    pattern = np.array([[k in f for k in range(bits)] for f in flips], bool)  # which signs a probe turns
    mask = pattern @ (1 << np.arange(bits))

    @F.pandas_udf("array<int>")
    def buckets(embedding: pd.Series) -> pd.Series:
        rows = np.stack(embedding.to_numpy()).astype(np.float64)
        projected = np.einsum("nd,dtb->ntb", rows, directions)
        own = (projected > 0) @ (1 << np.arange(bits))
        if probes == 1:
            found = own[:, :, None]
        else:
            cost = np.abs(projected) @ pattern.T.astype(float)
            chosen = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
            found = own[:, :, None] ^ mask[chosen]
        whole = found + (np.arange(tables) << bits)[None, :, None]
        return pd.Series(list(whole.reshape(len(rows), -1).astype(np.int32)))

    return buckets("embedding")


#: Hash tables, projections in each, and buckets a query looks into in each table.
TABLES, BITS, PROBES = 16, 8, 12


def knn_batch_projected(
    vectors: DataFrame, queries: DataFrame, n: int = cat.DEFAULT_TOP_K,
    tables: int = TABLES, bits: int = BITS, probes: int = PROBES, block: int = GRID_BLOCK, seed: int = 1,
) -> DataFrame:
    """Nearest rows of (id, embedding) for many queries (id, embedding), approximate: candidates are
    the rows that fall into a query's bucket in one of several tables of random projections, and these
    are compared exactly.

    A row goes to one bucket of each table, a query to its `probes` nearest ones.  A bucket with more
    than `block` rows is cut into parts, and its queries go to each, so no task has more than that.  A
    bucket gives out the best n per query.  Fewer bits or more probes find more and compare more; the
    test measures the recall of the defaults on the given vectors.  Zero vectors have a bucket too."""
    first = vectors.select(F.size("embedding")).first()
    if first is None:
        return knn_batch(vectors, queries, n, block)
    directions = _projections(first[0], tables, bits, seed)
    rows = vectors.select("id", "embedding", F.explode(_buckets(directions, 1)).alias("cell"))
    # One row per bucket at most: tables * 2^bits of them.
    sizes = vectors.select(F.explode(_buckets(directions, 1)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    parts = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    renamed = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("embedding"))
    asked = renamed.select("*", F.explode(_buckets(directions, probes)).alias("cell"))
    asked = asked.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    id_type = vectors.schema["id"].dataType.simpleString()
    found = (
        asked.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part"))
        .applyInPandas(_cell_top(n), f"query_id {id_type}, id {id_type}, distance double")
    )
    # A pair that met in several tables is one: its distance is the same in each.
    return _best(found.groupBy("query_id", "id").agg(F.min("distance").alias("distance")), n)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, neighbours to find, and how many of these were found (by distance: of several
    equally near rows any counts)."""
    worst = exact.groupBy("query_id").agg(F.max("distance").alias("worst"), F.count("*").alias("wanted"))
    near = found.join(worst, "query_id").filter(F.col("distance") <= F.col("worst")).groupBy("query_id").agg(F.count("*").alias("hits"))
    return worst.join(near, "query_id", "left").agg(
        F.count("*").alias("n_queries"), F.sum("wanted").alias("n_wanted"),
        F.sum(F.least(F.coalesce("hits", F.lit(0)), "wanted")).alias("n_found"),
    )
