"""The registered queries: each applies one operator with production parameters to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, jaccard, language, licences, mixing, outliers, packing, pii, pivots, quality, simhash, sketches, warc
from .common import table


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.verdicts(table(spark, sf_dir, "documents"))


def op2_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs).withColumn("n_chars", F.length("text"))


def op6_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files under source/language/shelf; every eighth is the licence file of its shelf."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", (F.col("doc_id") / 64).cast("long").cast("string"), name)
    found = licences.scan(docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text"))
    return found.withColumnRenamed("file", "doc_id")


def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return chunks.filter("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("chunk") + 1).alias("chunks"), "intact"
    )


def op10_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_with_next(table(spark, sf_dir, "documents"))


def op11_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.cluster(table(spark, sf_dir, "embeddings"))


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, sf_dir, "documents"))


def registered() -> dict:
    return {
        "op1_robust_outliers": op1_robust_outliers,
        "op2_weighted_mix": op2_weighted_mix,
        "op3_boosted_trees": op3_boosted_trees,
        "op4_vector_best_fit": op4_vector_best_fit,
        "op5_surrogates": op5_surrogates,
        "op6_word_backoff": op6_word_backoff,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_licence_scan": op8_licence_scan,
        "op9_warc_chunks": op9_warc_chunks,
        "op10_threshold_sketch": op10_threshold_sketch,
        "op11_pivot_clusters": op11_pivot_clusters,
        "op12_simhash_trie": op12_simhash_trie,
        "op13_token_alignment": op13_token_alignment,
    }


_ARCHIVES = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages),
q AS (SELECT *, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
  CAST(CASE WHEN refers_to IS NULL THEN greatest(1, (n + 1048575) // 1048576) ELSE 1 END AS INTEGER) AS chunks,
  true AS intact
FROM q"""


def _clusters_sql(clusters: int = pivots.CLUSTERS, rounds: int = pivots.ROUNDS) -> str:
    """The plain algorithm, one pair of steps for each round."""
    assigned = (
        "a{k} AS MATERIALIZED (SELECT vec_id, x, key % {n} AS c, key // {n} AS d FROM (SELECT v.vec_id, any_value(v.x) AS x,"
        " min(CAST(list_sum(list_transform(list_zip(v.x, c{k}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {n} + c) AS key"
        " FROM v, c{k} GROUP BY v.vec_id))"
    )
    moved = (
        "c{j} AS MATERIALIZED (SELECT c{k}.c, coalesce(m.x, c{k}.x) AS x FROM c{k} LEFT JOIN (SELECT c, list(q ORDER BY i) AS x FROM ("
        "SELECT c, i, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS q FROM"
        " (SELECT c, unnest(x) AS e, unnest(range(len(x))) AS i FROM a{k}) GROUP BY c, i) GROUP BY c) m USING (c))"
    )
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({pivots.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x"
        f" FROM embeddings WHERE len(embedding) = {pivots.WIDTH} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{pivots.SEED}:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {clusters})",
    ]
    for k in range(rounds):
        steps += [assigned.format(k=k, n=clusters), moved.format(k=k, j=k + 1)]
    steps.append(assigned.format(k=rounds, n=clusters))
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f USING (c)"""
    )


def oracles() -> dict[str, str]:
    """The other queries train, draw, pack or hash in ways that SQL can't express."""
    return {"op9_warc_chunks": _ARCHIVES, "op11_pivot_clusters": _clusters_sql()}
