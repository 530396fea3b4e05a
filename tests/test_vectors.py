import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import embedding
from siftwork.operators import enrich, search, vectors

ROWS = [
    (1, "https://a/CLAUDE.md", "You are Claude. python rust"),
    (2, "https://a/2", "langchain agents with permission to execute bash scripts"),
    (3, "https://a/3", "cooking recipes and more recipes"),
    (4, "https://a/4", "***"),
]


@pytest.fixture(scope="module")
def files(spark):
    docs = spark.createDataFrame([r + (None,) for r in ROWS], "seq bigint, url string, raw_content string, error string")
    return enrich.enrich(docs).cache()


def test_document_is_bounded(spark):
    rows = spark.createDataFrame([(["a" * 3000] * 5, "é" * 5000), ([], ""), (["b"], "raw")], "blocks array<string>, raw string")
    got = [r.d for r in rows.select(embedding.build_document("blocks", "raw").alias("d")).collect()]
    assert len(got[0]) == 8000 and got[1] == "" and got[2] == "b\n\nraw"


def test_search(files):
    index = vectors.index_rows(files)
    top = vectors.semantic_search(index, "bash scripts with langchain agents", 2).collect()
    assert top[0].url == "https://a/2" and [r.distance for r in top] == sorted(r.distance for r in top)
    assert vectors.semantic_search(index, "recipes", 99).count() == 4
    only = vectors.semantic_search(index, "recipes", 5, where=F.col("platform") == "claude").collect()
    assert [r.url for r in only] == ["https://a/CLAUDE.md"]
    assert {r.distance for r in vectors.semantic_search(index, "!!", 9).collect()} == {1.0}
    assert vectors.semantic_search(index.limit(0), "x").count() == 0


def test_query_is_not_joined(files):
    plan = vectors.semantic_search(vectors.index_rows(files), "x y")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "TakeOrderedAndProject" in plan


def test_own_embedder(spark, files):
    counts = lambda text: F.expr(f"array(float(length({text})), float(1))")
    index = vectors.index_rows(files, counts)
    vector = spark.range(1).select(F.array(F.lit(1.0), F.lit(0.0)))
    assert vectors.knn(index.select("id", "embedding", "url"), vector, 1).first().url in {r[1] for r in ROWS}


def test_collections_delete_reset_compact(spark, files, folder):
    assert vectors.index_batch(spark, files, folder, 1) == 4
    assert vectors.index_batch(spark, files, folder, 2) == 0
    assert vectors.index_batch(spark, files, folder, 2, collection="other") == 4
    one = vectors.read_index(spark, folder).filter("url = 'https://a/3'").select("id")
    vectors.delete_from_index(one, folder, 3)
    assert vectors.read_index(spark, folder).count() == 3
    assert vectors.index_batch(spark, files, folder, 4) == 1
    assert vectors.read_index(spark, folder).count() == 4
    vectors.compact_index(spark, folder, folder + "/small")
    assert vectors.read_index(spark, folder + "/small").count() == 4
    vectors.reset_index(spark, folder)
    assert vectors.read_index(spark, folder).count() == 0 and vectors.read_index(spark, folder, "other").count() == 4


def test_deletions_end_with_a_compaction(spark, files, folder):
    vectors.index_batch(spark, files, folder, 1)
    for batch, url in ((2, "https://a/2"), (3, "https://a/3")):
        vectors.delete_from_index(vectors.read_index(spark, folder).filter(F.col("url") == url).select("id"), folder, batch)
    plan = lambda: vectors.read_index(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan()
    want = {r.url for r in vectors.read_index(spark, folder).collect()}
    vectors.compact_in_place(spark, folder)
    assert "LeftAnti" not in plan() and {r.url for r in vectors.read_index(spark, folder).collect()} == want == {"https://a/CLAUDE.md", "https://a/4"}
    assert vectors.vacuum_index(spark, folder) == 0  # the version before may still be read
    assert vectors.index_batch(spark, files, folder, 4) == 2 and vectors.read_index(spark, folder).count() == 4
    assert vectors.vacuum_index(spark, folder) == 3 and vectors.read_index(spark, folder).count() == 4
    vectors.compact_in_place(spark, folder, "none")


def test_postings_find_what_the_scan_finds(spark, files, folder):
    vectors.index_batch(spark, files, folder, 1)
    vectors.build_postings(spark, folder)
    index = vectors.read_index(spark, folder)
    for query, n in (("bash scripts with langchain agents", 2), ("recipes", 99), ("!!", 3), ("claude rust zebra", 3), ("", 9)):
        want = vectors.semantic_search(index, query, n).collect()
        assert vectors.search_postings(spark, folder, query, n).collect() == want
    path = vectors._postings_folder(spark, folder, vectors.cat.DEFAULT_COLLECTION)
    own = spark.read.schema(vectors._POSTING_SCHEMA).parquet(path).filter(F.col("bucket").isin(1, 2))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_postings_hold_numbers_in_the_order_of_the_ids(spark, files, folder):
    """A posting is a number and a weight, not the id, which would stand in every bucket of its row."""
    vectors.index_batch(spark, files, folder, 1)
    vectors.build_postings(spark, folder)
    index = vectors.read_index(spark, folder)
    path = vectors._postings_folder(spark, folder, vectors.cat.DEFAULT_COLLECTION)
    postings = spark.read.parquet(path)
    assert dict(postings.dtypes) == {"number": "bigint", "weight": "float", "bucket": "int"}
    numbers = {r.number: r.id for r in spark.read.parquet(path.replace("/postings/", "/numbers/")).collect()}
    assert [numbers[n] for n in sorted(numbers)] == sorted(r.id for r in index.collect())
    entries = {(r.id, e.bucket, e.weight) for r in index.select("id", vectors.em.sparse("embedding").alias("s")).collect() for e in r.s}
    assert {(numbers[r.number], r.bucket, r.weight) for r in postings.collect()} == entries


@pytest.mark.parametrize("block", [2048, 3])
def test_batch_knn_against_brute_force(spark, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 8)).astype("float32")
    base[5] = base[9]
    base[7] = 0
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id bigint, embedding array<float>").repartition(5)
    queries = table.filter("id < 10")
    got = {(r.query_id, r.rank): (r.id, r.distance) for r in vectors.knn_batch(table, queries, 4, block).collect()}
    unit = base.astype("float64") / np.where((n := np.linalg.norm(base.astype("float64"), axis=1, keepdims=True)) > 0, n, 1)
    distance = np.round(1 - unit @ unit.T, 9)
    for q in range(10):
        order = np.lexsort((np.arange(120), distance[q]))[:4]
        assert [got[q, k + 1][0] for k in range(4)] == order.tolist()
    assert len(got) == 40


def test_bounded_batch_knn_finds_most_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    base = (centres[rng.integers(0, 20, 600)] + 0.3 * rng.normal(size=(600, 16))).astype("float32")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id bigint, embedding array<float>")
    queries = table.filter("id % 20 = 0")
    exact = {(r.query_id, r.id) for r in vectors.knn_batch(table, queries, 5).collect()}
    near = [(r.query_id, r.id) for r in vectors.knn_batch_bounded(table, queries, 5, cells=24, probes=6, block=10).collect()]
    assert len(near) == len(set(near)) == 150 and len(exact & set(near)) >= 0.9 * 150


def exact_neighbours(base, queries, n):
    unit = base / np.where((size := np.linalg.norm(base, axis=1, keepdims=True)) > 0, size, 1)
    distance = np.round(1 - unit[queries] @ unit.T, 9)
    return {int(q): np.lexsort((np.arange(len(base)), d))[:n].tolist() for q, d in zip(queries, distance, strict=True)}, distance


@pytest.mark.parametrize("block", [8192, 5])
def test_projected_knn(spark, block):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 12)).astype("float32").astype("float64")
    base[5], base[7] = base[9], 0
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id bigint, embedding array<float>").repartition(4)
    want, distance = exact_neighbours(base, np.arange(0, 150, 10), 4)
    # With every bucket probed nothing is missed, in whatever parts the buckets are.
    every = vectors.knn_batch_projected(table, table.filter("id % 10 = 0"), 4, tables=2, bits=2, probes=4, block=block).collect()
    assert {(r.query_id, r.rank): r.id for r in every} == {(q, k + 1): i for q, own in want.items() for k, i in enumerate(own)}
    # Otherwise what is found has its exact distance and rank.
    some = vectors.knn_batch_projected(table, table.filter("id % 10 = 0"), 4, tables=2, bits=3, probes=2, block=block).collect()
    for r in some:
        assert r.distance == pytest.approx(distance[r.query_id // 10][r.id], abs=1e-4)
    assert 0 < len(some) == len({(r.query_id, r.id) for r in some}) == len({(r.query_id, r["rank"]) for r in some}) <= 60
    assert vectors.knn_batch_projected(table.limit(0), table, 4).count() == 0


GIVEN = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="no test tables")
def test_projected_knn_finds_nine_tenths_at_its_defaults(spark):
    rows = spark.read.parquet(GIVEN).selectExpr("vec_id AS id", "embedding").orderBy("id").collect()
    base = np.array([r.embedding for r in rows], float)
    table = spark.createDataFrame([(i, r.embedding) for i, r in enumerate(rows)], "id bigint, embedding array<float>")
    want, _ = exact_neighbours(base, np.arange(0, len(base), 20), 10)
    got = {(r.query_id, r.id) for r in vectors.knn_batch_projected(table, table.filter("id % 20 = 0")).collect()}
    found = sum((q, i) in got for q, own in want.items() for i in own)
    assert found >= 0.9 * 10 * len(want) and len(got) == 10 * len(want)


def test_predicate_catalogue_sizes():
    sizes = {"code-host": 48, "open-web": 48, "code-search": 50, "blob-search": 32, "s3": 24, "all": 96, "github": 48, "web": 48}
    assert {name: len(search.predicates(name)) for name in sizes} == sizes
    texts = [p.query for _, p in search.predicates("every")]
    assert len(texts) == len(set(texts)) == 202
    assert 'intitle:"CLAUDE.md" site:github.com' in texts and "filename:copilot-instructions.md" in texts
    with pytest.raises(ValueError):
        search.predicates("nowhere")


def test_predicates_on_a_corpus(spark):
    rows = [
        (1, "https://github.com/u/r/CLAUDE.md", "you are an EXPERT developer"),
        (2, "https://x.org/.github/copilot-instructions.md?raw=1", "nothing"),
        (3, "https://b.s3.amazonaws.com/docs/a.yaml", "crewai in agent_config"),
        (4, "https://github.com/readme.txt", "see s3.amazonaws.com/system_prompt"),
    ]
    docs = spark.createDataFrame(rows, "seq int, url string, raw_content string")
    hits = {(r.seq, r.query) for r in search.search(docs, "every").collect()}
    assert (1, 'intitle:"CLAUDE.md" "You are an expert developer" site:github.com') in hits
    assert (2, "filename:copilot-instructions.md") in hits and (2, "path:.github/") in hits
    assert (2, 'intitle:".github/copilot-instructions.md"') in hits
    assert (3, 'extension:yaml "crewai"') in hits and (3, 'site:*.s3.amazonaws.com "agent_config"') in hits
    assert (4, 's3.amazonaws.com "system_prompt" site:github.com') in hits
    assert not any(s == 2 and q.startswith('"') for s, q in hits)
    capped = search.search_all(docs.unionByName(docs.selectExpr("seq + 10 AS seq", "concat(url, '#', seq) AS url", "raw_content")), "every", max_results_per_query=1)
    assert {r.url for r in capped.collect()} <= {r[1] for r in rows}


def test_cap_is_applied_before_the_shuffle(spark):
    docs = spark.range(100).selectExpr("id AS seq", "concat('https://x/', id, '/CLAUDE.md') AS url", "'t' AS raw_content")
    plan = search.search_all(docs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan.split("WindowGroupLimit", 1)[1]


def test_a_cap_of_any_size(spark):
    docs = spark.range(3000).selectExpr("id AS seq", "concat('https://x/', id, '/CLAUDE.md') AS url", "'t' AS raw_content").repartition(5)
    hits = search.match_predicates(docs, search.predicates("all")).select("query_no", "query", "seq", "url")
    assert hits.select("query_no").distinct().count() == 1 and hits.count() == 3000
    for cap in (1, 900, 2000, 5000):
        rows = search.first_hits(hits, cap).orderBy("rank").collect()
        assert [(r["rank"], r.seq) for r in rows] == [(i + 1, i) for i in range(min(cap, 3000))]
    found = search.search_all(docs, max_results_per_query=2000).collect()
    assert len(found) == 2000 and [r["rank"] for r in found] == list(range(1, 2001)) and len({r.query for r in found}) == 1
    ranges = search.first_hits(hits, 2000)._jdf.queryExecution().optimizedPlan().toString()
    # Beyond the two steps over parts of a group, no window gathers a query's rows: only counts per range.
    for window in [line for line in ranges.splitlines() if "row_number" in line]:
        assert "_range" in window


def test_many_literals_in_one_pass(spark):
    words = [f"w{i}x" for i in range(400)] + ["w1", "1x w2", "über", "ss"]
    chosen = [("own", search.Predicate(f'"{w}"', "content", (), needle=w)) for w in words]
    texts = ["w1x and w399x", "a w1x w2x b", "W77X ÜBER", "", None, "nothing", "classes " + "w5x " * 500]
    docs = spark.createDataFrame([(i, f"https://x/{i}", t) for i, t in enumerate(texts)], "seq bigint, url string, raw_content string")
    got = {(r.seq, r.query) for r in search.match_predicates(docs, chosen).collect()}
    assert got == {(i, f'"{w}"') for i, t in enumerate(texts) for w in words if t and w in t.lower()}
    few = {(r.seq, r.query) for part in range(0, len(words), 50) for r in search.match_predicates(docs, chosen[part : part + 50]).collect()}
    assert got == few
    plan = search.match_predicates(docs, chosen)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
