import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siftwork import catalogues as cat
from siftwork.operators import catalogue, dedup, enrich, vectors
from siftwork.plans import ingest, inventory
from siftwork.sources import tables, url_list, versions
from siftwork.streaming.ingest import ingest_stream

from .texts import GITHUB, OPENAI

AS_OF = datetime(2024, 5, 1, tzinfo=timezone.utc)
SCHEMA = "seq bigint, url string, raw_content string, error string"


def frame(spark, rows):
    return spark.createDataFrame([(r + (None,))[:4] for r in rows], SCHEMA).repartition(3)


FIRST = [
    (1, "https://a/CLAUDE.md", f"You are Claude.\nkey {OPENAI}"),
    (2, "https://a/2", "same text"),
    (3, "https://a/3", "same text"),
    (4, "https://a/4", "bad", "timeout"),
    (5, "https://a/5", ""),
    (6, "https://a/6", f"token {GITHUB} é"),
]
SECOND = [
    (11, "https://a/9", "same text"),
    (12, "https://a/2", "other text"),
    (13, "https://b/1", "fresh"),
    (14, "https://b/1", "fresh too"),
    (15, "https://b/2", "fresh"),
]


def stored(spark, root, **kw):
    return {r.url: r for r in catalogue.read_files(spark, root, **kw).collect()}


def test_save_skips_known_content_and_rejects_taken_addresses(spark, folder):
    catalogue.save_batch(spark, frame(spark, FIRST), folder, 1, AS_OF)
    assert set(stored(spark, folder)) == {"https://a/CLAUDE.md", "https://a/2", "https://a/6"}
    catalogue.save_batch(spark, frame(spark, SECOND), folder, 2, AS_OF)
    assert set(stored(spark, folder, batch=2)) == {"https://b/1"}
    assert {r.seq for r in catalogue.read_rejects(spark, folder).collect()} == {12, 14}
    # The same batch again replaces itself.
    catalogue.save_batch(spark, frame(spark, SECOND), folder, 2, AS_OF)
    assert catalogue.count_rows(catalogue.read_files(spark, folder)).first().n == 4
    row = stored(spark, folder)["https://a/CLAUDE.md"]
    assert row.platform == "claude" and row.has_secrets and row.indexed_at.replace(tzinfo=timezone.utc) == AS_OF


def test_one_key_and_address_with_two_contents(spark, folder):
    rows = [(1, "https://a/1", "one"), (1, "https://a/1", "two"), (2, "https://a/2", "twice"), (2, "https://a/2", "twice"), (3, None, "x")]
    catalogue.save_batch(spark, frame(spark, rows), folder, 1, AS_OF)
    assert sorted(r.url for r in catalogue.read_files(spark, folder).collect()) == ["https://a/1", "https://a/2"]
    assert sorted((r.seq, r.url) for r in catalogue.read_rejects(spark, folder).collect()) == [(1, "https://a/1"), (3, None)]
    catalogue.save_batch(spark, frame(spark, rows[:1]), folder, 2, AS_OF)
    assert catalogue.read_files(spark, folder, batch=2).count() == 0


def test_files_read_per_batch_stay_level(spark, folder):
    read = []
    for batch in range(1, 21):
        rows = [(batch, f"https://a/{batch}", f"text {batch}"), (batch, "https://a/0", f"again {batch}")]
        catalogue.save_batch(spark, frame(spark, rows), folder, batch, AS_OF)
        if batch % 4 == 0:
            catalogue.compact_keys(spark, folder, batch, files=2)
        read.append(catalogue.read_keys(spark, folder).select(F.input_file_name()).distinct().count())
    assert max(read[12:]) <= max(read[4:8]) and max(read) < 20
    assert catalogue.read_files(spark, folder).count() == 21


def test_queries_on_stored_files(spark, folder):
    catalogue.save_batch(spark, frame(spark, FIRST), folder, 1, AS_OF)
    files = catalogue.read_files(spark, folder)
    assert catalogue.by_url(files, "https://a/2").count() == 1 and catalogue.by_url(files, "https://nope").count() == 0
    assert catalogue.by_hash(files, files.first().content_hash).count() == 1
    assert [r.url for r in catalogue.by_platform(files, "claude").collect()] == ["https://a/CLAUDE.md"]
    assert [r.seq for r in catalogue.with_secrets(files).collect()] == [6, 1]
    pages = [[r.seq for r in catalogue.page(files, 2, o).collect()] for o in (0, 2, 4)]
    assert pages == [[6, 2], [1], []]
    assert {r.rule_name for r in catalogue.findings_of_file(files, "https://a/6").collect()} == {"github_token"}
    plan = catalogue.by_platform(files, "claude")._jdf.queryExecution().executedPlan().toString()
    assert "platform" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_summary_and_skips(spark):
    docs = frame(spark, FIRST)
    summary = {r.platform: r for r in catalogue.run_summary(docs).collect()}
    assert summary["claude"].n_findings == 1 and summary["unknown"].n_documents == 3 and summary["unknown"].n_files == 2
    assert {r.status: r.n for r in catalogue.skip_report(docs).collect()} == {"ok": 4, "timeout": 1, "empty": 1}


def test_nothing_written_holds_a_secret_outside_the_stored_text(spark, folder):
    catalogue.save_batch(spark, frame(spark, FIRST), folder, 1, AS_OF)
    catalogue.export_json(spark, folder, folder + "/out", AS_OF)
    found = (catalogue.read_findings(spark, folder), spark.read.json(folder + "/out/secret_findings"))
    for table in (*found, spark.read.json(folder + "/out/files")):
        dump = json.dumps([r.asDict() for r in table.collect()])
        assert OPENAI not in dump and GITHUB not in dump and "****" in dump
    manifest = spark.read.json(folder + "/out/manifest").first()
    assert manifest.total_files == 3 and manifest.exported_at == AS_OF.isoformat()
    lines = "".join(r.value for r in spark.read.text(folder + "/out/files").collect())
    assert "é" in lines and "2024-05-01T00:00:00" in lines
    catalogue.export_json(spark, folder, folder + "/raw", AS_OF, raw=True)
    assert OPENAI in "".join(r.value for r in spark.read.text(folder + "/raw/files").collect())


def test_first_wins_is_independent_of_the_input_order(spark):
    rows = [(i, f"u{i % 7}", f"h{i % 5}") for i in range(200)]
    for parts in (1, 5, 13):
        df = spark.createDataFrame(rows, "seq int, url string, content_hash string").repartition(parts, F.rand(parts))
        assert sorted(r.seq for r in dedup.dedup_content(df).collect()) == [0, 1, 2, 3, 4]
        assert [r.url for r in dedup.dedup_urls(df, "seq").collect()] == [f"u{i}" for i in range(7)]


def test_delta_and_union_keep_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "pos int, url string")
    b = spark.createDataFrame([(1, "z"), (2, "x"), (3, "z")], "pos int, url string")
    assert [r.url for r in dedup.union_sources(a, b).collect()] == ["x", "y", "z"]
    assert [r.url for r in dedup.new_urls(b, a, "pos").collect()] == ["z"]


def test_hot_keys_are_never_grouped_or_joined_on_whole(spark):
    """A third of all rows share one hash and one address: no task sees them together."""
    rows = spark.range(3000).selectExpr(
        "id AS seq", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('u', id) END AS url",
        "CASE WHEN id % 3 = 1 THEN 'hot text' ELSE concat('t', id) END AS raw_content", "cast(NULL AS string) AS error",
    )
    empty = catalogue.read_files(spark, "/nonexistent")
    result = catalogue.upsert(rows, empty)
    outcome = {r.outcome: r.n for r in result.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert outcome == {"accepted": 1002, "rejected": 999}
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Window" not in plan


def test_ingest_indexes_once_and_exports(spark, folder):
    assert ingest.ingest(spark, frame(spark, FIRST), folder, 1, AS_OF, folder + "/out") == 3
    assert ingest.ingest(spark, frame(spark, SECOND), folder, 2, AS_OF) == 1
    assert ingest.ingest(spark, frame(spark, SECOND), folder, 2, AS_OF) == 1
    assert vectors.read_index(spark, folder).count() == 4
    hits = ingest.search(spark, folder, "same text", 2).collect()
    assert hits[0].url == "https://a/2" and hits[0].distance == pytest.approx(0, abs=1e-3)


def test_stream_in_several_micro_batches(spark, folder):
    # Files arrive in two rounds; the second repeats content of the first.
    frame(spark, FIRST).coalesce(1).write.parquet(folder + "/in")
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    ingest_stream(read(), folder, folder + "/check", as_of=AS_OF, index=True).awaitTermination()
    assert catalogue.read_files(spark, folder).count() == 3
    frame(spark, SECOND).coalesce(1).write.mode("append").parquet(folder + "/in")
    ingest_stream(read(), folder, folder + "/check", as_of=AS_OF, index=True).awaitTermination()
    assert set(stored(spark, folder)) == {"https://a/CLAUDE.md", "https://a/2", "https://a/6", "https://b/1"}
    assert vectors.read_index(spark, folder).count() == 4
    # A late batch number must not collide with a batch job: numbers are the caller's.
    assert {r.batch for r in catalogue.read_files(spark, folder).select("batch").distinct().collect()} == {1, 2}


def test_text_files_as_a_corpus(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "CLAUDE.md").write_text("You are Claude.\nsecond line", encoding="utf-8")
    (folder / "b.txt").write_text("plain", encoding="utf-8")
    docs = tables.read_text_corpus(spark, str(folder))
    rows = {r.url.split("/")[-1]: r for r in tables.corpus_scan(docs).collect()}
    assert rows["CLAUDE.md"].metadata.length == 27 and rows["CLAUDE.md"].system_prompt_blocks
    catalogue.save_batch(spark, docs, str(tmp_path / "root"), 1, AS_OF)
    assert {r.platform for r in catalogue.read_files(spark, str(tmp_path / "root")).collect()} == {"claude", "unknown"}


def test_missing_catalogue_is_empty(spark, folder):
    assert catalogue.read_files(spark, folder).count() == 0
    assert catalogue.read_findings(spark, folder).count() == 0
    assert vectors.read_index(spark, folder, "new").count() == 0
    assert cat.DEFAULT_COLLECTION


def listed(spark, root):
    """Files that a read of the catalogue lists, texts and decisions."""
    return len(catalogue._stored(spark, root, None).inputFiles()) + len(catalogue.read_keys(spark, root).inputFiles())


def test_listed_files_stay_level_over_many_micro_batches(spark, folder):
    for n in range(40):
        frame(spark, [(n, f"https://a/{n}", f"text {n}"), (100 + n, "https://a/0", f"again {n}")]).coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    ingest_stream(stream, folder, folder + "/check", as_of=AS_OF, compact_every=4).awaitTermination()
    parts = versions.current(spark, folder).parts
    # 40 = 2 * 16 + 2 * 4 batches, and 3 at most of any size.
    assert sorted((p.hi - p.lo + 1) for p in parts) == [4, 4, 16, 16] and {p.level for p in parts} == {1, 2}
    assert listed(spark, folder) <= 4 * (1 + 8)
    assert catalogue.read_files(spark, folder).count() == 40 and catalogue.read_rejects(spark, folder).count() == 40
    assert catalogue.read_files(spark, folder, batch=17).count() == 1
    rows = [(17, "https://a/new", "only this")]
    catalogue.save_batch(spark, frame(spark, rows), folder, 17, AS_OF)
    assert [r.url for r in catalogue.read_files(spark, folder, batch=17).collect()] == ["https://a/new"]
    assert catalogue.read_files(spark, folder).count() == 40 and catalogue.read_keys(spark, folder).filter("batch = 17").count() == 1
    before = listed(spark, folder)
    assert catalogue.vacuum(spark, folder) > 40 and listed(spark, folder) == before
    assert catalogue.read_files(spark, folder).count() == 40


def test_a_failed_run_changes_nothing(spark, folder, monkeypatch):
    catalogue.save_batch(spark, frame(spark, FIRST), folder, 1, AS_OF)
    want = stored(spark, folder)
    broken = F.udf(lambda url: 1 // 0 or url, "string")  # fails in a task, after the decisions are written
    with pytest.raises(Exception, match="ZeroDivisionError"):
        catalogue.save_batch(spark, frame(spark, FIRST).withColumn("url", broken("url")), folder, 1, AS_OF)
    assert stored(spark, folder) == want
    write = catalogue._write_files

    def half(rows, path, **_):
        write(rows.limit(1), path)
        raise RuntimeError("lost")

    monkeypatch.setattr(catalogue, "_write_files", half)
    for batch in (1, 2):
        with pytest.raises(RuntimeError, match="lost"):
            catalogue.save_batch(spark, frame(spark, SECOND), folder, batch, AS_OF)
    with pytest.raises(RuntimeError, match="lost"):
        catalogue._merge(spark, folder, before := versions.current(spark, folder), list(before.parts), 1)
    monkeypatch.undo()
    assert stored(spark, folder) == want
    catalogue.save_batch(spark, frame(spark, SECOND), folder, 1, AS_OF)
    assert set(stored(spark, folder)) == {"https://a/9", "https://a/2", "https://b/1"}


def test_a_slot_that_is_being_written_does_not_count(spark, folder):
    import shutil

    for batch in (1, 2, 3):
        catalogue.save_batch(spark, frame(spark, [(batch, f"https://a/{batch}", f"t {batch}")]), folder, batch, AS_OF)
    assert versions.current(spark, folder).number == 3
    shutil.rmtree(folder + "/pointer/slot=1")  # as after a crash between the removal of a slot and its writing
    assert versions.current(spark, folder).number == 2 and catalogue.read_files(spark, folder).count() == 2
    catalogue.save_batch(spark, frame(spark, [(3, "https://a/3", "t 3")]), folder, 3, AS_OF)
    assert versions.current(spark, folder).number == 3 and catalogue.read_files(spark, folder).count() == 3


def test_stored_masks_are_those_of_a_scan(spark, folder):
    catalogue.save_batch(spark, frame(spark, FIRST), folder, 1, AS_OF)
    files = catalogue.read_files(spark, folder)
    scanned = {r.url: r.raw_content for r in enrich.mask_secrets(files).collect()}
    for row in files.collect():
        assert (row.masked_content or row.raw_content) == scanned[row.url]
        assert (row.masked_content is None) == (row.n_findings == 0) == (not row.has_secrets)
    assert "rlike" not in catalogue.export_files(files)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_paging_by_key_reads_few_parts(spark, folder):
    for batch in range(1, 13):
        rows = [(batch * 10 + k, f"https://a/{batch}/{k}", f"text {batch} {k}") for k in range(5)]
        catalogue.save_batch(spark, frame(spark, rows).coalesce(1), folder, batch, AS_OF + timedelta(days=batch))
    want = [(r.indexed_at, r.seq) for r in catalogue.page(catalogue.read_files(spark, folder), 100).collect()]
    got, place, read = [], None, []
    for _ in range(9):
        found = catalogue.page_after(spark, folder, 7, place)
        rows = [(r.indexed_at, r.seq) for r in found.collect()]
        read.append(len({f.split("/part=")[1].split("/")[0] for f in found.inputFiles()}))
        got += rows
        place = rows[-1] if rows else place
    assert got == want and len(got) == 60
    assert max(read) <= 4  # two batches hold a page, its place is in another, one more is not known to be unneeded
    catalogue.compact(spark, folder, fanout=4, key_files=1)
    catalogue.save_batch(spark, frame(spark, [(33, "https://a/3/3", "text 3 3")]), folder, 3, AS_OF + timedelta(days=3))
    assert [(r.indexed_at, r.seq) for r in catalogue.page_after(spark, folder, 100).collect()] == [w for w in want if w[1] // 10 != 3 or w[1] == 33]
    assert catalogue.page_after(spark, folder + "/none").count() == 0


def test_inventory_versions(spark, folder):
    path = folder + "/urls"
    add = lambda *urls: spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "pos int, url string")
    assert [r.url for r in inventory.refresh(spark, path, 1, add("b", "a")).collect()] == ["b", "a"]
    assert [r.url for r in inventory.refresh(spark, path, 2, add("c", "a"), add("d", "c")).collect()] == ["c", "d"]
    # The same version again: against the one before, with the same result.
    assert [r.url for r in inventory.refresh(spark, path, 2, add("c", "a"), add("d", "c")).collect()] == ["c", "d"]
    assert sorted(r.url for r in url_list.load_urls(spark, path).collect()) == ["a", "b", "c", "d"]
    assert sorted(r.url for r in url_list.load_urls(spark, path, before=2).collect()) == ["a", "b"]
    assert inventory.refresh(spark, path, 3, add("a")).count() == 0 and url_list.load_urls(spark, path, before=1).count() == 0


def test_sorted_lists_evaluate_every_file_once(spark):
    """A sort samples its input first: what was below it ran twice."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def scan(seq):
        seen.add(1)
        return seq % 2 == 0

    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") % 7).alias("indexed_at"))
    files = rows.withColumn("has_secrets", scan.asNondeterministic()("seq")).withColumn("platform", F.lit("a"))
    got = [(r.indexed_at, r.seq) for r in catalogue.with_secrets(files).collect()]
    assert len(got) == 200 and got == sorted(got, reverse=True) and seen.value == 400
    assert len(catalogue.by_platform(files, "a").collect()) == 400 and seen.value == 800


def test_micro_batches_are_dealt_out_before_they_are_scanned(spark, folder, monkeypatch):
    """The new texts of a micro-batch do not stay in the splits of its few files; all are stored."""
    plans, plain = [], catalogue.enrich

    def enriched(docs, *args, **options):
        plans.append(docs._jdf.queryExecution().optimizedPlan().toString())
        return plain(docs, *args, **options)

    monkeypatch.setattr(catalogue, "enrich", enriched)
    frame(spark, FIRST).coalesce(1).write.parquet(folder + "/inbox")
    inbox = spark.readStream.schema(SCHEMA).parquet(folder + "/inbox")
    ingest_stream(inbox, folder, folder + "/checkpoint", as_of=AS_OF).awaitTermination()
    assert plans and all("RepartitionByExpression [content_hash" in p for p in plans)
    assert set(stored(spark, folder)) == {"https://a/CLAUDE.md", "https://a/2", "https://a/6"}
