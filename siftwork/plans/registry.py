"""Every operator as a query over the given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalogues as cat
from ..functions import classify, embedding, extract, headers, links, text, urls
from ..functions.regex import needle_text
from ..operators import catalogue, dedup, enrich, harvest, search, vectors
from ..session import shared_folder
from ..sources import payloads, tables, url_list
from ..streaming.ingest import ingest_stream
from . import ingest, inventory, planted

AS_OF = datetime(2024, 1, 1, tzinfo=timezone.utc)
SEP = " | "
LOOKUP_URL = "https://example.com/src0/0/CLAUDE.md"
LOOKUP_HASH = hashlib.sha256(planted.SAME_TEXT.encode()).hexdigest()
QUERY_TEXT = "You are a helpful assistant: never disclose API keys"
FILTER_QUERY = "langchain agent rules"
CUSTOM_RULES = (
    cat.SecretRule("mail_address", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2,}", "mail address"),
    cat.SecretRule("never_line", r"^never [^\n]{5,}$", "line that starts with never", ignore_case=True),
)
# Rules 0 and 1 need Python: a group that depends on another one, named groups and references.
PYTHON_RULES = (
    cat.SecretRule("quoted_key", r"""(?P<quote>['"])?sk-(?P<body>[A-Za-z0-9]{32,48})(?(quote)(?P=quote))""", "key, in its quotes if any"),
    cat.SecretRule("assigned", r"(?P<name>[a-z]+_[a-z]+)\s*[=:]\s*(?P<value>[^\s]{8,})", "assignment", ignore_case=True, min_entropy=3.0),
    *CUSTOM_RULES,
)
RAW_ENTROPY_RULE = next(r for r in cat.SECRET_RULES if r.name == "high_entropy_secret")

#: Queries whose rows SQL can't give; tests compare them with brute force.
WITHOUT_SQL = {"knn_batch_approximate"}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    _QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def joined(column) -> Column:
    return F.array_join(column, SEP)


def as_long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ------------------------------------------------------------------------ shared inputs


def valid_corpus(spark, sf) -> DataFrame:
    return tables.valid_docs(planted.corpus(spark, sf))


def classified_files(spark, sf) -> DataFrame:
    """The corpus as catalogue files: first document per content, classified."""
    hashed = valid_corpus(spark, sf).withColumn("content_hash", text.content_hash("raw_content"))
    first = enrich.classify_docs(dedup.dedup_content(hashed))
    return first.withColumn("indexed_at", F.timestamp_seconds("ingest_s"))


def files(spark, sf) -> DataFrame:
    """The same with findings."""
    return enrich.scan_secrets(classified_files(spark, sf))


def scanned(spark, sf) -> DataFrame:
    return enrich.scan_secrets(valid_corpus(spark, sf))


def all_urls(spark, sf) -> DataFrame:
    pages = tables.read_table(spark, sf, "pages", ["page_id", "url"])
    return planted.url_table(spark, sf).unionByName(pages.selectExpr(f"{planted.key_sql('page_id', planted.PAGE)} AS seq", "url"))


def _place(pos) -> Column:
    """Place of a link among those of all pages."""
    return F.struct("page_id", (F.col(pos) if isinstance(pos, str) else pos).cast("bigint").alias("pos")).alias("pos")


def with_haystack(spark, sf) -> DataFrame:
    return valid_corpus(spark, sf).withColumn("_hay", needle_text("raw_content"))


# ------------------------------------------------------------------ S: sources and sinks


@query
def url_list_scan(spark, sf):
    lines = tables.read_table(spark, sf, "pages", ["url"]).select(
        F.explode(F.array(F.concat(F.lit("  "), "url", F.lit("\t")), F.concat(F.lit("# "), "url"), F.lit(""))).alias("value")
    )
    return url_list.clean_lines(lines)


@query
def url_list_sink(spark, sf):
    path = f"{shared_folder(spark)}/inventory"
    existing = tables.read_table(spark, sf, "pages", ["url"])
    new = harvest.harvest_links(planted.linked_pages(spark, sf)).select("url")
    url_list.update_urls(existing, new, path, version=1)
    return url_list.load_urls(spark, path)


@query
def corpus_scan(spark, sf):
    return tables.corpus_scan(planted.corpus(spark, sf)).select(
        "seq", "content_hash", F.col("metadata.length").cast("bigint").alias("length"),
        F.col("metadata.raw_url").alias("raw_url"), joined("system_prompt_blocks").alias("blocks"),
    )


@query
def catalogue_sink(spark, sf):
    root = shared_folder(spark) + "/catalogue_sink"
    catalogue.save_batch(spark, planted.corpus(spark, sf), root, 1, AS_OF)
    return catalogue.read_files(spark, root).select(
        "url", "content_hash", "platform", text.tags_csv("tags").alias("tags"),
        F.col("has_secrets").cast("bigint").alias("has_secrets"),
        F.size("findings").cast("bigint").alias("n_findings"),
    )


@query
def export_json(spark, sf):
    root = shared_folder(spark) + "/export_json"
    catalogue.save_batch(spark, planted.corpus(spark, sf), root, 1, AS_OF)
    catalogue.export_json(spark, root, root + "/json", AS_OF)
    manifest = spark.read.schema("exported_at string, total_files bigint, total_findings bigint").json(root + "/json/manifest")
    per_rule = spark.read.schema("rule_name string").json(root + "/json/secret_findings")
    exported = spark.read.schema("platform string").json(root + "/json/files")
    return (
        manifest.select(F.concat(F.lit("manifest "), "exported_at").alias("part"), F.col("total_files").alias("n"))
        .unionByName(per_rule.groupBy(F.concat(F.lit("rule "), "rule_name").alias("part")).agg(F.count("*").alias("n")))
        .unionByName(exported.groupBy(F.concat(F.lit("platform "), "platform").alias("part")).agg(F.count("*").alias("n")))
    )


def _indexed(spark, sf, name: str) -> str:
    root = f"{shared_folder(spark)}/{name}"
    ingest.ingest(spark, planted.corpus(spark, sf), root, 1, AS_OF)
    return root


@query
def vector_table(spark, sf):
    root = _indexed(spark, sf, "vector_table")
    return vectors.read_index(spark, root).select(
        "id", F.char_length("document").cast("bigint").alias("document_chars"),
        F.size("embedding").cast("bigint").alias("dim"), "url", "platform", "tags",
        F.col("has_secrets").cast("bigint").alias("has_secrets"),
    )


@query
def catalogue_dims(spark, sf):
    """Every catalogue value with the number of documents that hold it."""
    dims = search.catalogue_dims(spark)
    values = list(dict.fromkeys([*cat.TARGET_FILENAMES, *cat.CONTENT_SIGNATURES, *cat.TARGET_PATHS, *cat.S3_TERMS]))
    corpus = planted.search_corpus(spark, sf).select(F.concat_ws("\n", "url", "raw_content").alias("t"))
    counts = corpus.select(F.explode(search._held("t", values)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return dims.join(counts, "value", "left").select(
        "kind", F.col("pos").cast("bigint").alias("pos"), "value", F.coalesce("n", F.lit(0)).alias("n_docs")
    )


@query
def api_payload_scan_github(spark, sf):
    bodies = planted.payloads(spark, sf).select("page_id", "github_body")
    return payloads.github_payload_urls(bodies, "github_body").select("page_id", *as_long("pos"), "url")


@query
def api_payload_scan_gitlab(spark, sf):
    bodies = planted.payloads(spark, sf).select("page_id", "gitlab_body")
    return payloads.gitlab_payload_urls(bodies, "gitlab_body").select("page_id", *as_long("pos"), "url")


# ------------------------------------------------------------------------- C: scalars


def _url_query(name: str, fn) -> None:
    def run(spark, sf):
        return all_urls(spark, sf).select("seq", "url", fn(F.col("url")).alias("result"))

    _QUERIES[name] = run


_url_query("github_blob_to_raw", urls.github_blob_to_raw)
_url_query("gitlab_blob_to_raw", urls.gitlab_blob_to_raw)
_url_query("bitbucket_src_to_raw", urls.bitbucket_src_to_raw)
_url_query("to_raw_url", urls.to_raw_url)
_url_query("repo_base_github", urls.repo_base_github)
_url_query("repo_base_gitlab", urls.repo_base_gitlab)


def _documents(spark, sf, *columns) -> DataFrame:
    return tables.read_table(spark, sf, "documents", columns or ["doc_id", "text"], key="doc_id")


@query
def content_hash(spark, sf):
    return _documents(spark, sf).select("doc_id", text.content_hash("text").alias("content_hash"))


@query
def content_length(spark, sf):
    return _documents(spark, sf).select("doc_id", text.content_length("text").cast("bigint").alias("length"))


@query
def redact(spark, sf):
    return _documents(spark, sf, "doc_id", "text", "source").select(
        "doc_id", text.redact("text").alias("redacted_text"), text.redact("source").alias("redacted_source")
    )


@query
def shannon_entropy(spark, sf):
    return _documents(spark, sf).select("doc_id", F.round(text.shannon_entropy("text"), 6).alias("entropy"))


@query
def excerpt(spark, sf):
    return _documents(spark, sf).select("doc_id", text.excerpt("text").alias("excerpt"))


@query
def tags_csv(spark, sf):
    return enrich.classify_docs(planted.corpus(spark, sf)).select("seq", text.tags_csv("tags").alias("tags"))


@query
def tag_flags(spark, sf):
    traits = enrich.classify_docs(planted.corpus(spark, sf)).select("seq", "model_dna.raw_traits.*")
    return traits.select("seq", "persona_found", *as_long("tech_stack_count", "constraint_count"))


# ------------------------------------------------------------------------- F: filters


@query
def valid_docs(spark, sf):
    return valid_corpus(spark, sf).select("seq", "url")


_FILE = ("seq", "url", "content_hash", "platform", "confidence")


@query
def by_url(spark, sf):
    return catalogue.by_url(classified_files(spark, sf), LOOKUP_URL).select(*_FILE)


@query
def by_hash(spark, sf):
    return catalogue.by_hash(classified_files(spark, sf), LOOKUP_HASH).select(*_FILE)


@query
def by_platform(spark, sf):
    return catalogue.by_platform(classified_files(spark, sf), "crewai").select(*_FILE)


@query
def with_secrets(spark, sf):
    return catalogue.with_secrets(files(spark, sf)).select(*_FILE)


@query
def where_metadata(spark, sf):
    index = vectors.index_rows(files(spark, sf))
    return index.filter((F.col("platform") == "unknown") & (F.col("has_secrets") == 1)).select("id", "url", "tags")


@query
def has_secrets(spark, sf):
    return scanned(spark, sf).select("seq", "has_secrets")


@query
def exclude_domains(spark, sf):
    return harvest.harvest_links(planted.linked_pages(spark, sf), exclude_domains=cat.EXCLUDED_HOSTS).select("page_id", "url")


@query
def external_only(spark, sf):
    return harvest.harvest_links(planted.linked_pages(spark, sf), exclude_domains=()).select("page_id", "url")


# ---------------------------------------------------------------------- E: extraction


def _extract_query(name: str, fn) -> None:
    def run(spark, sf):
        found = fn("raw_content", "_hay")
        return with_haystack(spark, sf).select("seq", F.size(found).cast("bigint").alias("n"), joined(found).alias("found"))

    _QUERIES[name] = run


_extract_query("prompt_assign", extract.prompt_assign)
_extract_query("prompt_section", extract.prompt_section)
_extract_query("prompt_system_tag", extract.prompt_system_tag)
_extract_query("prompt_persona_span", extract.prompt_persona_span)
_extract_query("prompt_html_tags", extract.prompt_html_tags)
_extract_query("prompt_blocks", extract.prompt_blocks)
_extract_query("constraints", extract.constraints)


@query
def persona(spark, sf):
    return with_haystack(spark, sf).select("seq", extract.persona("raw_content", "_hay").alias("persona"))


@query
def tech_stack(spark, sf):
    lowered = valid_corpus(spark, sf).select("seq", F.lower("raw_content").alias("_lower"))
    return lowered.select("seq", joined(extract.tech_stack("_lower")).alias("tech_stack"))


@query
def model_dna(spark, sf):
    dna = enrich.classify_docs(planted.corpus(spark, sf)).select("seq", "model_dna.*")
    return dna.select(
        "seq", "persona", joined("tech_stack").alias("tech_stack"), joined("constraints").alias("constraints"),
        F.col("raw_traits.persona_found").alias("persona_found"),
    )


@query
def tags(spark, sf):
    return enrich.classify_docs(planted.corpus(spark, sf)).select("seq", F.explode("tags").alias("tag"))


@query
def link_harvest(spark, sf):
    return harvest.harvest_links(planted.linked_pages(spark, sf)).select("page_id", *as_long("pos"), "url")


@query
def unwrap_redirect(spark, sf):
    hrefs = harvest.page_hrefs(planted.linked_pages(spark, sf))
    return hrefs.select("page_id", *as_long("pos"), "href", links.unwrap_redirect("href").alias("target"))


@query
def top_links(spark, sf):
    return harvest.harvest_links(planted.linked_pages(spark, sf), top=2).select("page_id", *as_long("pos"), "url")


# ------------------------------------------------------------------ P: classification


@query
def platform_scores(spark, sf):
    hay = valid_corpus(spark, sf).select("seq", classify.haystack("raw_content", "url").alias("_hay"))
    scores = hay.select("seq", classify.platform_scores("_hay").alias("_scores"))
    hits = scores.select("seq", F.inline_outer(classify.hit_scores("_scores")))
    return hits.filter("platform IS NOT NULL").select("seq", "platform", *as_long("score"))


@query
def platform(spark, sf):
    return enrich.classify_docs(planted.corpus(spark, sf)).select("seq", "platform")


@query
def confidence(spark, sf):
    return enrich.classify_docs(planted.corpus(spark, sf)).select("seq", "platform", "confidence")


@query
def classify_documents(spark, sf):
    return enrich.classify_docs(planted.corpus(spark, sf)).select(
        "seq", "url", "content_hash", "platform", "confidence", text.tags_csv("tags").alias("tags"),
        F.size("system_prompt_blocks").cast("bigint").alias("n_blocks"),
    )


# The short name is taken by the module above.
_QUERIES["classify"] = _QUERIES.pop("classify_documents")


# ------------------------------------------------------------------------- X: secrets


@query
def lines(spark, sf):
    numbered = _documents(spark, sf).select("doc_id", F.posexplode_outer(text.lines("text")).alias("pos", "line"))
    return numbered.filter("line IS NOT NULL").select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_number"), "line")


def _findings(docs: DataFrame) -> DataFrame:
    return enrich.explode_findings(docs, "seq").select(
        "seq", "rule_name", *as_long("line_number", "start"), "redacted", "context"
    )


@query
def secret_findings(spark, sf):
    return _findings(scanned(spark, sf))


@query
def secret_findings_raw_tables(spark, sf):
    """The same scan over the untouched texts of documents, pages and conversations."""
    key = planted.key_sql
    turn = planted.pair_sql("conv_id", "turn", "div")
    parts = [
        tables.read_table(spark, sf, "documents", key="doc_id").selectExpr(f"{key('doc_id', 0)} AS seq", "text AS raw_content"),
        tables.read_table(spark, sf, "pages", key="page_id").selectExpr(f"{key('page_id', planted.PAGE)} AS seq", "html AS raw_content"),
        tables.read_table(spark, sf, "conversations", key="conv_id").selectExpr(
            f"{key(turn, planted.TURN)} AS seq", "text AS raw_content"),
    ]
    return _findings(enrich.scan_secrets(parts[0].unionByName(parts[1]).unionByName(parts[2])))


@query
def secret_rule_counts(spark, sf):
    """Findings per rule, rules without any included."""
    found = enrich.explode_findings(scanned(spark, sf), "seq")
    counts = found.groupBy("rule_name").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"))
    rules = spark.createDataFrame(
        [(i, r.name, r.min_entropy) for i, r in enumerate(cat.SECRET_RULES)], "rule_pos bigint, rule_name string, min_entropy double"
    )
    return rules.join(counts, "rule_name", "left").select(
        "rule_pos", "rule_name", "min_entropy", F.coalesce("n", F.lit(0)).alias("n_findings"), F.coalesce("d", F.lit(0)).alias("n_docs")
    )


@query
def entropy_filter(spark, sf):
    """Matches of the entropy rule per document, with and without its threshold."""
    both = [RAW_ENTROPY_RULE._replace(name="all", min_entropy=0.0), RAW_ENTROPY_RULE._replace(name="kept")]
    found = enrich.scan_secrets(valid_corpus(spark, sf), both)
    return found.select("seq", *[_rule_count(name) for name in ("all", "kept")])


def _rule_count(name: str):
    return F.size(F.filter("findings", lambda f: f["rule"] == name)).cast("bigint").alias(f"n_{name}")


@query
def finding_context(spark, sf):
    return _findings(scanned(spark, sf)).select("seq", "rule_name", "line_number", "start", "context")


@query
def secret_report(spark, sf):
    report = enrich.secret_report(scanned(spark, sf), "seq", "url")
    shown = F.transform("findings", lambda f: F.concat_ws(":", f["rule"], f["line"], f["redacted"]))
    return report.select("seq", "url", *as_long("secret_count"), "has_secrets", joined(shown).alias("findings"))


@query
def custom_rules(spark, sf):
    return _findings(enrich.scan_secrets(valid_corpus(spark, sf), CUSTOM_RULES))


@query
def custom_rules_python(spark, sf):
    return _findings(enrich.scan_secrets(valid_corpus(spark, sf), PYTHON_RULES))


@query
def mask_document(spark, sf):
    return enrich.mask_secrets(valid_corpus(spark, sf)).select("seq", "raw_content")


# ----------------------------------------------------------------- A: catalogue work


@query
def catalogue_count(spark, sf):
    hashed = valid_corpus(spark, sf).select("seq", text.content_hash("raw_content").alias("content_hash"))
    return catalogue.count_rows(dedup.first_per_value(hashed, "content_hash", "seq"))


@query
def dedup_content(spark, sf):
    hashed = valid_corpus(spark, sf).withColumn("content_hash", text.content_hash("raw_content"))
    return dedup.dedup_content(hashed).select("seq", "url", "content_hash")


def _url_log(spark, sf) -> DataFrame:
    """Addresses of both batches with their position."""
    first = planted.corpus(spark, sf).select("seq", "url")
    return first.unionByName(planted.recrawl(spark, sf).select("seq", "url"))


@query
def dedup_urls(spark, sf):
    return dedup.dedup_urls(_url_log(spark, sf), "seq").select("seq", "url")


@query
def upsert_catalogue(spark, sf):
    root = shared_folder(spark) + "/upsert_catalogue"
    catalogue.save_batch(spark, planted.corpus(spark, sf), root, 1, AS_OF)
    catalogue.save_batch(spark, planted.recrawl(spark, sf), root, 2, AS_OF)
    columns = ["seq", "url", "content_hash", F.col("batch").cast("bigint").alias("batch")]
    stored = catalogue.read_files(spark, root).select(*columns, F.lit("accepted").alias("outcome"))
    return stored.unionByName(catalogue.read_rejects(spark, root).select(*columns, F.lit("rejected").alias("outcome")))


@query
def upsert_catalogue_stream(spark, sf):
    """The corpus as a file stream, one micro-batch per trigger, into an empty catalogue."""
    root = shared_folder(spark) + "/upsert_stream"
    planted.corpus(spark, sf).select("seq", "url", "raw_content", "error").write.mode("overwrite").parquet(root + "/inbox")
    inbox = (
        spark.readStream.schema("seq bigint, url string, raw_content string, error string")
        .option("maxFilesPerTrigger", 4).parquet(root + "/inbox")
    )
    ingest_stream(inbox, root, root + "/checkpoint", as_of=AS_OF).awaitTermination()
    return catalogue.read_files(spark, root).select("content_hash", "platform", "has_secrets")


@query
def index_documents(spark, sf):
    root = _indexed(spark, sf, "index_documents")
    ingest.ingest(spark, planted.recrawl(spark, sf), root, 2, AS_OF)
    return vectors.read_index(spark, root).groupBy(F.col("batch").cast("bigint").alias("batch")).agg(
        F.count("*").alias("n"), F.sum(F.col("has_secrets")).alias("n_secrets")
    )


@query
def index_delete(spark, sf):
    root = _indexed(spark, sf, "index_delete")
    gone = vectors.read_index(spark, root).filter(F.col("platform") == "crewai").select("id")
    vectors.delete_from_index(gone, root, 2)
    return vectors.read_index(spark, root).select("id", "platform")


@query
def index_reset(spark, sf):
    """Rows of a collection before it is reset, after that, and after adding the files again."""
    root = _indexed(spark, sf, "index_reset")

    def size(state: str) -> DataFrame:
        n = vectors.read_index(spark, root).count()
        return spark.createDataFrame([(state, n)], "state string, n bigint")

    before = size("before")
    vectors.reset_index(spark, root)
    reset = size("reset")
    vectors.index_batch(spark, catalogue.read_files(spark, root), root, 2)
    return before.unionByName(reset).unionByName(size("again"))


@query
def search_postings(spark, sf):
    """The same search through the postings of the stored collection."""
    root = _indexed(spark, sf, "search_postings")
    vectors.build_postings(spark, root)
    return vectors.search_postings(spark, root, QUERY_TEXT)


@query
def search_stored_index(spark, sf):
    """The text search over a collection that was written and read back."""
    return ingest.search(spark, _indexed(spark, sf, "search_stored_index"), QUERY_TEXT)


@query
def page_catalogue(spark, sf):
    return catalogue.page(classified_files(spark, sf), limit=100, offset=100).select("seq", "url", "ingest_s", "platform")


@query
def findings_of_file(spark, sf):
    found = enrich.explode_findings(files(spark, sf), "url", "content_hash")
    return found.select("url", "content_hash", "rule_name", *as_long("line_number"), "redacted")


@query
def inventory_delta(spark, sf):
    inventory = planted.corpus(spark, sf).select("url")
    return dedup.new_urls(planted.recrawl(spark, sf).select("url", "seq"), inventory, "seq").select("seq", "url")


@query
def inventory_refresh(spark, sf):
    """Harvested links and payload addresses that the page inventory lacks, after writing it back."""
    path = f"{shared_folder(spark)}/inventory"
    pages = tables.read_table(spark, sf, "pages", ["url"])
    url_list.update_urls(pages.limit(0), pages, path, version=1)
    links_found = harvest.harvest_links(planted.linked_pages(spark, sf)).select(_place("pos"), "url")
    bodies = planted.payloads(spark, sf).select("page_id", "github_body")
    from_search = payloads.github_payload_urls(bodies, "github_body").select(_place("pos"), "url")
    added = inventory.refresh(spark, path, 2, links_found, from_search)
    return added.select("url").unionByName(url_list.load_urls(spark, path).select(F.concat(F.lit("stored "), "url").alias("url")))


@query
def inventory_merge(spark, sf):
    return url_list.merge_urls(planted.corpus(spark, sf), planted.recrawl(spark, sf))


@query
def run_summary(spark, sf):
    return catalogue.run_summary(planted.corpus(spark, sf))


@query
def skip_report(spark, sf):
    return catalogue.skip_report(planted.corpus(spark, sf))


@query
def multi_source_union(spark, sf):
    pages = tables.read_table(spark, sf, "pages", ["page_id", "url"]).select(_place(F.lit(0)), "url")
    harvested = harvest.harvest_links(planted.linked_pages(spark, sf)).select(_place("pos"), "url")
    github = planted.payloads(spark, sf).select("page_id", "github_body")
    found = payloads.github_payload_urls(github, "github_body").select(_place("pos"), "url")
    union = dedup.union_sources(pages, harvested, found)
    return union.select("url", *as_long("source"), F.col("pos.page_id").alias("page_id"), F.col("pos.pos").cast("bigint").alias("pos"))


# ---------------------------------------------------------------- V: vectors and search


@query
def build_document(spark, sf):
    docs = enrich.classify_docs(planted.corpus(spark, sf))
    return docs.select("seq", embedding.build_document("system_prompt_blocks", "raw_content").alias("document"))


@query
def tokenize(spark, sf):
    tokens = _documents(spark, sf).select("doc_id", embedding.tokenize("text").alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query
def hash_embed(spark, sf):
    weights = _documents(spark, sf).select("doc_id", embedding.bucket_weights("text").alias("w"))
    return weights.select("doc_id", F.inline(embedding.sparse("w"))).select("doc_id", *as_long("bucket"), "weight")


@query
def l2_normalize(spark, sf):
    weights = _documents(spark, sf).select("doc_id", embedding.bucket_weights("text").alias("w"))
    unit = weights.select("doc_id", embedding.l2_normalize("w").alias("v"))
    return unit.select("doc_id", F.inline(embedding.sparse("v"))).select(
        "doc_id", *as_long("bucket"), F.round("weight", 5).alias("weight")
    )


@query
def index_metadata(spark, sf):
    return vectors.index_rows(files(spark, sf)).select(
        "id", "url", "platform", "tags", F.col("has_secrets").cast("bigint").alias("has_secrets")
    )


@query
def semantic_search(spark, sf):
    return vectors.semantic_search(vectors.index_rows(files(spark, sf)), QUERY_TEXT)


@query
def semantic_search_filtered(spark, sf):
    return vectors.semantic_search(
        vectors.index_rows(files(spark, sf)), FILTER_QUERY, 5, where=F.col("platform") == "langchain"
    )


def _vectors(spark, sf) -> DataFrame:
    return tables.read_table(spark, sf, "embeddings", key="vec_id").withColumnRenamed("vec_id", "id")


@query
def knn_embeddings(spark, sf):
    table = _vectors(spark, sf)
    probe = table.filter(F.col("id") == 0).select("embedding")
    return vectors.knn(table, probe, 10).select("id", "label", "distance")


@query
def knn_batch(spark, sf):
    table = _vectors(spark, sf).select("id", "embedding")
    return vectors.knn_batch(table, table, 5).select("query_id", "id", "distance", *as_long("rank"))


def _every_20th(table: DataFrame) -> DataFrame:
    """The queries of the approximate search; they are compared with all rows."""
    return table.filter("id % 20 = 0")


@query
def knn_batch_approximate(spark, sf):
    table = _vectors(spark, sf).select("id", "embedding")
    found = vectors.knn_batch_projected(table, _every_20th(table))
    return found.select("query_id", "id", "distance", *as_long("rank"))


@query
def knn_recall(spark, sf):
    """Whether the approximate search finds nine tenths of the exact one's neighbours."""
    table = _vectors(spark, sf).select("id", "embedding")
    asked = _every_20th(table)
    measured = vectors.recall(vectors.knn_batch_projected(table, asked), vectors.knn_batch(table, asked))
    return measured.select("n_queries", "n_wanted", (F.col("n_found") >= 0.9 * F.col("n_wanted")).alias("enough"))


@query
def knn_batch_text(spark, sf):
    """Documents nearest to every benchmark passage."""
    docs = _documents(spark, sf).select(F.col("doc_id").alias("id"), embedding.hash_embed("text").alias("embedding"))
    items = tables.read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), embedding.hash_embed("text").alias("embedding")
    )
    return vectors.knn_batch(docs, items, 3).select("query_id", "id", "distance", *as_long("rank"))


# ------------------------------------------------------------ D: predicates on a corpus


def _search_query(name: str, source: str, kind: str | None) -> None:
    def run(spark, sf):
        hits = search.search(planted.search_corpus(spark, sf), source, kind)
        return hits.select("seq", "source", "query", "tags")

    _QUERIES[name] = run


_search_query("search_filename", "every", "filename")
_search_query("search_content", "code-search", "content")
_search_query("search_path", "every", "path")
_search_query("search_combined", "every", "combined")
_search_query("search_extension", "code-search", "extension")
_search_query("search_filetype", "open-web", "content")
_search_query("search_host", "s3", None)
_search_query("search_host_code", "code-host", None)


@query
def predicate_catalogue(spark, sf):
    """All predicates with the number of documents that satisfy them."""
    hits = search.search(planted.search_corpus(spark, sf), "every").groupBy("query_no").agg(F.count("*").alias("n"))
    return search.predicate_table(spark, "every").join(hits, "query_no", "left").select(
        *as_long("query_no"), "source", "query", "kind", "description", F.array_join("tags", ",").alias("tags"),
        F.coalesce("n", F.lit(0)).alias("n_hits"),
    )


@query
def search_all(spark, sf):
    return search.search_all(planted.search_corpus(spark, sf), "all", max_results_per_query=10).select(
        "url", *as_long("query_no", "rank"), "query"
    )


@query
def coverage_grid(spark, sf):
    return search.coverage_grid(all_urls(spark, sf)).select("repo_base", *as_long("pos"), "filename", "url")


# ------------------------------------------------------------------------ M: map functions


@query
def mask_auth_headers(spark, sf):
    masked = planted.request_log(spark, sf).select("event_id", headers.mask_auth_headers("headers").alias("h"))
    shown = F.transform(F.map_entries("h"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return masked.select("event_id", F.array_join(F.array_sort(shown), ";").alias("headers"))
