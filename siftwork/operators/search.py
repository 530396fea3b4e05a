"""Catalogue predicates over a corpus of (seq, url, text).

A predicate is a conjunction: file name, literal in the text, path part, extension, host.  The
whole catalogue is a constant array; a document's atoms (base name, host, literals it holds ...)
are computed once and the array is filtered against them, so any number of predicates costs one
scan and no join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalogues as cat
from ..functions import urls
from ..functions.regex import sql_literal
from ..session import shared_folder
from .enrich import once


@dataclass(frozen=True)
class Predicate:
    query: str
    kind: str
    tags: tuple[str, ...]
    basename: str | None = None
    needle: str | None = None
    path: str | None = None
    extensions: tuple[str, ...] = ()
    host: str | None = None
    host_suffix: str | None = None
    mention: str | None = None

    @property
    def description(self) -> str:
        return f"{self.kind}: " + " + ".join(part for part in (self.basename, self.needle, self.path) if part)


def _filetypes(extensions: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"filetype:{e}" for e in extensions) + ")"


def _engine_predicates(host: str | None) -> list[Predicate]:
    """Web-search predicates, restricted to one host or open."""
    site = f" site:{host}" if host else ""
    extra = () if host else ("open-web",)
    kinds = _filetypes(cat.CONTENT_FILETYPES), _filetypes(cat.PATH_FILETYPES)
    out = [
        Predicate(f'intitle:"{f}"{site}', "filename", ("filename", f, *extra), basename=f, host=host)
        for f in cat.TARGET_FILENAMES
    ]
    out += [
        Predicate(f'"{s}" {kinds[0]}{site}', "content", ("content-signature", *extra), needle=s,
                  extensions=cat.CONTENT_FILETYPES, host=host)
        for s in cat.CONTENT_SIGNATURES
    ]
    out += [
        Predicate(f'inurl:"{p}"{site} {kinds[1]}', "path", ("path", *extra), path=p,
                  extensions=cat.PATH_FILETYPES, host=host)
        for p in cat.TARGET_PATHS
    ]
    out += [
        Predicate(f'intitle:"{f}" "{s}"{site}', "combined", ("combined", f, *extra), basename=f, needle=s, host=host)
        for f in cat.GRID_FILENAMES
        for s in cat.GRID_SIGNATURES
    ]
    return out


def _base(name: str) -> str:
    return name.split("/")[-1]


def _code_search_predicates() -> list[Predicate]:
    out = [Predicate(f"filename:{_base(f)}", "filename", ("filename", _base(f)), basename=_base(f))
           for f in cat.TARGET_FILENAMES]
    out += [Predicate(f'"{s}"', "content", ("content-signature",), needle=s) for s in cat.CONTENT_SIGNATURES]
    out += [Predicate(f"path:{p}", "path", ("path",), path=p) for p in cat.TARGET_PATHS]
    out += [Predicate(f'filename:{_base(f)} "{k}"', "combined", ("combined", _base(f)), basename=_base(f), needle=k)
            for f, k in cat.FILENAME_KEYWORD_PAIRS]
    out += [Predicate(f'extension:{e} "{k}"', "extension", ("extension", e), needle=k, extensions=(e,))
            for e, k in cat.EXTENSION_KEYWORD_PAIRS]
    return out


def _blob_search_predicates() -> list[Predicate]:
    out = [Predicate(_base(f), "filename", ("filename", _base(f)), basename=_base(f)) for f in cat.TARGET_FILENAMES]
    return out + [Predicate(s, "content", ("content-signature",), needle=s) for s in cat.CONTENT_SIGNATURES]


def _s3_predicates() -> list[Predicate]:
    s3 = cat.S3_HOST
    out = [Predicate(f'site:{s3} "{t}"', "s3", ("s3", "listing"), needle=t, host=s3) for t in cat.S3_TERMS]
    out += [Predicate(f'site:*.{s3} "{t}"', "s3", ("s3", "custom-domain"), needle=t, host_suffix="." + s3)
            for t in cat.S3_TERMS]
    out += [Predicate(f'{s3} "{t}" site:{cat.CODE_HOST}', "s3", ("s3", "github-leak"), needle=t, mention=s3,
                      host=cat.CODE_HOST) for t in cat.S3_TERMS]
    return out


_CATALOGUES = {
    "code-host": lambda: _engine_predicates(cat.CODE_HOST),
    "open-web": lambda: _engine_predicates(None),
    "code-search": _code_search_predicates,
    "blob-search": _blob_search_predicates,
    "s3": _s3_predicates,
}
#: Selections of catalogues by name; "github", "web" and "all" are the web-search sources.
SOURCES = {
    "github": ("code-host",),
    "web": ("open-web",),
    "all": ("code-host", "open-web"),
    **{name: (name,) for name in _CATALOGUES},
    "every": tuple(_CATALOGUES),
}


def predicates(source: str = "all") -> list[tuple[str, Predicate]]:
    """(catalogue, predicate) of a selection, in order; the first of equal query texts stays."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}; one of {sorted(SOURCES)}")
    chosen: dict[str, tuple[str, Predicate]] = {}
    for name in SOURCES[source]:
        for predicate in _CATALOGUES[name]():
            chosen.setdefault(predicate.query, (name, predicate))
    return list(chosen.values())


def predicate_table(spark: SparkSession, source: str = "all") -> DataFrame:
    """The selection as a small table."""
    rows = [
        (i, name, p.query, p.kind, p.description, list(p.tags), p.basename, p.needle, p.path, list(p.extensions), p.host,
         p.host_suffix, p.mention)
        for i, (name, p) in enumerate(predicates(source))
    ]
    return spark.createDataFrame(
        rows,
        "query_no int, source string, query string, kind string, description string, tags array<string>, basename string,"
        " needle string, path string, extensions array<string>, host string, host_suffix string, mention string",
    )


def catalogue_dims(spark: SparkSession) -> DataFrame:
    """The constant dimension lists as one table (kind, pos, value)."""
    lists = {
        "filename": cat.TARGET_FILENAMES,
        "signature": cat.CONTENT_SIGNATURES,
        "path": cat.TARGET_PATHS,
        "s3_term": cat.S3_TERMS,
    }
    rows = [(kind, pos, value) for kind, values in lists.items() for pos, value in enumerate(values)]
    return spark.createDataFrame(rows, "kind string, pos int, value string")


def _string(value: str | None) -> str:
    return "cast(NULL AS string)" if value is None else sql_literal(value)


def _strings(values) -> str:
    return "array(" + ", ".join(sql_literal(v) for v in values) + ")" if values else "cast(array() AS array<string>)"


def _literal(number: int, source: str, p: Predicate) -> str:
    return (
        f"named_struct('query_no', {number}, 'source', {sql_literal(source)}, 'query', {sql_literal(p.query)},"
        f" 'kind', {sql_literal(p.kind)}, 'tags', {_strings(p.tags)}, 'basename', {_string(p.basename)},"
        f" 'needle', {_string(p.needle and p.needle.lower())}, 'path', {_string(p.path)},"
        f" 'extensions', {_strings(p.extensions)}, 'host', {_string(p.host)},"
        f" 'host_suffix', {_string(p.host_suffix)}, 'mention', {_string(p.mention)})"
    )


#: Literals from which one automaton is faster than a substring test for each.
_MANY = 64


def _held_by_automaton(haystack: str, values) -> Column:
    """The literals that occur in a text, in one pass over it however many they are."""
    values = tuple(values)

    @F.arrow_udf("array<string>")
    def held(texts: pa.Array) -> pa.Array:
        automaton = _automaton(values)
        found = [sorted({i for _, i in automaton.iter(t)}) if t else [] for t in texts.to_pylist()]
        return pa.array([[values[i] for i in own] for own in found], pa.list_(pa.string()))

    return held(F.col(haystack))


@lru_cache(maxsize=8)
def _automaton(values: tuple[str, ...]):
    """Finds every literal, also those inside another one; built once per worker."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, value in enumerate(values):
        automaton.add_word(value, i)
    automaton.make_automaton()
    return automaton


def _held(haystack: str, values) -> Column:
    """The literals that occur in a text, in their order."""
    if len(values) >= _MANY:
        return _held_by_automaton(haystack, values)
    kept = ", ".join(f"CASE WHEN contains({haystack}, {sql_literal(v)}) THEN {sql_literal(v)} END" for v in values)
    return F.expr(f"array_compact(array({kept}))") if values else F.expr("cast(array() AS array<string>)")


def _matching(chosen: list[tuple[str, Predicate]]) -> Column:
    literals = ", ".join(_literal(i, name, p) for i, (name, p) in enumerate(chosen))
    return F.expr(
        f"filter(array({literals}), p ->"
        " (p.basename IS NULL OR p.basename = _base OR (contains(p.basename, '/') AND endswith(_path, concat('/', p.basename))))"
        " AND (p.host IS NULL OR p.host = _host)"
        " AND (p.host_suffix IS NULL OR endswith(_host, p.host_suffix))"
        " AND (size(p.extensions) = 0 OR array_contains(p.extensions, _ext))"
        " AND (p.path IS NULL OR contains(_path, p.path))"
        " AND (p.needle IS NULL OR array_contains(_held, p.needle))"
        " AND (p.mention IS NULL OR array_contains(_held, p.mention)))"
    )


def match_predicates(docs: DataFrame, chosen: list[tuple[str, Predicate]], text: str = "raw_content") -> DataFrame:
    """Hits: one row per (document, predicate it satisfies).

    Literal text is compared without case; names, paths and hosts as they are (hosts lower-cased)."""
    needles = list(dict.fromkeys(p.needle.lower() for _, p in chosen if p.needle))
    needles += [m for m in dict.fromkeys(p.mention for _, p in chosen if p.mention) if m not in needles]
    url = F.col("url")
    atoms = docs.select(
        "seq",
        "url",
        urls.basename_of(url).alias("_base"),
        urls.path_of(url).alias("_path"),
        urls.extension_of(url).alias("_ext"),
        F.lower(urls.host_of(url)).alias("_host"),
        *([F.lower(text).alias("_lower")] if needles else []),
    )
    # (The optimizer copies no expression out of a generator: the literals are looked for once.)
    atoms = once(atoms, "_held", _held("_lower", needles))
    hits = atoms.select("seq", "url", F.explode_outer(_matching(chosen)).alias("p"))
    return hits.filter(F.col("p").isNotNull()).select(
        "seq", "url", "p.query_no", "p.source", "p.query", "p.kind", F.array_join("p.tags", ",").alias("tags")
    )


def search(docs: DataFrame, source: str = "every", kind: str | None = None, text: str = "raw_content") -> DataFrame:
    """Hits of a catalogue selection, optionally of one kind of predicate."""
    chosen = [c for c in predicates(source) if kind in (None, c[1].kind)]
    return match_predicates(docs, chosen, text)


#: The optimizer limits a window's groups per task up to this rank, by default.
_GROUP_LIMIT = 1000
_SALTS = 64


def first_hits(hits: DataFrame, n: int) -> DataFrame:
    """The first n hits of every query by (seq, url), with their rank.

    A query that all documents satisfy is a group with all rows, so its hits are ranked in two steps:
    by parts of the group first, of which each keeps n.  A small n is then ranked in one window of at
    most n rows a part.  A large one is ranked along the order: the rest is shuffled by range and
    written, a range ranks its own rows, and starts after the rows of the ranges before; what is
    small there is the number of rows per query and range."""
    order = ["seq", "url"]
    salted = Window.partitionBy("query_no", F.pmod(F.xxhash64("seq"), F.lit(_SALTS))).orderBy(*order)
    kept = hits.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= n).drop("rank")
    if n <= _GROUP_LIMIT:
        whole = Window.partitionBy("query_no").orderBy(*order)
        return kept.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= n)
    spark = hits.sparkSession
    folder = shared_folder(spark) + "/hits"
    ranged = kept.repartitionByRange("query_no", *order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(folder)
    ranges = spark.read.schema(ranged.schema).parquet(folder)
    counts = ranges.groupBy("query_no", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("query_no").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("query_no", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("query_no", "_range").orderBy(*order)
    ranked = ranges.filter(F.col("query_no").isNotNull()).withColumn("rank", F.row_number().over(inside)).join(starts, ["query_no", "_range"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("_before")).cast("int"))
    return ranked.filter(F.col("rank") <= n).drop("_range", "_before")


def search_all(
    docs: DataFrame,
    source: str = "all",
    max_queries: int | None = None,
    max_results_per_query: int = 10,
    text: str = "raw_content",
) -> DataFrame:
    """Addresses found by a catalogue: first results per query, then each address once.

    The cap per query is the feature, of any size; it is applied per task before the shuffle (window
    group limit), so a query that matches everything sends a handful of rows."""
    chosen = predicates(source)[:max_queries]
    hits = match_predicates(docs, chosen, text).select("query_no", "query", "seq", "url")
    capped = first_hits(hits, max_results_per_query)
    # The first hit of an address, as one number: an aggregation over numbers needs no sort.
    place = F.col("query_no").cast("bigint") * (1 << 32) + F.col("rank")
    first = capped.groupBy("url").agg(F.min(place).alias("_place"))
    first = first.select("url", F.shiftright("_place", 32).cast("int").alias("query_no"), F.col("_place").bitwiseAND((1 << 32) - 1).cast("int").alias("rank"))
    names = "array(" + ", ".join(sql_literal(p.query) for _, p in chosen) + ")" if chosen else "cast(array() AS array<string>)"
    return first.withColumn("query", F.expr(f"get({names}, query_no)")).orderBy("query_no", "rank")


def coverage_grid(inventory: DataFrame, url: str = "url") -> DataFrame:
    """Expected files that the inventory lacks, per repository base found in it.

    The file names are a constant array exploded per base: no cross join."""
    bases = inventory.select(
        F.coalesce(urls.repo_base_github(F.col(url)), urls.repo_base_gitlab(F.col(url))).alias("repo_base")
    ).filter("repo_base IS NOT NULL").distinct()
    names = F.expr(_strings(cat.TARGET_FILENAMES))
    grid = bases.select("repo_base", F.posexplode(names).alias("pos", "filename")).withColumn(
        "url", F.concat_ws("/", "repo_base", "filename")
    )
    known = inventory.select(F.col(url).alias("url")).distinct()
    return grid.join(known, "url", "left_anti").orderBy("repo_base", "pos")
