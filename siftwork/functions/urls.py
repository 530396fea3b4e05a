"""URL canonicalisation as Column expressions over (scheme, host, path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalogues as cat

# RFC 3986 appendix B; it matches every string.
_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def _clean(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _PARTS, 1))


def host_of(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _PARTS, 2)


def path_of(url: Column) -> Column:
    """Path without query, fragment and the `;parameters` of its last segment."""
    return F.regexp_replace(F.regexp_extract(_clean(url), _PARTS, 3), r";[^/]*$", "")


def basename_of(url: Column) -> Column:
    return F.regexp_extract(path_of(url), r"([^/]*)$", 1)


def extension_of(url: Column) -> Column:
    return F.regexp_extract(basename_of(url), r"\.([^.]+)$", 1)


def github_blob_to_raw(url: Column) -> Column:
    pattern = r"^/*([^/]+/[^/]*)/blob/(.*)$"
    path = path_of(url)
    hit = (host_of(url) == cat.CODE_HOST) & path.rlike(pattern)
    return F.when(
        hit,
        F.concat(F.lit(f"https://{cat.RAW_CODE_HOST}/"), F.regexp_replace(path, pattern, "$1/$2")),
    ).otherwise(url)


def gitlab_blob_to_raw(url: Column) -> Column:
    path = path_of(url)
    halves = F.split(path, "/-/blob/", 2)
    return F.when(
        F.contains(path, F.lit("/-/blob/")),
        F.concat(scheme_of(url), F.lit("://"), host_of(url), halves[0], F.lit("/-/raw/"), halves[1]),
    ).otherwise(url)


def bitbucket_src_to_raw(url: Column) -> Column:
    pattern = r"^/*([^/]+/[^/]*)/src/(.*)$"
    path = path_of(url)
    hit = (host_of(url) == cat.SRC_HOST) & path.rlike(pattern)
    return F.when(
        hit,
        F.concat(F.lit(f"https://{cat.SRC_HOST}/"), F.regexp_replace(path, pattern, "$1/raw/$2")),
    ).otherwise(url)


def to_raw_url(url: Column) -> Column:
    """Raw-content address of a repository page; other addresses stay as they are."""
    return (
        F.when(host_of(url) == cat.CODE_HOST, github_blob_to_raw(url))
        .when(F.contains(path_of(url), F.lit("/-/blob/")), gitlab_blob_to_raw(url))
        .otherwise(bitbucket_src_to_raw(url))
    )


def repo_base_github(url: Column) -> Column:
    base = F.regexp_extract(path_of(url), r"^/*([^/]+/[^/]*/[^/]*)/", 1)
    return F.when(
        (host_of(url) == cat.RAW_CODE_HOST) & (base != ""),
        F.concat(F.lit(f"https://{cat.RAW_CODE_HOST}/"), base),
    )


def repo_base_gitlab(url: Column) -> Column:
    halves = F.split(path_of(url), "/-/raw/", 2)
    branch = F.regexp_extract(F.get(halves, F.lit(1)), r"^([^/]*)", 1)
    return F.when(
        branch != "",
        F.concat(scheme_of(url), F.lit("://"), host_of(url), halves[0], F.lit("/-/raw/"), branch),
    )
