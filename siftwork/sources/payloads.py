"""Addresses inside stored search-API response bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import to_raw_url

_GITHUB = "items array<struct<html_url:string>>"
_GITLAB = "array<struct<project_id:bigint,path:string,ref:string>>"


def github_payload_urls(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Raw addresses of a code-search response, one row each, with the position in the body."""
    items = F.from_json(F.col(body), _GITHUB)["items"]
    return (
        bodies.select("*", F.posexplode(items).alias("pos", "item"))
        .filter(F.coalesce(F.col("item.html_url"), F.lit("")) != "")
        .withColumn("url", to_raw_url(F.col("item.html_url")))
        .drop("item", body)
    )


def gitlab_payload_urls(bodies: DataFrame, body: str = "body") -> DataFrame:
    """File addresses of a blob-search response; a body that is not a list gives none.

    An absent `ref` and a null one both become HEAD."""
    items = F.when(F.startswith(F.ltrim(body), F.lit("[")), F.from_json(F.col(body), _GITLAB))
    url = F.concat(
        F.lit("https://gitlab.com/api/v4/projects/"),
        F.col("item.project_id").cast("string"),
        F.lit("/repository/files/"),
        F.replace("item.path", F.lit("/"), F.lit("%2F")),
        F.lit("/raw?ref="),
        F.coalesce("item.ref", F.lit("HEAD")),
    )
    return (
        bodies.select("*", F.posexplode(items).alias("pos", "item"))
        .filter((F.coalesce("item.project_id", F.lit(0)) != 0) & (F.coalesce("item.path", F.lit("")) != ""))
        .withColumn("url", url)
        .drop("item", body)
    )
