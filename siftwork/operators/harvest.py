"""Links of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalogues as cat
from ..functions import links, markup


def harvest_links(
    pages: DataFrame, key: str = "page_id", html: str = "html", exclude_domains=cat.EXCLUDED_HOSTS, top: int | None = None
) -> DataFrame:
    """One row per distinct external link of a page: (key, pos, url), pos counting from 1.

    Everything happens inside the page's row; nothing is shuffled."""
    found = (
        pages.select(key, markup.anchor_targets(html).alias("_hrefs"))
        .select(key, links.external_links("_hrefs", exclude_domains).alias("links"))
    )
    if top is not None:
        found = found.withColumn("links", links.top_links("links", top))
    return (
        found.select(key, F.posexplode_outer("links").alias("pos", "url"))
        .filter("url IS NOT NULL")
        .withColumn("pos", F.col("pos") + 1)
    )


def page_hrefs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per anchor target of a page as written: (key, pos, href)."""
    return (
        pages.select(key, markup.anchor_targets(html).alias("_hrefs"))
        .select(key, F.posexplode_outer("_hrefs").alias("pos", "href"))
        .filter("href IS NOT NULL")
    )
