"""Link harvesting from stored HTML as one array expression per page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalogues as cat
from .regex import let_sql, sql_literal

def _query_value(query: str, name: str) -> str:
    """First non-blank value of a query parameter, decoded; null if there is none.  A per cent
    sign that no two hex digits follow stays as it is."""
    value = f"nullif(regexp_extract({query}, '(?:^|&){name}=([^&]+)', 1), '')"
    return f"try_url_decode(regexp_replace({value}, '%(?![0-9A-Fa-f][0-9A-Fa-f])', '%25'))"


def unwrap_redirect_sql(href: str) -> str:
    """Target of a search-result redirect address, else the address itself."""
    first = (
        f"CASE WHEN startswith({href}, '/url?') THEN"
        f" coalesce({_query_value(f'substring({href}, 6)', 'q')}, {href}) ELSE {href} END"
    )
    query = "split_part(split_part(h, '#', 1), '?', 2)"
    second = (
        "CASE WHEN rlike(h, '^https?://(?i:www\\\\.)?(?i:duckduckgo\\\\.com)(?:[/?#]|$)') THEN"
        f" coalesce({_query_value(query, 'uddg')}, h) ELSE h END"
    )
    return let_sql("h", first, second)


def unwrap_redirect(href: str) -> Column:
    return F.expr(unwrap_redirect_sql(href))


def is_external_sql(href: str) -> str:
    return f"(startswith({href}, 'http://') OR startswith({href}, 'https://'))"


def link_host_sql(href: str) -> str:
    return f"lower(regexp_extract({href}, '^https?://([^/?#]*)', 1))"


def is_excluded_sql(href: str, domains=cat.EXCLUDED_HOSTS) -> str:
    """Host, with or without a leading `www.`, is one of the domains."""
    names = ", ".join(sql_literal(d) for d in domains)
    host = link_host_sql(href)
    return f"({host} IN ({names}) OR regexp_replace({host}, '^www\\\\.', '') IN ({names}))"


def external_links(href_list: str, exclude_domains=cat.EXCLUDED_HOSTS) -> Column:
    """Distinct external targets of a page in page order, redirects unwrapped."""
    keep = is_external_sql("u")
    if exclude_domains:
        keep += f" AND NOT {is_excluded_sql('u', exclude_domains)}"
    return F.expr(
        f"array_distinct(filter(transform({href_list}, x -> {unwrap_redirect_sql('x')}), u -> {keep}))"
    )


def top_links(links: str, n: int) -> Column:
    return F.slice(F.expr(links), 1, n)
