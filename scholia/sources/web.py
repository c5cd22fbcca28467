"""Web pages as records: URL checks and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import strip


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def is_private(h: Column) -> Column:
    """Hosts that must not be fetched: local names and private, loopback, link-local and carrier addresses."""
    return h.rlike(r"^(?:localhost|.*\.local|.*\.internal|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(?:1[6-9]|2\d|3[01])\..*|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\..*|\[?::1\]?|\[?f[cd][0-9a-f]{2}:.*|\[?fe80:.*)$") | (h == "")


#: Character references of titles; that of & comes last, so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def title(html: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for entity, char in entities:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return strip(t)


def pages(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    h, scheme = host(F.col(url)), F.regexp_extract(F.lower(F.col(url)), r"^([a-z][a-z0-9+.-]*)://", 1)
    return df.withColumns({"host": h, "scheme": scheme, "allowed": scheme.isin("http", "https") & ~is_private(h), "title": F.coalesce(F.nullif(title(F.col(html)), F.lit("")), h)})
