"""URL functions as Spark columns."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File name endings that are not crawled.
SKIPPED = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".css", ".js", ".xml", ".zip", ".tar", ".gz",
    ".mp3", ".mp4", ".avi", ".mov", ".doc", ".docx", ".xls", ".xlsx", ".exe",
)


def origin(u: Column, lower: bool = False) -> Column:
    """Scheme and authority; null where there is none."""
    o = F.nullif(F.regexp_extract(u, r"^([^:/?#]+://[^/?#]*)", 1), F.lit(""))
    return F.lower(o) if lower else o


def normalize(u: Column) -> Column:
    """Without fragment, and without one slash at the end of a path longer than that slash; the query stays."""
    bare = F.regexp_replace(u, r"#.*$", "")
    return F.regexp_replace(bare, r"^([^:/?#]+://[^/?#]*/[^?]*[^/?]|[^:/?#]+://[^/?#]*/[^?]*/)/(\?.*)?$", "$1$2")


def strip_slashes(u: Column) -> Column:
    return F.regexp_replace(F.coalesce(u, F.lit("")), r"/+$", "")


def skipped_extension(u: Column) -> Column:
    out = F.lit(False)
    for ending in SKIPPED:
        out = out | F.lower(u).endswith(ending)
    return out


def may_crawl(u: Column, seed: Column) -> Column:
    """Same origin as the seed, no fragment, no skipped ending; what was seen is for an anti-join."""
    return F.coalesce(origin(u) == origin(seed), F.lit(False)) & ~u.contains("#") & ~skipped_extension(u)


def is_internal(u: Column, base: Column) -> Column:
    return F.coalesce(origin(u) == origin(base), F.lit(False))


def resolve(base: Column, link: Column) -> Column:
    """Absolute url of a link: absolute and root-relative ones in SQL, the rest by an Arrow UDF on those rows alone."""
    rest = F.when(~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~link.rlike(r"^/([^/]|$)"), link)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.rlike(r"^/([^/]|$)"), F.concat(origin(base), link)).otherwise(_join(base, rest))


@F.pandas_udf(T.StringType())
def _join(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link)])


def is_scrapable(u: Column) -> Column:
    """https, with a host that has a dot."""
    return F.coalesce(u.rlike(r"^https://[^/?#\s]*[^/?#\s.]\.[^/?#\s.][^/?#\s]*"), F.lit(False))


def scrape_error(u: Column) -> Column:
    """Why a url is refused; null if it is not."""
    return (
        F.when(F.coalesce(F.trim(u), F.lit("")) == "", "URL is required").when(~u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), "URL must include a scheme")
        .when(~u.startswith("https://"), "Only HTTPS URLs are allowed").when(~is_scrapable(u), "URL must include a valid domain")
    )


def input_type(c: Column) -> Column:
    """url, question or message."""
    t = F.lower(F.trim(c))
    asks = t.rlike(r"^(what|who|where|when|why|how|is|are|can|could|does|do|did|will|would|should|which)\b") | t.endswith("?")
    return F.when(t.rlike(r"https?://[^\s]+"), "url").when(asks, "question").otherwise("message")


#: Parts of a url that tell the kind of its page, and that mark a login page.
CONTENT_PARTS = {
    "documentation": ("/docs/", "/documentation/", "/api/", "/reference/"), "article": ("/blog/", "/news/", "/post/", "/article/"),
    "ecommerce": ("/product/", "/item/", "/p/", "/shop/"), "data_table": ("/pricing/", "/compare/", "/features/"),
}
LOGIN_SEGMENTS = ("login", "signin", "auth", "log-in", "sign-in", "authenticate", "session", "sso", "oauth", "oidc", "saml", "account", "login?redirect")
LOGIN_QUERIES = ("redirect=login", "returnurl")
LOGIN_WHITELIST = (
    "samsung.com", "apple.com", "microsoft.com", "amazon.com", "ebay.com", "google.com", "facebook.com", "twitter.com",
    "linkedin.com", "github.com", "nvidia.com",
)


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: c.contains(p))


def content_type(u: Column) -> Column:
    """Kind of page by whole parts of its url; null where none tells."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, parts in CONTENT_PARTS.items():
        out = out.when(_any(u, parts), kind)
    return out


def domain(u: Column) -> Column:
    """Host and port without ``www.``, lower-cased; empty where there is none."""
    return F.replace(F.lower(F.regexp_extract(F.coalesce(u, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def looks_like_login(u: Column) -> Column:
    """A segment of the path that names a login, or a query that leads back from one, but on well-known sites."""
    path = F.lower(F.regexp_extract(F.coalesce(u, F.lit("")), r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1))
    query = F.lower(F.regexp_extract(F.coalesce(u, F.lit("")), r"^[^?#]*\?([^#]*)", 1))
    return _any(path, LOGIN_SEGMENTS) | _any(query, LOGIN_QUERIES) & ~domain(u).isin(*LOGIN_WHITELIST)
