"""URLs as column expressions; resolution against a base as an Arrow UDF."""

from __future__ import annotations

from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Links of these kinds lead to no page; the test is case-sensitive, as links are written.
NO_PAGE = ("mailto:", "tel:", "javascript:", "#")
IMAGE_KINDS = ("jpg", "jpeg", "png", "webp", "gif")


def strip(c: Column) -> Column:
    """Without white space at either end, of any Unicode kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def domain(url: Column) -> Column:
    """scheme://host:port of an absolute URL, else the empty string."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def leads_to_page(href: Column) -> Column:
    found = strip(href)
    return ~(found.startswith(NO_PAGE[0]) | found.startswith(NO_PAGE[1]) | found.startswith(NO_PAGE[2]) | found.startswith(NO_PAGE[3]))


def allowed(url: Column, patterns: list[str]) -> Column:
    """Does any pattern match somewhere; without patterns all do."""
    out = F.lit(not patterns)
    for p in patterns:
        out = out | url.rlike(p)
    return out


def extension(url: Column) -> Column:
    """Lower-cased text after the last dot of the path; a path without a dot as a whole."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def image_kept(src: Column, kinds: tuple[str, ...] = IMAGE_KINDS) -> Column:
    """Inline images always; others by their extension."""
    return src.startswith("data:image/") | extension(src).isin(*kinds)


def canonical(base: str, href: str) -> str:
    """The absolute form of a link, without fragment and without parameters of its last segment; the query stays."""
    try:
        u = urlparse(urljoin(base, href))
    except ValueError:
        return ""
    return f"{u.scheme}://{u.netloc}{u.path}" + (f"?{u.query}" if u.query else "")


def canonical_link(base: Column, href: Column) -> Column:
    @F.arrow_udf("string")
    def run(bases: pa.Array, hrefs: pa.Array) -> pa.Array:
        return pa.array([None if b is None or h is None else canonical(b, h.strip()) for b, h in zip(bases.to_pylist(), hrefs.to_pylist(), strict=True)], pa.string())

    return run(base, href)


def rooted_link(url: Column, href: Column) -> Column:
    """canonical_link for hrefs that begin with one slash or are absolute, without leaving the JVM."""
    whole = F.when(href.startswith("/"), F.concat(domain(url), href)).otherwise(href)
    return F.regexp_replace(F.regexp_replace(whole, r"#.*$", ""), r";[^/?]*(?=$|\?)", "")
