"""URL checks and rewriting, HTML text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text as tx

URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
URL_CONTROL = r"[\x00-\x1f\x7f]"
SLUG_LENGTH = 120
DEFAULT_SLUG = "web-dataset"

# Search engines' own hosts, never results.
BLOCKED_HOSTS = (
    "duckduckgo.com",
    "www.duckduckgo.com",
    "google.com",
    "www.google.com",
    "bing.com",
    "www.bing.com",
)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PARTS, 2))


def safe_http_url(value: Column) -> Column:
    """The URL with its scheme in lower case, or null when it must not be stored or shown.

    Accepted are absolute http(s) URLs with a host, without credentials or control characters.
    """
    url = tx.strip(F.coalesce(value, F.lit("")))
    scheme = F.lower(F.regexp_extract(url, URL_PARTS, 1))
    netloc = F.regexp_extract(url, URL_PARTS, 2)
    userinfo = F.regexp_extract(netloc, "^(.*)@", 1)
    good = (
        ~url.rlike(URL_CONTROL)
        & scheme.isin("http", "https")
        & (netloc != "")
        & userinfo.isin("", ":")
    )
    rest = F.substring(url, F.length(scheme) + 1, F.length(url))
    return F.when(good, F.concat(scheme, rest))


def url_slug(url: Column) -> Column:
    """Readable id from host and path."""
    path = F.regexp_replace(F.regexp_extract(url, URL_PARTS, 3), ";[^/]*$", "")
    plain = F.lower(F.concat(F.regexp_extract(url, URL_PARTS, 2), path))
    slug = F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(slug, 1, SLUG_LENGTH), F.lit("")), F.lit(DEFAULT_SLUG))


def record_id(user: Column, url: Column) -> Column:
    """Deterministic catalog id of a saved public dataset."""
    owner = F.coalesce(F.nullif(user, F.lit("")), F.lit("anon"))
    digest = F.sha2(F.concat(owner, F.lit(":"), url), 256)
    return F.concat(F.lit("public-"), F.substring(digest, 1, 12))


def query_parameter(url: Column, name: str) -> Column:
    raw = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.coalesce(F.try_url_decode(raw), F.lit(""))


def _base64_target(value: Column) -> Column:
    code = F.translate(F.regexp_replace(value, "^a1", ""), "-_", "+/")
    padded = F.concat(code, F.repeat(F.lit("="), F.pmod(-F.length(code), F.lit(4))))
    target = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(target.rlike("^https?://"), target)


def resolve_redirect(href: Column) -> Column:
    """Target of a search-result link (entities already resolved); null when it is not http(s)."""
    href = tx.strip(href)
    # Path and host also of scheme-less links.
    path = F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    host = F.lower(F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    wrapped = query_parameter(href, "uddg")
    # A plus sign stands for itself in the second decoding.
    unwrapped = F.coalesce(F.try_url_decode(F.replace(wrapped, F.lit("+"), F.lit("%2B"))), F.lit(""))
    target = (
        F.when(path == "/l/", unwrapped)
        .when(
            host.endswith("bing.com") & path.startswith("/ck/"),
            F.coalesce(_base64_target(query_parameter(href, "u")), href),
        )
        .otherwise(href)
    )
    absolute = F.when(target.startswith("//"), F.concat(F.lit("https:"), target)).otherwise(target)
    return F.when(absolute.rlike("^https?://"), absolute)


@F.pandas_udf(T.StringType())
def unescape_html(values: pd.Series) -> pd.Series:
    """Resolve HTML entities; the full entity table is the standard library's. Other texts are passed on."""
    found = values.str.contains("&", regex=False).fillna(False).astype(bool)
    return values.where(~found, values[found].map(html.unescape))


def strip_tags(value: Column) -> Column:
    return F.regexp_replace(value, "<[^>]+>", " ")


def clean_html(value: Column) -> Column:
    """Text of an HTML fragment: tags dropped, entities resolved, white space collapsed."""
    return tx.collapse_whitespace(unescape_html(strip_tags(value)))
