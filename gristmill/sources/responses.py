"""Candidates out of captured search responses (a table with one raw response per row).

A response has ``query_id, query, provider, provider_order, query_order, status, body``. Every
parser keeps these keys and yields ``position, id, title, url, source, description,
downloads, tags``. Unusable responses are left out here and reported by ``response_errors``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions import web

KEYS = ["query_id", "query", "provider", "provider_order", "query_order"]
DESCRIPTION_LENGTH = 500
MAX_TAGS = 12

# Base addresses of dataset pages and display names per provider.
HUB_WEB, HUB_NAME = "https://huggingface.co/datasets/", "HuggingFace Hub"
PORTAL_WEB, PORTAL_NAME = "https://catalog.data.gov/dataset/", "data.gov"
PORTAL_ROOT = "https://catalog.data.gov"
LIST_WEB, LIST_NAME = "https://www.kaggle.com/datasets/", "Kaggle"
WEB_NAME = "Web"

# Patterns of listing and result pages.
LISTING_ITEM = (
    r'(?is)<li[^>]*class="[^"]*organization-datasets__item[^"]*"[^>]*>(.*?)</li>\s*(?=<li|\s*</ul>)'
)
LISTING_LINK = r'(?is)<a[^>]+class="[^"]*usa-link[^"]*"[^>]+href="([^"]+)"[^>]*>(.*?)</a>'
LISTING_TEXT = r'(?is)<p[^>]*class="[^"]*usa-collection__description[^"]*"[^>]*>(.*?)</p>'
LISTING_FORMAT = r'(?i)data-format="([^"]+)"'
RESULT_BLOCK = r'(?is)<li[^>]+class="[^"]*b_algo[^"]*"[^>]*>(.*?)</li>'
BLOCK_LINK = r'(?is)<h2[^>]*>\s*<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'
RESULT_LINK = r'(?is)<a[^>]+class="[^"]*result__a[^"]*"[^>]+href="([^"]+)"[^>]*>(.*?)</a>'
ANY_LINK = r'(?is)<a[^>]+href="(https?://[^"]+)"[^>]*>(.*?)</a>'


def _get(value: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _present(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def _usable(responses: DataFrame, provider: str) -> DataFrame:
    return responses.where((F.col("provider") == provider) & (F.col("status") == 200)).select(
        *KEYS, F.try_parse_json("body").alias("doc")
    )


def _items(parsed: DataFrame, rows: Column) -> DataFrame:
    items = F.when(_is_list(rows), rows.cast("array<variant>"))
    return parsed.select(*KEYS, F.posexplode(items).alias("position", "item"))


def _candidate(df: DataFrame, id_: Column, title: Column, url: Column, source: str, description: Column,
               downloads: Column, tags: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(
        *KEYS,
        "position",
        id_.alias("id"),
        title.alias("title"),
        url.alias("url"),
        F.lit(source).alias("source"),
        F.substring(F.coalesce(description, F.lit("")), 1, DESCRIPTION_LENGTH).alias("description"),
        F.coalesce(downloads, F.lit(0)).cast("long").alias("downloads"),
        F.slice(F.coalesce(tags, none), 1, MAX_TAGS).alias("tags"),
    )


def parse_hub(responses: DataFrame) -> DataFrame:
    """JSON array of models or datasets; the id may stand under either of two keys."""
    parsed = _usable(responses, "huggingface")
    rows = _items(parsed, F.col("doc")).withColumn(
        "key", F.coalesce(_present(_get("item", "$.id")), _present(_get("item", "$.modelId")))
    ).where("key IS NOT NULL")
    return _candidate(
        rows, F.col("key"), F.col("key"), F.concat(F.lit(HUB_WEB), "key"), HUB_NAME,
        _get("item", "$.description"), _get("item", "$.downloads", "bigint"), _get("item", "$.tags", "array<string>"),
    )


def parse_portal(responses: DataFrame) -> DataFrame:
    """JSON of an open-data portal; nothing unless the answer says it succeeded."""
    parsed = _usable(responses, "data.gov").where(F.coalesce(_get("doc", "$.success", "boolean"), F.lit(False)))
    rows = _items(parsed, _get("doc", "$.result.results", "variant")).withColumn(
        "key", _present(_get("item", "$.name"))
    ).where("key IS NOT NULL")
    names = F.transform(
        _get("item", "$.tags", "array<variant>"), lambda t: _present(F.try_variant_get(t, "$.name", "string"))
    )
    return _candidate(
        rows, F.col("key"), F.coalesce(_present(_get("item", "$.title")), F.col("key")),
        F.concat(F.lit(PORTAL_WEB), "key"), PORTAL_NAME, _get("item", "$.notes"), F.lit(0), F.array_compact(names),
    )


def parse_list(responses: DataFrame) -> DataFrame:
    """JSON array keyed by ``ref``."""
    parsed = _usable(responses, "kaggle")
    rows = _items(parsed, F.col("doc")).withColumn("key", _present(_get("item", "$.ref"))).where("key IS NOT NULL")
    return _candidate(
        rows, F.col("key"), F.coalesce(_present(_get("item", "$.title")), F.col("key")),
        F.concat(F.lit(LIST_WEB), "key"), LIST_NAME, _get("item", "$.subtitle"),
        _get("item", "$.downloadCount", "bigint"), F.lit(None).cast("array<string>"),
    )


def parse_listing_html(responses: DataFrame, provider: str = "data.gov-html") -> DataFrame:
    """Item blocks of a portal's HTML listing."""
    pages = responses.where((F.col("provider") == provider) & (F.col("status") == 200))
    items = pages.select(
        *KEYS, F.posexplode(F.regexp_extract_all("body", F.lit(LISTING_ITEM), F.lit(1))).alias("position", "block")
    )
    found = items.where(F.col("block").rlike(LISTING_LINK)).select(
        *KEYS,
        "position",
        web.unescape_html(F.regexp_extract("block", LISTING_LINK, 1)).alias("href"),
        web.clean_html(F.regexp_extract("block", LISTING_LINK, 2)).alias("title"),
        web.clean_html(F.regexp_extract("block", LISTING_TEXT, 1)).alias("text"),
        web.unescape_html(
            F.array_join(F.regexp_extract_all("block", F.lit(LISTING_FORMAT), F.lit(1)), "\u001f")
        ).alias("formats"),
    ).withColumn("href", tx.strip(F.col("href")))
    rows = found.where(F.col("href").startswith("/dataset/") & (F.col("title") != ""))
    formats = F.transform(
        F.split("formats", "\u001f"), lambda f: F.lower(tx.collapse_whitespace(web.strip_tags(f)))
    )
    return _candidate(
        rows, F.substring_index("href", "/", -1), F.col("title"), F.concat(F.lit(PORTAL_ROOT), "href"), PORTAL_NAME,
        F.col("text"), F.lit(0), F.array_sort(F.array_distinct(F.filter(formats, lambda f: f != ""))),
    )


def parse_web_results(responses: DataFrame, provider: str = "web") -> DataFrame:
    """Links of a web result page: result blocks, else result anchors, else any absolute link.

    Redirect wrappers are resolved, search engines' own hosts and untitled links dropped, and
    repeats of a URL within one response kept once.
    """
    pages = responses.where((F.col("provider") == provider) & (F.col("status") == 200))

    def links(text: Column, pattern: str) -> Column:
        return F.arrays_zip(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("href"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("label"),
        )

    def block_link(block: Column) -> Column:
        return F.struct(
            F.regexp_extract(block, BLOCK_LINK, 1).alias("href"), F.regexp_extract(block, BLOCK_LINK, 2).alias("label")
        )

    blocks = F.filter(
        F.transform(F.regexp_extract_all("body", F.lit(RESULT_BLOCK), F.lit(1)), block_link),
        lambda pair: pair["href"] != "",
    )
    shape = "array<struct<href:string,label:string>>"
    staged = pages.select(*KEYS, "body", blocks.cast(shape).alias("blocks"), links(F.col("body"), RESULT_LINK).cast(shape).alias("anchors"))
    chosen = (
        F.when(F.size("blocks") > 0, F.col("blocks"))
        .when(F.size("anchors") > 0, F.col("anchors"))
        .otherwise(links(F.col("body"), ANY_LINK).cast(shape))
    )
    rows = (
        staged.select(*KEYS, F.posexplode(chosen).alias("position", "pair"))
        .select(
            *KEYS,
            "position",
            web.unescape_html(F.col("pair.href")).alias("href"),
            web.clean_html(F.col("pair.label")).alias("title"),
        )
        .withColumn("url", web.resolve_redirect(F.col("href")))
        .where(F.col("url").isNotNull() & (F.col("title") != "") & ~web.url_host(F.col("url")).isin(*web.BLOCKED_HOSTS))
    )
    first = rows.groupBy(*KEYS, "url").agg(
        F.min("position").alias("position"), F.min_by("title", "position").alias("title")
    )
    return _candidate(
        first, web.url_slug(F.col("url")), F.col("title"), F.col("url"), WEB_NAME,
        F.concat(F.lit("Web result for dataset search: "), "title"), F.lit(0), F.array(F.lit("web"), F.lit("dataset")),
    )


def parse_all(responses: DataFrame) -> DataFrame:
    parsers = (parse_hub, parse_portal, parse_list, parse_listing_html, parse_web_results)
    return reduce(lambda a, b: a.unionByName(b), [p(responses) for p in parsers])


def response_errors(responses: DataFrame) -> DataFrame:
    """One row per unusable response; the others are not affected by it."""
    doc = F.try_parse_json("body")
    name = F.col("provider")
    json_based = name.isin("huggingface", "data.gov", "kaggle")
    succeeded = F.coalesce(F.try_variant_get(doc, "$.success", "boolean"), F.lit(False))
    message = (
        F.when(F.col("status") != 200, F.concat(name, F.lit(" returned status "), F.col("status").cast("string")))
        .when(json_based & doc.isNull(), F.concat(name, F.lit(" returned malformed JSON")))
        .when(name.isin("huggingface", "kaggle") & ~_is_list(doc), F.concat(name, F.lit(": unexpected response shape")))
        .when((name == "data.gov") & ~succeeded, F.concat(name, F.lit(": request not successful")))
    )
    return responses.select(*KEYS, message.alias("error")).where("error IS NOT NULL")
