"""Parsing captured responses and checking URLs, on responses made from parts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import web
from gristmill.operators import catalog, search
from gristmill.plans.registry import query, table
from gristmill.sources import responses

# Links as outsiders send them: the page URL spoiled in several ways.
_LINK_SQL = """
  SELECT page_id, CASE page_id % 10 WHEN 0 THEN url WHEN 1 THEN ' ' || replace(url, 'http', 'HTTP') || ' '
    WHEN 2 THEN replace(url, '://', '://user:pw@') WHEN 3 THEN 'javascript:alert(1)' WHEN 4 THEN replace(url, '://', ':///')
    WHEN 5 THEN 'http:/' || chr(1) || '/x' WHEN 6 THEN '//' || split_part(url, '://', 2) WHEN 7 THEN 'ftp://' || split_part(url, '://', 2)
    WHEN 8 THEN '' ELSE url || '#a@b' END AS link FROM pages"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, url = F.col("page_id") % 10, F.col("url")
    tail = F.split(url, "://")[1]
    link = (
        F.when(key == 0, url)
        .when(key == 1, F.concat(F.lit(" "), F.replace(url, F.lit("http"), F.lit("HTTP")), F.lit(" ")))
        .when(key == 2, F.replace(url, F.lit("://"), F.lit("://user:pw@")))
        .when(key == 3, "javascript:alert(1)")
        .when(key == 4, F.replace(url, F.lit("://"), F.lit(":///")))
        .when(key == 5, "http:/\u0001/x")
        .when(key == 6, F.concat(F.lit("//"), tail))
        .when(key == 7, F.concat(F.lit("ftp://"), tail))
        .when(key == 8, "")
        .otherwise(F.concat(url, F.lit("#a@b")))
    )
    return table(spark, sf_dir, "pages").select("page_id", link.alias("link"))


@query(
    "url_safety",
    f"""WITH l AS ({_LINK_SQL}) SELECT page_id, CASE WHEN page_id % 10 IN (0, 9) THEN link
      WHEN page_id % 10 = 1 THEN replace(trim(link), 'HTTP', 'http') END AS safe_url FROM l""",
)
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("page_id", web.safe_http_url(F.col("link")).alias("safe_url"))


@query(
    "url_slug",
    r"""SELECT page_id, substr(trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 120)
      AS slug, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
      'public-' || substr(sha256('u' || page_id % 3 || ':' || url), 1, 12) AS record_id FROM pages""",
)
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.concat(F.lit("u"), (F.col("page_id") % 3).cast("string"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        web.url_slug(F.col("url")).alias("slug"),
        web.url_host(F.col("url")).alias("host"),
        web.record_id(user, F.col("url")).alias("record_id"),
    )


@query(
    "redirect_urls",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN url WHEN 3 THEN 'https://' || split_part(url, '://', 2)
      WHEN 4 THEN NULL ELSE 'https://www.bing.com/ck/a?u=a1!!' END AS target FROM pages""",
)
def redirect_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped page URLs must come out as they went in."""
    key, url = F.col("page_id") % 6, F.col("url")
    code = F.translate(F.base64(url.cast("binary")), "+/=\r\n", "-_")
    href = (
        F.when(key == 0, url)
        .when(key == 1, F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode(url), F.lit("&rut=1")))
        .when(key == 2, F.concat(F.lit("https://www.bing.com/ck/a?ptn=3&u=a1"), code))
        .when(key == 3, F.concat(F.lit("//"), F.split(url, "://")[1]))
        .when(key == 4, "/relative")
        .otherwise("https://www.bing.com/ck/a?u=a1!!")
    )
    return table(spark, sf_dir, "pages").select("page_id", web.resolve_redirect(href).alias("target"))


_UNESCAPE_SQL = (
    "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)


@query(
    "html_clean_text",
    f"""SELECT page_id, sha256(trim(regexp_replace({_UNESCAPE_SQL.format(x="regexp_replace(html, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g'))) AS text_sha
    FROM pages""",
)
def html_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.sha2(web.clean_html(F.col("html")), 256).alias("text_sha")
    )


def _web_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages made of each page's navigation links, in one of three layouts."""
    key = F.col("page_id")
    links = F.regexp_replace("html", 'href="/', 'href="https://links.example/')
    body = (
        F.when(key % 3 == 0, F.concat(
            F.lit('<ol><li class="b_algo x"><h2 class="t"> <a href="'), F.col("url"), F.lit('"><b>Page</b> &amp; '), key.cast("string"),
            F.lit('</a></h2></li><li class="b_algo"><h2><a href="https://www.bing.com/x">own</a></h2></li></ol>'), links))
        .when(key % 3 == 1, F.concat(
            F.lit('<a class="result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode("url"), F.lit('">R '), key.cast("string"), F.lit("</a>"),
            F.lit('<a class="result__a" href="'), F.col("url"), F.lit('">again</a><a class="result__a" href="https://u.example/"> </a>'), links))
        .otherwise(links)
    )
    return table(spark, sf_dir, "pages").select(
        key.alias("query_id"), F.lit("q").alias("query"), F.lit("web").alias("provider"), F.lit(1).alias("provider_order"),
        F.lit(0).alias("query_order"), F.when(key % 10 == 9, 503).otherwise(200).alias("status"), body.alias("body"),
    )


@query(
    "html_links",
    f"""WITH p AS (SELECT page_id, url, replace(html, 'href="/', 'href="https://links.example/') AS body FROM pages
        WHERE page_id % 10 <> 9),
    raw AS (SELECT page_id, unnest(regexp_extract_all(body, '(?is)<a[^>]+href="(https?://[^"]+)"[^>]*>(.*?)</a>', 1)) AS href,
        unnest(regexp_extract_all(body, '(?is)<a[^>]+href="(https?://[^"]+)"[^>]*>(.*?)</a>', 2)) AS label,
        generate_subscripts(regexp_extract_all(body, '(?is)<a[^>]+href="(https?://[^"]+)"[^>]*>(.*?)</a>', 1), 1) AS pos FROM p WHERE page_id % 3 = 2),
    t AS (SELECT page_id, {_UNESCAPE_SQL.format(x='href')} AS url, pos,
        trim(regexp_replace({_UNESCAPE_SQL.format(x="regexp_replace(label, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS title FROM raw),
    u AS (SELECT page_id, url, arg_min(title, pos) AS title FROM t WHERE title <> '' GROUP BY 1, 2)
    SELECT page_id AS query_id, url, title, substr(trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 120) AS id FROM u
    UNION ALL SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'Page & ' ELSE 'R ' END || page_id,
      substr(trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 120) FROM p WHERE page_id % 3 < 2""",
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = responses.parse_web_results(_web_responses(spark, sf_dir))
    return found.select("query_id", "url", "title", "id")


@query(
    "html_listing",
    """SELECT page_id AS query_id, 'd' || page_id AS id, 'Title ' || page_id || ' & more' AS title,
      'https://catalog.data.gov/dataset/d' || page_id AS url, 'About ' || url AS description, 'csv,json' AS tags
    FROM pages WHERE page_id % 4 <> 3""",
)
def html_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portal listings with one good item, one foreign link and an item without a title."""
    key = F.col("page_id").cast("string")
    body = F.concat(
        F.lit('<ul>\n<li class="a organization-datasets__item">\n<h3><a class="usa-link" href="/dataset/d'), key, F.lit('"><b>Title</b>\n'), key,
        F.lit(' &amp; more</a></h3><p class="usa-collection__description">About <i>'), F.col("url"),
        F.lit('</i></p><span data-format="JSON"></span><span data-format="csv"></span><span data-format="CSV"></span></li>\n'
              '<li class="organization-datasets__item"><a class="usa-link" href="https://x.example/">out</a></li>'
              '<li class="organization-datasets__item"><a class="usa-link" href="/dataset/none"> </a></li> </ul>'),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("query_id"), F.lit("q").alias("query"), F.lit("data.gov-html").alias("provider"),
        F.lit(2).alias("provider_order"), F.lit(0).alias("query_order"),
        F.when(F.col("page_id") % 4 == 3, 500).otherwise(200).alias("status"), body.alias("body"),
    )
    return responses.parse_listing_html(pages).select(
        "query_id", "id", "title", "url", "description", F.array_join("tags", ",").alias("tags")
    )


def _api_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hub, portal and list answers made from parts; some broken, some of the wrong shape."""
    key = F.col("p_partkey")
    text = key.cast("string")
    hub = F.concat(
        F.lit('[{"id": "org/'), F.col("p_name"), F.lit('", "downloads": '), F.col("p_size").cast("string"),
        F.lit(', "description": "d", "tags": ["t1", "t2"]}, {"modelId": "m/'), text, F.lit('", "tags": null}, {"id": "", "downloads": 9}]'),
    )
    portal = F.concat(
        F.lit('{"success": true, "result": {"results": [{"name": "n'), text, F.lit('", "title": "", "notes": null, "tags": [{"name": "a"}, {"name": ""}, {}]}, {"title": "x"}]}}'),
    )
    listing = F.concat(F.lit('[{"ref": "o/'), text, F.lit('", "title": "T", "subtitle": "S", "downloadCount": '), (key % 50).cast("string"), F.lit("}]"))
    kind = key % 7
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("query_id"),
        F.lower("p_type").alias("query"),
        F.when(kind.isin(0, 3), "huggingface").when(kind.isin(1, 4), "data.gov").otherwise("kaggle").alias("provider"),
        F.when(kind.isin(0, 3), 0).when(kind.isin(1, 4), 2).otherwise(3).alias("provider_order"),
        key.alias("query_order"),
        F.when(kind == 6, 429).otherwise(200).alias("status"),
        F.when(kind == 0, hub).when(kind == 1, portal).when(kind == 2, listing).when(kind == 3, '{"error": 1}')
        .when(kind == 4, '{"success": false}').when(kind == 5, "<html>").otherwise(listing).alias("body"),
    )


_API_SQL = """
  c AS (SELECT p_type AS query_id, p_partkey AS query_order, 0 AS provider_order, 0 AS position, 'huggingface' AS provider, 'org/' || p_name AS id,
      'https://huggingface.co/datasets/org/' || p_name AS url, 'd' AS description, p_size AS downloads, 't1,t2' AS tags FROM part WHERE p_partkey % 7 = 0
    UNION ALL SELECT p_type, p_partkey, 0, 1, 'huggingface', 'm/' || p_partkey, 'https://huggingface.co/datasets/m/' || p_partkey, '', 0, '' FROM part WHERE p_partkey % 7 = 0
    UNION ALL SELECT p_type, p_partkey, 2, 0, 'data.gov', 'n' || p_partkey, 'https://catalog.data.gov/dataset/n' || p_partkey, '', 0, 'a' FROM part WHERE p_partkey % 7 = 1
    UNION ALL SELECT p_type, p_partkey, 3, 0, 'kaggle', 'o/' || p_partkey, 'https://www.kaggle.com/datasets/o/' || p_partkey, 'S', p_partkey % 50, '' FROM part WHERE p_partkey % 7 = 2)"""


@query("api_candidates", f"WITH {_API_SQL} SELECT query_id, query_order, position, provider, id, url, description, CAST(downloads AS BIGINT) AS downloads, tags FROM c")
def api_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.parse_all(_api_responses(spark, sf_dir)).select(
        "query_id", "query_order", "position", "provider", "id", "url", "description", "downloads",
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    "response_errors",
    """SELECT p_type AS query_id, p_partkey AS query_order, CASE p_partkey % 7 WHEN 3 THEN 'huggingface: unexpected response shape'
      WHEN 4 THEN 'data.gov: request not successful' WHEN 5 THEN 'kaggle returned malformed JSON' ELSE 'kaggle returned status 429' END AS error
    FROM part WHERE p_partkey % 7 >= 3""",
)
def response_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.response_errors(_api_responses(spark, sf_dir)).select("query_id", "query_order", "error")


@query(
    "discovery_dedup_topn",
    f"""WITH {_API_SQL},
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, query_order, provider ORDER BY position) AS nth FROM c),
    u AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY provider_order, query_order, position) AS seen
      FROM k WHERE nth <= 12)
    SELECT query_id, provider, url, CAST(downloads AS BIGINT) AS downloads,
      row_number() OVER (PARTITION BY query_id ORDER BY downloads DESC, provider_order, query_order, position) AS place
    FROM u WHERE seen = 1""",
)
def discovery_dedup_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 results of each provider call, then the first-seen URL, then one order by downloads."""
    found = responses.parse_all(_api_responses(spark, sf_dir))
    order = ["provider_order", "query_order", "position"]
    called = search.top_k(found, ["query_id", "query_order", "provider"], [F.asc("position")], 12, "nth").drop("nth")
    unique = search.first_seen(called, ["query_id"], "url", order)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("downloads"), *[F.asc(c) for c in order]))
    return unique.select("query_id", "provider", "url", "downloads", place.alias("place"))


@query(
    "blocked_hosts",
    """WITH l AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://WWW.google.com/url?q=' || url ELSE url END AS link FROM pages)
    SELECT page_id, link FROM l WHERE page_id % 4 <> 0""",
)
def blocked_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://WWW.google.com/url?q="), "url")).otherwise(F.col("url"))
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", link.alias("link"))
        .where(~web.url_host(F.col("link")).isin(*web.BLOCKED_HOSTS))
    )


@query(
    "save_public_candidates",
    f"""WITH {_API_SQL} SELECT 'public-' || substr(sha256('anon:' || url), 1, 12) AS dataset_id, provider, url AS source_url, query_order, position,
      CASE WHEN description = '' THEN 'Public dataset from ' || CASE provider WHEN 'huggingface' THEN 'HuggingFace Hub' WHEN 'kaggle' THEN 'Kaggle'
        ELSE provider END || ' saved from search.' ELSE description END AS description,
      array_to_string(list_sort(list_filter(string_split(tags, ','), lambda t: t <> '') || ['public', provider]), ',') AS tags FROM c""",
)
def save_public_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = responses.parse_all(_api_responses(spark, sf_dir))
    saved = catalog.save_candidates(found, F.lit(None).cast("string"), F.col("query"), ["query_order", "position"])
    return saved.select(
        "dataset_id", "provider", "source_url", "query_order", "position", "description",
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    "index_uploads",
    """SELECT 'local-' || substr(sha256(source), 1, 12) AS id, source || '.part' AS title, source || '.part.jsonl' AS filename, NULL AS url,
      count(*) AS rows, array_to_string(list_sort(list_distinct(['doc_id', 'n_chars', 'part', 'text', 'uploaded', source])), ',') AS tags
    FROM documents GROUP BY source""",
)
def index_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = F.array(F.lit("Doc_ID"), F.lit("text"), F.lit("n_chars"))
    results = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("row_count")).select(
        F.concat(F.lit("local-"), F.substring(F.sha2("source", 256), 1, 12)).alias("dataset_id"),
        F.concat("source", F.lit(".part.jsonl")).alias("filename"),
        F.lit("jsonl").alias("format"),
        "row_count",
        columns.alias("columns"),
        F.lit(None).cast("int").alias("quality_score"),
        F.lit("").alias("quality_narrative"),
        F.lit("").alias("summary"),
        F.lit("2024-01-01").alias("created_at"),
        F.lit(None).cast("string").alias("user_id"),
    )
    records = catalog.api_rows(catalog.index_uploads(results))
    return records.select("id", "title", "filename", "url", "rows", F.array_join("tags", ",").alias("tags"))


@query(
    "catalog_listing",
    """SELECT o_orderkey AS dataset_id, o_custkey AS user_id, o_orderdate AS created_at FROM orders
    WHERE o_orderpriority = '2-HIGH' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""",
)
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one project among those a caller may see."""
    records = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dataset_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("project"), F.col("o_orderdate").alias("created_at"),
    )
    allowed = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("dataset_id"))
    return catalog.scoped(records, project="2-HIGH", allowed=allowed).drop("project")


@query(
    "schema_entries",
    """SELECT doc_id, unnest(['text', 'lang']) AS name, unnest(['string', 'string']) AS type, unnest([0, CASE WHEN lang = 'en' THEN 0 ELSE 1 END]) AS missing_count FROM documents""",
)
def schema_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = lambda missing: F.struct(F.lit("string").alias("type"), missing.alias("missing_count"))
    schema = F.create_map(
        F.lit("text"), column(F.lit(0)), F.lit("lang"), column(F.when(F.col("lang") == "en", 0).otherwise(1))
    )
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.explode(catalog.schema_entries(schema)).alias("e"))
        .select("doc_id", "e.*")
    )
