import html

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions import web


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw", ["", "  a b ", " x ", "\x1cq\x85", "one\n\ntwo\t three ", "　"])
def test_words_and_strip_like_python(spark, raw):
    assert value(spark, tx.strip(F.lit(raw))) == raw.strip()
    assert value(spark, tx.words(F.lit(raw))) == raw.split()


def test_tokens(spark):
    assert value(spark, tx.token_bag(F.lit("A big BIG x9, é"))) == ["big", "big", "x9"]
    assert value(spark, tx.token_set(F.lit("A big BIG x9"))) == ["big", "x9"]


@pytest.mark.parametrize("words,tokens", [(0, 0), (1, 2), (3, 4), (1536, 2048), (1537, 2050)])
def test_token_estimate(spark, words, tokens):
    assert value(spark, tx.approx_tokens(F.lit(words))) == tokens


@pytest.mark.parametrize("number,text", [(3.0, "3"), (2.5, "2.50"), (99.999, "100.00")])
def test_number_text(spark, number, text):
    assert value(spark, tx.number_text(F.lit(number))) == text


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://example.com/a?b=1", "https://example.com/a?b=1"),
        (" HTTP://Example.com/x ", "http://Example.com/x"),
        ("javascript:alert(1)", None),
        ("data:text/html,x", None),
        ("//example.com/a", None),
        ("http:///missing", None),
        ("https://user:pw@example.com/", None),
        ("https://user@example.com/", None),
        ("ftp://example.com", None),
        ("http://exa\nmple.com", None),
        ("", None),
        (None, None),
    ],
)
def test_safe_url(spark, url, want):
    assert value(spark, web.safe_http_url(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize(
    "href,want",
    [
        ("/l/?uddg=https%3A%2F%2Fx.org%2Fa%252Bb&r=1", "https://x.org/a+b"),
        ("//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org", "https://x.org"),
        ("https://www.bing.com/ck/a?u=a1aHR0cHM6Ly94Lm9yZy9k&n=1", "https://x.org/d"),
        ("https://www.bing.com/ck/a?u=%%%", "https://www.bing.com/ck/a?u=%%%"),
        ("//x.org/y", "https://x.org/y"),
        ("mailto:a@b", None),
    ],
)
def test_redirects(spark, href, want):
    assert value(spark, web.resolve_redirect(F.lit(href))) == want


def test_slug(spark):
    assert value(spark, web.url_slug(F.lit("https://X.org/A b/c_d?q=1"))) == "x-org-a-b-c-d"
    assert value(spark, web.url_slug(F.lit("https://???"))) == "web-dataset"


def test_clean_html(spark):
    raw = "<p>A&nbsp;&lt;b&gt; &eacute;&#233;\n <i>x</i></p>"
    assert value(spark, web.clean_html(F.lit(raw))) == " ".join(html.unescape("A&nbsp;&lt;b&gt; &eacute;&#233; x").split())
