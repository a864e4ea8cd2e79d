from pyspark.sql import functions as F

from gristmill.operators import access, gates, paging, search
from gristmill.sources import responses


def test_synonyms_make_texts_similar(spark):
    docs = spark.createDataFrame([(1, "road crash collision data"), (2, "rainfall by month")], "id int, text string")
    asked = spark.createDataFrame([("q", "traffic accident")], "q string, text string")
    rows = search.semantic_top_k(asked, "q", "text", docs, "id", "text", 5).collect()
    assert [r.id for r in rows] == [1] and rows[0].cosine > 0.4


def catalog(spark):
    return spark.createDataFrame(
        [
            (1, "diabetes study", "d.csv", "glucose rows", "glucose rows", ["uploaded"], ["glucose", "bmi"], 95, 0.0, "local"),
            (2, "rainfall", "r.csv", "rain", "rain", ["climate"], ["month"], 99, 0.0, "local"),
            (3, "misc", "m.csv", "x", "x", [], [], None, 0.5, "other"),
        ],
        "dataset_id int, title string, filename string, description string, ai_summary string, tags array<string>, "
        "columns array<string>, quality_score int, missing_ratio double, provider string",
    )


def test_catalog_search_finds_by_column_and_keeps_unmatched_last(spark):
    asked = spark.createDataFrame([("a", "glucose"), ("b", "")], "query_id string, query string")
    rows = search.catalog_search(asked, catalog(spark), 10).collect()
    assert [r.dataset_id for r in sorted((r for r in rows if r.query_id == "a"), key=lambda r: r.rank)] == [1, 2, 3]
    empty = {r.dataset_id: r for r in rows if r.query_id == "b"}
    assert len(empty) == 3 and empty[2].lexical_relevance == 1.0


def test_catalog_search_min_relevance(spark):
    asked = spark.createDataFrame([("a", "glucose")], "query_id string, query string")
    rows = search.catalog_search(asked, catalog(spark), 10, min_relevance=0.1).collect()
    assert [r.dataset_id for r in rows] == [1]


def test_query_variants(spark):
    row = spark.range(1).select(search.query_variants(F.lit(" Find  Traffic accidents India data "), F.lit(9)).alias("v")).first()
    assert row.v == ["Find Traffic accidents India data", "traffic accidents india", "traffic accidents india dataset", "traffic accidents", "traffic"]
    one = spark.range(1).select(search.query_variants(F.lit("traffic"), F.lit(9)).alias("v")).first()
    assert one.v == ["traffic", "traffic dataset"]


def test_license_policy(spark):
    rows = spark.createDataFrame([("MIT",), ("CC-BY-NC-4.0",), (None,), ("gpl-3.0",)], "l string")
    status = lambda use: [r.status for r in gates.license_decision(rows, gates.resolve_license(F.col("l")), use).collect()]
    assert status("commercial") == ["APPROVED", "REJECTED", "UNKNOWN", "REJECTED"]
    assert status("research") == ["APPROVED", "APPROVED", "UNKNOWN", "REJECTED"]


def test_role_caps_and_best_team(spark):
    members = spark.createDataFrame([(1, 7, "viewer"), (2, 7, "member"), (3, 7, "stranger")], "team_id int, user_id int, team_role string")
    shares = spark.createDataFrame(
        [("d", 10, 1, "edit"), ("d", 10, 2, "view"), ("d", 11, 2, "edit"), ("d", 12, 3, "edit"), ("run", 13, 2, "edit")],
        "resource_type string, resource_id int, team_id int, permission string",
    )
    got = {r.resource_id: r.permission for r in access.shared_permissions(shares, members, "d").collect()}
    assert got == {10: "view", 11: "edit"}


def test_nobody_sees_nothing(spark):
    records = spark.createDataFrame([(1, 2)], "resource_id int, owner_id int")
    assert access.visible_to(None, False, records, None, None, "d").count() == 0


def test_pages_are_clamped(spark):
    rows = spark.range(95)
    page = paging.paginate(rows, ["id"], page=2, page_size=20).orderBy("id").collect()
    assert [r.id for r in page] == list(range(20, 40)) and page[0].total_pages == 5 and page[0].has_next and page[0].has_prev
    last = paging.paginate(rows, ["id"], page=99, page_size=20).collect()
    assert len(last) == 15 and last[0].page == 5 and not last[0].has_next
    assert paging.paginate(rows, ["id"], page=0, page_size=1000).first().page_size == 200


def test_response_parsers_leave_bad_answers_to_the_error_table(spark):
    rows = [
        ("q", "q", "huggingface", 0, 0, 200, '[{"id": "a/b", "downloads": 5, "tags": ["x"]}, {"modelId": "c"}, {"id": ""}]'),
        ("q", "q", "huggingface", 0, 1, 500, "oops"),
        ("q", "q", "kaggle", 3, 0, 200, "not json"),
        ("q", "q", "data.gov", 2, 0, 200, '{"success": false}'),
        ("q", "q", "web", 1, 0, 200, '<a href="https://x.org/1">One</a><a href="https://x.org/1">Again</a><a href="https://google.com/">G</a>'),
    ]
    df = spark.createDataFrame(rows, "query_id string, query string, provider string, provider_order int, query_order int, status int, body string")
    found = {r.url: r for r in responses.parse_all(df).collect()}
    assert set(found) == {"https://huggingface.co/datasets/a/b", "https://huggingface.co/datasets/c", "https://x.org/1"}
    assert found["https://x.org/1"].title == "One"
    errors = sorted(r.error for r in responses.response_errors(df).collect())
    assert errors == ["data.gov: request not successful", "huggingface returned status 500", "kaggle returned malformed JSON"]
