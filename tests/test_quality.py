from pyspark.sql import functions as F

from gristmill.operators import quality


def metrics(spark, rows, schema, **kw):
    df = spark.createDataFrame(rows, schema).withColumn("ds", F.lit("d"))
    return quality.quality_metrics(df, "ds", **kw).collect()[0]


def pairs(n, blank=0):
    return [(f"Explain topic number {i}", "" if i < blank else f"Answer about topic {i}") for i in range(n)]


def test_good_pairs(spark):
    m = metrics(spark, pairs(20), "instruction string, response string")
    assert m.completeness >= 0.99 and m.overall >= 90


def test_blank_responses_lower_completeness(spark):
    assert metrics(spark, pairs(10, 2), "instruction string, response string").completeness == 0.8


def test_identical_rows(spark):
    m = metrics(spark, [("same thing", "same answer")] * 10, "instruction string, response string")
    assert m.diversity == m.duplicate_ratio == 0.1


def test_ragged_rows(spark):
    rows = [(i, f"t {i} x", "k,extra" if i == 4 else "k") for i in range(10)]
    m = metrics(spark, rows, "id int, text string, keys string", key_set="keys", row_id="id")
    assert m.consistency == 0.9


def test_padding_lowers_formatting(spark):
    rows = [(" padded text", "fine answer"), ("tab\t", "x y")] * 5
    assert metrics(spark, rows, "instruction string, response string").formatting == 0.5


def test_inner_tab_is_clean_but_control_is_not(spark):
    m = metrics(spark, [("a\tb",), ("a\x01b",)], "text string")
    assert m.formatting == 0.5


def test_null_is_missing_and_not_clean(spark):
    m = metrics(spark, [("q one", None), ("q two", "a two")], "question string, answer string")
    assert m.completeness == 0.5 and m.formatting == 0.75


def test_long_text(spark):
    long = "word " * 5000
    m = metrics(spark, [(long + str(i), long) for i in range(5)], "instruction string, response string")
    assert m.readability == 0 and m.model_compatibility == 0


def test_single_and_unstructured(spark):
    assert metrics(spark, [(f"text {i}",) for i in range(10)], "text string").model_compatibility == 0.7
    m = metrics(spark, [(i, i) for i in range(10)], "foo int, bar int")
    assert m.model_compatibility == 0.4 and m.completeness == 0


def test_scorer_replaces_a_dimension(spark):
    rows = [(f"text {i}",) for i in range(4)]
    own = {"readability": F.when(F.col("text").endswith("0"), 0.0).otherwise(1.0)}
    assert metrics(spark, rows, "text string", scorers=own).readability == 0.75


def test_report_threshold_and_status(spark):
    df = spark.createDataFrame([(f"text {i}",) for i in range(10)], "text string").withColumn("ds", F.lit("d"))
    m = quality.quality_metrics(df, "ds")
    report = quality.quality_report(m, "enterprise").collect()[0]
    assert report.threshold == 98 and report.requires_generation == (report.score < 98)
    assert quality.quality_report(m, "nonsense").collect()[0].threshold == 90


def test_tier_default(spark):
    row = spark.range(1).select(quality.meets_tier(F.lit(85.0), "nonsense").alias("a"), quality.meets_tier(F.lit(85.0), "production").alias("b")).first()
    assert row.a and not row.b


def test_empty_dataset_gives_no_row(spark):
    df = spark.createDataFrame([], "ds string, text string")
    assert quality.quality_metrics(df, "ds").count() == 0


def test_bias_many_languages(spark):
    df = spark.createDataFrame([("d", x) for x in ["en", "fr", "de", None, "en"]], "ds string, language string")
    row = quality.language_bias(df, "ds", "language").first()
    assert row.languages == "de, en, fr, unknown" and row.distribution_risk == "medium"


def test_band_limits(spark):
    scores = [(0.9, "easy"), (90.0, "easy"), (0.75, "medium"), (55.0, "hard"), (35.0, "very_hard"), (0.1, "intense"), (250.0, "easy"), (0.0, "intense")]
    got = spark.createDataFrame(scores, "s double, want string").select("want", quality.difficulty_band(F.col("s")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_dispersion_of_any_length(spark):
    import math
    import random

    rng = random.Random(2)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    groups = {f"g{n}": [[rng.gauss(1, 1) for _ in range(n)] for _ in range(9)] for n in (3, 64, 66)}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rows += [("mixed", [1.0, 2.0]), ("mixed", [1.0, 2.0, 3.0]), ("zero", [0.0, 0.0]), ("null", None), ("null", [1.0])]
    rows += [("hole", [1.0, None]), ("hole", [1.0, 2.0]), ("empty", [])]
    got = {r.g: (r.row_count, r.dispersion) for r in quality.embedding_dispersion(spark.createDataFrame(rows, "g string, v array<double>"), "g", "v").collect()}
    for g, vectors in groups.items():
        centre = [sum(x) / len(vectors) for x in zip(*vectors)]
        expected = sum(1 - cosine(v, centre) for v in vectors) / len(vectors)
        assert got[g][0] == 9 and abs(got[g][1] - expected) < 1e-5
    assert {g: got[g] for g in ("mixed", "zero", "null", "hole", "empty")} == {
        "mixed": (2, None), "zero": (1, None), "null": (2, None), "hole": (2, None), "empty": (1, None),
    }
