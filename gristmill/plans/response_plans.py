"""Reading rows and verdicts out of model answers made from assistant turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import requests
from gristmill.plans.registry import query, table


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers: bare JSON lists, JSON inside prose, objects, and plain prose."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("answer_id"),
        ((F.col("conv_id") + F.col("turn")) % 5).alias("kind"),
        F.length("text").cast("string").alias("n"),
    )
    rows = F.concat(
        F.lit('[{"prompt": "p'), "n", F.lit('", "completion": '), "n", F.lit(', "extra": 1}, {"prompt": "only"}, 5, {"completion": "c", "prompt": "q"}, '
                                                                        '{"completion": "x", "prompt": "y"}]'),
    )
    verdict = F.when(F.length("n") % 2 == 0, "accept").otherwise("maybe")
    return turns.select(
        "answer_id",
        F.when(F.col("kind") == 0, rows)
        .when(F.col("kind") == 1, F.concat(F.lit("Sure, here you go:\n"), rows, F.lit("\nDone.")))
        .when(F.col("kind") == 2, F.concat(F.lit('{"verdict": "'), verdict, F.lit('", "score": '), "n", F.lit(', "issues": ["a", "b"]}')))
        .when(F.col("kind") == 3, 'I say {"verdict": "reject"} for now')
        .otherwise(F.concat(F.lit("nothing here "), "n"))
        .alias("answer"),
    )


_BASE_SQL = "SELECT conv_id || '-' || turn AS answer_id, (conv_id + turn) % 5 AS kind, CAST(length(text) AS VARCHAR) AS n FROM conversations"


@query(
    "model_rows_parsed",
    f"""WITH a AS ({_BASE_SQL}) SELECT answer_id, 1 AS row_number, 'p' || n AS prompt, n AS completion FROM a WHERE kind < 2
    UNION ALL SELECT answer_id, 2, 'q', 'c' FROM a WHERE kind < 2""",
)
def model_rows_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.answer_rows(_answers(spark, sf_dir), "answer_id", "answer", ["prompt", "completion"], 2)


@query(
    "critic_parsed",
    f"""WITH a AS ({_BASE_SQL}) SELECT answer_id, 'accept' AS verdict, CAST(n AS INT) AS score, 2 AS n_issues FROM a WHERE kind = 2 AND length(n) % 2 = 0
    UNION ALL SELECT answer_id, 'reject', 0, 0 FROM a WHERE kind = 3""",
)
def critic_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.answer_verdicts(_answers(spark, sf_dir), "answer_id", "answer")


@query(
    "synthetic_gap_fill",
    """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT max(n) AS target FROM s),
    g AS (SELECT source, target - n AS missing FROM s, q), f AS (SELECT source, unnest(range(missing)) AS i FROM g)
    SELECT source, i AS row_number, '[deterministic] prompt #' || i || ' about ' || source AS prompt,
      '[deterministic] completion #' || i || ' about ' || source AS completion, TRUE AS synthetic FROM f""",
)
def synthetic_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows every source lacks to match the largest one, as tagged placeholders."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    target = sizes.agg(F.max("n")).scalar()
    gaps = sizes.select("source", (target - F.col("n")).alias("missing"))
    return requests.placeholder_rows(gaps, "source", "missing", ["prompt", "completion"], F.col("source"))
