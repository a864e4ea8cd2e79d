"""Quality of JSON-lines collections that grow by micro-batches: quarantine, states, running totals.

A micro-batch is parsed and split into accepted rows and a quarantine with reasons. Of the accepted
rows only a state per dataset is kept: sums, and a theta sketch of the distinct texts. States add
up, so totals never read rows again. A dataset's structure and field set are those of its first
row in the first micro-batch that brings any, and are kept with it.

Every result lies in a folder named by its micro-batch, so one that is repeated after a failure
overwrites itself. Totals of a micro-batch are those of the last finished one before it plus its
own states, which keeps the folder of totals as small as there are datasets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import json_rows, quality
from gristmill.sources import readers

# Distinct texts are exact up to 2**LOG_TEXTS per dataset, then within some 0.4 %.
LOG_TEXTS = 16
SUMS = ("n", "complete", "clean", "n_values", "readable", "over", "same_keys", "rejected")
STATE = (
    "name STRING, structure INT, first_keys STRING, "
    + ", ".join(f"{s} BIGINT" for s in SUMS)
    + ", max_words INT, texts BINARY"
)


class LiveQuality:
    """``ingest`` is the work of a micro-batch of (name, position, line) rows below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(table, batch))
        return self.spark.read.schema(df.schema).parquet(self._path(table, batch))

    def _finished(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/total")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        done = [s.getPath() for s in system.listStatus(path)]
        return sorted(int(p.getName().partition("=")[2]) for p in done if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def totals(self, before: int | None = None) -> DataFrame:
        """Running state per dataset after the last finished micro-batch, or the last one before ``before``."""
        done = [n for n in self._finished() if before is None or n < before]
        if not done:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self._path("total", done[-1]))

    def ingest(self, lines: DataFrame, batch: int) -> None:
        parsed = readers.parse_json_lines(lines.withColumn("_line", F.col("line")), "line")
        reason = F.when(F.col("row").isNull(), "not JSON").when(~F.col("is_object"), "not an object")
        refused = parsed.where(~F.col("is_object")).select("name", "position", F.col("_line").alias("line"), reason.alias("reason"))
        refused = self._write(refused, "quarantine", batch)
        row = F.col("row")
        good = parsed.where("is_object")
        narrow = self._write(
            good.select("name", F.col("position").alias("_row"), json_rows.field_mask(row).cast("int").alias("_mask"), *json_rows.row_measures(row)),
            "measured",
            batch,
        )
        before = self.totals(batch)
        kept = before.where("first_keys is not null").select("name", "structure", "first_keys")
        first = narrow.groupBy("name").agg(
            json_rows.structure_of(F.min_by("_mask", "_row")).alias("structure"), F.min_by("_keys", "_row").alias("first_keys")
        )
        of = first.alias("f").join(kept.alias("k"), "name", "left").select(
            "name",
            F.coalesce("k.structure", "f.structure").cast("int").alias("structure"),
            F.coalesce("k.first_keys", "f.first_keys").alias("first_keys"),
        )
        rows = json_rows.measures(narrow, "name", of).groupBy(
            "name", "structure", "first_keys", "_text_key", "_keys"
        ).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_complete").alias("complete"),
            F.sum("_clean").alias("clean"),
            F.sum("_values").alias("n_values"),
            F.sum(F.col("_words").between(*quality.READABLE_WORDS).cast("long")).alias("readable"),
            F.sum((tx.approx_tokens(F.col("_words")) > quality.MAX_TOKENS).cast("long")).alias("over"),
            F.max("_words").alias("max_words"),
        )
        state = rows.withColumn("same_keys", F.when(F.col("_keys") == F.col("first_keys"), F.col("n")).otherwise(0))
        state = state.groupBy("name", "structure", "first_keys").agg(
            *[F.sum(s).alias(s) for s in SUMS if s != "rejected"],
            F.max("max_words").alias("max_words"),
            F.theta_sketch_agg("_text_key", LOG_TEXTS).alias("texts"),
        )
        count = refused.groupBy("name").agg(F.count(F.lit(1)).alias("rejected"))
        state = state.join(count, "name", "full").select(
            "name", "structure", "first_keys", *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s) for s in SUMS], "max_words", "texts"
        )
        own = self._write(state, "state", batch)
        both = before.unionByName(own).groupBy("name").agg(
            F.max("structure").alias("structure"),
            F.max("first_keys").alias("first_keys"),
            *[F.sum(s).alias(s) for s in SUMS],
            F.max("max_words").alias("max_words"),
            F.theta_union_agg("texts", LOG_TEXTS).alias("texts"),
        )
        self._write(both, "total", batch)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Ingests what is available, trigger by trigger."""
        writer = stream.writeStream.foreachBatch(self.ingest).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def quarantine(self) -> DataFrame:
        return self.spark.read.schema("name STRING, position BIGINT, line STRING, reason STRING").parquet(f"{self.folder}/quarantine")


def dimensions(states: DataFrame) -> DataFrame:
    """Dimensions, score and validation per dataset from states; datasets of refused lines only are not ready."""
    place = F.col("structure")
    n = F.col("n")

    def share(c: Column | str) -> Column:
        return F.coalesce(F.try_divide(F.col(c) if isinstance(c, str) else c, n), F.lit(0.0))

    kinds = F.array(*[F.lit(kind) for kind, _ in json_rows.STRUCTURES])
    bases = F.array(*[F.lit(quality.BASE_COMPATIBILITY[kind]) for kind, _ in json_rows.STRUCTURES])
    kind = F.get(kinds, place)
    texts = F.when(F.col("texts").isNotNull(), F.theta_sketch_estimate("texts")).otherwise(0)
    raw = {
        "completeness": share("complete"),
        "consistency": share("same_keys"),
        "diversity": F.least(F.lit(1.0), share(texts)),
        "duplicate_ratio": F.least(F.lit(1.0), share(texts)),
        "formatting": F.coalesce(F.try_divide(F.col("clean"), F.col("n_values")), F.lit(0.0)),
        "readability": F.when(kind == "none", F.lit(0.0)).otherwise(share("readable")),
        "model_compatibility": F.get(bases, place) * (1 - share("over")),
    }
    overall = sum((raw[d] * F.lit(w) for d, w in list(quality.WEIGHTS.items())[1:]), raw["completeness"] * F.lit(quality.WEIGHTS["completeness"]))
    return states.select(
        "name",
        kind.alias("structure"),
        n.alias("row_count"),
        "rejected",
        (n > 0).alias("ready"),
        *[F.bround(c, 4).alias(d) for d, c in raw.items()],
        F.bround(overall, 2).alias("overall"),
    )
