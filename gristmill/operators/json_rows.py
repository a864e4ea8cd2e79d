"""Quality, duplicates and facts of schema-less JSON rows held as VARIANT objects.

Which fields make up a dataset's text is known only once its first row (or, after
normalization, all its rows) has been seen. So that no text is shuffled for that, every row is
reduced in one read to what each possible structure needs: the digest and the number of words of
its text and whether its fields are filled. These narrow rows are written; the structure of each
dataset comes from the bit masks of field names in them, and each row then takes the measures
that belong to its dataset's structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import gates, profile, quality, reports
from gristmill.scratch import Scratch

FIELDS = (*[f for pair in quality.FIELD_PAIRS for f in pair], *quality.SINGLE_TEXT_FIELDS)
# In order of precedence; the last one stands for rows without any of the fields.
STRUCTURES = (
    *[("pair", pair) for pair in quality.FIELD_PAIRS],
    *[("single", (field,)) for field in quality.SINGLE_TEXT_FIELDS],
    ("none", ()),
)
# A dataset's one row of structure is repeated so often, and its rows spread over the copies.
SALTS = 64


def _bits(fields: tuple[str, ...]) -> int:
    return sum(1 << FIELDS.index(f) for f in fields)


def fields_of(row: Column) -> Column:
    """A VARIANT object as map of its fields."""
    return row.cast("map<string,variant>")


def value_text(value: Column) -> Column:
    """Text of a VARIANT value, null for a missing one; objects and lists as JSON."""
    return F.try_variant_get(value, "$", "string")


def normalized(row: Column) -> Column:
    """The object with its strings stripped, without blank and null fields."""
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    stripped = F.transform_values(
        fields_of(row),
        lambda _, v: F.when(is_text(v), tx.blank_to_null(value_text(v)).cast("variant")).otherwise(v),
    )
    return F.to_variant_object(F.map_filter(stripped, lambda _, v: v.isNotNull() & ~F.is_variant_null(v)))


def structure_of(mask: Column) -> Column:
    """Place in ``STRUCTURES`` for the field names that ``mask`` has bits of."""
    chosen = F.lit(len(STRUCTURES) - 1)
    for place, (_, fields) in reversed(list(enumerate(STRUCTURES[:-1]))):
        bits = F.lit(_bits(fields))
        chosen = F.when(mask.bitwiseAND(bits) == bits, F.lit(place)).otherwise(chosen)
    return chosen


def _measure(row: Column, fields: tuple[str, ...], json: Column) -> Column:
    """Digest, words and completeness of a row's text under one structure."""
    texts = [F.try_variant_get(row, f"$.{f}", "string") for f in fields]
    # An absent field is an empty text; without any structure the whole object is the text.
    whole = tx.strip(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])) if fields else json
    complete = F.lit(bool(fields))
    for text in texts:
        complete = complete & tx.blank_to_null(text).isNotNull()
    return F.struct(
        F.sha2(whole, 256).alias("key"), complete.cast("long").alias("complete"), tx.word_count(whole).alias("words")
    )


def field_mask(row: Column) -> Column:
    """Bits of the known field names that an object has."""
    names = F.map_keys(fields_of(row))
    return sum((F.when(F.array_contains(names, f), F.lit(1 << k)).otherwise(0) for k, f in enumerate(FIELDS)), F.lit(0))


def row_measures(row: Column, json: Column | None = None) -> list[Column]:
    """What scoring needs of each row, whatever its dataset's structure turns out to be.

    ``json`` is the row as JSON where a column holds it already.
    """
    json = F.to_json(row) if json is None else json
    fields = fields_of(row)
    names = F.array_sort(F.map_keys(fields))
    options = []
    for _, wanted in STRUCTURES:
        some = F.arrays_overlap(names, F.array(*[F.lit(f) for f in wanted])) if wanted else F.lit(True)
        options.append(F.when(some, _measure(row, wanted, json)))
    return [
        F.sha2(F.to_json(names), 256).alias("_keys"),
        F.size(fields).cast("long").alias("_values"),
        F.size(F.filter(F.map_values(fields), lambda v: tx.is_clean_value(value_text(v)))).cast("long").alias("_clean"),
        F.array(*options).alias("_options"),
        F.sha2(json, 256).alias("_row_key"),
    ]


def structures(narrow: DataFrame, dataset: str, aligned: bool) -> DataFrame:
    """(dataset, structure): from the first row by ``_row``, or from all rows if ``aligned``."""
    mask = F.bit_or("_mask") if aligned else F.min_by("_mask", "_row")
    return narrow.groupBy(dataset).agg(structure_of(mask).alias("structure"))


def measures(narrow: DataFrame, dataset: str, of: DataFrame) -> DataFrame:
    """Each row's measures under its dataset's structure, as ``quality.metrics_from_measures`` reads them.

    What else ``of`` says of a dataset is carried along.
    """
    kinds = F.array(*[F.lit(kind) for kind, _ in STRUCTURES])
    bases = F.array(*[F.lit(quality.BASE_COMPATIBILITY[kind]) for kind, _ in STRUCTURES])
    spread = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = narrow.withColumn("_salt", F.pmod(F.xxhash64("_row_key"), F.lit(SALTS)).cast("int"))
    joined = salted.join(spread, [dataset, "_salt"])
    if "column_count" in of.columns:
        # After normalization every row has all of the dataset's fields.
        joined = joined.withColumn("_values", F.col("column_count"))
    option = F.get("_options", F.col("structure"))
    empty = F.struct(F.sha2(F.lit(""), 256).alias("key"), F.lit(0).cast("long").alias("complete"), F.lit(0).alias("words"))
    return joined.withColumn("_o", F.coalesce(option, empty)).select(
        *[c for c in narrow.columns if c not in ("_mask", "_options")],
        *[c for c in of.columns if c not in (dataset, "column_count")],
        F.col("_o.key").alias("_text_key"),
        F.col("_o.complete").alias("_complete"),
        F.col("_o.words").alias("_words"),
        F.get(kinds, F.col("structure")).alias("_kind"),
        F.get(bases, F.col("structure")).alias("_base"),
    )


def _kind(of: DataFrame) -> Column:
    return F.get(F.array(*[F.lit(kind) for kind, _ in STRUCTURES]), of["structure"]).alias("structure")


def json_quality(df: DataFrame, dataset: str, row: str, order: str) -> DataFrame:
    """Dimensions in 0..1, overall score and structure per dataset of ragged JSON objects.

    ``row`` is a VARIANT column of objects. The dataset's structure and field set are those of its
    row of least ``order``; consistency is the share of rows with that field set. A null or absent
    field is incomplete and, where present, no clean value. A dataset without rows has no result.
    """
    rows = df.where(F.col(row).isNotNull()).select(
        dataset, F.col(order).alias("_row"), field_mask(F.col(row)).cast("int").alias("_mask"), *row_measures(F.col(row))
    )
    narrow = Scratch(df.sparkSession, "json-quality").keep(rows, "narrow")
    of = structures(narrow, dataset, aligned=False)
    scored = quality.metrics_from_measures(measures(narrow, dataset, of), dataset, None, key_set="_keys", row_id="_row")
    return scored.drop("max_tokens").join(of.select(dataset, _kind(of)), dataset)


def json_facts(
    df: DataFrame,
    dataset: str,
    row: str,
    quality_profile: str = "production",
    language: str = "language",
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """One row per dataset with everything the reports state, from parsed JSON lines.

    ``df`` has a VARIANT column and the flag ``is_object``; other values are rejected and make
    ``schema_parse`` fail. Rows are normalized first: strings are stripped, blank ones are null,
    and every row has all fields of its dataset, so structure and field set are those of the
    whole dataset. ``verdicts`` (``name`` and any of ``license``, ``critical_toxicity``) brings gate
    verdicts that rows alone can't give; the personal-data gate is judged here.
    """
    scratch = Scratch(df.sparkSession, "json-facts")
    # All that is needed of a line comes from one read; of a rejected one there is no object.
    lines = df.select(F.col(dataset).alias("name"), "is_object", F.when(F.col("is_object"), F.col(row)).alias("_raw"))
    texts = F.concat_ws("\n", F.transform(F.map_values(fields_of(F.col("_raw"))), value_text))
    # Columns of their own, as several expressions need them.
    clean = lines.withColumns({"_clean_row": normalized(F.col("_raw")), "_texts": texts})
    clean = clean.withColumn("_json", F.to_json("_clean_row"))
    found = sum(gates.pii_counts(F.col("_texts")).values(), F.lit(0))
    reduced = scratch.keep(
        clean.select(
            "name",
            "is_object",
            field_mask(F.col("_raw")).cast("int").alias("_mask"),
            *row_measures(F.col("_clean_row"), F.col("_json")),
            (found > 0).alias("_pii"),
            F.try_variant_get("_clean_row", f"$.{language}", "string").alias("_language"),
            profile.variant_cells(F.col("_raw")).alias("_cells"),
        ),
        "narrow",
    )
    parsed = reduced.groupBy("name").agg(F.count_if(~F.col("is_object")).alias("rejected"))
    good = reduced.where("is_object").drop("is_object")
    narrow = good.drop("_cells")
    cells = good.select("name", F.explode("_cells").alias("cell")).select("name", "cell.*")
    columns = scratch.keep(profile.profile_of_cells(cells, good, "name"), "columns")
    shape = columns.groupBy("name").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.sum("missing_count").alias("missing_cells"),
        F.sort_array(F.collect_list(F.struct("column", "type"))).alias("_fields"),
    )
    # Rows may have no field at all.
    none = F.array().cast("array<struct<column:string,type:string>>")
    shape = narrow.select("name").distinct().join(shape, "name", "left").select(
        "name",
        F.coalesce("column_count", F.lit(0)).alias("column_count"),
        F.coalesce("missing_cells", F.lit(0)).alias("missing_cells"),
        F.coalesce("_fields", none).alias("_fields"),
    )
    of = structures(narrow, "name", aligned=True).join(shape.select("name", "column_count"), "name")
    metrics = quality.metrics_from_measures(measures(narrow, "name", of), "name", None)
    score = quality.quality_report(metrics, quality_profile)
    by_row = narrow.groupBy("name", "_row_key").agg(F.count(F.lit(1)).alias("n"), F.max("_pii").alias("pii"))
    copies = by_row.groupBy("name").agg(
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"),
        F.when(F.max("pii"), "FAIL").otherwise("PASS").alias("gate_pii"),
    )
    bias = quality.language_bias(narrow, "name", "_language")
    facts = score.join(shape, "name").join(copies, "name").join(bias, "name").join(parsed, "name")
    gates_given = [g for g in ("license", "critical_toxicity") if verdicts is not None and g in verdicts.columns]
    if gates_given:
        facts = facts.join(verdicts.select("name", *[F.col(g).alias(f"gate_{g}") for g in gates_given]), "name", "left")
    for gate in ("license", "critical_toxicity"):
        if gate not in gates_given:
            facts = facts.withColumn(f"gate_{gate}", F.lit(None).cast("string"))
    count = F.col("row_count")
    return facts.select(
        "name",
        F.lit("uploaded_dataset_analysis").alias("purpose"),
        F.lit("uploaded").alias("domain"),
        F.split("languages", ", ").alias("languages"),
        F.lit("user_provided").alias("license"),
        "row_count", "column_count", "missing_cells", "duplicate_rows",
        F.col("_fields.column").alias("fields"),
        F.col("_fields.type").alias("field_types"),
        F.lit(None).cast("string").alias("source_checksum"),
        F.array(F.col("name").cast("string")).alias("sources"),
        count.alias("output_rows"),
        "score", "threshold", "profile", "requires_generation", *quality.DIMENSIONS,
        count.alias("record_count"), "rejected",
        F.when(F.col("rejected") == 0, "PASS").otherwise("FAIL").alias("schema_parse"),
        F.when(count > 0, "PASS").otherwise("FAIL").alias("training_readiness"),
        F.when(F.col("max_tokens") <= quality.MAX_TOKENS, "PASS").otherwise("FAIL").alias("token_length_fit"),
        "distribution_risk",
        F.coalesce("gate_license", F.lit("USER_PROVIDED")).alias("gate_license"),
        "gate_pii",
        F.coalesce("gate_critical_toxicity", F.lit("NOT_EVALUATED")).alias("critical_toxicity"),
    )


def json_reports(facts: DataFrame) -> DataFrame:
    """(name, report, text) of ``json_facts``, with the gates' own verdicts."""
    verdicts = {"license": F.col("gate_license"), "pii": F.col("gate_pii"), "critical_toxicity": F.col("critical_toxicity")}
    return reports.all_reports(facts, verdicts)
