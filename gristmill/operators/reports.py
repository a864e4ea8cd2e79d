"""Texts about datasets, one column per text, from a table of facts with one row per dataset.

Facts used: ``name, domain, purpose, languages`` (array), ``license, row_count, column_count,
missing_cells, duplicate_rows, fields`` (array of names in order), ``field_types`` (array),
``tags`` (array), ``source_checksum, sources`` (array), ``output_rows, score, threshold,
profile, requires_generation`` and the seven dimensions, ``record_count, schema_parse,
training_readiness, token_length_fit, distribution_risk, critical_toxicity``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators.gates import certification
from gristmill.operators.quality import DIMENSIONS

GENERATOR_NAME = "Gristmill"
SUMMARY_FIELDS = 8
CARD_FIELDS = 20
INSTRUCTION_FIELDS = ("instruction", "response", "prompt", "completion")


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _listed(values: Column, empty: str = "") -> Column:
    return F.coalesce(F.nullif(F.array_join(values, ", "), F.lit("")), F.lit(empty))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def dataset_summary(name: Column, rows: Column, columns: Column, fields: Column, missing: Column, duplicates: Column) -> Column:
    return _say(
        name, " contains ", rows, " records across ", columns, " columns. Key fields include ",
        _listed(F.slice(fields, 1, SUMMARY_FIELDS), "Unavailable"), ". The upload has ", _or(missing, "Unavailable"),
        " missing values and ", _or(duplicates, "Unavailable"),
        " duplicate rows, making it suitable for quick dataset inspection, search, and packaging.",
    )


def recommendation(title: Column, query: Column, matched: Column, rows: Column, quality: Column) -> Column:
    """Why a search result fits; ``matched`` is the comma list of matched terms.

    The query is named by its distinct tokens in order of the alphabet.
    """
    asked = F.array_join(F.array_sort(tx.token_set(query)), " ")
    return _say(
        title, " is recommended for '", F.coalesce(F.nullif(asked, F.lit("")), F.lit("catalog search")),
        "' because it matches ", F.coalesce(F.nullif(matched, F.lit("")), F.lit("metadata relevance")), ", contains ",
        rows, " rows, and has a quality score of ", _or(quality, "None"), ".",
    )


def gap_analysis(rows: Column, fields: Column, have: Column, wanted: Column, min_rows: Column, target_model: Column, domain: Column) -> Column:
    """Shortfalls in volume, languages and format against a requirement.

    A dataset without known languages lacks all wanted ones.
    """
    names = F.transform(fields, F.lower)
    missing = F.array_sort(
        F.array_except(F.transform(wanted, F.lower), F.transform(F.coalesce(have, F.array().cast("array<string>")), F.lower))
    )
    instruction = F.arrays_overlap(names, F.array(*[F.lit(f) for f in INSTRUCTION_FIELDS]))
    gaps = F.array_compact(
        F.array(
            F.when((min_rows > 0) & (rows < min_rows), _say("volume: ", rows, " of ", min_rows, " target rows (", min_rows - rows, " short)")),
            F.when(F.size(missing) > 0, _say("languages: missing ", F.array_join(missing, ", "))),
            F.when((F.coalesce(target_model, F.lit("")) != "") & ~instruction, "format: no instruction/response columns for instruction tuning"),
        )
    )
    fine = _say(
        "No material gaps detected for '", domain, "'. ", rows, " rows with fields ", _listed(F.array_sort(names), "unknown"),
        " satisfy the stated requirement; proceed to curation and skip synthetic generation.",
    )
    found = _say(
        "Coverage gaps detected -- ", F.array_join(gaps, "; "),
        ". Recommended order: search additional sources for the shortfall first, then reserve synthetic generation for residual gaps only.",
    )
    return F.when(F.size(gaps) == 0, fine).otherwise(found)


def catalog_card(name: Column, summary: Column, rows: Column, columns: Column, tags: Column, fields: Column, types: Column, license_name: Column, quality: Column) -> Column:
    """Markdown card of a catalog record."""
    lines = F.transform(
        F.slice(F.arrays_zip(fields.alias("f"), types.alias("t")), 1, CARD_FIELDS), lambda x: _say("- `", x["f"], "`: ", x["t"])
    )
    return _say(
        "# ", name, "\n\n## Summary\n", summary, "\n\n## Composition\n- Records: ", rows, "\n- Columns: ", columns, "\n- Tags: ",
        _listed(tags, "none"), "\n\n## Schema\n",
        F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("- (schema unavailable)")),
        "\n\n## Licensing\n- Declared license: ", license_name, "\n- Verify redistribution terms before commercial use.",
        "\n\n## Quality\n- Weighted quality score: ", _or(quality, "None"),
        "\n\n## Intended Use\nDiscovery, exploratory analysis, prototyping, and packaging.",
        "\n\n## Limitations\nMetrics are computed by deterministic heuristics unless live LLM mode is enabled; "
        "validate domain coverage before production training.",
    )


def quality_narrative(score: Column, threshold: Column, profile: Column, metrics: dict[str, Column]) -> Column:
    """Score, strongest (last of the best) and weakest (first of the worst) dimension, and the verdict."""
    entries = F.array(
        *[
            F.struct(value.cast("double").alias("v"), F.lit(i).alias("i"), F.lit(name).alias("n"))
            for i, (name, value) in enumerate(metrics.items())
        ]
    )
    weakest, strongest = F.array_min(entries), F.array_max(entries)
    verdict = F.when(
        score >= threshold, _say(" The dataset meets the ", profile, " threshold of ", threshold, ".")
    ).otherwise(
        _say(" The dataset falls short of the ", profile, " threshold of ", threshold,
             ", so search-first remediation or targeted generation is advised.")
    )
    return _say(
        "Overall weighted quality is ", score, " on a 0-100 scale for the ", profile, " profile. Strongest dimension: ",
        strongest["n"], " (", tx.number_text(strongest["v"]), "). Weakest dimension: ", weakest["n"], " (",
        tx.number_text(weakest["v"]), ").", F.coalesce(verdict, F.lit("")),
    )


def package_card() -> Column:
    """Markdown card shipped with an exported dataset."""
    c = F.col
    return _say(
        "# Dataset Card\n\nName: ", c("name"), "\nDomain: ", c("domain"), "\nLanguages: ", _listed(c("languages")), "\nLicense: ",
        c("license"), "\nRows: ", c("row_count"), "\nColumns: ", c("column_count"), "\nMissing values: ", c("missing_cells"),
        "\nDuplicate rows: ", c("duplicate_rows"), "\nQuality score: ", c("score"), "/100\nBenchmark readiness: ",
        c("training_readiness"), "\nSource checksum: ", _or(c("source_checksum"), "Unavailable"), "\nSources: ",
        _listed(c("sources"), "Unavailable"), f"\nGenerated by: {GENERATOR_NAME}\n",
    )


def package_card_json() -> Column:
    c = F.col
    return F.to_json(
        F.struct(
            c("name"), c("domain"), c("languages"), c("license"), c("row_count").alias("rows"), c("column_count").alias("columns"),
            c("missing_cells").alias("missing_values"), c("duplicate_rows"), c("source_checksum"),
            F.map_from_arrays("fields", "field_types").alias("schema"), c("score").alias("quality_score"),
            c("training_readiness").alias("benchmark_readiness"), c("sources"),
        ),
        {"ignoreNullFields": "false"},
    )


def quality_text(gates: dict[str, Column]) -> Column:
    parts: list[Column | str] = [
        "# Quality Report\n\nOverall score: ", F.col("score"), "/100\nProfile: ", F.col("profile"), "\n\n## Hard Gates\n",
    ]
    for name, value in gates.items():
        parts += [f"- {name}: ", value, "\n"]
    parts.append("\n## Weighted Metrics\n")
    for name in DIMENSIONS:
        parts += [f"- {name}: ", F.col(name), "\n"]
    return _say(*parts)


def bias_text() -> Column:
    return _say(
        "# Bias Report\n\nRecords sampled: ", F.col("record_count"), "\nCritical toxicity: ", F.col("critical_toxicity"),
        "\nDistribution risk: ", F.col("distribution_risk"), "\nLanguages: ", _listed(F.col("languages")), "\n",
    )


def benchmark_text() -> Column:
    return _say(
        "# Benchmark Report\n\nRecord count: ", F.col("record_count"), "\nSchema parse: ", F.col("schema_parse"),
        "\nTraining readiness: ", F.col("training_readiness"), "\nToken length fit: ", F.col("token_length_fit"), "\n",
    )


def recommendation_text() -> Column:
    advice = F.when(F.col("requires_generation"), "Review generated samples before production use.").otherwise(
        "No generated samples; ready for export."
    )
    return _say("# Recommendation Report\n\n", advice, "\n")


def intelligence_text(gates: dict[str, Column]) -> Column:
    """``gates`` are verdicts by gate; a certificate needs PASS from each of them."""
    c = F.col
    passed = reduce(lambda a, b: a & b, [v == "PASS" for v in gates.values()], F.lit(True))
    certificate = F.coalesce(certification(c("score"), passed, F.lit(False)), F.lit("none"))
    return _say(
        "# Dataset Intelligence Report\n\nDataset: ", c("name"), "\nPurpose: ", c("purpose"), "\nDomain: ", c("domain"), "\nLanguages: ",
        _listed(c("languages")), "\nRows: ", c("row_count"), "\nColumns: ", c("column_count"), "\nMissing values: ", c("missing_cells"),
        "\nDuplicate rows: ", c("duplicate_rows"), "\nQuality score: ", c("score"), "/100\nLicense: ", c("license"), "\nCleaned rows: ",
        c("output_rows"), "\nBenchmark readiness: ", c("training_readiness"), "\nCertification: ", certificate, "\n",
    )


def explainability_text(rationale: Column, synthetic_added: Column) -> Column:
    return _say(
        "# Explainability Report\n\nPlanner decision: ", F.coalesce(rationale, F.lit("Planner rationale unavailable.")),
        "\nSearch-first policy: existing datasets were evaluated before generation.\nSynthetic samples added: ", synthetic_added,
        "\nFinal quality score: ", F.col("score"), "/100\n",
    )


def all_reports(facts: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(name, report, text) for the five package reports, the explanation and the card."""
    texts = {
        "quality_report": quality_text(gates),
        "bias_report": bias_text(),
        "benchmark_report": benchmark_text(),
        "recommendation_report": recommendation_text(),
        "dataset_intelligence_report": intelligence_text(gates),
        "explainability_report": explainability_text(F.lit(None).cast("string"), F.lit(0)),
        "dataset_card": package_card(),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("report"), v.alias("text")) for k, v in texts.items()])
    return facts.select("name", F.explode(entries).alias("r")).select("name", "r.report", "r.text")
