"""Licences of files: TF-IDF cosine of their statements to templates, then directory inheritance.

Statements are the lines and the paragraphs (blocks between empty lines) of a file, and the
whole file. Term weights come from the templates: a term's inverse document frequency over them,
the largest one for any other word. A file's own licence is the template with the highest cosine
of at least ``LEAST`` to any of its statements.

Whole texts are searched, but few statements are weighed: from each template the fewest terms are
taken as anchors without which no statement can reach ``LEAST`` (what the other terms of the
template weigh is less), so a statement without any anchor is passed over safely. So is one whose
cosines stay too low if each unknown word is taken to occur once, which can only raise them.

A directory's licence is that of its first file (by path) that has one and is flagged as
speaking for its directory. A file without a licence of its own inherits from the nearest
directory above it that has one, found by joining the paths of all directories above.

Everything is expressed in Spark's own functions. Defined results: null and empty texts have no
licence of their own; a null path has no directory and inherits nothing; equal cosines go to the
template name that sorts first; repeated rows are judged one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.scratch import Scratch

LEAST = 0.6
WORD = "[a-z0-9]+"

# Words of templates by measured frequency in documents; as anchors they would be the costliest.
FREQUENT = tuple(
    "in the of and to a is as that it with by this are at or mit under licensed license version 0 3 work general public gnu"
    " released 4 nc cc 2 apache".split()
)

# Usual statements of each licence.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
        " compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    (
        "cc-by-nc-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
)


class Model:
    """Weights of the templates; its size is that of the templates, whatever the corpus."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST):
        counts = [Counter(re.findall(WORD, text.lower())) for _, text in templates]
        spread = Counter(term for c in counts for term in c)
        self.least = least
        self.rare = math.log(1 + len(counts)) + 1
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in sorted(spread.items())}
        self.weights: list[tuple[str, int, str, float]] = []  # term, template, licence, normalized weight
        anchors: set[str] = set()
        # Cosines are rounded to four digits before they are compared.
        self.enough = least - 1e-4
        place = {t: n for n, t in enumerate(FREQUENT)}
        for number, ((name, _), c) in enumerate(zip(templates, counts)):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            left = 0.0
            # Any order is safe; frequent words first keeps them from being anchors.
            for t, n in sorted(c.items(), key=lambda x: (place.get(x[0], len(place)), x[1] * self.idf[x[0]], x[0])):
                weight = n * self.idf[t] / norm
                self.weights.append((t, number, name, weight))
                left += weight * weight
                if left >= self.enough**2:
                    anchors.add(t)
        self.anchors = sorted(anchors)


def _statements(text: Column) -> Column:
    """Lines, paragraphs and the whole of a text, each once."""
    return F.array_distinct(
        F.concat(F.split(text, "\n", -1), F.split(text, "\n[ \t]*\n\\s*", -1), F.array(text))
    )


def _may_reach(statement: Column, model: Model) -> Column:
    """Whether a cosine of a statement can be high enough; counts of its known words are exact."""
    templates = 1 + max(number for _, number, _, _ in model.weights)
    shares = {t: [0.0] * templates for t in sorted(model.idf)}
    for t, number, _, weight in model.weights:
        shares[t][number] = model.idf[t] * weight
    idf = F.create_map(*[F.lit(x) for t in shares for x in (t, model.idf[t])])
    share = F.create_map(*[F.lit(x) for t in shares for x in (t, shares[t])])

    def of_words(words: Column) -> Column:
        known = F.transform(
            F.array_intersect(words, F.lit(list(shares))),
            lambda t: F.struct(t.alias("t"), (F.size(words) - F.size(F.array_remove(words, t))).alias("n")),
        )
        start = F.struct(F.size(words).alias("other"), F.lit(0.0).alias("square"), F.lit([0.0] * templates).alias("dots"))
        return F.aggregate(
            known,
            start,
            lambda acc, k: F.struct(
                (acc["other"] - k["n"]).alias("other"),
                (acc["square"] + F.pow(k["n"] * idf[k["t"]], F.lit(2.0))).alias("square"),
                F.zip_with(acc["dots"], share[k["t"]], lambda dot, x: dot + k["n"] * x).alias("dots"),
            ),
            lambda acc: F.array_max(acc["dots"])
            >= model.enough * F.sqrt(acc["square"] + acc["other"] * F.lit(model.rare * model.rare)),
        )

    # The one-element array binds the words, so that a text is split once.
    words = F.array(F.array_remove(F.split(statement, "[^a-z0-9]+"), ""))
    return F.exists(words, of_words)


def anchored(text: Column, model: Model) -> Column:
    """Lowered statements that may reach ``LEAST``; null for a text without any anchor."""
    anchor = "(?:^|[^a-z0-9])(?:" + "|".join(model.anchors) + ")(?:[^a-z0-9]|$)"
    # ASCII capitals only, so that every engine lowers alike.
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(low.rlike(anchor), F.filter(_statements(low), lambda s: s.rlike(anchor) & _may_reach(s, model)))


def own_licences(df: DataFrame, key: str, statements: str, model: Model) -> DataFrame:
    """(``key``, own_license, own_similarity) of the rows that have a licence; ``key`` is unique."""
    parts = df.select(key, F.posexplode(statements))
    terms = parts.select(key, "pos", F.explode(F.regexp_extract_all("col", F.lit(WORD), F.lit(0))).alias("term"))
    counted = terms.groupBy(key, "pos", "term").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    # Templates are a fixed table of some hundred rows.
    idf = F.broadcast(spark.createDataFrame(list(model.idf.items()), "term string, idf double"))
    rows = [(t, number, name, w) for t, number, name, w in model.weights]
    weights = F.broadcast(spark.createDataFrame(rows, "term string, template int, license string, weight double"))
    weighed = counted.join(idf, "term", "left").withColumn("value", F.col("n") * F.coalesce("idf", F.lit(model.rare)))
    norms = weighed.groupBy(key, "pos").agg(
        F.sum(F.col("value") * F.col("value")).alias("square"),
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "value"))).alias("known"),
    )
    pairs = norms.select(key, "pos", "square", F.explode("known").alias("k")).select(
        key, "pos", "square", F.col("k.term").alias("term"), F.col("k.value").alias("value")
    )
    cosine = (
        pairs.join(weights, "term")
        .groupBy(key, "pos", "template", "license")
        .agg((F.sum(F.col("value") * F.col("weight")) / F.sqrt(F.first("square"))).alias("cosine"))
        .withColumn("cosine", F.round("cosine", 4))
    )
    return (
        cosine.where(F.col("cosine") >= model.least)
        .groupBy(key, "license")
        .agg(F.max("cosine").alias("cosine"))
        .groupBy(key)
        .agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("best"))
        .select(key, F.col("best.license").alias("own_license"), (-F.col("best.less")).alias("own_similarity"))
    )


def directory_of(path: Column) -> Column:
    """All of a path before its last slash; null without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def directories_above(directory: Column) -> Column:
    """The directory itself and all above it."""
    names = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))


def licences(df: DataFrame, path: str, text: str, speaks: Column | None = None, model: Model | None = None) -> DataFrame:
    """``df`` without the text, with ``own_license, own_similarity, license, basis, from_directory``.

    ``speaks`` flags rows whose licence may hold for their directory (default: files named
    LICENSE, LICENCE or COPYING). ``basis`` is ``own``, ``inherited`` or ``none``. Columns of
    these names in ``df`` are replaced.
    """
    model = model or Model()
    scratch = Scratch(df.sparkSession, "license-scan")
    named = F.lower(F.element_at(F.split(F.col(path), "/"), -1)).rlike("^(licen[sc]e|copying)([.].*)?$")
    made = ["own_license", "own_similarity", "license", "basis", "from_directory"]
    rows = df.drop(*[c for c in made if c in df.columns and c not in (path, text)])
    read = scratch.keep(
        rows.withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_speaks", F.coalesce(named if speaks is None else speaks, F.lit(False)))
        .withColumn("_directory", directory_of(F.col(path)))
        .withColumn("_statements", anchored(F.col(text), model))
        .drop(text),
        "read",
    )
    own = own_licences(read, "_row", "_statements", model)
    files = scratch.keep(read.drop("_statements").join(own, "_row", "left").drop("_row"), "files")
    scratch.drop("read")
    speaking = files.where(F.col("own_license").isNotNull() & F.col("_speaks") & F.col("_directory").isNotNull())
    held = scratch.keep(
        speaking.groupBy("_directory")
        .agg(F.min(F.struct(path, "own_license")).alias("_first"))
        .select(F.col("_directory").alias("_above"), F.col("_first.own_license").alias("_held")),
        "held",
    )
    # Directories, not files, are joined with the directories above them.
    above = files.where(F.col("_directory").isNotNull()).select("_directory").distinct()
    above = above.select("_directory", F.explode(directories_above(F.col("_directory"))).alias("_above"))
    nearest = scratch.keep(
        above.join(held, "_above")
        .groupBy("_directory")
        .agg(F.max(F.struct(F.length("_above").alias("_n"), "_above", "_held")).alias("_near"))
        .select("_directory", "_near._above", "_near._held"),
        "nearest",
    )
    has = F.col("own_license").isNotNull()
    return (
        files.join(nearest, "_directory", "left")
        .withColumn("license", F.coalesce("own_license", "_held"))
        .withColumn("basis", F.when(has, "own").when(F.col("_held").isNotNull(), "inherited").otherwise("none"))
        .withColumn("from_directory", F.when(~has, F.col("_above")))
        .drop("_directory", "_speaks", "_held", "_above")
    )
