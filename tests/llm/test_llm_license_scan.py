"""Licences by cosine and inheritance against plain Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from gristmill.llm import license_scan

MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0."
SCHEMA = "path string, text string, license int, held string, extra int"
FILES = [
    ("a/LICENSE", MIT),
    ("a/x.py", "code\n\nmore code"),
    ("a/b/y.py", None),
    ("a/b/c/z.py", f"# header\n{APACHE}\ncode " + "word " * 20_000),
    ("a/b/c/LICENSE.txt", APACHE),
    ("a/b/c/d/e.py", ""),
    ("a/b/c/d/e.py", ""),
    ("ab/f.py", "licence of nothing"),
    ("g.py", MIT.upper()),
    (None, APACHE),
    ("k/COPYING", "no licence here"),
    ("k/m.py", "x"),
]


def scan(spark, rows, **more):
    df = spark.createDataFrame([(p, t, 1, "h", 2) for p, t in rows], SCHEMA)
    return license_scan.licences(df, "path", "text", **more)


def plain_own(text, model):
    best = None
    text = text or ""
    for part in [*text.split("\n"), *re.split(r"\n[ \t]*\n\s*", text), text]:
        counts = Counter(re.findall("[a-z0-9]+", part.lower()))
        value = {t: n * model.idf.get(t, model.rare) for t, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        scores: dict = {}
        for t, number, name, w in model.weights:
            scores[number, name] = scores.get((number, name), 0) + value.get(t, 0) * w
        for (_, name), s in scores.items():
            if norm and round(s / norm, 4) >= model.least and (best is None or (-round(s / norm, 4), name) < best):
                best = (-round(s / norm, 4), name)
    return best


def test_files(spark):
    out = scan(spark, FILES)
    assert set(out.columns) == {"path", "held", "extra", "own_license", "own_similarity", "license", "basis", "from_directory"}
    got = sorted((str(r["path"]), r["license"], r["basis"], r["from_directory"]) for r in out.collect())
    assert got == sorted(
        [
            ("a/LICENSE", "mit", "own", None),
            ("a/x.py", "mit", "inherited", "a"),
            ("a/b/y.py", "mit", "inherited", "a"),
            ("a/b/c/z.py", "apache-2.0", "own", None),
            ("a/b/c/LICENSE.txt", "apache-2.0", "own", None),
            ("a/b/c/d/e.py", "apache-2.0", "inherited", "a/b/c"),
            ("a/b/c/d/e.py", "apache-2.0", "inherited", "a/b/c"),
            ("ab/f.py", None, "none", None),
            ("g.py", "mit", "own", None),
            ("None", "apache-2.0", "own", None),
            ("k/COPYING", None, "none", None),
            ("k/m.py", None, "none", None),
        ]
    )
    assert scan(spark, []).count() == 0


def test_anchors_lose_nothing(spark):
    model = license_scan.Model()
    terms = sorted(model.idf)
    texts = [" ".join(terms[i::7]) for i in range(7)] + [t for _, t in license_scan.TEMPLATES]
    texts += [" ".join(t.split()[: len(t.split()) * 2 // 3]) + " and other things" for _, t in license_scan.TEMPLATES]
    texts += ["under the license", "software free of charge", "a b c", f"x\n\n{MIT} y\nz"]
    out = scan(spark, [(f"d{i:03}/f", t) for i, t in enumerate(texts)], speaks=F.lit(False)).orderBy("path").collect()
    for r, text in zip(out, texts):
        best = plain_own(text, model)
        assert (r["own_license"], r["own_similarity"]) == ((best[1], -best[0]) if best else (None, None)), text
        assert r["basis"] == ("own" if best else "none")


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL_HEAD = """GNU GENERAL PUBLIC LICENSE
Version 3, 29 June 2007"""


def test_licence_file_parts_are_found(spark):
    got = {r["path"]: r["own_license"] for r in scan(spark, [("a/LICENSE", MIT_BODY), ("b/LICENSE", GPL_HEAD)]).collect()}
    assert got == {"a/LICENSE": "mit", "b/LICENSE": "gpl-3.0"}
    assert license_scan.LEAST == 0.6


def test_only_statements_that_may_reach_are_kept(spark):
    prose = "in the of and to a is as that it with by this are at or " + "word " * 200
    df = spark.createDataFrame([(f"{prose}\n{MIT}\n{prose}",), (prose,)], "text string")
    kept = df.select(license_scan.anchored(F.col("text"), license_scan.Model()).alias("s")).collect()
    assert [r["s"] for r in kept] == [[MIT.lower()], []]
