import random

from pyspark.sql import functions as F

from gristmill.operators import buckets, call_log, curate, traces


def shingles(text, n=3):
    words = text.lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(60)]
    for i in range(40):  # copies with one changed word
        words = texts[i].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += texts[:10]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in curate.near_duplicates(df, "id", "text").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        exact = [j for j in range(i) if texts[j] == text]
        near = [j for j in range(i) if len(shingles(texts[j]) & shingles(text)) >= 0.8 * len(shingles(texts[j]) | shingles(text))]
        if exact:
            assert got[i].kind == "exact" and got[i].copy_of == exact[0]
        else:
            assert (got[i].kind == "near") == bool(near)


def test_copies_of_one_text_give_one_row_each(spark):
    """A third of all rows share a text: the output stays one row per document."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "the same text again and again").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" of many"))).alias("text"))
    rows = curate.near_duplicates(df, "id", "text").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in rows} == {"exact": 999, "unique": 2001}


def test_close_clusters_lose_no_copy(spark):
    """A pair of similar texts is found although nearer texts share all its buckets."""
    rng = random.Random(7)
    texts = []

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"new{rng.randrange(10**9)}"
        return out

    for c in range(60):
        base = [f"w{c}x{rng.randrange(400)}" for _ in range(200)]
        far = edited(base, 10)
        texts += [" ".join(edited(base, 1)) for _ in range(3)] + [" ".join(edited(far, 3)) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.kind for r in curate.near_duplicates(df, "id", "text").collect()}
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        group = range(i - i % 5, i)
        earlier = [j for j in group if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        if earlier:
            assert got[i] == "near", i


def test_a_bucket_of_half_of_the_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(buckets, "COMPARISONS", 16)
    monkeypatch.setattr(buckets, "SLICE", 16)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 10)):
            words[at] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.copy_of for r in curate.near_duplicates(df, "id", "text").collect()}
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    assert got == {i: root(i) for i in range(len(texts))}


def test_balance_matches_plain_ranking(spark, monkeypatch):
    monkeypatch.setattr(curate, "SLICE_ROWS", 40)
    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 10 < 8 THEN 'big' ELSE 'small' END AS g")
    got = curate.balance(rows, "g", "id").collect()
    assert sorted(r.g for r in got).count("big") == 100
    import hashlib

    order = sorted((i for i in range(500) if i % 10 < 8), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    assert {r.id for r in got if r.g == "big"} == set(order[:100])


def test_histogram_of_one_to_hundred(spark):
    df = spark.range(1, 101).selectExpr("'m' AS metric", "CAST(id AS DOUBLE) AS v", "id")
    row = call_log.histogram_snapshot(df, "metric", "v", ["id"]).first()
    assert (row["count"], row["min"], row["max"], row.p95) == (100, 1.0, 100.0, 95.0)


def test_histogram_keeps_the_newest_thousand(spark):
    df = spark.range(1, 3001).selectExpr("'m' AS metric", "CAST(id AS DOUBLE) AS v", "id")
    row = call_log.histogram_snapshot(df, "metric", "v", ["id"]).first()
    assert row["count"] == 1000 and row["min"] == 2001.0


def test_trace_rules(spark):
    good = ["discovery", "license", "curator", "quality_evaluator", "validator", "formatter", "packaging"]
    runs = {"good": good, "order": ["license", "discovery", *good[2:]], "short": ["discovery"], "twice": [*good, "packaging"]}
    rows = [(run, s, i) for run, stages in runs.items() for i, s in enumerate(stages)]
    df = spark.createDataFrame(rows, "run string, stage string, pos int")
    found = {}
    for r in traces.conformance(df, "run", "stage", "pos").collect():
        found.setdefault(r.run, set()).add((r.violation, r.stage, r.other))
    assert "good" not in found
    assert found["order"] == {("order", "discovery", "license")}
    assert ("companion", "discovery", "license") in found["short"] and len([v for v in found["short"] if v[0] == "missing"]) == 3
    assert found["twice"] == {("duplicate", "packaging", None)}
