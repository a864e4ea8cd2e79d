"""DuckDB twins of the queries that SQL can express, written from their definitions."""

from gristmill.llm.license_scan import Model

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}')"


DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS MATERIALIZED (SELECT p.rid, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.win = x.win AND p.n = x.n),
covered AS (SELECT rid, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(k) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS leader FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN strlen(body) >= 1000 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(body) >= 1000 AND page_id <> leader THEN leader END AS refers_to
FROM q
"""


def pii() -> str:
    """Spans by the plain patterns; RE2 finds the same matches as the guarded ones in Spark."""
    luhn = (
        "list_sum(list_transform(range(0, length(g)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(g[length(g) - i] AS INT)"
        " ELSE (2 * CAST(g[length(g) - i] AS INT)) // 10 + (2 * CAST(g[length(g) - i] AS INT)) % 10 END)) % 10 = 0"
    )
    turned = "(a[5:] || a[1:4])"
    letters = (
        f"list_aggregate(list_transform(range(1, length({turned}) + 1), lambda i: CASE WHEN {turned}[i] BETWEEN 'A' AND 'Z'"
        f" THEN CAST(ascii({turned}[i]) - 55 AS VARCHAR) ELSE {turned}[i] END), 'string_agg', '')"
    )
    # A number of up to 68 digits modulo 97, in parts of seven digits.
    mod97 = (
        f"list_reduce(list_prepend(0, list_transform(range(0, (length({letters}) + 6) // 7), lambda k: CAST({letters}[k * 7 + 1 : k * 7 + 7] AS BIGINT)"
        f" + 1000000000 * length({letters}[k * 7 + 1 : k * 7 + 7]))),"
        " lambda x, y: (x * CAST(pow(10, y // 1000000000) AS BIGINT) + y % 1000000000) % 97) = 1"
    )
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) <= 255))"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length(g) BETWEEN 13 AND 19 THEN {luhn} ELSE FALSE END"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)", mod97),
        ("tel", r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}", "regexp_matches(near, 'phone|tel|call|fax|mobile')"),
    ]
    found = " UNION ALL ".join(
        f"""SELECT rid, {k} AS k, '{name}' AS kind, m, s, translate(m, ' -', '') AS g, replace(m, ' ', '') AS a,
          translate(substr(t, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)), '{_UPPER}', '{_UPPER.lower()}') AS near
        FROM (SELECT rid, t, ms[i] AS m,
          CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
          FROM (SELECT rid, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d),
          unnest(range(1, len(ms) + 1)) AS u(i))"""
        for k, (name, p, _) in enumerate(kinds)
    )
    tests = " ".join(f"WHEN {k} THEN {test}" for k, (_, _, test) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{kinds[k][0]}" for k in range(4))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS MATERIALIZED ({found}),
good AS MATERIALIZED (SELECT *, kind || ':' || s || ':' || (s + length(m)) AS one FROM found WHERE CASE k {tests} END),
listed AS (SELECT rid, {counts}, string_agg(one, ',' ORDER BY k, s) FILTER (WHERE k < 4) AS base,
  string_agg(one, ',' ORDER BY k, s) AS spans FROM good GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kinds[k][0]}, 0) AS n_{kinds[k][0]}" for k in range(4))},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (rid)
"""


def licences() -> str:
    model = Model()
    anchor = "(?:^|[^a-z0-9])(?:" + "|".join(model.anchors) + ")(?:[^a-z0-9]|$)"
    idf = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in model.idf.items())
    weights = ", ".join(f"('{t}', {n}, '{name}', {w!r}::DOUBLE)" for t, n, name, w in model.weights)
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source,
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t,
    CAST(doc_id AS VARCHAR) AS s FROM documents),
idf(term, idf) AS (VALUES {idf}),
weights(term, template, license, weight) AS (VALUES {weights}),
files AS MATERIALIZED (SELECT rid, doc_id, source || '/' || array_to_string(list_transform(range(1, length(s)),
    lambda n: s[1:n]), '/') || CASE WHEN length(s) > 1 THEN '/' ELSE '' END || s || '.txt' AS path FROM d),
parts AS MATERIALIZED (SELECT rid, pos, list_extract(ss, pos) AS part FROM (
    SELECT rid, list_filter(list_distinct(list_concat(string_split(t, chr(10)),
      string_split_regex(t, '
[ 	]*
\s*'), [t])), lambda x: regexp_matches(x, '{anchor}')) AS ss
    FROM d WHERE regexp_matches(t, '{anchor}')), unnest(range(1, len(ss) + 1)) AS u(pos)),
terms AS (SELECT rid, pos, term, count(*) AS n FROM (
    SELECT rid, pos, unnest(regexp_extract_all(part, '[a-z0-9]+')) AS term FROM parts) GROUP BY ALL),
weighed AS MATERIALIZED (SELECT rid, pos, term, n * coalesce(idf, {model.rare!r}::DOUBLE) AS value
    FROM terms LEFT JOIN idf USING (term)),
norms AS (SELECT rid, pos, sqrt(sum(value * value)) AS norm FROM weighed GROUP BY ALL),
cosines AS (SELECT rid, pos, template, license, round(sum(value * weight) / any_value(norm), 4) AS cosine
    FROM weighed JOIN weights USING (term) JOIN norms USING (rid, pos) GROUP BY ALL),
own AS (SELECT rid, license AS own_license, cosine AS own_similarity FROM cosines WHERE cosine >= {model.least}
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, license) = 1),
placed AS MATERIALIZED (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM files LEFT JOIN own USING (rid)),
held AS (SELECT dir, own_license AS held FROM placed WHERE own_license IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path, own_license) = 1),
near AS (SELECT p.rid, h.dir AS from_directory, h.held FROM placed p JOIN held h
    ON p.dir = h.dir OR starts_with(p.dir, h.dir || '/')
    QUALIFY row_number() OVER (PARTITION BY p.rid ORDER BY length(h.dir) DESC) = 1)
SELECT doc_id, path, own_license, own_similarity, coalesce(own_license, held) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN held IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
  CASE WHEN own_license IS NULL THEN from_directory END AS from_directory
FROM placed LEFT JOIN near USING (rid)
"""


TOP_K = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1),
    lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def spelling() -> str:
    """Words by plain counting, crc32 bit by bit from its polynomial, neighbours by deleted letters."""
    octet = "list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    table = f"[{octet} for b in range(256)]"
    octets = (
        "flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]"
        " ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END for c in string_split(doc_id || ':' || run, '')])"
    )
    return f"""
WITH RECURSIVE occurrences AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM documents),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM occurrences WHERE length(run) >= 6 GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT run, k, xor(list_reduce([4294967295::BIGINT] || {octets},
    lambda c, b: xor(list_extract(t, CAST(xor(c, b) & 255 AS BIGINT) + 1), c >> 8)), 4294967295) AS h
  FROM runs, (SELECT {table} AS t)),
slipped AS (
  SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
shorter AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
    CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
steps AS (
  SELECT word, word AS root FROM judged
  UNION ALL SELECT s.word, j.form FROM steps s JOIN judged j ON j.word = s.root WHERE j.form IS NOT NULL)
SELECT j.word, j.form, s.root, j.n, j.n_near, j.form_n
FROM judged j JOIN steps s ON s.word = j.word JOIN judged e ON e.word = s.root AND e.form IS NULL
"""
