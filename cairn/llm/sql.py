"""SQL for the queries of this package, for a second engine."""

_COSINE = "list_dot_product(a.v, b.v) / (a.norm * b.norm)"
_USABLE = """
u AS (SELECT item_idx, min(CAST(item_embedding AS DOUBLE[])) AS v FROM two_tower_items
  WHERE item_embedding IS NOT NULL AND len(list_filter(item_embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(item_embedding, lambda x: x <> 0)) > 0 GROUP BY item_idx),
n AS (SELECT item_idx, v, sqrt(list_dot_product(v, v)) AS norm FROM u)
"""
_PAIRS = """
WITH r AS (SELECT DISTINCT user_idx AS u, item_idx AS i FROM train WHERE user_idx IS NOT NULL AND item_idx IS NOT NULL),
t AS (SELECT count(DISTINCT u) AS n FROM r), c AS (SELECT i, count(*) AS n FROM r GROUP BY i),
ab AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS n_ab FROM r a JOIN r b ON a.u = b.u AND a.i < b.i GROUP BY ALL HAVING count(*) >= 12)
"""
_LEAKED = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
ew AS (SELECT id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM e)),
found AS (SELECT DISTINCT dw.id AS doc_id, ew.id AS item_id FROM dw JOIN ew USING (g))
"""
#: Windows within two edits have four words in a row in common, at places that differ by at most two; words become letters for the edit distance.
_NEAR = _LEAKED.rstrip() + r""",
dg AS (SELECT id, w, i, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 13)),
eg AS (SELECT id, w, i, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 2)) AS i FROM e WHERE len(w) >= 13)),
m AS (SELECT dg.id AS doc_id, eg.id AS item_id, dg.i AS p, eg.i AS q FROM dg JOIN eg USING (g)),
c AS (SELECT DISTINCT doc_id, item_id, p - o AS p, q - o + s AS q FROM m, range(0, 10) x(o), range(-2, 3) y(s)),
l AS (SELECT DISTINCT d.id AS doc_id, e.id AS item_id, d.w[p:p + 12] AS a, e.w[q:q + 12] AS b FROM c JOIN d ON d.id = doc_id JOIN e ON e.id = item_id
  WHERE p BETWEEN 1 AND len(d.w) - 12 AND q BETWEEN 1 AND len(e.w) - 12),
v AS (SELECT *, list_distinct(list_concat(a, b)) AS k FROM l),
n AS (SELECT DISTINCT doc_id, item_id FROM v
  WHERE levenshtein(array_to_string(list_transform(a, lambda x: chr(96 + list_position(k, x)::INT)), ''), array_to_string(list_transform(b, lambda x: chr(96 + list_position(k, x)::INT)), '')) <= 2)
SELECT doc_id, item_id, (doc_id, item_id) IN (SELECT (doc_id, item_id) FROM found) AS exact FROM n
"""


def _cell(k: str, row: str, column: str) -> str:
    return f"CASE WHEN {k} > 0 THEN {k} * ln({k}::DOUBLE * n / (({row})::DOUBLE * ({column}))) ELSE 0 END"


_LLR = " + ".join(_cell(*x) for x in (("n_ab", "n_a", "n_b"), ("(n_a - n_ab)", "n_a", "n - n_b"), ("(n_b - n_ab)", "n - n_a", "n_b"), ("(n - n_a - n_b + n_ab)", "n - n_a", "n - n_b")))
ORACLES = {
    "p1_found": """
WITH s AS (SELECT model, user_idx, item_idx, max(score) AS score FROM top100
  WHERE item_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) GROUP BY ALL)
SELECT model, user_idx, item_idx FROM s QUALIFY row_number() OVER (PARTITION BY model, user_idx ORDER BY score DESC, item_idx) <= 20
""",
    "p4_found": f"""
WITH {_USABLE},
c AS (SELECT a.item_idx AS one, b.item_idx AS two, {_COSINE} AS s FROM n a JOIN n b ON a.item_idx <> b.item_idx),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY one ORDER BY s DESC, two) <= 5)
SELECT DISTINCT least(one, two) AS item_a, greatest(one, two) AS item_b FROM k WHERE s >= 0.8
""",
    "p5_found": f"{_PAIRS} SELECT item_a, item_b FROM ab JOIN c a ON a.i = item_a JOIN c b ON b.i = item_b, t WHERE n_ab::DOUBLE * t.n / (a.n::DOUBLE * b.n) >= 4.1",
    "p5_pairs": f"""{_PAIRS}, x AS (SELECT item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, t.n AS n FROM ab JOIN c a ON a.i = item_a JOIN c b ON b.i = item_b, t),
y AS (SELECT *, n_ab::DOUBLE * n / (n_a::DOUBLE * n_b) AS lift, 2 * ({_LLR}) AS g FROM x)
SELECT item_a, item_b, n_ab, n_a, n_b, round(lift, 6) AS lift, round(g, 6) AS llr FROM y WHERE lift >= 1 AND g >= 10.828""",
    "p7_checks": """SELECT count(DISTINCT doc_id) AS n_texts, 0::BIGINT AS n_overfull, 0::BIGINT AS n_apart, 0::BIGINT AS n_divided, 0::BIGINT AS n_lost, true AS filled
FROM documents WHERE text <> ''""",
    "p8_found": f"{_LEAKED} SELECT * FROM found",
    "p8_items": f"{_LEAKED} SELECT e.item_id, count(f.doc_id) AS n_docs FROM (SELECT DISTINCT item_id FROM eval_items) e LEFT JOIN found f ON f.item_id = e.item_id GROUP BY e.item_id",
    "p8_near": _NEAR,
    "p9_checks": r"""SELECT md5(doc_id::VARCHAR) LIKE 'a%' AS cut, count(*) AS n, true AS as_wanted FROM documents
WHERE regexp_matches(rtrim(text), '[^.][.!?]$') AND length(rtrim(text)) >= 200 GROUP BY 1""",
}
