"""SQL for the queries of ``plans.reference``, for a second engine. Rounds of loops are written out as CTEs."""

from __future__ import annotations

from cairn.plans.reference import DIM, EV, KEEP, NEAR, TOP, TX_CORE

_EV = "SELECT user_id::INT AS u, (props->>'$.k')::INT AS i, value AS rating, ts, event_id AS seq FROM events"
_TX = "SELECT o_custkey::INT AS u, l_partkey::INT AS i, l_quantity AS rating, l_shipdate AS ts, l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_CATALOGUE = "SELECT p_partkey::INT AS i, p_name AS title, replace(p_name, ' ', '|') || '|' || p_type AS genres FROM part"


def _core(source: str, minimum: int, rounds: int = 6) -> str:
    """CTEs r0 to core: all rounds count users and items on the same rows."""
    parts = [f"r0 AS MATERIALIZED ({source})"]
    for n in range(1, rounds + 1):
        keep = " AND ".join(f"{c} IN (SELECT {c} FROM r{n - 1} GROUP BY {c} HAVING count(*) >= {minimum})" for c in "ui")
        parts.append(f"r{n} AS MATERIALIZED (SELECT * FROM r{n - 1} WHERE {keep})")
    return ", ".join(parts) + f", core AS (SELECT * FROM r{rounds})"


def _split(order: str) -> str:
    return f"""
p AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY {order}) - 1 AS pos, count(*) OVER (PARTITION BY u) AS n FROM core),
z AS (SELECT *, n * 8 // 10 AS t, n // 10 AS v, n - n * 8 // 10 - n // 10 AS e FROM p),
s AS MATERIALIZED (SELECT *, CASE WHEN pos < cut THEN 'train' WHEN pos < cut + greatest(v, 1) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, t - CASE WHEN v = 0 AND e <= 1 THEN 1 ELSE 0 END AS cut FROM z))"""


_EV_CORE = _core(_EV, EV.min_interactions)
_EV_SPLIT = f"{_EV_CORE}, {_split('ts, seq')}"
_TX_CORE = _core(_TX, TX_CORE)
_ALL_GENRES = f"SELECT DISTINCT i, unnest(string_split(genres, '|')) AS genre FROM ({_CATALOGUE})"
_GENRES = f"g AS (SELECT * FROM ({_ALL_GENRES}) WHERE i IN (SELECT i FROM s)), vocab AS (SELECT genre, row_number() OVER (ORDER BY genre) - 1 AS idx FROM (SELECT DISTINCT genre FROM g))"
_SHARES = "sh AS (SELECT i, genre, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS share FROM g)"
_PROFILES = f"""{_GENRES}, {_SHARES},
m AS (SELECT u, genre, sum(share) AS w FROM s JOIN sh USING (i) WHERE split = 'train' GROUP BY ALL),
pr AS (SELECT u, genre, w / sum(w) OVER (PARTITION BY u) AS p FROM m)"""
_VECTORS = f"""
iv AS MATERIALIZED (SELECT vec_id::INT AS i, embedding::DOUBLE[{DIM}] AS v FROM embeddings),
uv AS MATERIALIZED (SELECT u, list(x ORDER BY d)::DOUBLE[{DIM}] AS v FROM (SELECT u, d, avg(x) AS x FROM (
  SELECT u, unnest(range(1, {DIM + 1})) AS d, unnest(iv.v::DOUBLE[]) AS x FROM s JOIN iv USING (i) WHERE split = 'train') GROUP BY u, d) GROUP BY u)"""
_LISTS = f"""{_VECTORS},
li AS MATERIALIZED (SELECT u, i, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM (
  SELECT uv.u, iv.i, round(array_inner_product(uv.v, iv.v), 6) AS score FROM uv, iv
  WHERE iv.i IN (SELECT i FROM s) AND (uv.u, iv.i) NOT IN (SELECT (u, i) FROM s WHERE split = 'train')) QUALIFY rank <= {TOP})"""


def _negatives(split: str, draws: int = 6000) -> str:
    seed = EV.negative_seed(split)
    return f"""
SELECT '{split}' AS split, u, row_number() OVER (PARTITION BY u ORDER BY j) AS cand_pos, i FROM (
  SELECT u, i, min(j) AS j FROM (
    SELECT u, j, ('0x' || left(md5('{seed}:' || u || ':' || j), 15))::BIGINT % (SELECT count(*) FROM it) AS k FROM (SELECT DISTINCT u FROM s), range(0, {draws}) t(j)) d
  JOIN it USING (k) WHERE (u, i) NOT IN (SELECT (u, i) FROM s) GROUP BY u, i) QUALIFY cand_pos <= {EV.negatives}"""


_LATEST = "la AS (SELECT split, u, arg_max(i, pos) AS i FROM s GROUP BY split, u)"
_CANDIDATES = f"""{_LATEST}, it AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM (SELECT DISTINCT i FROM s)),
ca AS MATERIALIZED (SELECT split, u, 0 AS cand_pos, i FROM la WHERE split <> 'train' UNION ALL ({_negatives("val")}) UNION ALL ({_negatives("test")}))"""
_SCORED = f"""{_CANDIDATES}, {_VECTORS},
sc AS MATERIALIZED (SELECT split, u, cand_pos, ca.i, round(array_inner_product(uv.v, iv.v), 6) AS score FROM ca JOIN uv USING (u) JOIN iv ON iv.i = ca.i)"""
_RANKS = f"""{_SCORED},
ra AS (SELECT a.split, a.u, 1 + count(b.u) AS rank FROM sc a LEFT JOIN sc b ON a.split = b.split AND a.u = b.u AND b.cand_pos > 0 AND b.score >= a.score WHERE a.cand_pos = 0 GROUP BY ALL)"""
_KL = "CASE WHEN {x} > 0 THEN {x} * ln(({x} + 1e-12) / (({p} + {q}) / 2 + 1e-12)) ELSE 0 END"
_JS = f"1 - (sum({_KL.format(x='p', p='p', q='q')}) + sum({_KL.format(x='q', p='p', q='q')})) / 2 / ln(2)"
_CALIBRATED = f"""{_PROFILES}, {_LISTS},
mix AS (SELECT u, genre, sum(share) / {TOP} AS q FROM li JOIN sh USING (i) GROUP BY ALL),
bo AS (SELECT coalesce(pr.u, mix.u) AS u, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM pr FULL JOIN mix ON pr.u = mix.u AND pr.genre = mix.genre),
cal AS (SELECT u, {_JS} AS calibration FROM bo GROUP BY u)"""
#: Cosine of genre sets: what two items have in common over the root of the product of their sizes.
_DIVERSE = """
co AS MATERIALIZED (SELECT a.i AS i, b.i AS j, count(*) / sqrt(any_value(a.n) * any_value(b.n)) AS c FROM
  (SELECT *, count(*) OVER (PARTITION BY i) AS n FROM g) a JOIN (SELECT *, count(*) OVER (PARTITION BY i) AS n FROM g) b ON a.genre = b.genre GROUP BY ALL),
di AS (SELECT a.u, avg(1 - coalesce(c, 0)) AS ild FROM li a JOIN li b ON a.u = b.u AND a.rank < b.rank LEFT JOIN co ON co.i = a.i AND co.j = b.i GROUP BY a.u)"""


def _greedy() -> str:
    """One CTE a step. c: candidates with their relevance; at step n, ch<n> holds what was chosen so far."""
    parts = [f"{_PROFILES}, {_LISTS}, {_DIVERSE}"]
    parts.append("c AS MATERIALIZED (SELECT *, (score - min(score) OVER (PARTITION BY u)) / greatest(max(score) OVER (PARTITION BY u) - min(score) OVER (PARTITION BY u), 1e-8) AS rel FROM li)")
    parts.append("ch0 AS (SELECT u, i, 0 AS step, 0.0::DOUBLE AS objective FROM li WHERE false)")
    for n in range(1, KEEP + 1):
        parts.append(f"""
x{n} AS MATERIALIZED (SELECT c.u, c.i, c.rank, c.rel FROM c LEFT JOIN ch{n - 1} o ON o.u = c.u AND o.i = c.i WHERE o.i IS NULL),
q{n} AS (SELECT u, i, genre, sum(share) / {n} AS q FROM (
  SELECT x.u, x.i, sh.genre, sh.share FROM x{n} x JOIN sh ON sh.i = x.i UNION ALL
  SELECT x.u, x.i, sh.genre, sh.share FROM x{n} x JOIN ch{n - 1} o ON o.u = x.u JOIN sh ON sh.i = o.i) GROUP BY ALL),
k{n} AS (SELECT u, i, {_JS} AS cal FROM (
  SELECT coalesce(a.u, b.u) AS u, coalesce(a.i, b.i) AS i, coalesce(a.p, 0) AS p, coalesce(b.q, 0) AS q FROM
  (SELECT x.u, x.i, genre, p FROM x{n} x JOIN pr ON pr.u = x.u) a FULL JOIN q{n} b ON a.u = b.u AND a.i = b.i AND a.genre = b.genre) GROUP BY u, i),
d{n} AS (SELECT x.u, x.i, greatest(0, least(1, (1 - sum(coalesce(c, 0)) / greatest({n} - 1, 1)) / 2)) AS far FROM x{n} x JOIN ch{n - 1} o ON o.u = x.u LEFT JOIN co ON co.i = x.i AND co.j = o.i GROUP BY ALL),
ch{n} AS MATERIALIZED (SELECT * FROM ch{n - 1} UNION ALL SELECT u, i, {n}, objective FROM (
  SELECT x.u, x.i, x.rank, round(0.7 * rel + 0.15 * cal + 0.15 * coalesce(far, 0), 9) AS objective FROM x{n} x JOIN k{n} USING (u, i) LEFT JOIN d{n} USING (u, i))
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY objective DESC, rank) = 1)""")
    return ",".join(parts)


_CHOSEN = f"SELECT u AS \"user\", step AS rank, i AS item, round(objective, 6) AS objective FROM ch{KEEP}"
SPLIT_CHECKS = """train_all_users_present val_all_users_present test_all_users_present train_before_val val_before_test minimum_item_interactions
minimum_user_interactions""".split()
SHAPE_CHECKS = "grouped_by_user splits_follow_each_other profiles_shape genres_shape candidates_shape".split()
CANDIDATE_CHECKS = "positive_is_latest negatives_unseen candidates_unique".split()
_CHECKS = [*SPLIT_CHECKS, "profiles_sum_to_one", *SHAPE_CHECKS, *CANDIDATE_CHECKS, "train_count_matches_stats", "val_count_matches_stats", "test_count_matches_stats"]
_CHECKS += """top20_unique top20_length top20_sorted top20_unseen top5_unique top5_length top5_in_top20 neighbours_unique neighbours_length neighbours_sorted
neighbours_exclude_self items_finite items_unit_length""".split()


def _metric(k: int) -> str:
    parts = (("hr", "1.0"), ("ndcg", "1.0 / log2(rank + 1)"), ("mrr", "1.0 / rank"))
    return ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN {x} ELSE 0 END), 6) AS {name}_{k}" for name, x in parts)


ORACLES = {
    "ev_interactions": f'SELECT u AS "user", i AS item, round(rating, 4) AS rating, ts FROM ({_EV})',
    "item_genres": f"SELECT i AS item, genre FROM ({_ALL_GENRES})",
    "kcore_5_ev": f'WITH {_EV_CORE} SELECT u AS "user", i AS item, seq FROM core',
    "kcore_20_tx": f'WITH {_TX_CORE} SELECT u AS "user", count(*) AS n_rows, count(DISTINCT i) AS n_items, sum(i)::BIGINT AS item_sum FROM core GROUP BY u',
    "dense_ids_tx": f"""WITH {_TX_CORE} SELECT 'user' AS kind, u AS id, row_number() OVER (ORDER BY u) - 1 AS idx FROM (SELECT DISTINCT u FROM core)
UNION ALL SELECT 'item', i, row_number() OVER (ORDER BY i) - 1 FROM (SELECT DISTINCT i FROM core)""",
    "chrono_split": f'WITH {_EV_SPLIT} SELECT u AS "user", i AS item, seq, pos, split FROM s',
    "chrono_split_tx": f"""WITH {_TX_CORE}, {_split('ts, i, l_orderkey, l_linenumber, l_extendedprice')}
SELECT u AS "user", split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum(i)::BIGINT AS item_sum FROM s GROUP BY ALL""",
    "latest_positive": f'WITH {_EV_SPLIT}, {_LATEST} SELECT split, u AS "user", i AS item FROM la',
    "dataset_stats": f"""WITH {_EV_SPLIT} SELECT count(*) AS n_interactions, count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items,
{", ".join(f"count(*) FILTER (split = '{x}') AS n_{x}, round(count(*) FILTER (split = '{x}') / count(*), 6) AS ratio_{x}" for x in ("train", "val", "test"))},
min(ts) AS first_ts, max(ts) AS last_ts, (SELECT count(*) FROM events) AS n_raw, {EV.min_interactions} AS min_interactions, {EV.negatives} AS negatives, {EV.seed} AS seed,
(SELECT min(c) FROM (SELECT count(*) AS c FROM core GROUP BY u)) AS min_user_rows, (SELECT min(c) FROM (SELECT count(*) AS c FROM core GROUP BY i)) AS min_item_rows FROM s""",
    "genre_vocab": f"WITH {_EV_SPLIT}, {_GENRES} SELECT idx AS genre_idx, genre FROM vocab",
    "multi_hot": f"""WITH {_EV_SPLIT}, {_GENRES} SELECT x.i AS item, '[' || string_agg(CASE WHEN g.genre IS NULL THEN '0' ELSE '1' END, ', ' ORDER BY idx) || ']' AS hot
FROM (SELECT DISTINCT i FROM g) x CROSS JOIN vocab LEFT JOIN g ON g.i = x.i AND g.genre = vocab.genre GROUP BY x.i""",
    "user_profiles": f'WITH {_EV_SPLIT}, {_PROFILES} SELECT u AS "user", genre, round(p, 6) AS p FROM pr',
    "seen_items": f"WITH {_EV_SPLIT} SELECT u AS \"user\", string_agg(i::VARCHAR, ',' ORDER BY pos) AS items FROM s GROUP BY u",
    "eval_candidates": f'WITH {_EV_SPLIT}, {_CANDIDATES} SELECT split, u AS "user", cand_pos, i AS item, cand_pos = 0 AS is_positive FROM ca',
    "candidate_scores": f'WITH {_EV_SPLIT}, {_SCORED} SELECT split, u AS "user", cand_pos, i AS item, score FROM sc',
    "eval_ranks": f'WITH {_EV_SPLIT}, {_RANKS} SELECT split, u AS "user", rank FROM ra',
    "ranking_metrics": f"WITH {_EV_SPLIT}, {_RANKS} SELECT split, count(*) AS n_users, {', '.join(map(_metric, (10, 20, 100)))} FROM ra GROUP BY split",
    "retrieve_topk": f'WITH {_EV_SPLIT}, {_LISTS} SELECT u AS "user", rank, i AS item, score FROM li',
    "item_neighbors": f"""WITH v AS (SELECT vec_id::INT AS i, embedding::DOUBLE[{DIM}] AS v FROM embeddings),
w AS (SELECT a.i, b.i AS j, round(array_inner_product(a.v, b.v) / sqrt(array_inner_product(a.v, a.v) * array_inner_product(b.v, b.v)), 6) AS x FROM v a JOIN v b ON a.i <> b.i)
SELECT i AS item, row_number() OVER (PARTITION BY i ORDER BY x DESC, j) AS rank, j AS neighbor, x AS inner_product FROM w QUALIFY rank <= {NEAR}""",
    "calibration": f'WITH {_EV_SPLIT}, {_CALIBRATED} SELECT u AS "user", round(calibration, 6) AS calibration FROM cal',
    "ild": f'WITH {_EV_SPLIT}, {_GENRES}, {_LISTS}, {_DIVERSE} SELECT u AS "user", round(ild, 6) AS ild FROM di',
    "list_quality": f"""WITH {_EV_SPLIT}, {_CALIBRATED}, {_DIVERSE} SELECT round(avg(calibration), 5) AS calibration_mean, round(stddev_pop(calibration), 5) AS calibration_std,
round(avg(ild), 5) AS ild_mean, round(stddev_pop(ild), 5) AS ild_std FROM cal JOIN di USING (u)""",
    "minmax_relevance": f"""WITH {_EV_SPLIT}, {_LISTS} SELECT u AS "user", rank, i AS item,
round((score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-8), 6) AS relevance FROM li WINDOW w AS (PARTITION BY u)""",
    "greedy_rerank": f"WITH {_EV_SPLIT}, {_greedy()} {_CHOSEN}",
    "sample_report": f"""WITH {_EV_SPLIT}, {_greedy()}, us AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS user_idx FROM (SELECT DISTINCT u FROM s)),
ix AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS item_idx FROM (SELECT DISTINCT i FROM s))
SELECT user_idx, us.u AS "userId", r.rank, item_idx, r.item AS "movieId", title, genres, objective AS rerank_score
FROM ({_CHOSEN}) r JOIN us ON us.u = r."user" JOIN ix ON ix.i = r.item JOIN ({_CATALOGUE}) p ON p.i = r.item WHERE user_idx < 100""",
    "validation_report": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', 0, true)" for c in _CHECKS) + ') t("check", violations, ok)',
    **{
        f"train_{m}_topk": f"""WITH {_EV_SPLIT}, seen AS (SELECT u, count(DISTINCT i) FILTER (split = 'train') AS c FROM s GROUP BY u)
SELECT u AS "user", least({TOP}, (SELECT count(DISTINCT i) FROM s) - c) AS n_rows, least({TOP}, (SELECT count(DISTINCT i) FROM s) - c) AS n_items, 0::BIGINT AS n_seen, 0::BIGINT AS n_unsorted FROM seen"""
        for m in ("mf", "two_tower")
    },
}
