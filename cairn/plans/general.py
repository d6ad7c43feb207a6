"""Queries of the general operators on the test tables, with their SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.packed import split_packed
from cairn.operators.sessions import sessionize
from cairn.operators.skewed import Measure, key_statistics
from cairn.session import tables

KEY_MEASURES = (Measure("n_rows", "rows"), Measure("first_ts", "min", "ts"), Measure("last_ts", "max", "ts"), Measure("mean_rating", "mean", "rating"))
KEY_SHARE = 0.02


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(tables(spark, d, "train"), "user_idx", "ts")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_sessions(spark, d).select("user_idx", "start_ts", "end_ts")


def p3_keys(spark: SparkSession, d: str) -> DataFrame:
    found = key_statistics(tables(spark, d, "train"), {"user": "user_idx", "item": "item_idx"}, KEY_MEASURES, ["row_id"])
    return found.withColumn("mean_rating", F.round("mean_rating", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    train = tables(spark, d, "train")
    found = key_statistics(train, {"user": "user_idx", "item": "item_idx"}, KEY_MEASURES, ["row_id"])
    return found.where(F.col("n_rows") >= KEY_SHARE * train.count()).select("key_kind", "key_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(tables(spark, d, "movies"), "catalog_pos", "genres", value_name="genre")


QUERIES = {"p2_found": p2_found, "p2_sessions": p2_sessions, "p3_found": p3_found, "p3_keys": p3_keys, "p6_found": p6_found}

_SESSIONS = """
WITH r AS (SELECT user_idx, ts FROM train WHERE user_idx IS NOT NULL AND ts > 0),
g AS (SELECT *, lag(ts) OVER (PARTITION BY user_idx ORDER BY ts) AS before FROM r),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_idx ORDER BY ts, before NULLS FIRST ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_idx, min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration, count(*) AS n_events FROM n GROUP BY user_idx, no
"""
_KEYS = """
SELECT key_kind, key_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(rating), 6) AS mean_rating
FROM (SELECT 'user' AS key_kind, user_idx AS key_id, ts, rating FROM train UNION ALL SELECT 'item', item_idx, ts, rating FROM train)
WHERE key_id IS NOT NULL GROUP BY key_kind, key_id
"""
_PACKED = """
WITH v AS (SELECT string_agg(regexp_escape(genre), '|' ORDER BY length(genre) DESC) AS names FROM genres),
f AS (SELECT catalog_pos, regexp_extract_all(replace(m.genres, '""', '"'), (SELECT names FROM v)) AS hits FROM movies m WHERE m.genres IS NOT NULL)
SELECT catalog_pos, CAST(i AS INTEGER) AS pos, hits[i] AS genre FROM (SELECT catalog_pos, hits, unnest(range(1, len(hits) + 1)) AS i FROM f)
"""
ORACLES = {
    "p2_sessions": _SESSIONS,
    "p2_found": f"SELECT user_idx, start_ts, end_ts FROM ({_SESSIONS})",
    "p3_keys": _KEYS,
    "p3_found": f"SELECT key_kind, key_id FROM ({_KEYS}) WHERE n_rows >= 0.02 * (SELECT count(*) FROM train)",
    "p6_found": _PACKED,
}
