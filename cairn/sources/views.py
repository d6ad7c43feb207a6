"""The test tables as interaction logs, catalogues and vectors.

EV: ``events``, whose times are unique. TX: ``orders`` with ``lineitem``, with ties and repeated keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import tables


def ev_interactions(spark: SparkSession, d: str) -> DataFrame:
    """(user, item, rating, ts) of the events; ``seq`` orders equal times."""
    return tables(spark, d, "events").select(
        F.col("user_id").cast("int").alias("user"),
        F.get_json_object("props", "$.k").cast("int").alias("item"),
        F.col("value").cast("float").alias("rating"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
    )


def tx_interactions(spark: SparkSession, d: str) -> DataFrame:
    orders = tables(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = tables(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_linenumber", "l_extendedprice")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("int").alias("user"),
        F.col("l_partkey").cast("int").alias("item"),
        F.col("l_quantity").cast("float").alias("rating"),
        F.col("l_shipdate").alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"),
    )


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """(item, catalog_pos, title, genres): parts, with the words of their names and their type as genres."""
    return tables(spark, d, "part").select(
        F.col("p_partkey").cast("int").alias("item"),
        F.col("p_partkey").cast("long").alias("catalog_pos"),
        F.col("p_name").alias("title"),
        F.concat_ws("|", F.regexp_replace("p_name", " ", "|"), F.col("p_type")).alias("genres"),
    )


def item_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(item, vec): 64 numbers an item."""
    return tables(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("item"), F.col("embedding").cast("array<double>").alias("vec"))
