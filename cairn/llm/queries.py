"""Queries of this package on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.rows import side_by_side
from cairn.llm.cooccur import pairs
from cairn.llm.leaks import find_leaks, leaked_shares
from cairn.llm.packing import VOCABULARY, count_tokens, pack_texts, packing_faults, packing_report
from cairn.llm.similar import neighbours, similar_pairs
from cairn.llm.sql import ORACLES
from cairn.llm.topn import top_n
from cairn.llm.truncation import find_truncated, truncation_by_source
from cairn.session import settle, tables

#: The log-likelihood ratio that one of 1,000 pairs without a link exceeds: chi-squared, one degree of freedom, p = 0.001, each pair by itself.
SIGNIFICANT = 10.828


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(tables(spark, d, "top100"), ["model", "user_idx"], "item_idx", "score", 20).select("model", "user_idx", "item_idx")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(neighbours(tables(spark, d, "two_tower_items"), "item_idx", "item_embedding", k=5, min_similarity=0.8))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs(tables(spark, d, "train"), "user_idx", "item_idx", min_support=12, min_lift=4.1).select("item_a", "item_b")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of the train table that at least 12 users have both, more often than chance at the level SIGNIFICANT."""
    found = pairs(tables(spark, d, "train"), "user_idx", "item_idx", min_support=12, min_llr=SIGNIFICANT)
    return found.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 6).alias("llr"))


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(tables(spark, d, "documents"), "doc_id", "text", "source", capacity=2048, vocabulary=VOCABULARY)


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the windows of all documents, and whether they are filled to 99 %."""
    docs = tables(spark, d, "documents")
    laid = settle(pack_texts(docs, "doc_id", "text", "source", capacity=2048, vocabulary=VOCABULARY))
    faults = packing_faults(laid, count_tokens(docs, "doc_id", "text", "source", VOCABULARY), "doc_id", 2048)
    return side_by_side(faults, packing_report(laid, "source", 2048).select((F.col("fill") >= 0.99).alias("filled")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = find_leaks(tables(spark, d, "documents"), "doc_id", "text", tables(spark, d, "eval_items"), "item_id", "text", window_words=13)
    return found.select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 13 words within two word edits of 13 of an item's; ``exact`` where they are the same. A window is found with probability 0.999."""
    found = find_leaks(tables(spark, d, "documents"), "doc_id", "text", tables(spark, d, "eval_items"), "item_id", "text", window_words=13, max_edits=2, recall=0.999)
    return found.select("doc_id", "item_id", (F.col("edits") == 0).alias("exact"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each test item leaked."""
    return leaked_shares(p8_found(spark, d), tables(spark, d, "eval_items"), "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_truncated(tables(spark, d, "documents"), "doc_id", "text").where("truncated").select("doc_id").distinct()


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation_by_source(find_truncated(tables(spark, d, "documents"), "doc_id", "text", "source"), "source")


def p9_planted(spark: SparkSession, d: str) -> DataFrame:
    """All documents judged, one in sixteen of those that end as a sentence does having lost its last third, within a word: (ends_well, cut, n, told)."""
    docs = tables(spark, d, "documents").select("doc_id", F.rtrim("text").alias("text"))
    well = F.coalesce(F.expr("text RLIKE '[^.][.!?]$' AND length(text) >= 200"), F.lit(False))
    cut = well & F.md5(F.col("doc_id").cast("string")).startswith("a")
    short = F.expr("regexp_replace(left(text, CAST(length(text) * 2 / 3 AS INT)), '[^\\\\p{L}]+$', '')")
    docs = settle(docs.select("doc_id", well.alias("ends_well"), cut.alias("cut"), F.when(cut, short.substr(F.lit(1), F.length(short) - 1)).otherwise(F.col("text")).alias("text")))
    found = find_truncated(docs, "doc_id", "text").join(docs.select("doc_id", "ends_well", "cut"), "doc_id")
    return found.groupBy("ends_well", "cut").agg(F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("told"))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether of planted cuts nine in ten are told, and of the sentences' ends left as they were less than one in a hundred."""
    found = p9_planted(spark, d).where("ends_well")
    return found.select("cut", "n", F.when(F.col("cut"), F.col("told") >= 0.9 * F.col("n")).otherwise(F.col("told") < 0.01 * F.col("n")).alias("as_wanted"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p5_pairs": p5_pairs, "p7_windows": p7_windows, "p7_checks": p7_checks, "p8_found": p8_found, "p8_near": p8_near, "p8_items": p8_items, "p9_found": p9_found, "p9_sources": p9_sources, "p9_checks": p9_checks}

__all__ = ["ORACLES", "QUERIES"]
