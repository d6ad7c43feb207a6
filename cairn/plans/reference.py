"""Queries of the recommendation pipeline's operators, on the events (EV) and on orders with line items (TX)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.config import PrepareConfig, TrainConfig
from cairn.operators import candidates as C
from cairn.operators import profiles as P
from cairn.operators import quality as Q
from cairn.operators import rerank as R
from cairn.operators import retrieval as T
from cairn.operators import scoring as S
from cairn.operators import split as D
from cairn.operators import validation as V
from cairn.operators.encode import dense_ids, require_known
from cairn.operators.kcore import k_core
from cairn.plans.pipeline import fit
from cairn.session import settle
from cairn.sources import views

#: 100 items in EV, of which a user has seen up to 67.
EV = PrepareConfig(min_interactions=5, negatives=20)
TX_CORE, TOP, KEEP, NEAR, DIM = 20, 20, 5, 200, 64


def ev_core(spark: SparkSession, d: str) -> DataFrame:
    rows = views.ev_interactions(spark, d)
    require_known(rows, views.catalogue(spark, d), "item")
    return k_core(rows, EV.min_interactions)[0]


def ev_split(spark: SparkSession, d: str) -> DataFrame:
    return settle(D.chronological_split(ev_core(spark, d), ["ts", "seq"]))


def _train(split: DataFrame) -> DataFrame:
    return split.where("split = 'train'")


def _genres(spark: SparkSession, d: str, split: DataFrame) -> DataFrame:
    return P.item_genres(views.catalogue(spark, d).join(split.select("item").distinct(), "item", "left_semi"))


def _profiles(spark: SparkSession, d: str, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    shares = P.item_shares(_genres(spark, d, split))
    return P.user_profiles(_train(split), shares), shares


def _items(spark: SparkSession, d: str, split: DataFrame) -> DataFrame:
    return views.item_vectors(spark, d).join(split.select("item").distinct(), "item", "left_semi")


def _lists(spark: SparkSession, d: str, split: DataFrame) -> DataFrame:
    items = _items(spark, d, split)
    return T.recommend(S.mean_vectors(_train(split), items, DIM), items, _train(split), TOP)


def ev_interactions(spark, d):
    return views.ev_interactions(spark, d).select("user", "item", F.round(F.col("rating").cast("double"), 4).alias("rating"), "ts")


def item_genres(spark, d):
    return P.item_genres(views.catalogue(spark, d))


def kcore_5_ev(spark, d):
    return ev_core(spark, d).select("user", "item", "seq")


def kcore_20_tx(spark, d):
    core = k_core(views.tx_interactions(spark, d), TX_CORE)[0]
    return core.groupBy("user").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("item").alias("n_items"), F.sum("item").alias("item_sum"))


def dense_ids_tx(spark, d):
    core = k_core(views.tx_interactions(spark, d), TX_CORE)[0]
    users = dense_ids(core, "user", "idx").select(F.lit("user").alias("kind"), F.col("user").alias("id"), "idx")
    kept = views.catalogue(spark, d).join(core.select("item").distinct(), "item", "left_semi")
    ids = dense_ids(kept, "catalog_pos", "idx").join(kept, "catalog_pos")
    return users.unionByName(ids.select(F.lit("item").alias("kind"), F.col("item").alias("id"), "idx"))


def chrono_split(spark, d):
    return ev_split(spark, d).select("user", "item", "seq", "pos", "split")


def chrono_split_tx(spark, d):
    core = k_core(views.tx_interactions(spark, d), TX_CORE)[0]
    split = D.chronological_split(core, ["ts", "item", "seq"])
    return split.groupBy("user", "split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("item").alias("item_sum"))


def latest_positive(spark, d):
    return D.latest(ev_split(spark, d))


def dataset_stats(spark, d):
    split = ev_split(spark, d)
    return D.dataset_stats(views.ev_interactions(spark, d), split, split, EV.min_interactions, EV.negatives, EV.seed)


def genre_vocab(spark, d):
    return P.vocabulary(_genres(spark, d, ev_split(spark, d)))


def multi_hot(spark, d):
    mine = _genres(spark, d, ev_split(spark, d))
    return P.multi_hot(mine, P.vocabulary(mine)).select("item", F.transform("hot", lambda x: x.cast("int")).cast("string").alias("hot"))


def user_profiles(spark, d):
    return _profiles(spark, d, ev_split(spark, d))[0].withColumn("p", F.round("p", 6))


def seen_items(spark, d):
    return ev_split(spark, d).groupBy("user").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"].cast("string")), ",").alias("items"))


def _candidates(split: DataFrame) -> DataFrame:
    positives = settle(D.latest(split).where("split <> 'train'"))
    seeds = {s: EV.negative_seed(s) for s in ("val", "test")}
    return C.eval_candidates(positives, split, split.select("item").distinct(), EV.negatives, seeds)


def eval_candidates(spark, d):
    return _candidates(ev_split(spark, d))


def _scored(spark, d, split):
    items = _items(spark, d, split)
    S.require_finite(items)
    return S.candidate_scores(_candidates(split), S.mean_vectors(_train(split), items, DIM), items, digits=6)


def candidate_scores(spark, d):
    return _scored(spark, d, ev_split(spark, d)).select("split", "user", "cand_pos", "item", "score")


def eval_ranks(spark, d):
    return S.positive_ranks(_scored(spark, d, ev_split(spark, d)))


def ranking_metrics(spark, d):
    found = S.ranking_metrics(eval_ranks(spark, d))
    return found.select("split", "n_users", *(F.round(c, 6).alias(c) for c in found.columns[2:]))


def retrieve_topk(spark, d):
    return _lists(spark, d, ev_split(spark, d))


def item_neighbors(spark, d):
    return T.item_neighbours(views.item_vectors(spark, d), NEAR)


def _quality(spark, d):
    split = ev_split(spark, d)
    profiles, shares = _profiles(spark, d, split)
    return _lists(spark, d, split), profiles, shares, _hot(spark, d, split)


def _hot(spark, d, split):
    mine = _genres(spark, d, split)
    return P.multi_hot(mine, P.vocabulary(mine)).withColumnRenamed("hot", "vec")


def calibration(spark, d):
    lists, profiles, shares, _ = _quality(spark, d)
    return Q.calibration(profiles, Q.list_mix(lists, shares)).withColumn("calibration", F.round("calibration", 6))


def ild(spark, d):
    lists, _, _, hot = _quality(spark, d)
    return Q.diversity(lists, hot).withColumn("ild", F.round("ild", 6))


def list_quality(spark, d):
    found = Q.list_quality(*_quality(spark, d))
    return found.select(*(F.round(c, 5).alias(c) for c in found.columns))


def minmax_relevance(spark, d):
    found = R.min_max_relevance(_lists(spark, d, ev_split(spark, d)))
    return found.select("user", "rank", "item", F.round("relevance", 6).alias("relevance"))


def _reranked(spark, d, split):
    profiles, shares = _profiles(spark, d, split)
    return R.greedy_rerank(_lists(spark, d, split), profiles, shares, _hot(spark, d, split), KEEP)


def greedy_rerank(spark, d):
    return _reranked(spark, d, ev_split(spark, d)).withColumn("objective", F.round("objective", 6))


def sample_report(spark, d):
    split = ev_split(spark, d)
    users = dense_ids(split, "user", "user_idx")
    kept = views.catalogue(spark, d).join(split.select("item").distinct(), "item", "left_semi")
    items = dense_ids(kept, "catalog_pos", "item_idx").join(kept, "catalog_pos")
    lists = _reranked(spark, d, split).join(users, "user").join(items.select("item", "item_idx"), "item")
    lists = lists.select("user_idx", "rank", "item_idx", F.round("objective", 6).alias("rerank_score"))
    return R.sample_report(lists, users.withColumnRenamed("user", "userId"), items.select("item_idx", F.col("item").alias("movieId"), "title", "genres"), n_users=100)


def validation_report(spark, d):
    split = ev_split(spark, d)
    profiles, _ = _profiles(spark, d, split)
    cands, lists, near = settle(_candidates(split)), settle(_lists(spark, d, split)), settle(item_neighbors(spark, d))
    reranked = settle(_reranked(spark, d, split))
    checks = V.split_checks(split, EV.min_interactions) + V.profile_checks(profiles) + V.candidate_checks(cands, D.latest(split), split)
    checks += V.grouping_checks(split) + V.shape_checks(split, profiles, _genres(spark, d, split), cands, EV.negatives)
    checks += V.stats_checks(split, D.dataset_stats(split, split, split, EV.min_interactions, EV.negatives, EV.seed).first().asDict())
    checks += V.list_checks("top20", lists, "score", TOP, open_items=V.unseen_counts(split, _train(split), _items(spark, d, split))) + [V.unseen_check("top20_unseen", lists, _train(split))]
    checks += V.list_checks("top5", reranked, "objective", KEEP)[:2] + [V.containment_check("top5_in_top20", reranked, lists)]
    checks += V.list_checks("neighbours", near, "inner_product", NEAR, "item", "neighbor") + [V.self_check(near)]
    checks += V.embedding_checks("items", views.item_vectors(spark, d), DIM, unit=True)
    return V.report(checks)


def _fitted(spark, d, split, model, **settings):
    """Users and items of a model trained on the events' training rows, by their own ids."""
    genres = _genres(spark, d, split)
    data = {"split": split, "catalogue": split.select("item"), "item_genre": genres, "profiles": P.user_profiles(_train(split), P.item_shares(genres))}
    return fit(data, TrainConfig(model=model, **{"epochs": 2, "batch_size": 1024} | settings))


def _trained(spark, d, model):
    """What the Top-20 unseen items of a model trained on the events' training rows keep to, user by user."""
    split = ev_split(spark, d)
    users, items, _ = _fitted(spark, d, split, model)
    lists = settle(T.recommend(users, items, _train(split), TOP))
    seen = _train(split).select("user", "item").distinct().withColumn("seen", F.lit(1))
    before = lists.select("user", (F.col("rank") + 1).alias("rank"), F.col("score").alias("before"))
    rows = lists.join(seen, ["user", "item"], "left").join(before, ["user", "rank"], "left")
    return rows.groupBy("user").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("item").alias("n_items"), F.count("seen").alias("n_seen"), F.count_if(F.col("score") > F.col("before")).alias("n_unsorted"))


def train_mf_topk(spark, d):
    return _trained(spark, d, "mf")


def train_two_tower_topk(spark, d):
    return _trained(spark, d, "two-tower")


_NAMES = """ev_interactions item_genres kcore_5_ev kcore_20_tx dense_ids_tx chrono_split chrono_split_tx latest_positive dataset_stats genre_vocab
multi_hot user_profiles seen_items eval_candidates candidate_scores eval_ranks ranking_metrics retrieve_topk item_neighbors calibration ild list_quality
minmax_relevance greedy_rerank sample_report validation_report train_mf_topk train_two_tower_topk"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}
