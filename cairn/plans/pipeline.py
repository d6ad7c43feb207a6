"""The whole pipeline over a folder of CSV files: prepare, train, evaluate, retrieve, rerank, validate."""

from __future__ import annotations

import logging
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.config import PrepareConfig, RerankWeights, TrainConfig, fingerprint
from cairn.operators import candidates as C
from cairn.operators import profiles as P
from cairn.operators import quality as Q
from cairn.operators import rerank as R
from cairn.operators import retrieval as T
from cairn.operators import scoring as S
from cairn.operators import split as D
from cairn.operators import training as L
from cairn.operators import validation as V
from cairn.operators.encode import dense_ids, require_known
from cairn.operators.kcore import k_core
from cairn.sources import files, paths

log = logging.getLogger("cairn")


def prepare(spark: SparkSession, raw: str, out: str, config: PrepareConfig, force: bool = False) -> dict[str, DataFrame]:
    """Tables split, users, items, item_genre, profiles, candidates, all_seen and train_seen, each made once per setting and input."""
    key = fingerprint(config, inputs=[paths.stamps(spark, f"{raw}/{name}.csv") for name in ("movies", "ratings")])

    def stage(name, make, **options):
        return files.cached(spark, f"{out}/{name}", key, make, force, **options)

    movies = files.read_movies(spark, f"{raw}/movies.csv").withColumnRenamed("movieId", "item")
    ratings = files.read_ratings(spark, f"{raw}/ratings.csv", config.max_rows)
    rows = ratings.select(F.col("userId").alias("user"), F.col("movieId").alias("item"), "rating", F.col("timestamp").alias("ts"))

    def core():
        require_known(rows, movies, "item")
        return k_core(rows, config.min_interactions)[0]

    kept = stage("core", core)
    users = stage("users", lambda: dense_ids(kept, "user", "user_idx"))
    known = movies.join(kept.select("item").distinct(), "item", "left_semi")
    items = stage("items", lambda: dense_ids(known, "catalog_pos", "item_idx").join(known, "catalog_pos"))

    def split():
        dense = kept.join(users, "user").join(items.select("item", "item_idx"), "item")
        dense = dense.select(F.col("user_idx").alias("user"), F.col("item_idx").alias("item"), "rating", "ts")
        return D.chronological_split(dense, ["ts", "item", "rating"])

    parts = stage("split", split, partition_by=["split"])
    by_idx = items.select(F.col("item_idx").alias("item"), "genres")
    genres = stage("item_genre", lambda: P.item_genres(by_idx))
    profiles = stage("profiles", lambda: P.user_profiles(parts.where("split = 'train'"), P.item_shares(genres)))

    def cands():
        positives = D.latest(parts.where("split <> 'train'"))
        seeds = {s: config.negative_seed(s) for s in ("val", "test")}
        return C.eval_candidates(positives, parts, by_idx, config.negatives, seeds)

    for name, history in (("all_seen", parts), ("train_seen", parts.where("split = 'train'"))):
        stage(name, lambda history=history: files.ragged(history))
    found = {"split": parts, "users": users, "items": items, "item_genre": genres, "profiles": profiles, "candidates": stage("candidates", cands)}
    stats = D.dataset_stats(rows, parts, parts, config.min_interactions, config.negatives, config.seed)
    files.save_json(f"{out}/stats.json", stats.first().asDict())
    return found


def genre_arrays(data: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Profiles as (user, profile) and items' genres as (item, hot): arrays as long as there are genres."""
    vocab = P.vocabulary(data["item_genre"])
    names = [r["genre"] for r in vocab.orderBy("genre_idx").collect()]
    weights = F.map_from_entries(F.collect_list(F.struct("genre", "p")))
    rows = data["profiles"].groupBy("user").agg(weights.alias("m"))
    profiles = rows.select("user", F.transform(F.lit(names), lambda g: F.coalesce(F.try_element_at("m", g), F.lit(0.0))).alias("profile"))
    return profiles, P.multi_hot(data["item_genre"], vocab)


def fit(data: dict[str, DataFrame], config: TrainConfig, **options) -> tuple[DataFrame, DataFrame, L.Model]:
    """(users, items) with vectors and biases by id, and the model, from the training rows of ``data``."""
    profiles, hot = genre_arrays(data) if config.model == "two-tower" else (None, None)
    rows = data["split"].where("split = 'train'").select("user", "item")
    model = L.train(rows, data["catalogue"], config, profiles, hot, **options)
    features = {}
    if config.model == "two-tower":
        features = {"users": profiles.select(F.col("user").cast("long").alias("id"), F.col("profile").alias("features")), "items": hot.select(F.col("item").cast("long").alias("id"), F.col("hot").cast("array<double>").alias("features"))}
    users, items = (model.vectors(side, features.get(side)) for side in ("users", "items"))
    return users.select(F.col("id").cast("int").alias("user"), "vec"), items.select(F.col("id").cast("int").alias("item"), "vec", "bias"), model


def train(spark: SparkSession, data: dict[str, DataFrame], out: str, config: TrainConfig) -> tuple[DataFrame, DataFrame]:
    """(users, items) with vectors, written with the training log and the model's state."""
    catalogue = data["items"].select(F.col("item_idx").alias("item"))
    users, items, model = fit(data | {"catalogue": catalogue}, config)
    items.select("item", F.col("vec").cast("array<float>"), F.col("bias").cast("float")).write.mode("overwrite").parquet(f"{out}/{config.model}_items")
    users.withColumn("vec", F.col("vec").cast("array<float>")).write.mode("overwrite").parquet(f"{out}/{config.model}_users")
    model.save(f"{out}/{config.model}")
    files.save_json(f"{out}/{config.model}_training.json", asdict(config) | {"loss": model.losses})
    return spark.read.parquet(f"{out}/{config.model}_users"), spark.read.parquet(f"{out}/{config.model}_items")


def evaluate(data: dict[str, DataFrame], users: DataFrame, items: DataFrame, out: str, model: str, split: str) -> dict:
    if split not in ("val", "test"):
        raise ValueError("split must be val or test")
    S.require_finite(users)
    S.require_finite(items)
    scored = S.candidate_scores(data["candidates"].where(F.col("split") == split), users, items)
    return files.save_row(S.ranking_metrics(S.positive_ranks(scored)), f"{out}/{model}_{split}_sampled_metrics.json")


def recommend(spark: SparkSession, data: dict[str, DataFrame], users: DataFrame, items: DataFrame, out: str, model: str, k: int = 100) -> DataFrame:
    T.recommend(users, items, data["split"].where("split = 'train'"), k).write.mode("overwrite").parquet(f"{out}/{model}_top{k}")
    return spark.read.parquet(f"{out}/{model}_top{k}")


def similar_items(spark: SparkSession, items: DataFrame, out: str, model: str, k: int = 200, normalize: bool = True) -> DataFrame:
    T.item_neighbours(items, k, normalize=normalize).write.mode("overwrite").parquet(f"{out}/{model}_item_neighbors_top{k}")
    return spark.read.parquet(f"{out}/{model}_item_neighbors_top{k}")


def rerank(spark: SparkSession, data: dict[str, DataFrame], lists: DataFrame, out: str, model: str, k: int = 20, weights: RerankWeights | None = None) -> DataFrame:
    weights = weights or RerankWeights()
    hot = P.multi_hot(data["item_genre"], P.vocabulary(data["item_genre"])).withColumnRenamed("hot", "vec")
    shares = P.item_shares(data["item_genre"])
    R.greedy_rerank(lists, data["profiles"], shares, hot, k, weights).write.mode("overwrite").parquet(f"{out}/{model}_rerank_top{k}")
    found = spark.read.parquet(f"{out}/{model}_rerank_top{k}")
    row = Q.list_quality(found, data["profiles"], shares, hot).first().asDict()
    files.save_json(f"{out}/{model}_quality.json", row | asdict(weights))
    named = found.select(F.col("user").alias("user_idx"), "rank", F.col("item").alias("item_idx"), F.col("objective").alias("rerank_score"))
    items = data["items"].select("item_idx", F.col("item").alias("movieId"), "title", "genres")
    report = R.sample_report(named, data["users"].select("user_idx", F.col("user").alias("userId")), items)
    files.write_csv(report, f"{out}/{model}_sample_recommendations", single=True)
    return found


def validate(data: dict[str, DataFrame], found: dict[str, DataFrame], out: str, minimum: int, top: int, keep: int) -> DataFrame:
    split = data["split"]
    checks = V.split_checks(split, minimum) + V.profile_checks(data["profiles"]) + V.stats_checks(split, files.load_json(f"{out}/stats.json"))
    checks += V.grouping_checks(split) + V.shape_checks(split, data["profiles"], data["item_genre"], data["candidates"], files.load_json(f"{out}/stats.json")["negatives"])
    checks += V.candidate_checks(data["candidates"], D.latest(split), split)
    train = split.where("split = 'train'")
    for model in sorted({n.rpartition("_")[0] for n in found if n.endswith("_lists")}):
        lists, kept = found[f"{model}_lists"], found[f"{model}_kept"]
        for side in ("users", "items"):
            vectors = found[f"{model}_{side}"]
            checks += V.embedding_checks(f"{model}_{side}", vectors, len(vectors.first()["vec"]), unit=model == "two-tower")
        if f"{model}_near" in found:
            near = found[f"{model}_near"]
            checks += [V.self_check(near), V.list_checks(f"{model}_neighbours", near, "inner_product", 0, "item", "neighbor")[2]]
        left = V.unseen_counts(found[f"{model}_users"], train, found[f"{model}_items"])
        checks += V.list_checks(f"{model}_top{top}", lists, "score", top, open_items=left) + [V.unseen_check(f"{model}_top{top}_unseen", lists, train)]
        checks += V.list_checks(f"{model}_top{keep}", kept, "objective", keep)[:2] + [V.containment_check(f"{model}_top{keep}_in_top{top}", kept, lists)]
    report = V.report(checks)
    files.save_json(f"{out}/validation_report.json", [r.asDict() for r in report.collect()])
    return report


def run_all(spark: SparkSession, raw: str, out: str, config: PrepareConfig, models: list[TrainConfig], top: int = 100, keep: int = 20, near: int = 200, force: bool = False) -> DataFrame:
    """Every stage for every model; the validation report. Raises if a check fails."""
    data, found = prepare(spark, raw, out, config, force), {}
    for m in models:
        log.info("training %s", m.model)
        users, items = train(spark, data, out, m)
        for split in ("val", "test"):
            evaluate(data, users, items, out, m.model, split)
        found[f"{m.model}_lists"] = recommend(spark, data, users, items, out, m.model, top)
        found[f"{m.model}_users"], found[f"{m.model}_items"] = users, items
        if m.model == "two-tower":
            found[f"{m.model}_near"] = similar_items(spark, items, out, m.model, near)
        found[f"{m.model}_kept"] = rerank(spark, data, found[f"{m.model}_lists"], out, m.model, keep)
    report = validate(data, found, out, config.min_interactions, top, keep)
    V.require_ok(report)
    return report
