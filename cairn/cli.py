"""Command line: python -m cairn.cli STAGE --raw FOLDER --out FOLDER ..."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from cairn.config import PrepareConfig, RerankWeights, TrainConfig
from cairn.plans import pipeline as X
from cairn.session import local_session
from cairn.sources import files

STAGES = ("preprocess", "train", "evaluate", "recommend", "item-similarity", "rerank", "validate", "pipeline")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--raw", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--model", choices=("mf", "two-tower"), default="mf")
    p.add_argument("--split", choices=("val", "test"), default="test")
    for name, default in (("min-interactions", 5), ("negatives", 100), ("seed", 2026), ("epochs", 1), ("dim", 64), ("hidden-dim", 128), ("batch-size", 4096), ("candidate-k", 100), ("output-k", 20), ("neighbors", 200), ("cpus", 8)):
        p.add_argument(f"--{name}", type=int, default=default)
    for name, default in (("learning-rate", 0.01), ("regularization", 1e-5), ("weight-decay", 1e-5)):
        p.add_argument(f"--{name}", type=float, default=default)
    p.add_argument("--download", metavar="URL", help="a ZIP file with the raw CSV files, fetched to --raw and unpacked unless they are there")
    p.add_argument("--no-normalize", action="store_true", help="item-similarity: inner products of the vectors as they are")
    p.add_argument("--max-rows", type=int)
    p.add_argument("--steps-per-epoch", type=int)
    p.add_argument("--weights", type=float, nargs=3, default=(0.70, 0.15, 0.15), metavar=("RELEVANCE", "CALIBRATION", "DIVERSITY"))
    p.add_argument("--force", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one stage; 0 if all went well. A session is made where none is given."""
    a = parser().parse_args(argv)
    logging.basicConfig(format="[%(asctime)s] %(message)s", datefmt="%H:%M:%S", level=logging.INFO)
    spark = spark or local_session(a.cpus)
    if a.download:
        files.obtain(a.download, a.raw, ("ratings.csv", "movies.csv"), a.force)
    config = PrepareConfig(a.min_interactions, a.negatives, a.seed, a.max_rows)
    shared = {"dim": a.dim, "hidden": a.hidden_dim, "epochs": a.epochs, "batch_size": a.batch_size, "steps_per_epoch": a.steps_per_epoch, "seed": a.seed}
    shared |= {"learning_rate": a.learning_rate, "l2": a.regularization, "weight_decay": a.weight_decay}
    trained = [TrainConfig(model=m, **shared) for m in (("mf", "two-tower") if a.stage == "pipeline" else (a.model,))]
    if a.stage == "pipeline":
        X.run_all(spark, a.raw, a.out, config, trained, a.candidate_k, a.output_k, a.neighbors, a.force)
        return 0
    data = X.prepare(spark, a.raw, a.out, config, a.force)
    read = lambda name: spark.read.parquet(f"{a.out}/{a.model}_{name}")
    if a.stage == "train":
        X.train(spark, data, a.out, trained[0])
    elif a.stage == "evaluate":
        X.evaluate(data, read("users"), read("items"), a.out, a.model, a.split)
    elif a.stage == "recommend":
        X.recommend(spark, data, read("users"), read("items"), a.out, a.model, a.candidate_k)
    elif a.stage == "item-similarity":
        X.similar_items(spark, read("items"), a.out, a.model, a.neighbors, not a.no_normalize)
    elif a.stage == "rerank":
        X.rerank(spark, data, read(f"top{a.candidate_k}"), a.out, a.model, a.output_k, RerankWeights(*a.weights))
    elif a.stage == "validate":
        found = {f"{a.model}_lists": read(f"top{a.candidate_k}"), f"{a.model}_kept": read(f"rerank_top{a.output_k}"), f"{a.model}_users": read("users"), f"{a.model}_items": read("items")}
        return int(not all(r["ok"] for r in X.validate(data, found, a.out, a.min_interactions, a.candidate_k, a.output_k).collect()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
