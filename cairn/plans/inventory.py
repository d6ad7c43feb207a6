"""Queries of sources, sinks, caches, training and the command line on the test tables, with their SQL for a second engine."""

from __future__ import annotations

import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import cli
from cairn.config import NO_GENRES, PrepareConfig, RerankWeights, TrainConfig
from cairn.functions.rows import side_by_side
from cairn.operators import candidates as C
from cairn.operators import profiles as P
from cairn.operators import scoring as S
from cairn.operators import split as D
from cairn.operators import training as L
from cairn.operators.encode import strays
from cairn.operators.kcore import k_core
from cairn.operators.packed import split_packed
from cairn.plans import oracles as O
from cairn.plans import reference as R
from cairn.plans.pipeline import evaluate, fit
from cairn.session import scratch_path, settle, tables
from cairn.sources import files, views
from cairn.streaming.profiles import genre_mass

FIRST, NEGATIVES = 3_000, 20


def csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue written as CSV, with commas and quotes in titles, and read with inferred types."""
    path = scratch_path(spark, "csv")
    titles = F.concat("title", F.lit(', "'), "genres", F.lit('"'))
    files.write_csv(views.catalogue(spark, d).select("item", titles.alias("title"), "genres"), path)
    return files.read_csv(spark, path)


def csv_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events written as a folder of typed CSV files in order, of which the first rows in file order are read."""
    path = scratch_path(spark, "ratings")
    rows = views.ev_interactions(spark, d).repartitionByRange(4, "seq").sortWithinPartitions("seq")
    files.write_csv(rows.select(F.col("user").alias("userId"), F.col("item").alias("movieId"), F.floor("rating").cast("float").alias("rating"), F.unix_timestamp("ts").alias("timestamp")), path)
    return files.read_ratings(spark, path, FIRST)


def archive_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Two small tables as files of an archive, which is fetched, checked and unpacked; the hashes of its files."""
    base = scratch_path(spark, "archive")
    if not base.startswith("file:"):
        raise RuntimeError("archives are unpacked on the driver, into a folder it can open")
    folder = Path("/" + base.removeprefix("file:").lstrip("/"))
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "raw.zip", "w") as z:
        for name, key in (("nation", "n"), ("region", "r")):
            rows = tables(spark, d, name).select(f"{key}_{name}key", f"{key}_name").collect()  # fixed tables of 25 and 5 rows
            z.writestr(f"raw/{name}.csv", "".join(f"{k},{v}\n" for k, v in sorted(rows)))
    home = files.obtain((folder / "raw.zip").as_uri(), str(folder / "raw"), ("nation.csv", "region.csv"))
    found = files.file_hashes(spark, f"{home}/*.csv", chunk_bytes=64)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


def array_files(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as NPZ files, one a partition, and read by the names of two of their three arrays."""
    path = scratch_path(spark, "arrays")
    rows = views.item_vectors(spark, d).select("item", F.col("vec").cast("array<float>").alias("vec"), F.lit(1.0).alias("unread"))
    files.write_arrays(rows.repartition(3, "item"), path)
    found = files.read_arrays(spark, path, ["item", "vec"])
    return found.select("item", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def split_sink(spark: SparkSession, d: str) -> DataFrame:
    """The split written by folders; only one of them is read."""
    path = scratch_path(spark, "split")
    files.write_split(R.ev_split(spark, d), path)
    return spark.read.parquet(path).where("split = 'val'").select("user", "item", "seq", "pos")


def seen_sinks(spark: SparkSession, d: str) -> DataFrame:
    """All items and the training items of each user, written as arrays and read again."""
    path, split = scratch_path(spark, "seen"), R.ev_split(spark, d)
    for kind, rows in (("all", split), ("train", split.where("split = 'train'"))):
        files.ragged(rows).withColumn("kind", F.lit(kind)).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("kind", "user", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"))


def stats_json(spark: SparkSession, d: str) -> DataFrame:
    """The statistics written as JSON and read again."""
    path, split = f"{scratch_path(spark, 'stats')}/stats.json", R.ev_split(spark, d)
    files.save_row(D.dataset_stats(views.ev_interactions(spark, d), split, split, R.EV.min_interactions, R.EV.negatives, R.EV.seed), path)
    found = files.load_json(path)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items() if isinstance(v, int | float)], "name string, value double")


def stage_cache(spark: SparkSession, d: str) -> DataFrame:
    """A stage's rows when it is made, asked for again, under another key, and by force."""
    path, regions = scratch_path(spark, "stage"), tables(spark, d, "region")
    twice = regions.unionByName(regions)
    asked = (("made", "a", regions, False), ("reused", "a", twice, False), ("other key", "b", twice, False), ("forced", "b", regions, True))
    return spark.createDataFrame([(n, files.cached(spark, path, key, lambda t=t: t, force).count()) for n, key, t, force in asked], "asked string, n_rows long")


def _refused(call) -> bool:
    try:
        call()
    except (ValueError, SystemExit):
        return True
    return False


def argument_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which settings are refused."""
    tried = {
        "model als": lambda: TrainConfig(model="als"),
        "model mf": lambda: TrainConfig(model="mf"),
        "steps 0": lambda: TrainConfig(steps_per_epoch=0),
        "max_rows 0": lambda: PrepareConfig(max_rows=0),
        "minimum 0": lambda: PrepareConfig(min_interactions=0),
        "weights 0.7 0.15 0.15": lambda: RerankWeights(),
        "weights 0.5 0.5 0.5": lambda: RerankWeights(0.5, 0.5, 0.5),
        "weights 1.5 -0.5 0": lambda: RerankWeights(1.5, -0.5, 0.0),
        "split train": lambda: evaluate({}, None, None, "", "mf", "train"),
        "stage none": lambda: cli.parser().parse_args(["none", "--raw", "x", "--out", "y"]),
    }
    return spark.createDataFrame([(k, _refused(v)) for k, v in tried.items()], "setting string, refused boolean")


def unknown_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of interactions that have no published list of neighbours, with how many rows name them."""
    return strays(tables(spark, d, "train"), tables(spark, d, "item_neighbors"), "item_idx")


def train_negatives(spark: SparkSession, d: str) -> DataFrame:
    """A drawn item for each training row: rows of each user, how many of their draws are known, and how many aren't items."""
    split = R.ev_split(spark, d)
    train = split.where("split = 'train'").select("user", "item")
    drawn = settle(L.draw_negatives(train, split.select("item"), R.EV.negative_seed("train")))
    known = drawn.join(train.distinct().select("user", F.col("item").alias("negative"), F.lit(1).alias("seen")), ["user", "negative"], "left")
    known = known.join(split.select(F.col("item").alias("negative")).distinct().withColumn("real", F.lit(1)), "negative", "left")
    return known.groupBy(F.col("user").cast("int").alias("user")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("seen").alias("n_seen"), (F.count(F.lit(1)) - F.count("real")).alias("n_strange"))


def _numbers(batches):
    for batch in batches:
        x = np.stack(batch["vec"])
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        state = np.zeros((2, *x.shape)), np.zeros((2, *x.shape))
        plain, decayed = np.zeros_like(x), x.copy()
        for y, decay, m, v in ((plain, 0.0, state[0][0], state[1][0]), (decayed, 0.5, state[0][1], state[1][1])):
            adam = L.LazyAdam(m, v, 0, 0.01, decay)
            for _ in range(2):
                adam.step(y, slice(None), x)
        found = {"relu": np.maximum(x, 0), "sigmoid": L.sigmoid(x), "log_sigmoid": L.log_sigmoid(x), "unit": unit, "adam": plain, "decayed": decayed}
        yield pd.DataFrame({"item": batch["item"]} | {k: v.sum(axis=1) for k, v in found.items()})


def activations(spark: SparkSession, d: str) -> DataFrame:
    """Sums over each item vector of its activations, of its unit vector, and of what two steps of each optimiser make of it."""
    names = ("relu", "sigmoid", "log_sigmoid", "unit", "adam", "decayed")
    found = views.item_vectors(spark, d).mapInPandas(_numbers, "item int, " + ", ".join(f"{n} double" for n in names))
    return found.select("item", *(F.round(n, 5).alias(n) for n in names))


HIDDEN, OUT = 8, 4


def _fixed_tower(inputs: int) -> list[np.ndarray]:
    h, i, o = np.arange(HIDDEN), np.arange(inputs), np.arange(OUT)
    return [((7 * h[:, None] + 3 * i) % 11 - 5) / 10, (h % 3 - 1) / 10, ((5 * o[:, None] + 2 * h) % 7 - 3) / 10, o / 10]


def tower_encode(spark: SparkSession, d: str) -> DataFrame:
    """Every item's vector and genres through a tower of fixed weights."""
    hot = P.item_genres(views.catalogue(spark, d))
    hot = P.multi_hot(hot, P.vocabulary(hot)).select(F.col("item").cast("long").alias("id"), F.col("hot").cast("array<double>").alias("features"))
    state = views.item_vectors(spark, d).select(F.col("item").cast("long").alias("id"), F.concat("vec", F.array(F.lit(0.0))).alias("x"))
    tower = _fixed_tower(R.DIM + len(hot.first()["features"]))
    found = L.Model(TrainConfig("two-tower", dim=R.DIM, hidden=HIDDEN), state, state, tower * 2, []).vectors("items", hot)
    return found.select(F.col("id").cast("int").alias("item"), F.posexplode("vec").alias("d", "y")).select("item", "d", F.round("y", 6).alias("y"))


def _losses(part: pd.DataFrame) -> pd.DataFrame:
    u, p, n = (np.stack(part[c]) for c in "upn")
    zero = np.zeros(len(part))
    unit = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (u, p, n)]
    return pd.DataFrame({"split": part["split"].iloc[:1], "user": part["user"].iloc[:1], "mf": [L.mf_loss(u, p, n, zero, zero, 0.1)[0]], "towers": [L.tower_loss(*unit)[0]]})


def batch_losses(spark: SparkSession, d: str) -> DataFrame:
    """Both models' losses of each user's candidates as one batch: the positive against each negative."""
    split = R.ev_split(spark, d)
    items, cands = R._items(spark, d, split), settle(R._candidates(split))
    users = S.mean_vectors(split.where("split = 'train'"), items, R.DIM).select("user", F.col("vec").alias("u"))
    pairs = cands.where(~F.col("is_positive")).select("split", "user", F.col("item").alias("b")).join(cands.where("is_positive").select("split", "user", F.col("item").alias("a")), ["split", "user"])
    rows = pairs.join(users, "user").join(items.select(F.col("item").alias("a"), F.col("vec").alias("p")), "a").join(items.select(F.col("item").alias("b"), F.col("vec").alias("n")), "b")
    found = rows.select("split", "user", "u", "p", "n").groupBy("split", "user").applyInPandas(_losses, "split string, user int, mf double, towers double")
    return found.select("split", "user", F.round("mf", 6).alias("mf"), F.round("towers", 6).alias("towers"))


def model_state(spark: SparkSession, d: str) -> DataFrame:
    """A trained model saved and loaded: rows and numbers of each side's state, and whether its vectors are the same."""
    split, path = R.ev_split(spark, d), scratch_path(spark, "model")
    users, items, model = R._fitted(spark, d, split, "mf", epochs=1)
    model.save(path)
    again = L.Model.load(spark, path, model.config)
    rows = None
    for side, mine in (("users", users), ("items", items)):
        key, state = side[:-1], getattr(again, side)
        theirs = again.vectors(side).select(F.col("id").cast("int").alias(key), F.col("vec").alias("again"))
        same = mine.join(theirs, key, "full").agg(F.coalesce(F.bool_and(F.col("vec").eqNullSafe(F.col("again"))), F.lit(False)).alias("same"))
        part = side_by_side(state.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("x")).alias("numbers")), same).select(F.lit(side).alias("side"), "n_rows", "numbers", "same")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _whole_genres(movies: DataFrame, items: DataFrame) -> DataFrame:
    """(item, genre), each once: all values of all listings of the ``items`` (item), in whatever notation; NO_GENRES where there are none."""
    found = split_packed(movies, "item_idx", "genres", value_name="genre").where(F.col("genre") != NO_GENRES)
    found = found.select(F.col("item_idx").alias("item"), "genre").distinct()
    return found.join(items.distinct(), "item", "right").select("item", F.coalesce("genre", F.lit(NO_GENRES)).alias("genre"))


def _quality(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Whether the loss of a model trained on the train table falls, and whether it ranks better than chance by a tenth at 10."""
    rows = tables(spark, d, "train").where("user_idx IS NOT NULL AND item_idx IS NOT NULL AND ts > 0")
    rows = rows.select(F.col("user_idx").alias("user"), F.col("item_idx").alias("item"), "ts").distinct()
    core = k_core(rows, 5)[0]
    # a user needs NEGATIVES items it hasn't met; whoever has met nearly all takes no part in this measurement
    known = core.select("item").distinct().count()
    met = core.groupBy("user").agg(F.count_distinct("item").alias("met")).where(F.col("met") <= known - NEGATIVES).select("user")
    split = settle(D.chronological_split(core.join(met, "user", "left_semi"), ["ts", "item"]))
    data = {"split": split, "catalogue": core.select("item")}
    if kind == "two-tower":  # the other model takes no features
        genres = settle(_whole_genres(tables(spark, d, "movies"), core.select("item")))
        data |= {"item_genre": genres, "profiles": P.user_profiles(split.where("split = 'train'"), P.item_shares(genres))}
    users, items, model = fit(data, TrainConfig(model=kind, dim=16, hidden=32, epochs=4, batch_size=256))
    positives = D.latest(split.where("split = 'test'"))
    cands = C.eval_candidates(positives, split, core.select("item"), NEGATIVES, {"test": 7})
    found = S.ranking_metrics(S.positive_ranks(S.candidate_scores(cands, users, items)), [10])
    falls = model.losses[-1] < model.losses[0] < 0.8
    return found.select(F.lit(kind).alias("model"), F.lit(falls).alias("loss_falls"), (F.col("hr_10") > 1.1 * 10 / (NEGATIVES + 1)).alias("beats_chance"))


def train_mf_quality(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d, "mf")


def train_two_tower_quality(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d, "two-tower")


def pipeline_report(spark: SparkSession, d: str) -> DataFrame:
    """All stages by the command line on the events as CSV files: the exit code, and the report that was written."""
    base = scratch_path(spark, "pipeline")
    files.write_csv(views.ev_interactions(spark, d).select(F.col("user").alias("userId"), F.col("item").alias("movieId"), "rating", F.unix_timestamp("ts").alias("timestamp")), f"{base}/raw/ratings.csv")
    files.write_csv(views.catalogue(spark, d).select(F.col("item").alias("movieId"), "title", "genres").orderBy("movieId"), f"{base}/raw/movies.csv", single=True)
    sizes = {"negatives": NEGATIVES, "candidate-k": R.TOP, "output-k": R.KEEP, "neighbors": 50, "batch-size": 1024, "dim": 16, "hidden-dim": 32}
    code = cli.main(["pipeline", "--raw", f"{base}/raw", "--out", f"{base}/out", *(x for k, v in sizes.items() for x in (f"--{k}", str(v)))], spark)
    rows = [(r["check"], int(r["violations"]), r["ok"], code) for r in files.load_json(f"{base}/out/validation_report.json")]
    return spark.createDataFrame(rows, "check string, violations long, ok boolean, exit_code int")


def stream_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Genre mass of the events as a stream of files, after all of them."""
    path = scratch_path(spark, "stream")
    shares = P.item_shares(P.item_genres(views.catalogue(spark, d)))
    views.ev_interactions(spark, d).select("user", "item").repartition(6).write.parquet(f"{path}/in")
    source = spark.readStream.schema("user int, item int").option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    asked = genre_mass(source, shares).writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint")
    asked.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/out")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").withColumn("w", F.round("w", 5))


_NAMES = """csv_inferred csv_first_rows archive_hashes array_files split_sink seen_sinks stats_json stage_cache argument_checks unknown_items
train_negatives activations tower_encode batch_losses model_state train_mf_quality train_two_tower_quality pipeline_report stream_profiles"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}


def _lists(name: str, k: int, checks: str) -> list[str]:
    return [f"{name}{k}_{c}" for c in checks.split()]


_MODELS = [
    c
    for m in ("mf", "two-tower")
    for c in [f"{m}_users_finite", f"{m}_items_finite", *_lists(f"{m}_top", R.TOP, "unique length sorted unseen"), *_lists(f"{m}_top", R.KEEP, f"unique length in_top{R.TOP}")]
]
_REPORT = [*O.SPLIT_CHECKS, "profiles_sum_to_one", "train_count_matches_stats", "val_count_matches_stats", "test_count_matches_stats", *O.SHAPE_CHECKS, *O.CANDIDATE_CHECKS, *_MODELS]
_REPORT += ["two-tower_users_unit_length", "two-tower_items_unit_length", "neighbours_exclude_self", "two-tower_neighbours_sorted"]
_STATS = "n_interactions n_users n_items n_train n_val n_test ratio_train ratio_val ratio_test n_raw min_interactions negatives seed min_user_rows min_item_rows".split()
_HASH = "SELECT '{0}.csv' AS name, octet_length(encode(t))::BIGINT AS length, sha256(t) AS sha256 FROM (SELECT string_agg({1}_{0}key || ',' || {1}_name || chr(10), '' ORDER BY {1}_{0}key) AS t FROM {0})"
ORACLES = {
    "csv_inferred": f"""SELECT i AS item, title || ', "' || genres || '"' AS title, genres FROM ({O._CATALOGUE})""",
    "csv_first_rows": f'SELECT u AS "userId", i AS "movieId", floor(rating::FLOAT)::FLOAT AS rating, floor(epoch(ts))::BIGINT AS timestamp FROM ({O._EV}) ORDER BY seq LIMIT {FIRST}',
    "archive_hashes": f"{_HASH.format('nation', 'n')} UNION ALL {_HASH.format('region', 'r')}",
    "array_files": "SELECT vec_id::INT AS item, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
    "split_sink": f"""WITH {O._EV_SPLIT} SELECT u AS "user", i AS item, seq, pos::INT AS pos FROM s WHERE split = 'val'""",
    "seen_sinks": f"""WITH {O._EV_SPLIT} SELECT 'all' AS kind, u AS "user", string_agg(i::VARCHAR, ',' ORDER BY pos) AS items FROM s GROUP BY u
UNION ALL SELECT 'train', u, string_agg(i::VARCHAR, ',' ORDER BY pos) FROM s WHERE split = 'train' GROUP BY u""",
    "stats_json": f"WITH t AS ({O.ORACLES['dataset_stats']}) " + " UNION ALL ".join(f"SELECT '{n}' AS name, {n}::DOUBLE AS value FROM t" for n in _STATS),
    "stage_cache": """SELECT * FROM (VALUES ('made', 1), ('reused', 1), ('other key', 2), ('forced', 1)) t(asked, k), (SELECT count(*) AS c FROM region)""",
    "argument_checks": """SELECT * FROM (VALUES ('model als', true), ('model mf', false), ('steps 0', true), ('max_rows 0', true), ('minimum 0', true), ('weights 0.7 0.15 0.15', false),
('weights 0.5 0.5 0.5', true), ('weights 1.5 -0.5 0', true), ('split train', true), ('stage none', true)) t(setting, refused)""",
    "unknown_items": "SELECT item_idx, count(*) AS n_rows FROM train WHERE item_idx IS NOT NULL AND item_idx NOT IN (SELECT item_idx FROM item_neighbors WHERE item_idx IS NOT NULL) GROUP BY item_idx",
    "train_negatives": f"""WITH {O._EV_SPLIT} SELECT u AS "user", count(*) AS n_rows, 0::BIGINT AS n_seen, 0::BIGINT AS n_strange FROM s WHERE split = 'train' GROUP BY u""",
    "activations": """WITH v AS (SELECT vec_id::INT AS item, unnest(embedding)::DOUBLE AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
w AS (SELECT *, 0.01 * x / (abs(x) + 1e-8) AS s FROM v)
SELECT item, round(sum(greatest(x, 0)), 5) AS relu, round(sum(1 / (1 + exp(-x))), 5) AS sigmoid, round(sum(-ln(1 + exp(-x))), 5) AS log_sigmoid, round(sum(x / greatest(n, 1e-12)), 5) AS unit,
round(sum(-2 * s), 5) AS adam, round(sum((x * 0.995 - s) * 0.995 - s), 5) AS decayed FROM w GROUP BY item""",
    "tower_encode": f"""WITH g AS ({O._ALL_GENRES}), vocab AS (SELECT genre, row_number() OVER (ORDER BY genre) - 1 AS idx FROM (SELECT DISTINCT genre FROM g)),
a AS (SELECT vec_id::INT AS i, unnest(range(0, {R.DIM})) AS c, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id IN (SELECT i FROM g)
  UNION ALL SELECT g.i, {R.DIM} + idx, 1.0 FROM g JOIN vocab USING (genre) WHERE g.i IN (SELECT vec_id FROM embeddings)),
h AS (SELECT i, h, greatest(0, sum(x * ((7 * h + 3 * c) % 11 - 5) / 10.0) + (h % 3 - 1) / 10.0) AS y FROM a, range(0, {HIDDEN}) t(h) GROUP BY i, h),
z AS (SELECT i, d, sum(y * ((5 * d + 2 * h) % 7 - 3) / 10.0) + d / 10.0 AS z FROM h, range(0, {OUT}) t(d) GROUP BY i, d)
SELECT i AS item, d::INT AS d, round(z / greatest(sqrt(sum(z * z) OVER (PARTITION BY i)), 1e-12), 6) AS y FROM z""",
    "batch_losses": f"""WITH {O._EV_SPLIT}, {O._CANDIDATES}, {O._VECTORS},
x AS (SELECT n.split, n.u, uv.v AS uv, a.v AS pv, b.v AS nv FROM ca n JOIN ca p ON n.split = p.split AND n.u = p.u AND p.cand_pos = 0 AND n.cand_pos > 0
  JOIN uv ON uv.u = n.u JOIN iv a ON a.i = p.i JOIN iv b ON b.i = n.i),
y AS (SELECT *, array_inner_product(uv, uv) AS uu, array_inner_product(pv, pv) AS pp, array_inner_product(nv, nv) AS nn, array_inner_product(uv, pv) AS up, array_inner_product(uv, nv) AS un FROM x)
SELECT split, u AS "user", round(avg(ln(1 + exp(-(up - un)))) + 0.1 * (avg(uu) + avg(pp) + avg(nn)) / {R.DIM}, 6) AS mf,
round(avg(ln(1 + exp(-(up / sqrt(uu * pp) - un / sqrt(uu * nn))))), 6) AS towers FROM y GROUP BY split, u""",
    "model_state": f"""WITH {O._EV_SPLIT} SELECT 'users' AS side, count(DISTINCT u) AS n_rows, {3 * (TrainConfig().dim + 1)} AS numbers, true AS same FROM s WHERE split = 'train'
UNION ALL SELECT 'items', count(DISTINCT i), {3 * (TrainConfig().dim + 1)}, true FROM s""",
    "train_mf_quality": "SELECT 'mf' AS model, true AS loss_falls, true AS beats_chance",
    "train_two_tower_quality": "SELECT 'two-tower' AS model, true AS loss_falls, true AS beats_chance",
    "pipeline_report": "SELECT *, 0 AS exit_code FROM (VALUES " + ", ".join(f"('{c}', 0::BIGINT, true)" for c in _REPORT) + ') t("check", violations, ok)',
    "stream_profiles": f"""WITH g AS ({O._ALL_GENRES}), sh AS (SELECT i, genre, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS share FROM g)
SELECT u AS "user", genre, round(sum(share), 5) AS w FROM ({O._EV}) JOIN sh USING (i) GROUP BY u, genre""",
}
ORACLES["stage_cache"] = "SELECT asked, k * c AS n_rows FROM (" + ORACLES["stage_cache"] + ")"
