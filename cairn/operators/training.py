"""Pairwise ranking models in NumPy, trained unit by unit and averaged.

Users are dealt to blocks of bounded rows, items to blocks of bounded size; a unit is one block of users with one block
of items. An epoch passes through as many strata as there are item blocks: in each, every block of users meets one
block of items, and all units of a stratum run at the same time. A unit receives the state of its users and items in
pieces, trains on them, and sends the pieces back with how often each row was touched; rows that several units touched
(items, users of more rows than a block holds, the towers' weights) are averaged by that, piece by piece. Nothing as
large as the users or the items is broadcast or passes through the driver; the towers' weights, a fixed number, do.

A row of state holds a vector, its bias, and Adam's moments of both, which therefore go on over strata and epochs. A piece
is the numbers of up to SHELF rows as bytes: a stratum's work is on arrays, and no row is met one by one. A user's
negatives in a unit are drawn evenly from the unit's items that they don't have in training; over the strata that is
the whole catalogue.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.config import TrainConfig
from cairn.session import settle, tidy

#: Items in one block; of 64 numbers with their moments it is 100 MB.
ITEM_BLOCK = 65_536
#: Numbers in one piece of the towers' weights, rows of state in one piece, interactions in one piece.
PIECE, SHELF, ROWS = 4_096, 2_048, 65_536


def log_sigmoid(x: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0.0, -x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(log_sigmoid(x))


class LazyAdam:
    """Adam on the rows that a step touches; bias correction by the number of all steps. ``decay`` is decoupled."""

    def __init__(self, m: np.ndarray, v: np.ndarray, t: int, rate: float, decay: float = 0.0):
        self.m, self.v, self.t, self.rate, self.decay = m, v, t, rate, decay

    def step(self, x: np.ndarray, rows: np.ndarray | slice, grad: np.ndarray) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        self.v[rows] = 0.999 * self.v[rows] + 0.001 * grad**2
        if self.decay:
            x[rows] *= 1 - self.rate * self.decay
        x[rows] -= self.rate * (self.m[rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[rows] / (1 - 0.999**self.t)) + 1e-8)


def by_row(ids: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that occur, each once, with the sums of their gradients."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    return ids[starts], np.add.reduceat(grads[order], starts, axis=0)


def mf_loss(u: np.ndarray, p: np.ndarray, n: np.ndarray, bp: np.ndarray, bn: np.ndarray, l2: float):
    """Loss of a batch and its gradients for user, positive and negative factors and both biases."""
    x = (u * (p - n)).sum(1) + bp - bn
    g = -sigmoid(-x) / len(x)
    loss = -log_sigmoid(x).mean() + l2 * ((u**2).mean() + (p**2).mean() + (n**2).mean())
    w = 2 * l2 / u.size
    return loss, g[:, None] * (p - n) + w * u, g[:, None] * u + w * p, -g[:, None] * u + w * n, g, -g


@dataclass
class Tower:
    """ReLU network on an id embedding next to fixed features; outputs of length 1."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def new(inputs: int, hidden: int, dim: int, rng: np.random.Generator) -> Tower:
        a, b = 1 / math.sqrt(inputs), 1 / math.sqrt(hidden)
        return Tower(rng.uniform(-a, a, (hidden, inputs)), rng.uniform(-a, a, hidden), rng.uniform(-b, b, (dim, hidden)), rng.uniform(-b, b, dim))

    def parts(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def forward(self, x: np.ndarray):
        h = x @ self.w1.T + self.b1
        z = np.maximum(h, 0) @ self.w2.T + self.b2
        size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        return z / size, (x, h, size)

    def backward(self, y: np.ndarray, kept, dy: np.ndarray, inputs: int | None = None):
        """Gradients of the four parts, and of the input or the first ``inputs`` numbers of it."""
        x, h, size = kept
        dz = (dy - y * (y * dy).sum(1, keepdims=True)) / size
        a = np.maximum(h, 0)
        dh = (dz @ self.w2) * (h > 0)
        return [dh.T @ x, dh.sum(0), dz.T @ a, dz.sum(0)], dh @ self.w1[:, :inputs]


class Unseen:
    """Items a user does not have, each as likely as any other, without drawing again.

    Users and items are numbered from 0. The r-th unseen item of a user is r plus the number of seen items before it,
    and that number is found by bisection: the j-th seen item has itself less j unseen items before it.
    """

    def __init__(self, users: np.ndarray, items: np.ndarray, n_users: int, n_items: int):
        keys = np.unique(users.astype(np.int64) * n_items + items)
        user, item = keys // n_items, keys % n_items
        self.seen, self.n_items = np.bincount(user, minlength=n_users), n_items
        self.starts = np.cumsum(self.seen) - self.seen
        self.before = user * (n_items + 1) + item - (np.arange(len(keys)) - self.starts[user])

    def left(self) -> np.ndarray:
        """How many items each user has not seen."""
        return self.n_items - self.seen

    def draw(self, users: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        r = rng.integers(0, self.n_items - self.seen[users])
        return r + np.searchsorted(self.before, users.astype(np.int64) * (self.n_items + 1) + r, side="right") - self.starts[users]


class Rows:
    """State of numbered rows: vectors, biases and Adam's moments of both, one line each: vector, bias, m, v."""

    def __init__(self, state: np.ndarray, dim: int, t: int, rate: float):
        self.state, self.touched, self.cut, self.t, self.rate = state, np.zeros(len(state), dtype=np.int64), dim + 1, t, rate
        self.vec, self.bias = state[:, :dim], state[:, dim]

    def step(self, ids: np.ndarray, grads: np.ndarray) -> None:
        """One step by the gradients of the vectors, or of the vectors and, in a last column, the biases."""
        rows, total = by_row(ids, grads)
        self.touched[rows] += 1
        state = self.state[rows]
        x, m, v = (state[:, i * self.cut :][:, : total.shape[1]] for i in range(3))
        LazyAdam(m, v, self.t, self.rate).step(x, slice(None), total)
        self.state[rows], self.t = state, self.t + 1


def _mf_steps(users: Rows, items: Rows, towers, u: np.ndarray, p: np.ndarray, n: np.ndarray, config: TrainConfig) -> float:
    loss, du, dp, dn, gp, gn = mf_loss(users.vec[u], items.vec[p], items.vec[n], items.bias[p], items.bias[n], config.l2)
    users.step(u, du)
    items.step(np.concatenate([p, n]), np.concatenate([np.column_stack([dp, gp]), np.column_stack([dn, gn])]))
    return loss


def tower_loss(yu: np.ndarray, yp: np.ndarray, yn: np.ndarray):
    """Loss of a batch from the towers' outputs, and its gradients for the three."""
    x = (yu * (yp - yn)).sum(1)
    g = (-sigmoid(-x) / len(x))[:, None]
    return -log_sigmoid(x).mean(), g * (yp - yn), g * yu, -g * yu


@dataclass
class Towers:
    """Both towers, whose weights are views of one array, with Adam's moments of it."""

    mine: Tower
    theirs: Tower
    weights: np.ndarray
    adam: LazyAdam

    @staticmethod
    def of(flat: np.ndarray, shapes: list[tuple[int, ...]], t: int, config: TrainConfig) -> Towers:
        """From all weights, then all m, then all v, laid end to end."""
        x, m, v = np.split(flat.copy(), 3)
        parts = unpack(x, shapes)
        return Towers(Tower(*parts[:4]), Tower(*parts[4:]), x, LazyAdam(m, v, t, config.learning_rate, config.weight_decay))

    def step(self, grads: list[np.ndarray]) -> None:
        self.adam.step(self.weights, slice(None), np.concatenate([g.ravel() for g in grads]))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights, self.adam.m, self.adam.v])


def unpack(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """Views of ``flat``, which holds arrays of these shapes end to end."""
    ends = np.cumsum([math.prod(x) for x in shapes])[:-1]
    return [part.reshape(x) for part, x in zip(np.split(flat, ends), shapes)]


def _tower_steps(users: Rows, items: Rows, towers, u: np.ndarray, p: np.ndarray, n: np.ndarray, config: TrainConfig) -> float:
    t, profile, hot = towers
    both = np.concatenate([p, n])
    yu, ku = t.mine.forward(np.hstack([users.vec[u], profile[u]]))
    y, k = t.theirs.forward(np.hstack([items.vec[both], hot[both]]))
    loss, dyu, dyp, dyn = tower_loss(yu, y[: len(p)], y[len(p) :])
    gu, du = t.mine.backward(yu, ku, dyu, config.dim)
    g, d = t.theirs.backward(y, k, np.concatenate([dyp, dyn]), config.dim)
    t.step(gu + g)
    users.step(u, du)
    items.step(both, d)
    return loss


def fresh(kind: int, ids: np.ndarray, config: TrainConfig) -> np.ndarray:
    """The first state of rows: normal vectors of deviation 0.05, all else 0. A row's numbers depend on its id alone."""
    state = np.zeros((len(ids), 3 * (config.dim + 1)))
    start = _mixed(np.array([config.seed], dtype=np.int64).view(np.uint64) * np.uint64(3) + np.uint64(kind)) ^ ids.astype(np.int64).view(np.uint64)
    draws = _mixed(_mixed(start)[:, None] + np.arange(1, 2 * config.dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = np.split(((draws >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53, 2, axis=1)
    state[:, : config.dim] = 0.05 * np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
    return state


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64: 64 bits of which each depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: x: numbers of rows; w: how often each was touched.
_PIECE = "kind string, at long, piece long, ids binary, x binary, w binary"


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [x.split() for x in names.split(", ")]
    # arrays are taken as they lie in memory
    columns = list(zip(*([x.tobytes() if isinstance(x, np.ndarray) else x for x in row] for row in rows))) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _numbers(cell: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype=kind)


def _shelved(kind: str, no: int, config: TrainConfig):
    """Pieces of the first state, and of the features if there are any, of one block's rows (at, id, features)."""

    def run(part: pa.Table) -> pa.Table:
        ids = part["id"].to_numpy()
        order = np.argsort(ids)
        ids, at = ids[order], part["at"][0].as_py()
        given, out = part["features"].combine_chunks(), []
        if config.model == "two-tower":
            if given.null_count:
                raise ValueError(f"{kind} without features")
            given = np.asarray(given.flatten(), dtype=np.float64).reshape(len(ids), -1)[order]
        for lo in range(0, len(ids), SHELF):
            some = ids[lo : lo + SHELF]
            out.append((kind, at, lo // SHELF, some, fresh(no, some, config), np.zeros(len(some), dtype=np.int64)))
            if config.model == "two-tower":
                out.append((f"{kind} features", at, lo // SHELF, some, given[lo : lo + SHELF], None))
        return pa.Table.from_batches([_batch([row], _PIECE) for row in out])

    return run


_ROWS = "kind string, u int, i int, piece long, ids binary, x binary"


def _row_pieces(kind: str):
    """Pieces of the interactions (u, i, id, other) of one unit, in order."""

    def run(part: pa.Table) -> pa.Table:
        users, items = part["id"].to_numpy(), part["other"].to_numpy()
        order = np.lexsort((items, users))
        users, items, u, i = users[order], items[order], part["u"][0].as_py(), part["i"][0].as_py()
        return pa.Table.from_batches([_batch([(kind, u, i, lo // ROWS, users[lo : lo + ROWS], items[lo : lo + ROWS])], _ROWS) for lo in range(0, len(users), ROWS)])

    return run


def _joined(pieces: list[tuple], dim: int) -> np.ndarray:
    return np.concatenate([x.reshape(len(ids), -1) for _, _, ids, x in pieces]) if pieces else np.zeros((0, dim))


def _unit(towers, shapes, config: TrainConfig, step_share: float, done: int, seed: list[int], only_block: bool):
    """Trains one unit on the pieces (u, kind, at, piece, ids, x) of its users, items and interactions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, block = {}, None
        for batch in batches:
            block = batch["u"][0].as_py()
            for kind, at, piece, ids, x in zip(*(batch[c] for c in ("kind", "at", "piece", "ids", "x"))):
                kind = kind.as_py()
                x = _numbers(x, np.int64 if kind in ("row", "known") else np.float64)
                kinds.setdefault(kind, []).append((at.as_py(), piece.as_py(), _numbers(ids, np.int64), x))
        for pieces in kinds.values():
            pieces.sort(key=lambda p: p[:2])
        width = 3 * (config.dim + 1)
        own, stock = [(k, p) for k in ("user", "spread") for p in kinds.get(k, ())], [("item", p) for p in kinds.get("item", ())]
        users, items = (Rows(_joined([p for _, p in x], width), config.dim, done, config.learning_rate) for x in (own, stock))
        who, what = (np.concatenate([np.zeros(0, dtype=np.int64), *(p[2] for _, p in x)]) for x in (own, stock))
        by_id = np.argsort(who)

        def pairs(kind: str) -> tuple[np.ndarray, np.ndarray]:
            u, p = (np.concatenate([np.zeros(0, dtype=np.int64), *(x[n] for x in kinds.get(kind, ()))]) for n in (2, 3))
            if not np.isin(p, what).all():
                raise ValueError("an item is not in the catalogue")
            return by_id[np.searchsorted(who, u, sorter=by_id)], np.searchsorted(what, p)

        u, p = pairs("row")
        if len(u):
            unseen = Unseen(*(np.concatenate(x) for x in zip((u, p), pairs("known"))), len(who), len(what))
            full = unseen.left()[u] < 1
            if full.any() and only_block:
                raise ValueError(f"user {who[u[full][0]]} has seen every item")
            u, p = u[~full], p[~full]
        if len(u):
            extra = None
            if towers is not None:
                profile = _joined([x for k in ("user features", "spread features") for x in kinds.get(k, ())], 0)
                extra = Towers.of(towers.value, shapes, done, config), profile, _joined(kinds["item features"], 0)
            rng = np.random.default_rng([*seed, block])
            step, steps, total = (_mf_steps if towers is None else _tower_steps), max(1, math.ceil(len(u) * step_share)), 0.0
            for _ in range(steps):
                at = rng.integers(0, len(u), config.batch_size)
                total += step(users, items, extra, u[at], p[at], unseen.draw(u[at], rng), config)
            weight = np.array([steps])
            if extra is not None:
                flat = extra[0].flat()
                for lo in range(0, len(flat), PIECE):
                    yield _batch([("tower", 0, lo // PIECE, None, flat[lo : lo + PIECE], weight)], _PIECE)
            yield _batch([("loss", 0, 0, None, np.array([total / steps]), weight)], _PIECE)
        for side, pieces in ((users, own), (items, stock)):
            lo = 0
            for kind, (at, piece, ids, _) in pieces:
                hi = lo + len(ids)
                yield _batch([(kind, at, piece, ids, side.state[lo:hi], side.touched[lo:hi])], _PIECE)
                lo = hi

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of the rows of one piece: one running sum, however many units send it. What none touched stays."""
    row, first, total, weight = None, None, None, None
    for batch in batches:
        for kind, at, piece, ids, x, w in zip(*(batch[c] for c in ("kind", "at", "piece", "ids", "x", "w"))):
            w = _numbers(w, np.int64)
            x = _numbers(x).reshape(len(w), -1)
            if row is None:
                row, first, weight = (kind.as_py(), at.as_py(), piece.as_py(), ids.as_py()), x, w
                continue
            if total is None:
                total = first * weight[:, None]
            total, weight = total + x * w[:, None], weight + w
    if row is not None:
        x = first if total is None else np.where(weight[:, None] > 0, total / np.maximum(weight, 1)[:, None], first)
        yield _batch([(*row, x, weight)], _PIECE)


def _unshelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces as rows (id, x)."""
    for batch in batches:
        for ids, x in zip(batch["ids"], batch["x"]):
            ids, x = _numbers(ids, np.int64), _numbers(x)
            ends = np.arange(len(ids) + 1, dtype=np.int32) * (len(x) // max(len(ids), 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=["id", "x"])


@dataclass
class Model:
    """users: (id, x); items: (id, x), x being vector, bias and moments; towers: their weights; losses: one an epoch."""

    config: TrainConfig
    users: DataFrame
    items: DataFrame
    towers: list[np.ndarray]
    losses: list[float]

    def vectors(self, side: str, features: DataFrame | None = None) -> DataFrame:
        """(id, vec, bias) of the users or items: factors as they are, or what the tower makes of them and ``features`` (id, features)."""
        rows, dim = self.users if side == "users" else self.items, self.config.dim
        rows = rows.select("id", F.slice("x", 1, dim).alias("vec"), F.col("x")[dim].alias("bias"))
        if self.config.model == "mf":
            return rows
        tower = Tower(*self.towers[:4]) if side == "users" else Tower(*self.towers[4:])
        value = rows.sparkSession.sparkContext.broadcast(tower)  # of a fixed size, whatever the data
        return rows.join(features, "id").mapInPandas(_encode(value), "id long, vec array<double>").withColumn("bias", F.lit(None).cast("double"))

    def save(self, path: str) -> None:
        for name in ("users", "items"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}_{name}_state")
        spark = self.items.sparkSession
        rows = [(k, [float(x) for x in w.ravel()], list(w.shape)) for k, w in enumerate(self.towers)]
        spark.createDataFrame(rows, "part int, weights array<double>, shape array<int>").write.mode("overwrite").parquet(f"{path}_parameters")

    @staticmethod
    def load(spark: SparkSession, path: str, config: TrainConfig) -> Model:
        """A saved model, to give vectors to the ids it knows, or, by a tower, to rows of state and features of others."""
        towers = [np.array(r["weights"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}_parameters").orderBy("part").collect()]
        return Model(config, *(spark.read.parquet(f"{path}_{n}_state") for n in ("users", "items")), towers, [])


def train(
    rows: DataFrame,
    items: DataFrame,
    config: TrainConfig,
    profiles: DataFrame | None = None,
    hot: DataFrame | None = None,
    block_rows: int = 2_000_000,
    item_block: int = ITEM_BLOCK,
) -> Model:
    """The model learnt from (user, item) rows over the catalogue ``items`` (item).

    The two-tower model also takes ``profiles`` (user, profile) and ``hot`` (item, hot), arrays as long as there are
    genres. There are as many blocks of users as the settings say, or more where one would hold over
    ``block_rows`` rows; and as many of items as hold ``item_block`` each. A user of more rows than half a block is
    spread over all blocks.
    """
    n = rows.count()
    if not n:
        raise ValueError("no training rows")
    two = config.model == "two-tower"
    if two and (profiles is None or hot is None):
        raise ValueError("the two-tower model needs profiles and genres")
    catalogue = items.select(F.col("item").cast("long").alias("id")).distinct()
    item_blocks = max(1, -(-catalogue.count() // item_block))
    blocks = max(config.blocks, -(-2 * n // block_rows), item_blocks)
    blocks = -(-blocks // item_blocks) * item_blocks

    def in_block(column: str):
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(item_blocks)).cast("int")

    large = rows.groupBy("user").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block_rows // 2).select("user", F.lit(True).alias("spread"))
    data = rows.select("user", "item").join(F.broadcast(large), "user", "left")  # at most 2 n / block_rows rows
    key = F.when(F.col("spread"), F.xxhash64("user", "item")).otherwise(F.xxhash64("user"))
    data = settle(data.select(F.col("user").cast("long").alias("id"), F.col("item").cast("long").alias("other"), "spread", in_block("item").alias("i"), F.pmod(key, F.lit(blocks)).cast("int").alias("u")))
    spot = settle(data.groupBy("u", "i").applyInArrow(_row_pieces("row"), _ROWS))
    # of a spread user each unit also knows the items it has elsewhere: at most an item block
    known = data.where("spread").select(F.lit(0).alias("u"), "i", "id", "other").distinct()
    known = settle(known.groupBy("u", "i").applyInArrow(_row_pieces("known"), _ROWS))
    nothing = F.lit(None).cast("array<double>")
    homes = data.select(F.when(F.col("spread"), F.lit(0)).otherwise(F.col("u")).cast("long").alias("at"), "id", F.coalesce("spread", F.lit(False)).alias("spread")).distinct()
    mine = profiles.select(F.col("user").cast("long").alias("id"), F.col("profile").alias("features")) if two else None
    theirs = hot.select(F.col("item").cast("long").alias("id"), F.col("hot").cast("array<double>").alias("features")) if two else None
    towers, shapes = [], []
    if two:
        genres = len(hot.first()["hot"])
        rng = np.random.default_rng([config.seed, 0])
        towers = [x for _ in range(2) for x in Tower.new(config.dim + genres, config.hidden, config.dim, rng).parts()]
        shapes = [x.shape for x in towers]
    flat = np.concatenate([x.ravel() for x in towers] + [np.zeros(2 * sum(x.size for x in towers))]) if two else None
    homes, catalogue = (x.join(f, "id", "left") if f is not None else x.withColumn("features", nothing) for x, f in ((homes, mine), (catalogue.withColumn("at", in_block("id").cast("long")), theirs)))
    state = None
    for kind, no, x in (("user", 1, homes.where("NOT spread")), ("spread", 1, homes.where("spread")), ("item", 2, catalogue)):
        part = x.select("at", "id", "features").groupBy("at").applyInArrow(_shelved(kind, no, config), _PIECE)
        state = part if state is None else state.unionByName(part)
    state = settle(state)
    features = state.where(F.col("kind").endswith("features"))  # the same in all strata
    state = state.where(~F.col("kind").endswith("features"))
    steps = config.steps_per_epoch or math.ceil(n / config.batch_size)
    share, done, losses = steps / n, 0, []
    names = ["u", "kind", "at", "piece", "ids", "x"]
    for epoch in range(config.epochs):
        sums = np.zeros(2)
        for stratum in range(item_blocks):
            meets = F.pmod(F.col("u") + stratum, F.lit(item_blocks))

            def to_units(pieces: DataFrame, at) -> DataFrame:
                """Pieces of a block of items to the blocks of users it meets, those of all (``at`` is null) to every one."""
                targets = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: at.isNull() | (F.pmod(b + stratum, F.lit(item_blocks)) == at))
                return pieces.withColumn("u", F.explode(targets)).select(names)

            rows_of = lambda x: x.withColumn("at", F.lit(0).cast("long"))
            unit = rows_of(spot.where(F.col("i") == meets)).select(names).unionByName(to_units(rows_of(known), F.col("i")))
            for pieces in (state, features) if two else (state,):
                unit = unit.unionByName(pieces.where(F.col("kind").startswith("user")).withColumn("u", F.col("at").cast("int")).select(names))
                unit = unit.unionByName(to_units(pieces.where(~F.col("kind").startswith("user")), F.when(F.col("kind").startswith("item"), F.col("at"))))
            value = rows.sparkSession.sparkContext.broadcast(flat) if two else None
            work = _unit(value, shapes, config, share, done, [config.seed, epoch, stratum], item_blocks == 1)
            merged = settle(unit.groupBy("u").applyInArrow(work, _PIECE).groupBy("kind", "at", "piece").applyInArrow(_merged, _PIECE))
            found = merged.where("kind IN ('loss', 'tower')").orderBy("kind", "piece").collect()  # of a fixed size
            for r in found[:1]:
                weight = np.frombuffer(r["w"], dtype=np.int64)[0]
                sums += np.array([np.frombuffer(r["x"])[0] * weight, weight])
            if two and found:
                flat = np.concatenate([np.frombuffer(r["x"]) for r in found[1:]])
            done += max(1, math.ceil(steps / blocks / item_blocks))
            state = merged.where("kind IN ('user', 'spread', 'item')")
            tidy(rows.sparkSession)
        losses.append(float(sums[0] / max(sums[1], 1)))
    users, things = (state.where(x).select("ids", "x").mapInArrow(_unshelved, "id long, x array<double>") for x in ("kind IN ('user', 'spread')", "kind = 'item'"))
    return Model(config, users, things, unpack(np.split(flat, 3)[0], shapes) if two else [], losses)


def _encode(tower):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.hstack([np.stack(batch["vec"]), np.stack(batch["features"])])
                yield pd.DataFrame({"id": batch["id"], "vec": list(tower.value.forward(x)[0])})

    return run


def draw_negatives(rows: DataFrame, items: DataFrame, seed: int, blocks: int = 8) -> DataFrame:
    """(user, item, negative): each (user, item) row with an item drawn evenly from those the user does not have.

    Blocks of users draw at the same time, each from its own stream of the seed. ``items`` (item) go to every
    block: a catalogue beyond ITEM_BLOCK is cut as in training, and users draw from the block of items that a hash of the row names.
    """
    item_blocks = max(1, -(-items.select("item").distinct().count() // ITEM_BLOCK))
    place = [F.pmod(F.xxhash64("user"), F.lit(blocks)).cast("int").alias("u"), F.pmod(F.xxhash64(F.col("item").cast("long")), F.lit(item_blocks)).cast("int").alias("i")]
    asked = F.pmod(F.xxhash64("user", "item", F.lit(seed)), F.lit(item_blocks)).cast("int")
    have = rows.select(*place, F.lit("seen").alias("kind"), F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"))
    want = rows.select(place[0], asked.alias("i"), F.lit("row").alias("kind"), F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"))
    stock = items.select("item").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("u"), place[1], F.lit("item").alias("kind"), F.lit(None).cast("long").alias("user"), F.col("item").cast("long").alias("item"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kinds = {k: v for k, v in part.groupby("kind")}
        if "row" not in kinds or "item" not in kinds:
            return pd.DataFrame({"user": [], "item": [], "negative": []})
        row, what = kinds["row"].sort_values(["user", "item"], kind="stable"), np.sort(kinds["item"]["item"].to_numpy())
        seen = kinds.get("seen", row.iloc[:0])
        who = np.unique(np.concatenate([row["user"], seen["user"]]).astype(np.int64))
        unseen = Unseen(np.searchsorted(who, seen["user"].to_numpy()), np.searchsorted(what, seen["item"].to_numpy()), len(who), len(what))
        users = np.searchsorted(who, row["user"].to_numpy())
        if (unseen.left()[users] < 1).any():
            raise ValueError("a user has seen every item")
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, int(part["u"].iloc[0]), int(part["i"].iloc[0])])))
        return pd.DataFrame({"user": row["user"].to_numpy(), "item": row["item"].to_numpy(), "negative": what[unseen.draw(users, rng)]})

    return have.unionByName(want).unionByName(stock).groupBy("u", "i").applyInPandas(run, "user long, item long, negative long")
