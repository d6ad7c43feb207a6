"""

Loading is counted, as it is in the queries. Nothing of the library is used.
"""

import sys
import time

import duckdb
import numpy as np

TX = "SELECT o_custkey::INT AS u, l_partkey::INT AS i, epoch(l_shipdate)::BIGINT AS ts, l_orderkey, l_linenumber, l_extendedprice FROM '{0}/lineitem.parquet' JOIN '{0}/orders.parquet' ON l_orderkey = o_orderkey"
EV = "SELECT user_id::INT AS u, (props->>'$.k')::INT AS i, ts, event_id AS seq FROM '{0}/events.parquet' ORDER BY u, ts, seq"


def load(sql: str, d: str) -> dict[str, np.ndarray]:
    return duckdb.sql(sql.format(d)).fetchnumpy()


def core(u: np.ndarray, i: np.ndarray, least: int) -> np.ndarray:
    at = np.arange(len(u))
    while True:
        keep = (np.bincount(u[at])[u[at]] >= least) & (np.bincount(i[at])[i[at]] >= least)
        if keep.all():
            return at
        at = at[keep]


def kcore_20_tx(d):
    rows = load(TX, d)
    at = core(rows["u"], rows["i"], 20)
    return len(np.unique(rows["u"][at]))


def split(d):
    rows = load(EV, d)
    at = core(rows["u"], rows["i"], 5)
    u, i = rows["u"][at], rows["i"][at]
    users, first, n = np.unique(u, return_index=True, return_counts=True)
    pos = np.arange(len(u)) - np.repeat(first, n)
    train, val = n * 8 // 10, n // 10
    test = n - train - val
    train = train - ((val == 0) & (test <= 1))
    part = np.where(pos < np.repeat(train, n), 0, np.where(pos < np.repeat(train + np.maximum(val, 1), n), 1, 2))
    return users, np.repeat(np.arange(len(users)), n), i, part


def chrono_split(d):
    return len(split(d)[3])


def vectors(d, items):
    rows = load("SELECT vec_id, embedding FROM '{0}/embeddings.parquet' ORDER BY vec_id", d)
    v = np.stack(rows["embedding"]).astype(np.float64)
    return v if items is None else v[items]


def lists(d, k=20):
    users, u, i, part = split(d)
    items, local = np.unique(i, return_inverse=True)
    v, train = vectors(d, items), part == 0
    means = np.zeros((len(users), v.shape[1]))
    np.add.at(means, u[train], v[local[train]])
    means /= np.bincount(u[train], minlength=len(users))[:, None]
    scores = np.round(means @ v.T, 6)
    scores[u[train], local[train]] = -np.inf
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return users, items, means, v, u, local, part, order


def retrieve_topk(d):
    return lists(d)[-1].size


def ranking_metrics(d, n=20):
    users, items, means, v, u, local, part, _ = lists(d)
    seen = np.zeros((len(users), len(items)), dtype=bool)
    seen[u, local] = True
    rng, found = np.random.default_rng(1), []
    for p in (1, 2):
        last = np.zeros(len(users), dtype=int)
        at = np.flatnonzero(part == p)
        last[u[at]] = local[at]
        for who in range(len(users)):
            negative = rng.choice(np.flatnonzero(~seen[who]), n, replace=False)
            s = v[np.append(last[who], negative)] @ means[who]
            found.append(1 + (s[1:] >= s[0]).sum())
    return float(np.mean(np.array(found) <= 10))


def item_neighbors(d, k=200):
    v = vectors(d, None)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.round(v @ v.T, 6)
    np.fill_diagonal(scores, -np.inf)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k].size


for name in ("kcore_20_tx", "chrono_split", "ranking_metrics", "retrieve_topk", "item_neighbors"):
    began = time.perf_counter()
    globals()[name](sys.argv[1])
    print(f"{name}: {time.perf_counter() - began:.3f} s", flush=True)
