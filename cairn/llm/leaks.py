"""Evaluation passages inside training texts: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of words: runs of letters and digits, in lower case. Every item is cut into all
its windows of ``window_words`` words, every document likewise. The CGK embedding turns a window into a string of
three times its length by a random walk: at each step the current word is written, and a random bit that
depends on the step and the word says whether to move on. Two windows that differ by few edits fall back into
step, and differ in few places of their embeddings. Bit sampling then compares a few places, as one key; the
walk is repeated with other bits until windows within ``max_edits`` word edits share a key with probability
``recall``. Windows that are equal share every key. Every window that shares a key is verified by edit distance.

Only windows that may match take part in the walks: of windows within e edits, one of the e + 1 parts of one is unchanged in
the other, so a window that holds none of the items' runs of so many words is passed over, by a bitmap of fixed size. This
leaves out no match. The walk is taken for all windows of a batch at once, in arrays. While the items' keys under all
walks fit ``broadcast_bytes``, they are broadcast, and no window of a document leaves its task; else windows are joined by
their keys as hashes, each distinct window once, and their texts and documents follow only where a key is shared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.skewed import heavy_hashes
from cairn.session import settle

WORD = re.compile(r"[^\W_]+")
#: Bytes of item windows that are broadcast at most: 16 for each walk and 150 for its words.
BROADCAST_BYTES = 64 << 20
_KEY_BYTES, _WINDOW_BYTES = 16, 150
#: Bits of a place in a bitmap of what items hold: 4 MB in every worker, 16 MB for the joined way.
_MAP_BITS, _WIDE_BITS = 25, 27
_MIX = np.uint64(0x9FB21C651E98DF25)


class Hashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Walk:
    """One CGK embedding of windows of ``size`` words, with the places that are sampled of it."""

    size: int
    places: tuple[int, ...]
    seed: int

    def keys(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A key for each window hashes[start : start + size]. A word's bits are those of its mixed hash."""
        mixed = (hashes ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed = np.append(mixed * np.uint64(0xD6E8FEB86659FD93), np.uint64(0))
        at, end = starts.astype(np.int64), starts + self.size
        key = np.full(len(starts), self.seed, dtype=np.uint64)
        sampled, last = set(self.places), max(self.places)
        for step in range(last + 1):
            ended = at >= end
            word = mixed[at]
            if step in sampled:
                key = (key ^ np.where(ended, np.uint64(0x5BD1E995), word)) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(29)
            at = at + (((word >> np.uint64(step % 61)) & np.uint64(1)).astype(np.int64) & ~ended)
        return key


def edits(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or ``most`` + 1 if it is larger; cells far from the diagonal are not filled."""
    if a == b:
        return 0
    if most == 0 or abs(len(a) - len(b)) > most:
        return most + 1
    row = [j if j <= most else most + 1 for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = min(i, most + 1)
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def edits_of_many(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """``edits`` of each row of ``a`` with the same row of ``b``, both of word hashes: one cell of all tables at a time."""
    n, size = a.shape
    row = [np.full(n, min(j, most + 1), dtype=np.int16) for j in range(size + 1)]
    far = np.full(n, most + 1, dtype=np.int16)
    for i in range(1, size + 1):
        new = [far] * (size + 1)
        new[0] = np.full(n, min(i, most + 1), dtype=np.int16)
        for j in range(max(1, i - most), min(size, i + most) + 1):
            best = np.minimum(row[j - 1] + (a[:, i - 1] != b[:, j - 1]), np.minimum(row[j], new[j - 1]) + 1)
            new[j] = np.minimum(best, most + 1).astype(np.int16)
        row = new
    return row[size]


def plan(size: int, max_edits: int, recall: float, trials: int = 4000, seed: int = 7) -> list[Walk]:
    """The walks needed to find windows within ``max_edits`` with probability ``recall``, by simulation.

    Windows with exactly ``max_edits`` random edits stand for the hardest case. Without edits one walk does.
    Places are drawn from the first 2 * size steps: by then half of all walks have come to the window's end,
    and what is written after the end is the same for all. The more edits, the fewer places are compared.
    """
    rng = np.random.default_rng(seed)
    places, sample = 2 * size, max(4, size // (1 + max_edits))

    def walk(no: int) -> Walk:
        return Walk(size, tuple(sorted(rng.choice(places, size=min(sample, places), replace=False).tolist())), seed + no)

    if max_edits == 0:
        return [walk(1)]
    base = rng.integers(0, 2**63, size=(trials, size + max_edits), dtype=np.uint64)
    changed = [list(x) for x in base]
    for row in changed:
        for kind, at in zip(rng.integers(0, 3, max_edits), rng.integers(0, size, max_edits)):
            if kind == 0:
                row[at] = np.uint64(rng.integers(2**62))
            elif kind == 1:
                row.insert(at, np.uint64(rng.integers(2**62)))
            else:
                del row[at]
    starts = np.arange(trials) * size
    a = base[:, :size].ravel()
    b = np.array([(x + [np.uint64(1)] * size)[:size] for x in changed], dtype=np.uint64).ravel()
    walks, missed = [], np.ones(trials, dtype=bool)
    while missed.mean() > 1 - recall:
        w = walk(len(walks) + 1)
        missed &= w.keys(a, starts) != w.keys(b, starts)
        walks.append(w)
        if len(walks) >= 256:
            raise ValueError("this recall can't be reached with so many edits in so short a window")
    return walks


def run_length(size: int, max_edits: int) -> int:
    """Words in a row that windows of ``size`` within ``max_edits`` surely have in common."""
    return size // (max_edits + 1)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` words."""
    found = np.zeros(max(len(hashes) - length + 1, 0), dtype=np.uint64)
    for k in range(length):
        found = (found + hashes[k : k + len(found)]) * _MIX
        found ^= found >> np.uint64(31)
    return found


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * _MIX) >> np.uint64(64 - bits)


def _held(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _mark(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))


def promising(hashes: np.ndarray, where: np.ndarray, size: int, length: int, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Which windows, by their starts in the text, hold a run that the bitmap has."""
    if not len(where):
        return np.zeros(0, dtype=bool)
    hit = np.concatenate([[0], np.cumsum(_held(bitmap, _places(runs(hashes, length), bits)))])
    return hit[where + size - length + 1] > hit[where]


@dataclass
class Index:
    """The windows of the items, by their keys under each walk."""

    walks: list[Walk]
    ids: list
    texts: list[list[str]]
    max_edits: int

    @cached_property
    def flat(self) -> np.ndarray:
        """The hashes of all items' words, end to end."""
        return Hashes(0).of([w for t in self.texts for w in t])

    @cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The item and the start in ``flat`` of each window."""
        item, _, where = _windows(np.array([len(t) for t in self.texts], dtype=np.int64), self.walks[0].size)
        return item.astype(np.int32), where.astype(np.int32)

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each walk: keys in order, and the window of each."""
        built = []
        for walk in self.walks:
            keys = walk.keys(self.flat, self.windows[1])
            order = np.argsort(keys, kind="stable").astype(np.int32)
            built.append((keys[order], order))
        return built

    @cached_property
    def bitmap(self) -> np.ndarray:
        """The runs that windows of items hold. A run from one item into the next does no harm."""
        found = np.zeros(1 << _MAP_BITS - 3, dtype=np.uint8)
        _mark(found, _places(runs(self.flat, run_length(self.walks[0].size, self.max_edits)), _MAP_BITS))
        return found

    def matches(self, sizes: np.ndarray, flat: np.ndarray, tokens: list[str]) -> set[tuple[int, int, int]]:
        """(document, item, edits) for each verified pair of windows, for documents laid end to end."""
        size = self.walks[0].size
        doc, _, where = _windows(sizes, size)
        near = promising(flat, where, size, run_length(size, self.max_edits), self.bitmap, _MAP_BITS)
        doc, where = doc[near], where[near]
        item, start = self.windows
        if not len(where) or not len(item):
            return set()
        pairs = []
        for walk, (keys, window) in zip(self.walks, self.tables):
            mine = walk.keys(flat, where)
            lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            count = hi - lo
            mine = np.repeat(np.arange(len(where)), count)
            theirs = window[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
            pairs.append(mine * len(item) + theirs)
        pairs = np.unique(np.concatenate(pairs))
        span, found = np.arange(size), {}
        for lo in range(0, len(pairs), 100_000):
            mine, theirs = np.divmod(pairs[lo : lo + 100_000], len(item))
            d = edits_of_many(flat[where[mine][:, None] + span], self.flat[start[theirs][:, None] + span], self.max_edits)
            good = np.flatnonzero(d <= self.max_edits)
            for k in good[np.argsort(d[good], kind="stable")]:
                pair = int(doc[mine[k]]), int(item[theirs[k]])
                if pair not in found or d[k] < found[pair][0]:
                    found[pair] = int(d[k]), int(where[mine[k]]), int(start[theirs[k]])
        # word for word, beyond their hashes
        words_of = [w for t in self.texts for w in t] if found else []
        sure = {(*pair, edits(tokens[w : w + size], words_of[v : v + size], self.max_edits)) for pair, (_, w, v) in found.items()}
        return {x for x in sure if x[2] <= self.max_edits}


def _windows(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, start within it, and start in all, of every window of ``size`` over sequences laid end to end."""
    counts = np.maximum(sizes - size + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, start, np.repeat(np.cumsum(sizes) - sizes, counts) + start


def _scan(index, most_words: int = 400_000):
    """The text is cut into stretches that overlap by a window less one word, so that memory stays bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, hashes = index.value, Hashes(0)
        size = table.walks[0].size

        def emit(ids, sizes, tokens):
            hits = table.matches(np.array(sizes, dtype=np.int64), hashes.of(tokens), tokens)
            return pd.DataFrame([(ids[d], table.ids[i], e) for d, i, e in hits], columns=["doc", "item", "edits"])

        ids, sizes, tokens = [], [], []
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"]):
                found = words(text)
                for lo in range(0, max(1, len(found) - size + 1), most_words):
                    part = found[lo : lo + most_words + size - 1]
                    ids.append(doc)
                    sizes.append(len(part))
                    tokens += part
                    if len(tokens) >= most_words:
                        yield emit(ids, sizes, tokens)
                        ids, sizes, tokens = [], [], []
        if ids:
            yield emit(ids, sizes, tokens)

    return run


def _marks(walks: list[Walk], length: int):
    """Each partition's bitmaps of the items' runs (kind 0) and of their keys (1), in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps, hashes, size = [np.zeros(1 << _WIDE_BITS - 3, dtype=np.uint8) for _ in range(2)], Hashes(0), walks[0].size
        for batch in batches:
            for text in batch["text"]:
                flat = hashes.of(words(text))
                where = _windows(np.array([len(flat)], dtype=np.int64), size)[2]
                if len(where):
                    _mark(maps[0], _places(runs(flat, length), _WIDE_BITS))
                    for walk in walks:
                        _mark(maps[1], _places(walk.keys(flat, where), _WIDE_BITS))
        for kind, held in enumerate(maps):
            for at, piece in enumerate(np.split(held, 64)):
                yield pd.DataFrame({"kind": [kind], "at": [at], "piece": [piece.tobytes()]})

    return run


def _either(parts: pd.DataFrame) -> pd.DataFrame:
    whole = np.frombuffer(parts["piece"].iloc[0], dtype=np.uint8).copy()
    for piece in parts["piece"].iloc[1:]:
        whole |= np.frombuffer(piece, dtype=np.uint8)
    return pd.DataFrame({"kind": parts["kind"].iloc[:1], "at": parts["at"].iloc[:1], "piece": [whole.tobytes()]})


def _bitmaps(items: DataFrame, walks: list[Walk], length: int, parts: int = 16) -> list[np.ndarray]:
    """Both bitmaps, of 16 MB each whatever the items: made by ``parts`` tasks and united piece by piece."""
    rows = items.repartition(parts).mapInPandas(_marks(walks, length), "kind int, at int, piece binary")
    rows = rows.groupBy("kind", "at").applyInPandas(_either, "kind int, at int, piece binary").orderBy("kind", "at").collect()
    return [np.frombuffer(b"".join(r["piece"] for r in rows if r["kind"] == k), dtype=np.uint8) for k in (0, 1)]


def _keys(walks: list[Walk], kind: str, length: int, bitmaps, most_words: int = 100_000):
    """(key, window, id, text) of each window that may match under any walk: its key, its own hash, whose it is, and its words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, size = Hashes(0), walks[0].size
        maps = bitmaps.value
        for batch in batches:
            for who, text in zip(batch[kind], batch["text"]):
                tokens = words(text)
                for lo in range(0, max(1, len(tokens) - size + 1), most_words):
                    part = tokens[lo : lo + most_words + size - 1]
                    flat = hashes.of(part)
                    where = _windows(np.array([len(part)], dtype=np.int64), size)[2]
                    where = where[promising(flat, where, size, length, maps[0], _WIDE_BITS)]
                    if not len(where):
                        continue
                    own, texts = runs(flat, size).view(np.int64), {}
                    for walk in walks:
                        key = walk.keys(flat, where)
                        at = np.flatnonzero(_held(maps[1], _places(key, _WIDE_BITS)))
                        if len(at):
                            spots = where[at]
                            for w in spots:
                                if w not in texts:
                                    texts[w] = " ".join(part[w : w + size])
                            yield pd.DataFrame({"key": key[at].view(np.int64), "window": own[spots], "id": [who] * len(at), "text": [texts[w] for w in spots]})

    return run


def _verify(max_edits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = [edits(a.split(" "), b.split(" "), max_edits) for a, b in zip(batch["text1"], batch["text2"])]
            out = batch[["window1", "window2"]].assign(edits=d)
            yield out[out["edits"] <= max_edits]

    return run


def _joined(docs: DataFrame, items: DataFrame, walks: list[Walk], max_edits: int, salts: int = 16) -> DataFrame:
    """(doc, item, edits) by joins. Keys meet as hashes of distinct windows; a window's words are joined once, its documents last.

    A window that is in a large share of all documents is spread over ``salts`` there.
    """
    length, sides = run_length(walks[0].size, max_edits), {}
    bitmaps = docs.sparkSession.sparkContext.broadcast(_bitmaps(items, walks, length))
    for side, df in (("doc", docs), ("item", items)):
        kind = df.schema[side].dataType.simpleString()
        rows = df.mapInPandas(_keys(walks, side, length, bitmaps), f"key long, window long, id {kind}, text string")
        sides[side] = settle(rows.select("window", F.col("id").alias(side), "key", "text"))
    shared = sides["doc"].select("key", F.col("window").alias("window1")).distinct().join(sides["item"].select("key", F.col("window").alias("window2")).distinct(), "key")
    shared = shared.select("window1", "window2").distinct()
    for side, n in (("doc", 1), ("item", 2)):
        texts = sides[side].groupBy(F.col("window").alias(f"window{n}")).agg(F.min("text").alias(f"text{n}"))
        shared = shared.join(texts, f"window{n}")
    same = settle(shared.mapInPandas(_verify(max_edits), "window1 long, window2 long, edits int"))
    holders = sides["doc"].select(F.col("window").alias("window1"), "doc").distinct()
    heavy = heavy_hashes(holders, F.col("window1"), 0.005)
    hot = F.col("window1").isin(heavy) if heavy else F.lit(False)
    holders = holders.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("doc"), F.lit(salts))).otherwise(F.lit(0).cast("long")))
    same = same.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(hot, F.lit(salts - 1)).otherwise(F.lit(0)).cast("long"))))
    found = same.join(sides["item"].select(F.col("window").alias("window2"), "item").distinct(), "window2").groupBy("window1", "salt", "item").agg(F.min("edits").alias("edits"))
    return holders.join(found, ["window1", "salt"]).select("doc", "item", "edits")


def find_leaks(
    docs: DataFrame,
    doc_id: str,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    window_words: int = 13,
    max_edits: int = 0,
    recall: float = 0.99,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, item_id, edits): documents that hold a window of an item, and the fewest edits of any such window.

    With ``max_edits`` 0 the window must be the same, word for word, and every one is found. Null texts and
    texts of fewer than ``window_words`` words hold nothing; so do such items. Whole texts are searched, of
    any length. Repeated rows of a document or item give one row for each pair of ids; null ids are left
    out. Empty tables give no rows. Other columns of both tables are ignored.
    """
    if window_words < 2 or max_edits < 0 or max_edits >= window_words:
        raise ValueError("window_words must be at least 2 and above max_edits")
    walks = plan(window_words, max_edits, recall)
    have = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    wanted = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    kinds = f"doc {have.schema['doc'].dataType.simpleString()}, item {wanted.schema['item'].dataType.simpleString()}, edits int"
    # a word and the gap after it are two characters at least
    bound = (wanted.agg(F.sum(F.length("text"))).first()[0] or 0) // 2
    if bound * (len(walks) * _KEY_BYTES + _WINDOW_BYTES) <= broadcast_bytes:
        rows = wanted.distinct().collect()
        index = docs.sparkSession.sparkContext.broadcast(Index(walks, [r["item"] for r in rows], [words(r["text"]) for r in rows], max_edits))
        found = have.mapInPandas(_scan(index), kinds)
    else:
        found = _joined(have, wanted, walks, max_edits)
    found = found.groupBy("doc", "item").agg(F.min("edits").alias("edits"))
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "edits")


def leaked_shares(leaks: DataFrame, items: DataFrame, item_id: str) -> DataFrame:
    """(item_id, n_docs): for every item, in how many documents it was found; 0 for clean items."""
    counts = leaks.groupBy(item_id).agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select(item_id).distinct().join(counts, item_id, "left").select(item_id, F.coalesce("n_docs", F.lit(0)).alias("n_docs"))

