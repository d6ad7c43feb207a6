"""Several values packed in one field: segmentation learnt by expectation-maximisation, Viterbi to split.

A field is cut into atoms at every run of delimiter characters outside quotes. Each atom, and each run of unquoted
neighbours with the text between them, is a possible value. Every kind of delimiter ("/" and " / " are two kinds)
separates values with a probability of its own, or else belongs to one. A field's probability under one way of cutting
it is the product of its values' frequencies and of its delimiters' probabilities. Expectation-maximisation learns all of
these from the whole column, so that a delimiter inside a value ("A/B", where A and B never stand alone) is told from one
between values. Copies of a field say nothing new about where it is cut: each distinct field counts once. A quoted span
between delimiters is one value, whatever it holds; quotes are undoubled.

The column decides what is a delimiter and how many atoms a value may have. A character that is neither letter, digit,
blank, bracket nor quote is a delimiter if what stands on both sides of it also stands beside other things, for one
kind of it mostly. A run of atoms can only be a value if it is in more distinct fields than it has atoms; where no run of
m atoms is, no longer one is either.

A field travels as its text and one record an atom; a run is known by a hash that follows from the atoms' hashes, so that
no text is copied for it. Values' frequencies are broadcast while they are few, else joined by hash; either way the
lattices of a batch are worked through at once, as arrays. A long run that many fields share makes lattices as large as
its length squared.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.skewed import heavy_hashes
from cairn.session import settle

#: Always tried as delimiters; others have to be found in the column.
DELIMITERS = "|,;/\t"
#: What a delimiter is not: letters, marks, digits, blanks, brackets, quotes, underscores.
_NEVER = r"[\p{L}\p{M}\p{N}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Pc}\p{Zs}\"'`´]"
#: Bounds of a delimiter's probability to separate; a value never met counts as this share of one occurrence.
SURE, NEVER_MET = 1e-3, 1e-6
#: Values whose frequencies are broadcast at most, of 16 bytes each.
BROADCAST_VALUES = 1_000_000
#: Spans worked through at once.
SPANS = 2_000_000
ATOM = np.dtype([("start", "<i4"), ("end", "<i4"), ("kind", "<u2"), ("quoted", "?"), ("hash", "<u8"), ("gap", "<u8")])
BASE = np.uint64(0x9E3779B97F4A7C15)


class Cutter:
    """Cuts fields into atoms, and numbers the kinds of delimiters."""

    def __init__(self, delimiters: str):
        self.delimiters = delimiters
        cut = re.escape(delimiters)
        self.stop = re.compile(f"[{cut}]")
        self.plain = re.compile(rf"[^\s{cut}](?:[^{cut}]*[^\s{cut}])?")
        self.closing = {q: re.compile(rf"(?<!^){q}(?=[^\S{cut}]*(?:[{cut}]|$))") for q in "\"'"}
        self.kinds = ["", *(s + c for c in delimiters for s in ("", " "))]
        self.number = {k: i for i, k in enumerate(self.kinds)}

    def kind(self, gap: str) -> str:
        """The first delimiter of a gap, with a blank in front if blanks stand on both sides of the gap."""
        marks = next((c for c in gap if c in self.delimiters), "")
        spaced = gap[:1].isspace() and gap[-1:].isspace() and gap[:1] not in self.delimiters
        return (" " if spaced and marks else "") + marks

    def atoms(self, field: str) -> list[tuple[int, int, str | None, str]]:
        """(start, end, quoted value or None, kind of what follows) of each non-empty atom.

        A quote opens at the start of an atom and closes where it is followed by blanks and a delimiter or the
        field's end; one that never closes is an ordinary character.
        """
        if '"' not in field and "'" not in field:
            spans = [m.span() for m in self.plain.finditer(field)]
            ends = [a for a, _ in spans[1:]] + [len(field)]
            return [(a, b, None, self.kind(field[b:c])) for (a, b), c in zip(spans, ends)]
        found, at, size = [], 0, len(field)
        while at < size:
            while at < size and field[at].isspace() and field[at] not in self.delimiters:
                at += 1
            if at >= size:
                break
            start, quoted, end = at, None, None
            if field[at] in self.closing:
                q, scan = field[at], at + 1
                while (m := self.closing[q].search(field, scan)) is not None:
                    run = m.start() - len(field[at + 1 : m.start()].rstrip(q)) - at - 1  # quotes just before this one
                    if run % 2 == 0:
                        quoted, end = field[at + 1 : m.start()].replace(q * 2, q).strip(), m.end()
                        break
                    scan = m.end()
            if end is None:
                m = self.stop.search(field, at)
                end = m.start() if m else size
            stop = end
            while stop < size and (field[stop] in self.delimiters or field[stop].isspace()):
                stop += 1
            text = field[start:end].rstrip()
            if quoted is not None and quoted or quoted is None and text:
                found.append((start, start + len(text), quoted, self.kind(field[end:stop])))
            at = max(stop, at + 1)
        return found


def atoms(field: str, delimiters: str = DELIMITERS) -> list[tuple[int, int, str | None, str]]:
    return Cutter(delimiters).atoms(field)


class Hashes(dict):
    """64-bit hashes of short texts; forgets all when it holds too many."""

    def __missing__(self, text: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[text] = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
        return h


def _chain(tokens: list[int]) -> int:
    """The hash of a run: its atoms' hashes and the gaps' between them as digits of a number modulo 2^64."""
    total = 0
    for t in tokens:
        total = (total * int(BASE) + t) & (2**64 - 1)
    return total


def _parse(delimiters: str):
    """Each field's atoms as one binary record each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, hashes = Cutter(delimiters), Hashes()
        for batch in batches:
            lines = []
            for field in batch["field"]:
                found = cutter.atoms(field)
                line = np.zeros(len(found), dtype=ATOM)
                for n, (start, end, quoted, kind) in enumerate(found):
                    after = found[n + 1][0] if n + 1 < len(found) else end
                    if quoted is None:
                        h = hashes[field[start:end]]
                    else:  # the same hash as that of equal text without quotes
                        parts = [m.span() for m in cutter.plain.finditer(quoted)]
                        tokens = [hashes[quoted[a:b]] for a, b in parts]
                        gaps = [hashes[quoted[b:c]] for (_, b), (c, _) in itertools.pairwise(parts)]
                        whole = parts and parts[0][0] == 0 and parts[-1][1] == len(quoted)
                        h = _chain([t for pair in itertools.zip_longest(tokens, gaps) for t in pair if t is not None]) if whole else hashes[quoted]
                    line[n] = start, end, cutter.number[kind], quoted is not None, h, hashes[field[end:after]]
                lines.append(line.tobytes())
            yield batch.assign(atoms=lines)

    return run


class Lattices:
    """All ways to cut the fields of a batch that have the same number of atoms: spans by end, then by start."""

    def __init__(self, lines: np.ndarray, longest: int):
        n, size = lines.shape
        self.lines, self.size = lines, size
        self.ends = np.repeat(np.arange(1, size + 1), np.minimum(np.arange(1, size + 1), longest))
        first = np.maximum(np.arange(1, size + 1) - longest, 0)
        self.starts = np.concatenate([np.arange(first[j - 1], j) for j in range(1, size + 1)])
        self.cuts = np.searchsorted(self.ends, np.arange(1, size + 2))
        before, after = np.zeros((n, size), dtype=np.uint64), np.zeros((n, size), dtype=np.uint64)
        run = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            before[:, k] = run
            after[:, k] = run * BASE + lines["hash"][:, k]
            run = after[:, k] * BASE + lines["gap"][:, k]
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * min(longest, size), BASE, dtype=np.uint64))])
        length = self.ends - self.starts
        self.values = after[:, self.ends - 1] - before[:, self.starts] * power[2 * length - 1]
        self.joined = length > 1
        quoted = np.concatenate([np.zeros((n, 1), dtype=np.int64), np.cumsum(lines["quoted"], axis=1)], axis=1)
        self.valid = ~self.joined[None, :] | (quoted[:, self.ends] == quoted[:, self.starts])

    def weights(self, logs: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The logarithm of each span's factor; ``logs`` are those of the values, ``cuts`` of the kinds to separate."""
        kinds = self.lines["kind"]
        inside = np.concatenate([np.zeros((len(kinds), 1)), np.cumsum(np.log1p(-cuts)[kinds], axis=1)], axis=1)
        after = np.log(cuts)[kinds]
        after[:, -1] = 0.0
        return np.where(self.valid, logs, -np.inf) + inside[:, self.ends - 1] - inside[:, self.starts] + after[:, self.ends - 1]

    def expected(self, w: np.ndarray) -> np.ndarray:
        """Each span's expected number, by the forward and backward sums."""
        forward, backward = (np.full((len(w), self.size + 1), -np.inf) for _ in range(2))
        forward[:, 0] = backward[:, -1] = 0.0
        for j in range(1, self.size + 1):
            at = slice(self.cuts[j - 1], self.cuts[j])
            forward[:, j] = np.logaddexp.reduce(forward[:, self.starts[at]] + w[:, at], axis=1)
        for j in range(self.size, 0, -1):
            at = slice(self.cuts[j - 1], self.cuts[j])
            i = self.starts[at]
            backward[:, i] = np.logaddexp(backward[:, i], w[:, at] + backward[:, [j]])
        return np.exp(forward[:, self.starts] + w + backward[:, self.ends] - forward[:, [-1]])

    def best(self, w: np.ndarray) -> np.ndarray:
        """Where the most likely way cuts: a flag for each atom at which a value starts."""
        score = np.full((len(w), self.size + 1), -np.inf)
        score[:, 0], origin = 0.0, np.zeros((len(w), self.size + 1), dtype=np.int64)
        for j in range(1, self.size + 1):
            at = slice(self.cuts[j - 1], self.cuts[j])
            options = score[:, self.starts[at]] + w[:, at]
            pick = options.argmax(axis=1)
            score[:, j], origin[:, j] = options[np.arange(len(w)), pick], self.starts[at][pick]
        begins, here = np.zeros((len(w), self.size), dtype=bool), np.full(len(w), self.size)
        for j in range(self.size, 0, -1):
            stand = here == j
            here = np.where(stand, origin[:, j], here)
            begins[stand, here[stand]] = True
        return begins


def _lattices(batch: pd.DataFrame, longest: int) -> Iterator[tuple[np.ndarray, Lattices]]:
    """The batch by number of atoms, in pieces of bounded size: rows' places and their lattices."""
    sizes = batch["atoms"].map(len).to_numpy() // ATOM.itemsize
    raw = batch["atoms"].to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        step = max(1, SPANS // int(size * min(size, longest)))
        for lo in range(0, len(rows), step):
            at = rows[lo : lo + step]
            yield at, Lattices(np.frombuffer(b"".join(raw[at]), dtype=ATOM).reshape(len(at), size), longest)


def _sums(values: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(values, return_inverse=True)
    return keys, np.bincount(at, weights=c, minlength=len(keys))


def _per_field(values: np.ndarray, c: np.ndarray, keep: np.ndarray, most: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values of spans with one number a field: the greatest of its copies there, or their sum but at most 1."""
    row, col = np.nonzero(keep)
    order = np.lexsort((values[row, col], row))
    row, v, c = row[order], values[row, col][order], c[row, col][order]
    if not len(v):
        return v, c
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (v[1:] != v[:-1])]))
    return v[first], np.maximum.reduceat(c, first) if most else np.minimum(np.add.reduceat(c, first), 1.0)


_COUNTS = "sep boolean, value long, joined boolean, c double"


def _counted(parts: list[tuple[bool, bool, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    rows = []
    for sep, joined in ((False, False), (False, True), (True, False)):
        mine = [(v, c) for s, j, v, c in parts if (s, j) == (sep, joined)]
        if mine:
            v, c = _sums(np.concatenate([v for v, _ in mine]), np.concatenate([c for _, c in mine]))
            rows.append(pd.DataFrame({"sep": sep, "value": v.astype(np.uint64).view(np.int64), "joined": joined, "c": c}))
    return pd.concat(rows, ignore_index=True) if rows else pd.DataFrame({"sep": [False], "value": [0], "joined": [False], "c": [0.0]}).iloc[:0]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(m, value, n): in how many fields each run of m atoms is, for powers of 2."""
    for batch in batches:
        found: dict[int, list[np.ndarray]] = {}
        for _, lattice in _lattices(batch, 1):
            size, lines = lattice.size, lattice.lines
            m = 2
            while m <= size:
                whole = _only(lines, m)
                v, _ = _per_field(whole[0], np.ones(whole[0].shape), whole[1], True)
                found.setdefault(m, []).append(v)
                m *= 2
        rows = []
        for m, parts in found.items():
            v, n = _sums(np.concatenate(parts), np.ones(sum(map(len, parts))))
            rows.append(pd.DataFrame({"m": m, "value": v.view(np.int64), "n": n.astype(np.int64)}))
        if rows:
            yield pd.concat(rows, ignore_index=True)


def _only(lines: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of exactly m atoms, and which hold no quoted atom."""
    n, size = lines.shape
    run, before, after = np.zeros(n, dtype=np.uint64), [], []
    for k in range(size):
        before.append(run)
        after.append(run * BASE + lines["hash"][:, k])
        run = after[-1] * BASE + lines["gap"][:, k]
    power = np.uint64(pow(int(BASE), 2 * m - 1, 2**64))
    values = np.stack(after[m - 1 :], axis=1) - np.stack(before[: size - m + 1], axis=1) * power
    quoted = np.concatenate([np.zeros((n, 1), dtype=np.int64), np.cumsum(lines["quoted"], axis=1)], axis=1)
    return values, quoted[:, m:] == quoted[:, : size - m + 1]


def _first_counts(longest: int, kinds: int):
    """What is counted before anything is known: atoms as often as they occur; a run of m atoms as 1 / m, once a field; delimiters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for _, lattice in _lattices(batch, longest):
                single, many = ~lattice.joined, lattice.valid & lattice.joined
                parts.append((False, False, lattice.values[:, single].ravel(), np.ones(lattice.values[:, single].size)))
                parts.append((False, True, *_per_field(lattice.values, np.broadcast_to(1.0 / (lattice.ends - lattice.starts), lattice.values.shape), many, True)))
                marks = lattice.lines["kind"][:, :-1].ravel()
                parts.append((True, False, np.arange(kinds), np.bincount(marks, minlength=kinds)))
            yield _counted(parts)

    return run


class Known:
    """Frequencies of values by hash, as a sorted array; ``floor`` for a single atom that is not among them."""

    def __init__(self, values: np.ndarray, logs: np.ndarray, floor: float):
        order = np.argsort(values)
        self.values, self.logs, self.floor = values[order], logs[order], floor

    def of(self, lattice: Lattices) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, lattice.values), len(self.values) - 1)
        found = np.where(self.values[at] == lattice.values, self.logs[at], -np.inf)
        return np.where(~lattice.joined & ~np.isfinite(found), self.floor, found)


def _logs(known, batch: pd.DataFrame, at: np.ndarray, lattice: Lattices) -> np.ndarray:
    """Values' logarithms from the broadcast, or as they came with the batch by their places."""
    if "logs" not in batch:
        return known.value.of(lattice)
    found = np.full(lattice.values.shape, -np.inf)
    for row, (places, logs) in enumerate(zip(batch["places"].to_numpy()[at], batch["logs"].to_numpy()[at])):
        if places is not None:
            found[row, np.asarray(places)] = logs
    return np.where(~lattice.joined & ~np.isfinite(found), known.value.floor, found)


def _round(known, cuts: np.ndarray, longest: int):
    """One round's expected counts of values and of separating delimiters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for at, lattice in _lattices(batch, longest):
                c = lattice.expected(lattice.weights(_logs(known, batch, at, lattice), cuts))
                single = ~lattice.joined
                parts.append((False, False, lattice.values[:, single].ravel(), c[:, single].ravel()))
                parts.append((False, True, *_per_field(lattice.values, c, lattice.valid & lattice.joined & (c > 1e-9), False)))
                inner = lattice.ends < lattice.size
                marks = lattice.lines["kind"][:, lattice.ends[inner] - 1]
                parts.append((True, False, np.arange(len(cuts)), np.bincount(marks.ravel(), weights=c[:, inner].ravel(), minlength=len(cuts))))
            yield _counted(parts)

    return run


def _best(known, cuts: np.ndarray, longest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.empty(len(batch), dtype=object)
            for n in range(len(batch)):
                values[n] = []
            fields = batch["field"].to_numpy()
            for at, lattice in _lattices(batch, longest):
                begins = lattice.best(lattice.weights(_logs(known, batch, at, lattice), cuts))
                for row, line, cut in zip(at, lattice.lines, begins):
                    first = np.flatnonzero(cut)
                    last = np.append(first[1:], lattice.size) - 1
                    text = fields[row]
                    values[row] = [_text(text[a:b], q) for a, b, q in zip(line["start"][first], line["end"][last], line["quoted"][first])]
            yield batch[["h1", "h2"]].assign(values=values)

    return run


def _text(span: str, quoted: bool) -> str:
    return span[1:-1].replace(span[0] * 2, span[0]).strip() if quoted else span


def _contexts(candidates: str):
    """(side, piece, low, high): what stands right (side 1) or left (-1) of each piece, as the least and greatest hash; and (side 0) how often a kind stands between a piece and the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, hashes = Cutter(candidates), Hashes()
        for batch in batches:
            ends: dict[tuple[int, int], list[int]] = {}
            between: dict[tuple[int, int, int], int] = {}
            for field in batch["field"]:
                spans = [m.span() for m in cutter.plain.finditer(field)]
                names = [hashes[field[a:b].strip("\"' ")] for a, b in spans]
                gaps = [cutter.kind(field[b:c]) for (_, b), (c, _) in itertools.pairwise(spans)]
                for n, name in enumerate(names):
                    right = hashes[gaps[n]] ^ names[n + 1] if n < len(gaps) else 0
                    left = hashes[gaps[n - 1]] ^ names[n - 1] if n else 0
                    for side, other in ((1, right), (-1, left)):
                        held = ends.setdefault((side, name), [other, other])
                        held[0], held[1] = min(held[0], other), max(held[1], other)
                for n, gap in enumerate(gaps):
                    key = cutter.number[gap], names[n], names[n + 1]
                    between[key] = between.get(key, 0) + 1
            to = lambda x: x - 2**64 if x >= 2**63 else x
            rows = [(s, to(p), 0, 0, to(lo), to(hi), 0) for (s, p), (lo, hi) in ends.items()]
            rows += [(0, to(a), to(b), k, 0, 0, n) for (k, a, b), n in between.items()]
            yield pd.DataFrame(rows, columns=["side", "piece", "next", "kind", "low", "high", "n"])

    return run


def find_delimiters(fields: DataFrame, column: str = "field") -> str:
    """The delimiters of a column: the usual ones, and each other mark that mostly, in one kind of it, stands between pieces that also stand beside other things."""
    chars = fields.select(F.explode(F.array_distinct(F.split(F.regexp_replace(column, _NEVER, ""), ""))).alias("c")).where("c <> ''").groupBy("c").count()
    others = sorted(r["c"] for r in chars.collect() if r["c"] not in DELIMITERS)  # as many as there are marks
    if not others:
        return DELIMITERS
    candidates = DELIMITERS + "".join(others)
    rows = fields.select(F.col(column).alias("field")).mapInPandas(_contexts(candidates), "side int, piece long, next long, kind int, low long, high long, n long")
    # whether anything else ever stands there: the least and the greatest differ. Both are of signed numbers, as any order will do
    rows = rows.groupBy("side", "piece", "next", "kind").agg(F.min(F.least("low", "high")).alias("low"), F.max(F.greatest("low", "high")).alias("high"), F.sum("n").alias("n"))
    rows = settle(rows)
    free, pairs = rows.where("side <> 0 AND low <> high"), rows.where("side = 0")
    left, right = (free.where(F.col("side") == s).select(F.col("piece").alias(c), F.lit(1).alias(f"{c}_free")) for s, c in ((1, "piece"), (-1, "next")))
    shares = pairs.join(left, "piece", "left").join(right, "next", "left").groupBy("kind")
    shares = shares.agg((F.sum(F.when(F.col("piece_free").isNotNull() & F.col("next_free").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    kinds = Cutter(candidates).kinds
    found = {kinds[r["kind"]].strip(" ") or kinds[r["kind"]] for r in shares.where("share > 0.5").collect()}
    return DELIMITERS + "".join(c for c in others if c in found)


def split_packed(
    df: DataFrame, key: str, column: str, delimiters: str | None = None, rounds: int = 4, value_name: str = "value", broadcast_values: int = BROADCAST_VALUES
) -> DataFrame:
    """(key, pos, value): one row per value of ``column``, pos from 1 within the field.

    Null, empty and blank fields, and fields of delimiters only, give no row; empty values take no position.
    Repeated rows are split each by itself; a null key is kept. An empty table gives no rows. Delimiters are learnt
    unless they are given. A field of any length is one lattice, of at most as many spans an atom as the longest
    run that may be a value. Other columns of ``df`` are ignored.
    """
    hashes = (F.xxhash64("field").alias("h1"), F.xxhash64("field", F.lit(1)).alias("h2"))  # 128 bits stand for a field
    rows = df.select(F.col(key).alias("id"), F.col(column).alias("field")).where(F.trim("field") != "")
    fields = rows.select("field").distinct()
    if delimiters is None:
        fields = settle(fields)
        delimiters = find_delimiters(fields)
    cutter = Cutter(delimiters)
    fields = fields.select("field", *hashes).mapInPandas(_parse(delimiters), "field string, h1 long, h2 long, atoms binary")
    fields = settle(fields.where(F.length("atoms") > 0))
    runs = fields.mapInPandas(_runs, "m int, value long, n long").groupBy("m", "value").agg(F.sum("n").alias("n"))
    longest = 2 * (runs.where("n > m").agg(F.max("m")).first()[0] or 0.5)
    longest = max(1, int(longest) - 1)
    counts = _merged(fields.mapInPandas(_first_counts(longest, len(cutter.kinds)), _COUNTS))
    model, known, total, marks = _learnt(counts, len(cutter.kinds), broadcast_values)
    cuts = np.full(len(cutter.kinds), 0.5)
    for _ in range(rounds):
        counts = _merged(_with_logs(fields, model, longest).mapInPandas(_round(known, cuts, longest), _COUNTS))
        model, known, total, found = _learnt(counts, len(cutter.kinds), broadcast_values)
        cuts = np.where(marks > 0, np.clip(found / np.maximum(marks, 1), SURE, 1 - SURE), 0.5)
    values = _with_logs(fields, model, longest).mapInPandas(_best(known, cuts, longest), "h1 long, h2 long, values array<string>")
    return _back(rows.select("id", *hashes), values, key, value_name)


def _merged(counts: DataFrame) -> DataFrame:
    return settle(counts.groupBy("sep", "value", "joined").agg(F.sum("c").alias("c")))


def _learnt(counts: DataFrame, kinds: int, most: int):
    """Frequencies, after one count is taken from each joined value: once is no evidence of a value.

    (a table or None, what is broadcast, the total, the delimiters' counts).
    """
    marks = np.zeros(kinds)
    for r in counts.where("sep").collect():  # at most two kinds a delimiter
        marks[r["value"]] = r["c"]
    kept = counts.where("NOT sep").select("value", (F.col("c") - F.col("joined").cast("double")).alias("c")).where("c > 0")
    kept = kept.groupBy("value").agg(F.sum("c").alias("c"))
    n, total = kept.agg(F.count(F.lit(1)), F.sum("c")).first()
    total, context = total or 1.0, counts.sparkSession.sparkContext
    floor = float(np.log(NEVER_MET / total))
    if n <= most:
        found = kept.toPandas()
        values = found["value"].to_numpy(dtype=np.int64).view(np.uint64) if n else np.zeros(1, dtype=np.uint64)
        logs = np.log(found["c"].to_numpy() / total) if n else np.full(1, -np.inf)
        return None, context.broadcast(Known(values, logs, floor)), total, marks
    nothing = Known(np.zeros(1, dtype=np.uint64), np.full(1, -np.inf), floor)
    return settle(kept.select("value", F.log(F.col("c") / F.lit(total)).alias("log"))), context.broadcast(nothing), total, marks


def _spans(longest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h1, h2 = batch["h1"].to_numpy(), batch["h2"].to_numpy()
            for at, lattice in _lattices(batch, longest):
                row, place = np.nonzero(lattice.valid)
                yield pd.DataFrame({"h1": h1[at[row]], "h2": h2[at[row]], "place": place, "value": lattice.values[row, place].view(np.int64)})

    return run


def _with_logs(fields: DataFrame, model: DataFrame | None, longest: int, salts: int = 16) -> DataFrame:
    """Fields with the logarithms of their spans' values, where these are too many to be broadcast. Ids travel, no text."""
    if model is None:
        return fields
    spans = fields.mapInPandas(_spans(longest), "h1 long, h2 long, place int, value long")
    heavy = heavy_hashes(spans, F.col("value"), 0.005)
    hot = F.col("value").isin(heavy) if heavy else F.lit(False)
    spans = spans.withColumn("salt", F.when(hot, F.pmod("h1", F.lit(salts))).otherwise(F.lit(0).cast("long")))
    model = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(hot, F.lit(salts - 1)).otherwise(F.lit(0)).cast("long"))))
    found = spans.join(model, ["value", "salt"]).groupBy("h1", "h2").agg(F.collect_list(F.struct("place", "log")).alias("x"))
    return fields.join(found.select("h1", "h2", F.col("x.place").alias("places"), F.col("x.log").alias("logs")), ["h1", "h2"], "left")


def _back(rows: DataFrame, values: DataFrame, key: str, value_name: str, salts: int = 16) -> DataFrame:
    """Rows of a field that holds a large share of all are spread over ``salts`` tasks, each with a copy of its one cut."""
    heavy = heavy_hashes(rows, F.col("h1"), 0.005)
    hot = F.col("h1").isin(heavy) if heavy else F.lit(False)
    rows = rows.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0).cast("long")))
    values = values.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(hot, F.lit(salts - 1)).otherwise(F.lit(0)).cast("long"))))
    split = rows.join(values, ["h1", "h2", "salt"]).select("id", F.posexplode("values").alias("pos", "value"))
    return split.select(F.col("id").alias(key), (F.col("pos") + 1).alias("pos"), F.col("value").alias(value_name))
