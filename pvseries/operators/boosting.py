"""Boosted regression trees on histograms of binned features.

Features are cut into quantile bins once, one byte a value, and saved as blocks of rows: a byte
matrix and the errors so far (prediction less target). A tree is grown by aggregates: tasks add up gradients
and row counts by (region, feature, bin), Spark sums them over the tasks, and the driver, which
sees a number of rows set by the model alone, picks the best cuts. An aggregate costs a job, so a tree
is not grown one level a job: the driver first guesses the tree on a bounded sample of rows, and
asks for the histograms of the guessed leaves. A node's histogram is the sum of those of its leaves,
so all levels at which the guess proves right are settled by one job; below a wrong cut the tree is
guessed anew. A guess is right if its gain over all rows is at most ``tolerance`` below that of the
best cut over all rows, which is taken otherwise; 0 admits the best cut only. Gradients are rounded
to integers before they are summed, so the sums, and with them the trees, do not depend on the order
of tasks.

Missing values have a bin of their own, and every split learns which side they go to. Rows and
columns are drawn once per tree. Blocks are written again with new errors every few trees; between
that, tasks run the latest trees on the bins. Everything a task needs can be read again.

A tree is run on bins without a walk: a table per feature tells, for each bin, which leaves its tests
leave open, one bit a leaf. The bits of all features together leave one. Files hold many blocks, so
their number, which every job pays for, follows the cores and not the rows.
"""

from __future__ import annotations

import io
import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pvseries.session import delete, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed copy of this module

BLOCK_ROWS = 1 << 16
FILE_ROWS = 1 << 22
WORK_ROWS = 1 << 14  # rows of a block worked on at once, so that they stay in the cache
REFRESH = 8  # trees between two writes of the errors
GUESS_ROWS = 1 << 16
_BLOCK = "block long, matrix binary, error binary"


@dataclass(frozen=True)
class TreeModel:
    """Trees as flat arrays (trees, nodes); the children of node i are 2 i + 1 and 2 i + 2, a leaf has feature -1."""

    features: tuple[str, ...]
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def runner(self) -> "Runner":
        return Runner(self)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values for the rows of ``x`` (rows, features), NaN where missing."""
        return Runner(self).predict(x)


class Runner:
    """A model made ready for many batches: values become ranks among the model's own limits, and trees run on those."""

    def __init__(self, model: TreeModel):
        self.base, self.value = model.base, model.value
        inner = model.feature >= 0
        self.limits = [np.unique(model.threshold[inner & (model.feature == f)]) for f in range(len(model.features))]
        self.tables = []
        for feature, threshold, gap in zip(model.feature, model.threshold, model.missing_left):
            cut = np.array([np.searchsorted(self.limits[f], t) if f >= 0 else 0 for f, t in zip(feature.tolist(), threshold.tolist())], np.int64)
            self.tables.append(LeafTables(feature, cut, gap, [len(e) + 1 for e in self.limits]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), WORK_ROWS):
            part = x[lo:lo + WORK_ROWS]
            ranks = [np.where(np.isnan(v), len(e) + 1, np.searchsorted(e, v)) for v, e in zip(part.T, self.limits)]
            for table, value in zip(self.tables, self.value):
                out[lo:lo + WORK_ROWS] += value.take(table.leaves(ranks))
        return out


class LeafTables:
    """The leaf that rows of bins reach in one tree, by a table per feature: bin to the leaves that its tests leave open.

    ``missing``: per feature the bin of missing values, its last one. Leaves are bits of some words.
    """

    def __init__(self, feature: np.ndarray, cut: np.ndarray, missing_left: np.ndarray, missing: Sequence[int]):
        below: dict[int, int] = {}  # the leaves under each node, as bits
        self.nodes: list[int] = []

        def number(node: int) -> int:
            if feature[node] < 0:
                below[node] = 1 << len(self.nodes)
                self.nodes.append(node)
            else:
                below[node] = number(2 * node + 1) | number(2 * node + 2)
            return below[node]

        number(0)
        self.at, self.words = np.array(self.nodes), -(-len(self.nodes) // _WORD)
        self.tables: dict[int, np.ndarray] = {}  # feature: (words, bins)
        for node in (n for n in below if feature[n] >= 0):
            f = int(feature[node])
            if f not in self.tables:
                self.tables[f] = np.stack([np.full(missing[f] + 1, w) for w in _words(below[0], self.words)])
            goes_left = np.r_[np.arange(missing[f]) <= cut[node], missing_left[node]]
            left, right = (_words(below[2 * node + side], self.words) for side in (1, 2))
            for w in range(self.words):
                self.tables[f][w] &= np.where(goes_left, ~right[w], ~left[w])

    def leaves(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """The leaf's node for every row; ``columns``: bins of each feature, as indices."""
        if not self.tables:
            return np.full(len(columns[0]), self.nodes[0])
        out = None
        for w in range(self.words):
            open_ = None
            for f, words in self.tables.items():
                more = words[w].take(columns[f])
                open_ = more if open_ is None else np.bitwise_and(open_, more, open_)
            # The one bit's place is the exponent of the word as a float.
            place = _WORD * w + (open_.astype(float).view(np.int64) >> 52) - 1023
            out = place if out is None else np.where(open_ > 0, place, out)
        return self.at.take(out)


_WORD = 62  # leaves to a word: bits that a float holds apart from its sign


def _words(bits: int, n: int) -> list[int]:
    return [bits >> _WORD * w & (1 << _WORD) - 1 for w in range(n)]


class _Growing:
    """One tree over bins while it grows."""

    def __init__(self, depth: int, columns: np.ndarray):
        n = (1 << (depth + 1)) - 1
        self.columns = columns
        self.feature, self.cut = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.missing_left, self.value, self.cover = np.zeros(n, bool), np.zeros(n), np.zeros(n)

    def copy(self) -> "_Growing":
        other = object.__new__(_Growing)
        other.__dict__.update({k: v.copy() for k, v in self.__dict__.items()})
        return other

    def split(self, node: int, cuts: "_Cuts", j: int) -> None:
        self.feature[node], self.cut[node], self.missing_left[node] = self.columns[cuts.column[j]], cuts.cut[j], cuts.missing_left[j]

    def leaves_below(self, node: int) -> list[int]:
        return [node] if self.feature[node] < 0 else self.leaves_below(2 * node + 1) + self.leaves_below(2 * node + 2)

    def tables(self, k: int, missing: int) -> LeafTables:
        """To run the tree as it is now on bins of ``k`` features."""
        return LeafTables(self.feature, self.cut, self.missing_left, [missing] * k)


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each feature, ascending and distinct, from one pass of bounded sketches."""
    probs = [i / bins for i in range(1, bins)]
    return [np.unique(q) for q in df.stat.approxQuantile(list(features), probs, 0.05 / bins)]


def to_blocks(rows: DataFrame, edges: list[np.ndarray], missing: int, base: float, parts: int) -> str:
    """Path of the saved blocks of rows (x0, x1, ..., y)."""
    k = len(edges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = [t.column(f"x{i}").to_numpy() for i in range(k)]
            matrix = np.stack([np.where(np.isnan(v), missing, np.searchsorted(e, v)) for v, e in zip(x, edges)]).astype(np.uint8)
            return pa.RecordBatch.from_pydict({"block": [number], "matrix": [matrix.tobytes()], "error": [(base - t.column("y").to_numpy()).tobytes()]})

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, BLOCK_ROWS - size)
                held.append(piece)
                at, size = at + piece.num_rows, size + piece.num_rows
                if size == BLOCK_ROWS:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    path = scratch_path(rows.sparkSession, "tree-blocks")
    rows.repartition(parts).mapInArrow(pack, _BLOCK).write.parquet(path)
    return path


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for j in range(batch.num_rows):
            matrix, error = (batch.column(c)[j].as_buffer() for c in ("matrix", "error"))
            yield batch.column("block")[j].as_py(), np.frombuffer(matrix, np.uint8).reshape(k, -1), np.frombuffer(error)


def _pieces(number: int, matrix: np.ndarray, error: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(row numbers, bins of each feature as indices, errors) of a block, some rows at a time."""
    for lo in range(0, len(error), WORK_ROWS):
        hi = min(lo + WORK_ROWS, len(error))
        yield number * BLOCK_ROWS + np.arange(lo, hi), list(matrix[:, lo:hi].astype(np.intp)), error[lo:hi]


def _replayed(error: np.ndarray, columns: list[np.ndarray], trees: list[tuple[LeafTables, np.ndarray]]) -> np.ndarray:
    for table, value in trees:
        error = error + value.take(table.leaves(columns))
    return error


@dataclass
class _Fit:
    """What every level of a fit shares."""

    spark: SparkSession
    path: str
    k: int
    missing: int
    scale: float
    share: float
    seed: int
    read: tuple[str, DataFrame] | None = None

    def table(self) -> DataFrame:
        if self.read is None or self.read[0] != self.path:
            self.read = (self.path, self.spark.read.schema(_BLOCK).parquet(self.path))
        return self.read[1]

    def ready(self, trees: list[_Growing]) -> list[tuple[LeafTables, np.ndarray]]:
        return [(t.tables(self.k, self.missing), t.value) for t in trees]

    def refresh(self, trees: list[_Growing]) -> None:
        """Write the blocks with the errors after ``trees``, and delete the ones before."""
        k, run = self.k, self.ready(trees)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, matrix, error in _blocks(batches, k):
                moved = [_replayed(e, columns, run) for _, columns, e in _pieces(number, matrix, error)]
                yield pa.RecordBatch.from_pydict({"block": [number], "matrix": [matrix.tobytes()], "error": [np.concatenate(moved).tobytes()]})

        old, self_path = self.path, scratch_path(self.spark, "tree-blocks")
        self.table().mapInArrow(move, _BLOCK).write.parquet(self_path)
        self.path = self_path
        delete(self.spark, old)

    def sample(self, chance: float) -> "_Guess":
        """Rows for guesses, each drawn with the same chance."""
        k, seed = self.k, self.seed

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, matrix, error in _blocks(batches, k):
                at = np.flatnonzero(drawn(number * BLOCK_ROWS + np.arange(len(error)), chance, seed, -1))
                yield pa.RecordBatch.from_pydict({"block": [number], "matrix": [matrix[:, at].tobytes()], "error": [error[at].tobytes()],
                                                  "at": [at.tobytes()]})

        found = self.table().mapInArrow(draw, _BLOCK + ", at binary").toArrow().sort_by("block").combine_chunks()
        parts = list(_blocks(iter(found.to_batches()), k))
        rows = [p[0] * BLOCK_ROWS + np.frombuffer(at, np.int64) for p, at in zip(parts, found.column("at").to_pylist())]
        return _Guess(np.concatenate([p[1] for p in parts], 1), np.concatenate([p[2] for p in parts]), np.concatenate(rows), self)

    def histograms(self, done: list[_Growing], tree: _Growing, nodes: list[int], number: int) -> tuple[np.ndarray, np.ndarray]:
        """(gradient sums, row counts) by (leaf among ``nodes``, drawn column, bin) over the drawn rows."""
        k, scale, share, seed = self.k, self.scale, self.share, self.seed
        shape = (len(nodes), len(tree.columns), self.missing + 1)
        place = np.full(len(tree.feature), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        run, table, columns = self.ready(done), tree.tables(k, self.missing), tree.columns

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grads, counts = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
            for number_, matrix, error in _blocks(batches, k):
                for rows, bins, e in _pieces(number_, matrix, error):
                    g = np.rint(_replayed(e, bins, run) * scale)
                    at = np.where(drawn(rows, share, seed, number), place.take(table.leaves(bins)), -1)
                    more = bin_sums(bins, g, at, columns, shape)
                    grads, counts = grads + more[0].astype(np.int64), counts + more[1]  # below 2 ** 53 in a piece: exact
            grads, counts = grads.ravel(), counts.ravel()
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"cell": some, "g": grads[some], "n": counts[some]})

        found = (self.table().mapInArrow(add, "cell long, g long, n long").groupBy("cell")
                 .agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow())
        out = []
        for name in ("g", "n"):
            flat = np.zeros(int(np.prod(shape)))
            flat[found.column("cell").to_numpy()] = found.column(name).to_numpy()
            out.append(flat.reshape(shape))
        return out[0] / scale, out[1]


def drawn(rows: np.ndarray, share: float, seed: int, number: int) -> np.ndarray:
    """Which of the numbered rows a tree draws: told by the numbers alone, on every machine alike."""
    x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + number) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return (x ^ x >> np.uint64(31)) >> np.uint64(11) < np.uint64(min(int(share * (1 << 53)), 1 << 53))


def bin_sums(bins: Sequence[np.ndarray], g: np.ndarray, place: np.ndarray, columns: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(gradient sums, row counts) by (place, column, bin) of the rows that have a place; ``bins``: of each feature, as indices."""
    at = np.flatnonzero(place >= 0)
    cells, start, weight = shape[0] * shape[2], place.take(at) * shape[2], g.take(at)
    grads, counts = np.empty(shape), np.empty(shape, np.int64)
    for c, f in enumerate(columns):
        key = bins[f].take(at)
        key += start
        grads[:, c] = np.bincount(key, weight, cells).reshape(shape[0], -1)
        counts[:, c] = np.bincount(key, minlength=cells).reshape(shape[0], -1)
    return grads, counts


class _Guess:
    """A sample of the rows on the driver, to guess trees from."""

    def __init__(self, matrix: np.ndarray, error: np.ndarray, rows: np.ndarray, fit: _Fit):
        self.bins, self.error, self.rows, self.missing, self.fit = list(matrix.astype(np.intp)), error, rows, fit.missing, fit

    def extend(self, tree: _Growing, number: int, open_: list[int], depth: int, penalty: float, least: float) -> _Growing:
        """A copy of ``tree`` with cuts below the open nodes, guessed from the drawn ones of the rows."""
        bold = tree.copy()
        g = np.rint(self.error * self.fit.scale) / self.fit.scale
        mine = drawn(self.rows, self.fit.share, self.fit.seed, number)
        while open_:
            place = np.full(len(bold.feature), -1, np.int64)
            place[open_] = np.arange(len(open_))
            shape = (len(open_), len(bold.columns), self.missing + 1)
            leaves = bold.tables(self.fit.k, self.missing).leaves(self.bins)
            grads, counts = bin_sums(self.bins, g, np.where(mine, place.take(leaves), -1), bold.columns, shape)
            cuts = best_cuts(grads, counts.astype(float), penalty, least, eager=True)
            after = []
            for j, i in enumerate(open_):
                if cuts.gain[j] > -np.inf:  # too many cuts cost nothing: those that gain too little over all rows are not made
                    bold.split(i, cuts, j)
                    after += [2 * i + 1, 2 * i + 2]
            open_ = [i for i in after if _level(i) < depth]
        return bold

    def add(self, tree: _Growing) -> None:
        self.error = _replayed(self.error, self.bins, self.fit.ready([tree]))


def _level(node: int) -> int:
    return (node + 1).bit_length() - 1


@dataclass(frozen=True)
class _Cuts:
    """The best cut of each node: its column, bin, the side of missing values, and what lies on the left."""

    gain: np.ndarray
    column: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    any_missing: np.ndarray
    left_g: np.ndarray
    left_n: np.ndarray


def best_cuts(g: np.ndarray, n: np.ndarray, penalty: float, least: float, liked: list[tuple | None] | None = None,
              tolerance: float = 0.0, eager: bool = False) -> _Cuts:
    """From histograms (nodes, columns, bins), whose last bin holds the missing values.

    ``liked``: per node a (column, bin, missing left) that is taken if its gain is within the tolerance.
    ``eager``: a cut may have any gain, not only one above rounding.
    """
    gap_g, gap_n = g[:, :, -1:], n[:, :, -1:]
    run_g, run_n = g[:, :, :-1].cumsum(2), n[:, :, :-1].cumsum(2)
    all_g, all_n = run_g[:, :, -1:] + gap_g, run_n[:, :, -1:] + gap_n
    left_g, left_n = np.stack([run_g + gap_g, run_g], 3), np.stack([run_n + gap_n, run_n], 3)
    right_g, right_n = all_g[..., None] - left_g, all_n[..., None] - left_n
    whole = (all_g ** 2 / (all_n + penalty))[..., None]
    gain = left_g ** 2 / (left_n + penalty) + right_g ** 2 / (right_n + penalty) - whole
    gain = np.where((left_n >= least) & (right_n >= least) & (eager | (gain > 1e-12 * np.maximum(1.0, whole))), gain, -np.inf)
    best, row = gain.reshape(len(g), -1).argmax(1), np.arange(len(g))
    for j, like in enumerate(liked or []):
        if like is not None and gain[(j, *like)] >= (1 - tolerance) * gain[j].flat[best[j]]:
            best[j] = np.ravel_multi_index(like, gain.shape[1:])
    column, cut, side = np.unravel_index(best, gain.shape[1:])
    gains, lg, ln, rn = [a.reshape(len(g), -1)[row, best] for a in (gain, left_g, left_n, right_n)]
    gap = gap_n[row, column, 0] > 0
    return _Cuts(gains, column, cut, np.where(gap, side == 0, ln >= rn), gap, lg, ln)


def _grow(fit: _Fit, guess: _Guess, done: list[_Growing], number: int, depth: int, columns: np.ndarray, rate: float, penalty: float,
          least: float, tolerance: float, least_gain: float) -> _Growing:
    tree, enough = _Growing(depth, columns), 0.0
    totals: dict[int, tuple[float, float]] = {}
    open_ = [0]
    while open_:
        bold = guess.extend(tree, number, open_, depth, penalty, least)
        leaves = {i: bold.leaves_below(i) for i in open_}
        asked = [leaf for i in open_ for leaf in leaves[i]]
        g, n = fit.histograms(done, bold, asked, number)
        at = {leaf: j for j, leaf in enumerate(asked)}
        wrong: list[int] = []
        while open_:  # level by level, as long as the guess is right
            sums = []
            for i in open_:
                own = [at[leaf] for leaf in bold.leaves_below(i)]
                sums.append((g[own].sum(0), n[own].sum(0)))
                totals.setdefault(i, (sums[-1][0][0].sum(), sums[-1][1][0].sum()))
            liked = [(int(np.searchsorted(columns, bold.feature[i])), int(bold.cut[i]), 1 - int(bold.missing_left[i]))
                     if bold.feature[i] >= 0 else None for i in open_]
            cuts = best_cuts(np.stack([x[0] for x in sums]), np.stack([x[1] for x in sums]), penalty, least, liked, tolerance)
            after = []
            for j, i in enumerate(open_):
                if not cuts.gain[j] > enough:
                    continue
                if i == 0:
                    enough = least_gain * cuts.gain[j]
                right = bold.feature[i] == columns[cuts.column[j]] and bold.cut[i] == cuts.cut[j] and (
                    not cuts.any_missing[j] or bold.missing_left[i] == cuts.missing_left[j])
                tree.split(i, cuts, j)
                (all_g, all_n), children = totals[i], [2 * i + 1, 2 * i + 2]
                totals[children[0]], totals[children[1]] = (cuts.left_g[j], cuts.left_n[j]), (all_g - cuts.left_g[j], all_n - cuts.left_n[j])
                if _level(i) + 1 < depth:
                    (after if right else wrong).extend(children)
            open_ = after
        open_ = wrong
    for i, (all_g, all_n) in totals.items():
        tree.value[i], tree.cover[i] = -rate * all_g / (all_n + penalty), all_n
    return tree


def fit_trees(train: DataFrame, features: Sequence[str], target: str, trees: int = 200, depth: int = 5, rate: float = 0.05,
              rows: float = 0.8, columns: float = 0.8, seed: int = 42, bins: int = 128, penalty: float = 1.0,
              least: float = 1.0, guess_rows: int = GUESS_ROWS, tolerance: float = 0.1, least_gain: float = 1e-4) -> TreeModel:
    """Squared-loss boosting from the mean target; every tree draws a share of the rows and of the columns.

    Rows without a target are left out, missing features (null or NaN) are not. A leaf holds the
    negative gradient sum over (rows + ``penalty``) times ``rate``. At most 255 bins. ``guess_rows`` bounds
    (on average) the sample that trees are guessed from: a larger one takes fewer jobs. A cut is made if
    it gains at least ``least_gain`` of what the tree's first cut gains.
    """
    spark, features = train.sparkSession, list(features)
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    data = train.select(*[number(f).alias(f"x{i}") for i, f in enumerate(features)], number(target).alias("y")).dropna(subset=["y"])
    n, base, lo, hi = data.agg(F.count("y"), F.avg("y"), F.min("y"), F.max("y")).first()
    if not n:
        raise ValueError("no row has a target")
    edges = bin_edges(data, [f"x{i}" for i in range(len(features))], bins)
    blocks = -(-n // BLOCK_ROWS)
    cores = spark.sparkContext.defaultParallelism
    # A job opens every file, so there are a few for each core, of a bounded size.
    parts = max(-(-n // FILE_ROWS), min(blocks, 2 * cores), min(n // 1024 + 1, cores, 4 * blocks))
    path = to_blocks(data, edges, bins, base, parts)
    bits = min(30, 61 - int(n).bit_length())
    fit = _Fit(spark, path, len(features), bins, 2.0 ** bits / ((hi - lo) or 1.0) / 2, rows, seed)
    guess = fit.sample(min(1.0, guess_rows / n))
    draw = np.random.default_rng(seed)
    some = max(1, round(columns * len(features)))
    done: list[_Growing] = []
    grown: list[_Growing] = []
    for k in range(trees):
        chosen = np.sort(draw.choice(len(features), some, replace=False))
        done.append(_grow(fit, guess, done, k, depth, chosen, rate, penalty, least, tolerance, least_gain))
        grown.append(done[-1])
        guess.add(done[-1])
        if len(done) == REFRESH and k < trees - 1:
            fit.refresh(done)
            done = []
    delete(spark, fit.path)
    cuts = [np.r_[e, np.full(bins + 1 - len(e), np.inf)] for e in edges]
    threshold = [np.array([cuts[f][c] if f >= 0 else np.nan for f, c in zip(t.feature.tolist(), t.cut.tolist())]) for t in grown]
    stack = lambda name: np.stack([getattr(t, name) for t in grown])
    return TreeModel(tuple(features), float(base), stack("feature"), np.stack(threshold), stack("missing_left"), stack("value"), stack("cover"))


def predict(model: TreeModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Add ``yhat`` to every row; ``keep`` limits the other columns of the result."""
    # Plain values: a broadcast class would have to be installed where the tasks run.
    shared = df.sparkSession.sparkContext.broadcast((model.features, model.base, *[getattr(model, a) for a in _ARRAYS]))

    @pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        held = TreeModel(*shared.value).runner()
        for columns in parts:
            yield pd.Series(held.predict(np.stack([c.to_numpy(float) for c in columns], 1)))

    yhat = score(*[F.col(f).cast("double") for f in model.features]).alias("yhat")
    return df.select(*(keep or df.columns), yhat)


_ARRAYS = ("feature", "threshold", "missing_left", "value", "cover")


def save(model: TreeModel, spark: SparkSession, path: str) -> None:
    """One row with the names and one with the arrays."""
    held = io.BytesIO()
    np.savez_compressed(held, **{a: getattr(model, a) for a in _ARRAYS})
    told = json.dumps({"features": model.features, "base": model.base.hex()})
    spark.createDataFrame([(told, bytearray(held.getvalue()))], "model string, arrays binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> TreeModel:
    row = spark.read.parquet(path).first()
    told, arrays = json.loads(row["model"]), np.load(io.BytesIO(bytes(row["arrays"])))
    return TreeModel(tuple(told["features"]), float.fromhex(told["base"]), *[arrays[a] for a in _ARRAYS])
