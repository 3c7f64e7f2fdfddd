"""Forests without a limit of depth from histograms of binned rows, for MLlib pipelines.

Features become numbers of at most ``BINS`` ranges and rows are written once in blocks of numpy arrays. A tree of a forest
is grown by one task without a limit of depth: while a node holds more than ``NODE_ROWS`` rows the task reads the blocks
once a level and keeps histograms only, smaller nodes are read in bundles of that many rows and grown in memory. Trees are
written to the shared folder and read one at a time, so neither the driver nor a task holds the forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from understory.session import new_path

BINS = 32
# Rows that a task grows nodes of in memory, about 100 bytes each.
NODE_ROWS = 2_000_000
# Rows that a task predicts while it reads the forest once.
ASKED_ROWS = 200_000

Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def cut_points(rows: DataFrame) -> list[np.ndarray]:
    """Ascending upper ends of the ranges of each entry of the array column ``x``."""
    width = rows.select(F.size("x").alias("n")).first()["n"]
    probs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.agg(*[F.percentile_approx(F.get("x", i), probs, 10_000).alias(f"c{i}") for i in range(width)]).first()
    return [np.unique(np.array(c, float)) for c in found]


def _binned(x: pa.Array, cuts: list[np.ndarray]) -> np.ndarray:
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def write_blocks(rows: DataFrame, cuts: list[np.ndarray]) -> str:
    """The path of the blocks ``x, y, w`` of the rows (``x array, y double, w double``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y, w = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                if not np.isfinite(y).all():
                    raise ValueError("the target must not be NULL, NaN or infinite")
                yield pa.RecordBatch.from_pydict({"x": [_binned(b.column(0), cuts).tobytes()], "y": [y.tobytes()], "w": [w.tobytes()]},
                                                 pa.schema([(c, pa.binary()) for c in "xyw"]))

    path = new_path(rows.sparkSession, "tree-blocks")
    rows.select("x", "y", "w").mapInArrow(run, "x binary, y binary, w binary").write.parquet(path)
    return path


def _read(path: str) -> ds.Dataset:
    system, at = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    files = sorted(f.path for f in system.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet"))
    return ds.dataset(files, filesystem=system, format="parquet")


def _block(x: bytes, y: bytes, w: bytes) -> Block:
    y = np.frombuffer(y)
    return np.frombuffer(x, np.uint8).reshape(len(y), -1), y, np.frombuffer(w)


def _best(c: np.ndarray, w: np.ndarray, s: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Cut and gain of nodes from the sums of their rows, weights and weighted targets by bin."""
    cl, wl, sl = (np.cumsum(a, axis=1) for a in (c, w, s))
    ct, wt, st = cl[:, -1:], wl[:, -1:], sl[:, -1:]
    cl, wl, sl = cl[:, :-1], wl[:, :-1], sl[:, :-1]
    good = (cl >= least) & (ct - cl >= least) & (wl > 0) & (wt - wl > 0)
    gain = np.where(good, sl * sl / np.where(good, wl, 1) + (st - sl) ** 2 / np.where(good, wt - wl, 1) - st * st / np.maximum(wt, 1e-300), 0.0)
    at = gain.argmax(axis=1)
    found = gain[np.arange(len(gain)), at]
    return at, np.where(found > 1e-12 * (1 + (st * st / np.maximum(wt, 1e-300))[:, 0]), found, 0.0)


class _Tree:
    """A tree that is being grown: of each node the feature (-1: leaf), cut, first child and value."""

    def __init__(self, width: int):
        self.arrays = [np.array([-1], np.int8), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.zeros(1)]
        self.importance = np.zeros(width)

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """The first child of each node; its other child is the next one."""
        first = len(self.arrays[0]) + 2 * np.arange(len(nodes))
        self.arrays[0][nodes], self.arrays[1][nodes], self.arrays[2][nodes] = feature, cut, first
        n = 2 * len(nodes)
        self.arrays = [np.concatenate([a, np.full(n, fill, a.dtype)]) for a, fill in zip(self.arrays, (-1, 0, 0, 0))]
        np.add.at(self.importance, feature, gain)
        return first


def place(x: np.ndarray, arrays: list[np.ndarray]) -> np.ndarray:
    """The leaf of each row."""
    feature, cut, left, _ = arrays
    at = np.zeros(len(x), np.int32)
    live = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, int)
    while len(live):
        node = at[live]
        at[live] = left[node] + (x[live, feature[node]] > cut[node])
        live = live[feature[at[live]] >= 0]
    return at


def _grow_here(tree: _Tree, ids: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray, tries: int,
               least: float, rng: np.random.Generator) -> None:
    """Grow the nodes ``ids`` to their ends; ``node`` tells which of them a row belongs to."""
    width = x.shape[1]
    while len(ids):
        m = len(ids)
        wt, st = np.bincount(node, w, m), np.bincount(node, w * y, m)
        tree.arrays[3][ids] = st / np.maximum(wt, 1e-300)
        tried = rng.random((m, width)).argsort(axis=1)[:, :tries]
        gain, cut, feature = np.zeros(m), np.zeros(m, np.uint8), np.zeros(m, np.int8)
        for f in range(width):
            who = (tried == f).any(axis=1)
            of = np.cumsum(who) - 1
            rows = np.flatnonzero(who[node])
            key, k = of[node[rows]] * BINS + x[rows, f], int(who.sum()) * BINS
            if not k:
                continue
            sums = [np.bincount(key, v, k).reshape(-1, BINS) for v in (c[rows], w[rows], w[rows] * y[rows])]
            at, g = _best(*sums, least)
            mine = np.flatnonzero(who)
            better = g > gain[mine]
            gain[mine[better]], cut[mine[better]], feature[mine[better]] = g[better], at[better], f
        cuts = gain > 0
        first = tree.split(ids[cuts], feature[cuts], cut[cuts], gain[cuts])
        rank = np.cumsum(cuts) - 1
        live = np.flatnonzero(cuts[node])
        old = node[live]
        node = 2 * rank[old] + (x[live, feature[old]] > cut[old])
        x, y, w, c = x[live], y[live], w[live], c[live]
        ids = (first[:, None] + np.arange(2)).ravel()


def grow(blocks: Callable[[], Iterator[Block]], rows: int, tries: int, least: float, bag: float, seed: list[int], limit: int | None = None) -> _Tree:
    """One tree of a forest on a bootstrap sample of all rows."""
    limit = limit or NODE_ROWS

    def drawn() -> Iterator[tuple[np.ndarray, ...]]:
        for i, (x, y, w) in enumerate(blocks()):
            c = np.random.default_rng([*seed, i]).poisson(bag, len(y)).astype(float)
            took = c > 0
            yield x[took], y[took], w[took] * c[took], c[took]

    rng = np.random.default_rng(seed)
    width = next(iter(blocks()))[0].shape[1]
    tree = _Tree(width)
    big, small = ([0], []) if rows > limit else ([], [(0, rows)])
    while big:
        ids = np.array(big)
        sums = np.zeros((3, len(ids), width, BINS))
        for x, y, w, c in drawn():
            of = np.full(len(tree.arrays[0]), -1)
            of[ids] = np.arange(len(ids))
            node = of[place(x, tree.arrays)]
            rows_in = node >= 0
            for f in range(width):
                key = node[rows_in] * BINS + x[rows_in, f]
                for total, v in zip(sums, (c, w, w * y)):
                    total[:, f] += np.bincount(key, v[rows_in], len(ids) * BINS).reshape(-1, BINS)
        tree.arrays[3][ids] = sums[2][:, 0].sum(axis=1) / np.maximum(sums[1][:, 0].sum(axis=1), 1e-300)
        tried = rng.random((len(ids), width)).argsort(axis=1)[:, :tries]
        found = [_best(*(s[:, f] for s in sums), least) for f in range(width)]
        gain = np.stack([np.where((tried == f).any(axis=1), found[f][1], 0.0) for f in range(width)], axis=1)
        feature = gain.argmax(axis=1)
        at = np.arange(len(ids))
        cut = np.stack([a for a, _ in found], axis=1)[at, feature]
        cuts = np.flatnonzero(gain[at, feature] > 0)
        first = tree.split(ids[cuts], feature[cuts].astype(np.int8), cut[cuts], gain[at, feature][cuts])
        big = []
        for i, node in zip(cuts, first):
            below = sums[0][i, feature[i], :cut[i] + 1].sum()
            for child, n in ((node, below), (node + 1, sums[0][i, feature[i]].sum() - below)):
                (big.append(int(child)) if n > limit else small.append((int(child), n)))
    while small:
        bundle, n = [], 0.0
        while small and (not bundle or n + small[-1][1] <= limit):
            node, k = small.pop()
            bundle.append(node)
            n += k
        of = np.full(len(tree.arrays[0]), -1)
        of[bundle] = np.arange(len(bundle))
        held = []
        for x, y, w, c in drawn():
            node = of[place(x, tree.arrays)]
            mine = node >= 0
            held.append((node[mine], x[mine], y[mine], w[mine], c[mine]))
        _grow_here(tree, np.array(bundle), *(np.concatenate(a) for a in zip(*held)), tries, least, rng)
    return tree


def _packed(arrays: list[np.ndarray]) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def _unpacked(parts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(p, t) for p, t in zip(parts, (np.int8, np.uint8, np.int32, np.float64))]


class Forest(Estimator):
    """Bagged regression trees without a limit of depth; of labels 0 and 1 the mean is the share of 1, and the split is Gini's."""

    def __init__(self, features: str, target: str, trees: int, min_leaf: int, bag: float, seed: int, weight: str | None = None):
        super().__init__()
        self.features, self.target, self.weight = features, target, weight
        self.trees, self.min_leaf, self.bag, self.seed = trees, min_leaf, bag, seed

    def _fit(self, rows: DataFrame) -> ForestModel:
        table = _learned(rows, self.features, self.target, self.weight)
        cuts = cut_points(table)
        path = write_blocks(table, cuts)
        spark, width = rows.sparkSession, len(cuts)
        n = spark.read.parquet(path).agg(F.sum(F.octet_length("x"))).first()[0] // width
        tries, least, bag, seed = max(1, int(np.ceil(np.sqrt(width)))), self.min_leaf, self.bag, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _read(path)

            def blocks() -> Iterator[Block]:
                for b in found.to_batches(batch_size=16, batch_readahead=1, fragment_readahead=1):
                    yield from (_block(*(b.column(c)[i].as_py() for c in "xyw")) for i in range(b.num_rows))

            for batch in batches:
                for no in batch.column(0).to_pylist():
                    tree = grow(blocks, n, tries, least, bag, [seed, no])
                    part = tree.importance / (tree.importance.sum() or 1.0)
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (no, *_packed(tree.arrays), part.tolist(), len(tree.arrays[0]))],
                                                     ["tree", "feature", "cut", "first", "value", "importance", "nodes"])

        out = new_path(spark, "forest-trees")
        spark.range(0, self.trees, 1, self.trees).mapInArrow(
            run, "tree long, feature binary, cut binary, first binary, value binary, importance array<double>, nodes long").write.parquet(out)
        made = spark.read.parquet(out).select("importance", "nodes").collect()
        total = np.sum([r["importance"] for r in made], axis=0)
        return ForestModel(self.features, cuts, out, total / (total.sum() or 1.0), self.trees, sum(r["nodes"] for r in made))


def _learned(rows: DataFrame, features: str, target: str, weight: str | None) -> DataFrame:
    return rows.select(vector_to_array(features).alias("x"), F.col(target).cast("double").alias("y"),
                       (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))


def _predicted(df: DataFrame, features: str, cuts: list[np.ndarray], value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` without its vectors and with ``prediction``."""
    vectors = [f.name for f in df.schema if f.dataType.simpleString() == "vector"]
    kept = df.drop(*vectors)
    asked = df.select(*kept.columns, vector_to_array(features).alias("_x"))
    schema = StructType([*kept.schema.fields, StructField("prediction", DoubleType())])
    most = ASKED_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = value(np.concatenate([_binned(b.column(b.num_columns - 1), cuts) for b in held]))
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found[at:at + b.num_rows])], [*b.schema.names[:-1], "prediction"])
                at += b.num_rows

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield from done(held)
                held = []
        if held:
            yield from done(held)

    return asked.mapInArrow(run, schema)


class ForestModel(Model):
    """A forest in the shared folder."""

    def __init__(self, features: str, cuts: list[np.ndarray], path: str, importance: np.ndarray, trees: int, nodes: int):
        super().__init__()
        self.features, self.cuts, self.path, self.trees, self.nodes = features, cuts, path, trees, nodes
        self.featureImportances = DenseVector(importance)

    def _transform(self, df: DataFrame) -> DataFrame:
        path, trees = self.path, self.trees

        def value(x: np.ndarray) -> np.ndarray:
            total = np.zeros(len(x))
            for b in _read(path).to_batches(["feature", "cut", "first", "value"], batch_size=1, batch_readahead=1, fragment_readahead=1):
                for i in range(b.num_rows):
                    arrays = _unpacked([b.column(c)[i].as_py() for c in range(4)])
                    total += arrays[3][place(x, arrays)]
            return total / trees

        return _predicted(df, self.features, self.cuts, value)
