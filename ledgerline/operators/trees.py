"""Tree ensembles as arrays, for use inside one Arrow pass: fitted MLlib models
read out, and boosted trees grown for many training windows at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel, SQLTransformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage

#: Bins of an octave: a bin is 1.1 % wide. They depend on no data, so no window
#: knows of later rows by them.
_PER_OCTAVE = 64
_MISSING = -(1 << 40)


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. x <= threshold goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(left, self.left[at], self.right[at]), at)


@dataclass
class Ensemble:
    """A change model: inputs, what stands for their missing values, weighted
    trees and a constant."""

    inputs: list[str]
    fill: np.ndarray
    trees: list[tuple[float, Tree]]
    constant: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Prediction of rows (missing values as NaN)."""
        x = np.where(np.isnan(x), self.fill, x) if self.inputs else x
        out = np.full(len(x), self.constant)
        for weight, tree in self.trees:
            out += weight * tree.predict(x)
        return out


def _tree(model) -> Tree:
    rows: list[list] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.getClass().getSimpleName() != "LeafNode":
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
        return at

    walk(model._java_obj.rootNode())
    return Tree(*(np.array(c) for c in zip(*rows, strict=True)))


def ensemble_of(model: PipelineModel) -> Ensemble:
    """The ensemble of a fitted change model: medians, then trees over numeric
    inputs, or the constant that stands for too few rows."""
    if isinstance(model.stages[0], SQLTransformer):
        return Ensemble([], np.zeros(0), [], float(model.stages[0].getStatement().split("'")[1]))
    imputer, last = model.stages[0], model.stages[-1]
    if not isinstance(imputer, ImputerModel) or len(model.stages) != 3:
        raise ValueError("only models over numeric inputs can be read out")
    inputs = list(imputer.getInputCols())
    medians = imputer.surrogateDF.first()
    return Ensemble(inputs, np.array([medians[c] for c in inputs], float), [(w, _tree(t)) for w, t in zip(last.treeWeights, last.trees, strict=True)])


def value_bins(x: np.ndarray) -> np.ndarray:
    """Bin of each number, in the order of the numbers; missing ones come first."""
    size = np.abs(x)
    tiny = ~(size > 1e-12)
    at = np.where(tiny, 0, np.floor(np.log2(np.where(tiny, 1.0, size)) * _PER_OCTAVE) + (1 << 20))
    return np.where(np.isnan(x), _MISSING, np.sign(np.where(tiny, 0.0, x)) * at).astype(np.int64)


@dataclass
class Windows:
    """Boosted trees of many training windows in complete layouts of one depth:
    split feature (-1: all go left) and bin by (window, inner node), leaf values
    by (window, leaf), one entry a tree; base by window (NaN: no model)."""

    depth: int
    base: np.ndarray
    feature: list[np.ndarray]
    bin: list[np.ndarray]
    leaf: list[np.ndarray]

    def nodes(self, tree: int, bins: np.ndarray, windows: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Node of the row-window pairs after so many levels of a tree; windows
        has the windows of each row."""
        at = np.zeros(windows.shape, np.int64)
        rows = np.arange(len(bins))[:, None]
        for _ in range(self.depth if depth is None else depth):
            f = self.feature[tree][windows, at]
            right = (f >= 0) & (bins[rows, np.maximum(f, 0)] > self.bin[tree][windows, at])
            at = 2 * at + 1 + right
        return at

    def predict(self, bins: np.ndarray, windows: np.ndarray) -> np.ndarray:
        out = self.base[windows].astype(float)
        for t in range(len(self.leaf)):
            out += self.leaf[t][windows, self.nodes(t, bins, windows) - (2**self.depth - 1)]
        return out


def matrix_of(values: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of arrays, all of one width; nulls as NaN."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def vector(columns: list[str]) -> Column:
    """The columns as one array of doubles."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def boost_windows(rows: DataFrame, x: Column, width: int, target: Column, group: Column, member: np.ndarray, rounds: int = 10, depth: int = 3, rate: float | np.ndarray = 0.3, least_rows: float | np.ndarray = 5, l2: float | np.ndarray = 0.0) -> Windows:
    """Least-squares boosted trees for many training windows, without a fit per
    window: window w is trained on the rows of each group g with member[g, w].
    rate, least_rows (on either side of a split) and l2 may differ by window, so
    origins, folds and candidates of a search are all grown together.

    Each level of each tree is one pass: tasks sum residuals by (window, node,
    input, bin), Spark adds the sums up and takes the best split of each node,
    the one of the least input and bin on ties. Only splits reach the driver, at
    most 2^depth for each window and tree. Missing values have a bin of their own
    below all numbers. Windows of fewer than two rows get no model; rows without
    a target take no part. rows are read once: rows of one group class whose
    inputs all fall into the same bins are met by the same trees, so all levels
    go over one row for each class and such vector of bins, with its count and
    sum of targets. Groups with the same windows are one class."""
    n_windows = member.shape[1]
    member, class_of = np.unique(member, axis=0, return_inverse=True)
    rate, least_rows, l2 = (np.broadcast_to(np.asarray(v, float), n_windows) for v in (rate, least_rows, l2))
    asked = rows.select(group.cast("int").alias("g"), target.cast("double").alias("y"), x.alias("x")).where("y is not null and g is not null")
    cells = asked.mapInArrow(_binned(class_of.reshape(-1), width), "g int, x array<bigint>, n double, y double")
    data = cut_lineage(cells.groupBy("g", "x").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    n, y = np.zeros(n_windows), np.zeros(n_windows)
    for r in data.groupBy("g").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect():
        n, y = n + member[r["g"]] * r["n"], y + member[r["g"]] * r["y"]
    model = Windows(depth, np.where(n >= 2, y / np.maximum(n, 1), np.nan), [], [], [])
    by_window = {"least": F.array(*map(F.lit, least_rows.tolist())), "l2": F.array(*map(F.lit, l2.tolist()))}
    for _ in range(rounds):
        model.feature.append(np.full((n_windows, 2**depth - 1), -1))
        model.bin.append(np.zeros((n_windows, 2**depth - 1), np.int64))
        leaf = np.zeros((n_windows, 2**depth))
        for level in range(depth):
            sums = data.mapInArrow(_level_sums(model, member, width, level), "w int, node int, input int, bin long, n double, s double")
            sums = sums.groupBy("w", "node", "input", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            own = Window.partitionBy("w", "node", "input")
            upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            cut = sums.select("w", "node", "input", "bin", F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"), F.sum("n").over(own).alias("n"), F.sum("s").over(own).alias("s"))
            least, reg = by_window["least"][F.col("w")], by_window["l2"][F.col("w")]
            nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
            score = lambda s, c: s * s / (c + reg)
            gain = F.when((F.col("nl") >= least) & (nr >= least), F.round(score(F.col("sl"), F.col("nl")) + score(sr, nr) - score(F.col("s"), F.col("n")), 9))
            best = F.max(F.struct(F.coalesce(gain, F.lit(-1.0)).alias("gain"), (-F.col("input")).alias("input"), (-F.col("bin")).alias("bin"), "nl", "sl", "n", "s"))
            for r in cut.groupBy("w", "node").agg(best.alias("b")).collect():
                w, node, b = r["w"], r["node"], r["b"]
                split = b["gain"] > 0
                if split:
                    model.feature[-1][w, node], model.bin[-1][w, node] = -b["input"], -b["bin"]
                if level == depth - 1:
                    left = 2 * node + 1 - (2**depth - 1)
                    parts = ((b["sl"], b["nl"]), (b["s"] - b["sl"], b["n"] - b["nl"])) if split else ((b["s"], b["n"]), (0.0, 1.0))
                    leaf[w, left], leaf[w, left + 1] = (rate[w] * v / (c + l2[w]) for v, c in parts)
        model.leaf.append(leaf)
    return model


def _binned(class_of: np.ndarray, width: int):
    """(g, x, n, y): count and sum of targets of a batch's rows by the class of
    their group and the bins of their inputs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.column_stack([class_of[batch.column(0).to_numpy()], value_bins(matrix_of(batch.column(2), width))])
            found, at = np.unique(keys, axis=0, return_inverse=True)
            n, y = np.bincount(at.reshape(-1), minlength=len(found)), np.bincount(at.reshape(-1), batch.column(1).to_numpy(), len(found))
            bins = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * width), pa.array(found[:, 1:].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].astype(np.int32)), bins, pa.array(n.astype(float)), pa.array(y)], ["g", "x", "n", "y"])

    return run


def _level_sums(model: Windows, member: np.ndarray, width: int, level: int):
    """Sums of residuals of a task's cells by (window, node, input, bin)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, fits = len(model.feature) - 1, ~np.isnan(model.base)
        names = ["w", "node", "input", "bin", "n", "s"]
        for batch in batches:
            groups = batch.column(0).to_numpy()
            for g in np.unique(groups):
                own = np.flatnonzero(member[g] & fits)
                part = batch.filter(pa.array(groups == g))
                step = max(1, (1 << 19) // max(1, len(own)))
                for start in range(0, part.num_rows if len(own) else 0, step):
                    yield sums(part.slice(start, step), own, tree, names)

    def sums(part: pa.RecordBatch, own: np.ndarray, tree: int, names: list[str]) -> pa.RecordBatch:
        bins = part.column(1).flatten().to_numpy().reshape(-1, width)
        count, y = part.column(2).to_numpy(), part.column(3).to_numpy()
        windows = np.broadcast_to(own, (len(y), len(own)))
        rest = (y[:, None] - count[:, None] * model.predict(bins, windows)).reshape(-1)
        node = model.nodes(tree, bins, windows, level) - ((1 << level) - 1)
        head = (np.arange(len(own))[None, :] << level) + node
        weight = np.repeat(count, len(own))
        out: list[list[np.ndarray]] = [[] for _ in names]
        for f in range(width):
            values, where = np.unique(bins[:, f], return_inverse=True)
            code = (head * len(values) + where.reshape(-1, 1)).reshape(-1)
            size = (len(own) << level) * len(values)
            if size <= 4 * len(code) + 4096:
                n, s = np.bincount(code, weight, size), np.bincount(code, rest, size)
                keys = np.flatnonzero(n)
                n, s = n[keys], s[keys]
            else:
                keys, at = np.unique(code, return_inverse=True)
                n, s = np.bincount(at.reshape(-1), weight, len(keys)), np.bincount(at.reshape(-1), rest, len(keys))
            at_window, bin_ = np.divmod(keys, len(values))
            w, node_at = np.divmod(at_window, 1 << level)
            for column, c in zip(out, [own[w].astype(np.int32), (node_at + (1 << level) - 1).astype(np.int32), np.full(len(keys), f, np.int32), values[bin_], n, s], strict=True):
                column.append(c)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return run
