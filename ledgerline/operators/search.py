"""Search over families of price models without a fit per candidate and fold."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.encoders import LinearScore, TreeScore, feature_names
from ledgerline.operators.moments import elastic_net, matrix, product_sums, ridge
from ledgerline.operators.trees import Windows, boost_windows, matrix_of, value_bins
from ledgerline.session import shuffles_dropped, written

#: What each family's candidates are drawn from.
GRIDS: dict[str, dict[str, tuple]] = {
    "ridge": {"penalty": (0.3, 1.0, 3.0, 10.0, 30.0)},
    "elastic_net": {"penalty": (0.0005, 0.001, 0.005, 0.01), "l1_ratio": (0.1, 0.3, 0.5, 0.7)},
    "gbt": {"rate": (0.1, 0.2, 0.3, 0.5), "least_rows": (5.0, 25.0, 50.0), "l2": (0.5, 1.0, 2.0)},
    "random_forest": {"least_rows": (5.0, 10.0, 25.0, 50.0)},
}
MOST_SETS = 8
#: Rounds and depth of boosted trees; trees and depth of a forest; buckets of
#: rows from which a tree of the forest takes half.
ROUNDS, DEPTH, TREES, FOREST_DEPTH, BUCKETS = 10, 3, 8, 5, 16


def parameter_sets(family: str, most: int = MOST_SETS, seed: int = 42) -> list[dict]:
    """At most so many different sets, drawn from the family's grid."""
    grid = GRIDS[family]
    sets = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    return sets if len(sets) <= most else random.Random(f"{seed}:{family}").sample(sets, most)


@dataclass
class Found:
    """A family's best set and its model on all rows; errors holds each set's
    root mean squared error of the label, the mean of the folds."""

    family: str
    best: dict
    error: float
    errors: list[tuple[dict, float]]
    model: PipelineModel


def grouped_search(train: DataFrame, stages: list, label: str, key: str, families: tuple[str, ...] = tuple(GRIDS), n_folds: int = 3, most_sets: int = MOST_SETS, seed: int = 42) -> dict[str, Found]:
    """Grouped cross-validation of every family on the logarithm of the label.

    All rows of a key are in one fold. The stages are fitted for each fold on the
    other folds' rows, and on all rows for the final model; what they make is one
    table of tagged vectors, packed by columns. Linear candidates are solved from
    one pass of sums of products over it, whatever their number; trees of all
    candidates and folds grow together, one pass a level. One last pass takes the
    errors of all. Of the rows, only the columns that the stages read are kept. A
    null label is left out; without rows there is an error. An input that is
    missing even after the stages leaves its row out of linear models. A fold whose
    other folds have no rows, or no value for a median, takes no part."""
    rows = train.where(F.col(label).isNotNull()).withColumns({"label": F.greatest(F.col(label).cast("double"), F.lit(0.0)), "fold": F.pmod(F.xxhash64(key), F.lit(n_folds)).cast("int"), "bucket": F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in train.columns if not dict(train.dtypes)[c].startswith("map")], F.lit(seed)), F.lit(BUCKETS)).cast("int")})
    asked = [_inputs(s) for s in stages]
    if None not in asked:
        rows = rows.select(*[c for c in train.columns if c not in ("label", "fold", "bucket") and any(c in a for a in asked)], "label", "fold", "bucket")
    rows = written(rows).withColumn("log_label", F.log1p("label"))
    fitted, parts = [], []
    for f in [*_folds(rows, stages, n_folds), n_folds]:  # the last one: all rows
        own = Pipeline(stages=stages).fit(rows.where(F.col("fold") != f))
        fitted.append(own)
        parts.append(own.transform(rows).select(F.lit(f).alias("part"), (F.col("fold") == f).alias("valid"), "bucket", "label", vector_to_array("features").alias("x")))
    data = parts[0]
    for part in parts[1:]:
        # Folds may have different slots: a vector is only met by its own part's model.
        data = data.unionByName(part)
    widths = [len(feature_names(m)) for m in fitted]
    width = max(widths)
    padded = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("x")))
    data = written(data.withColumn("x", padded)).withColumn("log_label", F.log1p("label"))

    sets = {f: parameter_sets(f, most_sets, seed) for f in families}
    scorers: list[tuple[str, int, int, object]] = []  # family, set, part, (weights | (trees, windows))
    with shuffles_dropped(train.sparkSession):
        if linear := [f for f in ("ridge", "elastic_net") if f in families]:
            cells = product_sums(data.where("not valid"), F.col("part"), F.concat("x", F.array("log_label")), width + 1).groupBy("g").agg(F.collect_list(F.struct("i", "j", "value")).alias("cells"))
            for r in cells.collect():  # one matrix a fold
                m = matrix(((c["i"], c["j"], c["value"]) for c in r["cells"]), width + 2)
                for f in linear:
                    for k, p in enumerate(sets[f]):
                        scorers.append((f, k, r["g"], ridge(m, **p) if f == "ridge" else elastic_net(m, **p)))
        for f in ("gbt", "random_forest"):
            if f in families:
                model, windows = _grow(data, width, n_folds, sets[f], f, seed)
                scorers += [(f, k, part, (model, windows[k, part])) for k in range(len(sets[f])) for part in range(n_folds + 1)]
        errors = {(r["scorer"], r["part"]): (r["e"] / r["n"]) ** 0.5 for r in _errors(data.where("valid"), scorers, width).collect() if r["n"]}
    out = {}
    for f in families:
        own = []
        for k, p in enumerate(sets[f]):
            seen = [errors[i, part] for i, (g, s, part, _) in enumerate(scorers) if g == f and s == k and (i, part) in errors]
            own.append((p, sum(seen) / len(seen) if seen else float("inf")))
        best = min(range(len(own)), key=lambda k: (own[k][1], k))
        what = next(w for g, s, part, w in scorers if (g, s, part) == (f, best, n_folds))
        columns = {"inputCol": "features", "outputCol": "log_prediction"}
        score = TreeScore.of(*what, **columns) if isinstance(what, tuple) else LinearScore(intercept=float(what[0]), weights=[float(v) for v in what[1 : 1 + widths[-1]]], **columns)
        out[f] = Found(f, own[best][0], own[best][1], own, PipelineModel([*fitted[-1].stages, score]))
    return out


def _inputs(stage) -> set[str] | None:
    """Columns that a stage reads; None if it doesn't name them."""
    named = [stage.getOrDefault(p) for p in ("inputCol", "inputCols", "labelCol") if stage.hasParam(p) and stage.isDefined(stage.getParam(p))]
    return {c for v in named for c in ([v] if isinstance(v, str) else v)} or None


def _folds(rows: DataFrame, stages: list, n_folds: int) -> list[int]:
    """Folds with rows for whose model the other folds have rows, and a value for
    every median."""
    known = lambda c: F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    medians = [c for s in stages if isinstance(s, Imputer) for c in s.getInputCols()]
    seen = {r[0]: r[1:] for r in rows.groupBy("fold").agg(F.count("*"), *map(known, medians)).collect()}
    rest = {f: [n for k, n in seen.items() if k != f] for f in range(n_folds) if f in seen}
    return [f for f, others in rest.items() if others and all(map(sum, zip(*others, strict=True)))]


def _grow(data: DataFrame, width: int, n_folds: int, sets: list[dict], family: str, seed: int) -> tuple[Windows, dict[tuple[int, int], list[int]]]:
    """Trees of all sets and parts, and the windows of each."""
    trees = TREES if family == "random_forest" else 1
    made = [(k, part, t) for k in range(len(sets)) for part in range(n_folds + 1) for t in range(trees)]
    windows = {(k, part): [i for i, m in enumerate(made) if m[:2] == (k, part)] for k in range(len(sets)) for part in range(n_folds + 1)}
    r = random.Random(f"{seed}:rows")
    halves = [r.sample(range(BUCKETS), BUCKETS // 2) if trees > 1 else range(BUCKETS) for _ in range(trees)]
    member = np.zeros(((n_folds + 1) * BUCKETS, len(made)), bool)
    for w, (_, part, t) in enumerate(made):
        member[[part * BUCKETS + b for b in halves[t]], w] = True
    of = lambda name, default: np.array([sets[k].get(name, default) for k, _, _ in made])
    group = F.when(~F.col("valid"), F.col("part") * BUCKETS + F.col("bucket"))
    rounds, depth = (1, FOREST_DEPTH) if trees > 1 else (ROUNDS, DEPTH)
    return boost_windows(data, F.col("x"), width, F.col("log_label"), group, member, rounds, depth, of("rate", 1.0), of("least_rows", 5.0), of("l2", 0.0)), windows


def _errors(data: DataFrame, scorers: list[tuple], width: int) -> DataFrame:
    """(scorer, part, n, e): rows and squared errors of each scorer on the rows
    of its part that it was not trained on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = matrix_of(batch.column(2), width)
            bins = value_bins(x)
            out = []
            for i, (_, _, p, what) in enumerate(scorers):
                own = part == p
                if not own.any():
                    continue
                if isinstance(what, tuple):
                    windows = np.broadcast_to(np.array(what[1]), (int(own.sum()), len(what[1])))
                    guess = what[0].predict(bins[own], windows).mean(axis=1)
                else:
                    guess = what[0] + x[own] @ what[1:]
                wrong = np.maximum(np.expm1(np.minimum(guess, 700.0)), 0.0) - label[own]
                known = ~np.isnan(wrong)
                out.append((i, p, int(known.sum()), float((wrong[known] ** 2).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["scorer", "part", "n", "e"])

    rows = data.select("part", "label", "x").mapInArrow(run, "scorer int, part int, n long, e double")
    return rows.groupBy("scorer", "part").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
