"""Toxicity by cumulative-link ordinal regression.

Features are words and word beginnings (3 to 9 letters), weighted by the
logarithm of their count. One weight vector is shared by the ordered thresholds
t1 < t2 < ... of the grades: P(grade >= k) = sigmoid(x.w - t_k), so the expected
severity is the sum of these over k. The model is fitted on a bounded sample of
labelled rows and applied to every whole text."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, bound_arrow, give_back, text_slices, trimmed, word_codes


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *(f"^{word[:n]}" for n in range(3, 10) if len(word) >= n)]


@dataclass
class OrdinalModel:
    """weights: per feature; thresholds: ascending, one per grade above 0."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [1e3])

    def scores(self, texts: list[str]) -> np.ndarray:
        """x.w of each text; words without a weighted feature cost one lookup."""
        lists = [WORD.findall(t.lower()) for t in texts]
        flat = [w for x in lists for w in x]
        out = np.zeros(len(texts))
        if not flat or not self.weights:
            return out
        codes, distinct = word_codes(flat)
        known = self.weights
        hits = {i: own for i, w in enumerate(distinct) if (own := [f for f in word_features(w) if f in known])}
        if not hits:
            return out
        marked = np.zeros(len(distinct), bool)
        marked[list(hits)] = True
        at = np.flatnonzero(marked[codes])
        docs = np.searchsorted(np.cumsum([len(x) for x in lists]), at, "right")
        counts: dict[int, Counter] = {}
        for d, c in zip(docs.tolist(), codes[at].tolist(), strict=True):
            counts.setdefault(d, Counter()).update(hits[c])
        for d, own in counts.items():
            out[d] = sum(known[f] * np.log1p(n) for f, n in own.items())
        return out

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k), one column per grade above 0."""
        return _sigmoid(scores[:, None] - np.asarray(self.thresholds)[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str], toxic: list[int], grades: int = 3, ridge: float = 0.1, min_docs: int = 2, min_z: float = 2.8, steps: int = 400) -> OrdinalModel:
    """Fit on labelled texts. The labels say only toxic or not, so the grades of
    the toxic texts are made here: thirds by the number of their words that carry
    a feature typical of toxic texts (log-odds ratio, z >= min_z)."""
    y = np.asarray(toxic, np.int64) > 0
    if not y.any() or y.all():
        return OrdinalModel()
    # words and features as integers: of the sample only distinct words are held as text
    code: dict[str, int] = {}
    codes, times = [], []
    for t in texts:
        own = Counter(code.setdefault(w, len(code)) for w in WORD.findall(t.lower()))
        codes.append(np.fromiter(own, np.int32, len(own)))
        times.append(np.fromiter(own.values(), np.int32, len(own)))
    feature: dict[str, int] = {}
    listed, sizes = array("q"), array("q")
    for w in code:
        own = word_features(w)
        listed.extend(feature.setdefault(f, len(feature)) for f in own)
        sizes.append(len(own))
    ends = np.cumsum([0, *sizes])
    flat = np.array(listed, np.int64)
    names = list(feature)
    del code, feature, listed

    def spread(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of words laid end to end, and the word's index of each."""
        sizes = ends[words + 1] - ends[words]
        of = np.repeat(np.arange(len(words)), sizes)
        return flat[ends[words][of] + np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]], of

    presence = np.zeros((2, len(names)), np.int64)
    for own, is_toxic in zip(codes, y.tolist(), strict=True):
        presence[int(is_toxic), np.unique(spread(own)[0])] += 1
    n1, n0 = int(y.sum()), int((~y).sum())
    ratio = np.log((presence[1] + 0.5) / (n1 + 1)) - np.log((presence[0] + 0.5) / (n0 + 1))
    chosen = np.flatnonzero((presence[1] >= min_docs) & (ratio / np.sqrt(1 / (presence[1] + 0.5) + 1 / (presence[0] + 0.5)) >= min_z))
    if not len(chosen):
        return OrdinalModel()
    typical = {names[i]: j for j, i in enumerate(chosen.tolist())}
    number = np.full(len(names), -1)
    number[chosen] = np.arange(len(chosen))
    rows: list[dict[int, int]] = []
    amount = np.zeros(len(texts))
    for i, (own, n) in enumerate(zip(codes, times, strict=True)):
        features, of = spread(own)
        known = number[features] >= 0
        amount[i] = n[np.unique(of[known])].sum()
        total = np.bincount(number[features[known]], n[of[known]]) if known.any() else np.zeros(0)
        rows.append({j: int(total[j]) for j in np.flatnonzero(total).tolist()})
    edges = np.quantile(amount[y], np.arange(1, grades) / grades)
    grade = np.where(y, 1 + np.searchsorted(edges, amount, "right"), 0)

    indptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    columns = np.array([j for r in rows for j in r], np.int64)
    values = np.log1p(np.array([n for r in rows for n in r.values()], np.float64))
    row_of = np.repeat(np.arange(len(rows)), np.diff(indptr))
    w = np.zeros(len(typical))
    first, gaps = np.array([1.0]), np.zeros(grades - 1)
    state = [np.zeros_like(p) for p in (w, first, gaps)], [np.zeros_like(p) for p in (w, first, gaps)]
    parts = [w, first, gaps]
    for step in range(1, steps + 1):
        score = np.bincount(row_of, values * w[columns], len(rows))
        t = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        reach = np.concatenate([np.ones((len(rows), 1)), _sigmoid(score[:, None] - t[None, :]), np.zeros((len(rows), 1))], 1)
        upper, lower = reach[np.arange(len(rows)), grade], reach[np.arange(len(rows)), grade + 1]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_score = -(du - dl) / len(rows)
        g_t = np.zeros(grades + 2)
        np.add.at(g_t, grade, du / len(rows))
        np.add.at(g_t, grade + 1, -dl / len(rows))
        g_t = g_t[1 : grades + 1]
        tail = np.cumsum(g_t[::-1])[::-1]
        gradients = [np.bincount(columns, values * g_score[row_of], len(w)) + ridge * w / len(rows), np.array([g_t.sum()]), tail[1:] * np.exp(gaps)]
        for k, g in enumerate(gradients):
            state[0][k] = 0.9 * state[0][k] + 0.1 * g
            state[1][k] = 0.999 * state[1][k] + 0.001 * g * g
            parts[k] -= 0.05 * (state[0][k] / (1 - 0.9**step)) / (np.sqrt(state[1][k] / (1 - 0.999**step)) + 1e-9)
    t = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
    return OrdinalModel({f: float(w[j]) for f, j in typical.items() if abs(w[j]) > 1e-6}, t.tolist())


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 8000, max_chars: int = 20_000, seed: int = 5) -> OrdinalModel:
    """Fit on at most max_rows labelled rows, chosen by a hash of their id, of
    which those count whose text has at most max_chars characters. Rows with a
    null id, label or text are no sample; without both labels nothing is toxic."""
    sample = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    sample = sample.orderBy(F.xxhash64("__id", F.lit(seed)), "__id", "__y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).where(F.length("__text") <= max_chars)
    got = rows.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select("__id", "__text", "__y").orderBy("__id", "__text", "__y").limit(max_rows).toArrow()
    texts, toxic = got.column("__text").to_pylist(), got.column("__y").to_pylist()
    del got
    model = fit(texts, toxic)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """(id_col, expected_severity, p_toxic, grade, rejected) of every document,
    one row per input row. rejected: P(grade >= 1) >= reject_at. Null and empty
    texts have no features and get the severity of the thresholds alone. Texts of
    any length are scored whole, repeated rows and null ids alike; extra columns
    are ignored; no documents give no rows."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    bound_arrow(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            p = model.exceed(model.scores(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1).astype(np.int64)), pa.array(p[:, 0] >= reject_at)], ["id", "expected_severity", "p_toxic", "grade", "rejected"])

    return source.mapInArrow(trimmed(run), f"id {kind}, expected_severity double, p_toxic double, grade long, rejected boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """The documents that score() does not reject, all columns as they were: a
    narrow filter, so nothing is shuffled."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text_col):
            yield part.filter(pa.array(model.exceed(model.scores(texts))[:, 0] < reject_at))

    return docs.mapInArrow(trimmed(run), docs.schema)
