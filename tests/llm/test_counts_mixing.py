from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm.mixing import mix, repeat_documents
from ledgerline.llm.queries import vocabulary
from ledgerline.llm.token_counts import byte_bpe, length_histogram, length_quantiles, suffix_sums, truncated_totals
from tests.llm.conftest import EDGE_ROWS, SCHEMA, row, words

RANKS = vocabulary("byte_bpe_50k.tiktoken")


def test_histogram_matches_brute_force(spark, edge):
    lengths = [len(byte_bpe(RANKS).encode_ordinary(r[1] or "")) for r in EDGE_ROWS]
    got = {r.length: r for r in suffix_sums(length_histogram(edge, RANKS)).collect()}
    assert {k: v.n_docs for k, v in got.items()} == Counter(lengths)
    for limit, r in got.items():
        assert r.docs_longer == sum(x > limit for x in lengths)
        assert r.truncated_total == sum(min(x, limit) for x in lengths)
        assert r.total_tokens == sum(lengths)


def test_any_limit_and_quantile(spark, edge):
    lengths = sorted(len(byte_bpe(RANKS).encode_ordinary(r[1] or "")) for r in EDGE_ROWS)
    sums = suffix_sums(length_histogram(edge, RANKS))
    for r in truncated_totals(sums, [0, 1, 77, 10**6]).collect():
        assert r.truncated_total == sum(min(x, r.limit) for x in lengths)
        assert r.docs_longer == sum(x > r.limit for x in lengths)
    for r in length_quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.length == lengths[int(np.ceil(r.q * len(lengths))) - 1]


def test_histogram_of_nothing(empty):
    assert suffix_sums(length_histogram(empty, RANKS)).count() == 0


def targets(sizes: dict) -> dict:
    """Water-filling by repeated sharing, in the plainest way."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s] + 1e-9}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_hits_budgets(spark):
    rows = [row(i, words(i, 5 + i % 40), source=s) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 5 + ["d"] * 90 + [None] * 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r[1])
    want = targets(dict(totals))
    got = mix(df, carry=("source",)).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == totals[r.source] and 0 <= r.taken <= 3 * r.size
    assert {s: int(t + 1e-9) for s, t in want.items()} == dict(taken)
    again = {r.doc_id: r.taken for r in mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mix_edges(edge, empty):
    got = mix(edge)
    assert got.count() == len(EDGE_ROWS)
    assert all(r.size == 0 and r.taken == 0 for r in got.where(F.col("doc_id").isin(3, 4, 5)).collect())
    assert mix(empty).count() == 0


def test_repeats_carry_the_taken_words(edge):
    mixed = mix(edge, carry=("doc_id", "text", "lang", "source", "n_chars"))
    want = mixed.agg(F.sum("taken")).first()[0]
    out = repeat_documents(mixed)
    got = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect())
    assert got == want
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
