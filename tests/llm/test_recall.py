"""Recall of the two similarity joins on whole tables, against brute force: all
texts of ids divisible by 50 against the texts of all ids."""

from __future__ import annotations

import os
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import line_dedup, ngram_join

FOLDER = os.environ.get("TEST_RECALL_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def near(sets: list[frozenset], asked: list[int]) -> list[tuple[int, int]]:
    """Pairs (asked, other) at a Jaccard similarity of 0.8 or more, by counting
    the common members of every asked set with all sets."""
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    at = {x: np.array(v) for x, v in at.items() if len(v) > 1}
    sizes = np.array([len(s) for s in sets])
    pairs = []
    for i in asked:
        lists = [at[x] for x in sets[i] if x in at]
        if lists:
            both = np.bincount(np.concatenate(lists), minlength=len(sets))
            pairs += [(i, j) for j in np.flatnonzero(5 * both >= 4 * (sizes[i] + sizes - both)).tolist() if j != i]
    return pairs


def found(pairs: list[tuple[int, int]], classes: list) -> float:
    return sum(classes[i] is not None and classes[i] == classes[j] for i, j in pairs) / max(1, len(pairs))


def test_recall_of_lines(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    lines = line_dedup._lines(docs, "doc_id", "text")
    lines = lines.groupBy("k1").agg(F.first("line").alias("line"), F.max(F.col("place.id") % 50 == 0).alias("asked"))
    rows = lines.join(line_dedup.line_classes(docs).select("k1", F.col("keep").cast("string").alias("keep")), "k1", "left").collect()
    grams = [(lambda x: frozenset(x[k : k + 5] for k in range(max(1, len(x) - 4))))(r.line.lower()) for r in rows]
    pairs = near(grams, [i for i, r in enumerate(rows) if r.asked])
    share = found(pairs, [r.keep for r in rows])
    print(f"lines: {len(rows)} different, {sum(r.asked for r in rows)} asked, {len(pairs)} near pairs, recall {share:.4f}")
    assert pairs and share >= 0.9


def test_recall_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = docs.join(ngram_join.ngram_join(docs), "doc_id").collect()
    words = [re.findall(ngram_join.WORD.pattern, (r.text or "").lower()) for r in rows]
    grams = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    asked = [i for i, r in enumerate(rows) if r.doc_id % 50 == 0]
    pairs = near(grams, asked)
    copies = [(i, j) for i, j in pairs if words[i] == words[j]]
    share = found(pairs, [r.class_id for r in rows])
    links = defaultdict(set)
    for i, j in pairs:
        if words[i] != words[j]:
            links[i].add(tuple(words[j]))
    wanted, counted = sum(map(len, links.values())), sum(rows[i].n_links for i in asked)
    print(f"documents: {len(rows)}, {len(asked)} asked, {len(pairs)} near pairs of which {len(copies)} copies, recall {share:.4f}; links counted {counted} of {wanted}")
    assert pairs and share >= 0.9 and 0.9 * wanted <= counted <= wanted
