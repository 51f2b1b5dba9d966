from __future__ import annotations

import itertools

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ledgerline.llm import queries
from ledgerline.llm.decontam import normalise
from ledgerline.llm.toxicity import fit_on_labels
from tests.llm.conftest import SCHEMA, row, words
from tests.llm.test_filters import substring_distance
from tests.llm.test_near_duplicates import find_classes, grams


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipe"))
    docs = [row(i, words(i, 40) + (" vileone grimsu awfulest" if i % 7 == 0 else ""), source="abc"[i % 3]) for i in range(120)]
    docs += [row(200 + i, words(i, 40)) for i in range(1, 4)]
    docs += [row(210 + i, words(i, 40)[:-1] + "zq") for i in range(8, 11)]  # near copies
    docs += [row(300 + i, words(2000 + i, 30) + " " + words(77, 25), source="b") for i in range(3)]
    docs += [row(400, None), row(401, ""), row(None, words(5000, 30)), row(402, "two words", None, None)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, words(77, 25))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit_on_labels(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = docs.collect()
    kept = {"toxicity": {(r.doc_id, r.text) for r in rows if model.exceed(model.scores([r.text or ""]))[0, 0] < 0.5}}
    assert not any(r[0] is not None and r[0] % 7 == 0 and r[0] < 120 for r in kept["toxicity"])
    told = sorted(kept["toxicity"], key=lambda x: (x[0] is None, x[0] or 0))
    sets = [grams(t) for _, t in told]
    links = [(i, j) for i, j in itertools.combinations(range(len(told)), 2) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = find_classes(len(told), links)
    kept["near_duplicates"] = {x for i, x in enumerate(told) if roots[i] == i}
    assert len(told) - len(kept["near_duplicates"]) >= 5
    item = normalise(words(77, 25))
    kept["decontamination"] = {(d, t) for d, t in kept["near_duplicates"] if substring_distance(item, normalise(t or "")) > int(0.08 * len(item))}
    assert len(kept["near_duplicates"]) - len(kept["decontamination"]) == 3
    at = docs
    for name, stage in cp.STAGES[:-1]:
        at = stage(spark, at, folder)
        assert at.columns == list(cp.COLUMNS)
        if name in kept:
            assert {(r.doc_id, r.text) for r in at.collect()} == kept[name], name
    texts = [r.text for r in at.collect()]
    assert texts and {t for t in texts} - {t for _, t in kept["decontamination"]} != {t for t in texts}
    whole = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    out = cp.STAGES[-1][1](spark, at, folder).collect()
    assert sorted(r.n_tokens for r in out) == sorted(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert sorted(r.start for r in out)[-1] + max(out, key=lambda r: r.start).n_tokens == int(np.sum([r.n_tokens for r in out]))


def test_run_agrees_with_itself(spark, folder):
    a, b = ({tuple(r) for r in cp.run(spark, folder).collect()} for _ in range(2))
    assert a == b and len(a) > 50


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_queries_are_registered():
    assert [n for n in sorted(queries.QUERIES, key=lambda x: int(x[2:].split("_")[0]))] and {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
