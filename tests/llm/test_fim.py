"""Fill-in-the-middle against a plain version in Python."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.fim import GRAMMARS, fill_in_middle, restore, units

TEXTS = [None, "", " ", "a", "ab", "a😀b\r\né\n👨‍👩‍👧x", "one  two\tthree\n", "\n\n", "Hi. There! ok?no", "x<P>y", "<S>", "a<M", "<<S<P", "M>S>P>", "long " * 60_000, "12ab 3.4,5", "\U00010000\U00010001"]


def plain_version(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return len(text), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(text), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_against_plain_version(spark):
    rows = [(i, t, "x", 1) for k, t in enumerate(TEXTS) for i in range(k, 120, len(TEXTS))] + [(None, "abc", "y", 2), (None, None, "y", 2), (3, "same", "z", 3), (3, "same", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    cut = fill_in_middle(docs)
    got = cut.select("doc_id", "n", "form", F.length("prefix"), F.length("middle"), "output", restore(F.col("output"), F.col("form"))).collect()
    want = [(r[0], *plain_version(r[0], r[1]), r[1] or "") for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("name", sorted(GRAMMARS))
def test_units_keep_every_character(spark, name):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", units(F.col("t"), GRAMMARS[name]).alias("u")).collect()
    for t, u in rows:
        assert "".join(u) == (t or "") and "" not in u
        if name == "char":
            assert u == list(t or "")
        if name == "line":
            assert u == [x for x in (t or "").replace("\n", "\n\0").split("\0") if x]


def test_units_by_grammar(spark):
    def cut(name, text):
        return spark.range(1).select(units(F.lit(text), GRAMMARS[name])).first()[0]

    assert cut("word", "  one  two\tthree\n") == ["  ", "one  ", "two\t", "three\n"]
    assert cut("sentence", "Hi. There! ok?no") == ["Hi.", " There!", " ok?no"]
    assert cut("kind", "ab12 3.4,,é😀😀") == ["ab", "12", " ", "3", ".", "4", ",", ",", "é", "😀", "😀"]


def test_edges(edge, empty):
    got = fill_in_middle(edge)
    assert got.count() == edge.count() and fill_in_middle(empty).count() == 0
    for grammar in GRAMMARS.values():
        rows = fill_in_middle(edge, grammar, plain_percent=0).select("*", restore(F.col("output"), F.col("form")).alias("back")).collect()
        assert all(r["back"] == (r["output"] if r["form"] == "plain" else r["prefix"] + r["middle"] + r["suffix"]) for r in rows)
