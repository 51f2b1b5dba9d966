from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import word_tokens
from ledgerline.llm.common import shared_path
from ledgerline.llm.huffman import canonical_codes, code_lengths, decode_table, encode
from ledgerline.llm.queries import vocabulary
from ledgerline.llm.token_files import WordTokenizer, decode_block, read_token_files, write_token_files
from tests.llm.conftest import EDGE_ROWS

PATH = vocabulary("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("abcXYZ .,!'<|>ßÀé0 \n", max_size=80), max_size=6))
def test_word_table_equals_whole_texts(texts):
    coder = WordTokenizer.at(PATH)
    whole = Tokenizer.from_file(PATH)
    got = [np.frombuffer(b, np.uint16).tolist() for b in coder.encode(texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


#: Every white space of Unicode, marks that combine with what is before them,
#: signs that mean something to the tokenizer, and letters of several kinds.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HARD = WHITE + "\u0300\u0301\u0308\u0327\u200d\ufe0f" + "'<|>/_w.,-09" + "aZéÉßÀ×÷ÿñΣςΑ中の한\u0130\u212a\ufb01"


def _special_tokens() -> list[str]:
    return [t.content for t in Tokenizer.from_file(PATH).get_added_tokens_decoder().values()]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.text(HARD, max_size=12) | st.sampled_from([*_special_tokens(), "<|", "|>", "'s", "'ll", " \u0301", "\n\u0308a"]), max_size=10), st.sampled_from(["", " ", "\n", "\u0301"]))
def test_hard_characters_equal_whole_texts(parts, between):
    text = between.join(parts)
    coder, whole = WordTokenizer.at(PATH), Tokenizer.from_file(PATH) if not _whole else _whole[0]
    _whole[:] = [whole]
    assert np.frombuffer(coder.encode([text, "plain", text])[2], np.uint16).tolist() == whole.encode(text, add_special_tokens=False).ids


_whole: list[Tokenizer] = []


def test_small_tables_and_pieces_change_nothing(monkeypatch):
    """Full tables, equal slots, long units and texts cut into pieces."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdeéüß"))
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 40, 3000)]
    texts = [" ".join(rng.choice(words, n)) + mark for n, mark in ((0, ""), (1, "!"), (4000, "..."), (700, " it's 2024"), (3000, "\u3000x"), (500, ""))]
    texts += [None, "", "x" * 5000, "a" * 16 + " " + "a" * 17, "A\tB" * 900, "é" * 3000]
    whole = Tokenizer.from_file(PATH)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for slots, room, slice_bytes in ((1 << 21, 1 << 20, 1 << 18), (256, 200, 1000), (1 << 12, 0, 64)):
        monkeypatch.setattr(word_tokens.UnitTable, "SLOTS", slots)
        monkeypatch.setattr(word_tokens.UnitTable, "ROOM", room)
        monkeypatch.setattr(word_tokens, "SLICE_BYTES", slice_bytes)
        coder = WordTokenizer(PATH)
        for _ in range(2):
            assert [np.frombuffer(b, np.uint16).tolist() for b in coder.encode(texts)] == want
        sliced = pa.array([*texts, *texts], pa.string()).slice(len(texts) - 2, 5)
        assert [np.frombuffer(b, np.uint16).tolist() for b in coder.encode(sliced)] == [*want[-2:], *want[:3]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40) | st.integers(0, 3000), max_size=1500), max_size=5), st.integers(12, 18))
def test_codec_round_trip(docs, limit):
    ids = np.array([i for d in docs for i in d], np.uint16)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    lengths = code_lengths(np.bincount(ids, minlength=3001), limit)
    if len(ids):
        used = lengths[lengths > 0].astype(float)
        assert lengths.max() <= limit and (2.0**-used).sum() <= 1
    payload, where, marks = encode(ids, starts, canonical_codes(lengths), lengths)
    block = {"doc_tokens": [len(d) for d in docs], "doc_bytes": where[:-1].tolist(), "checkpoints": [int(p) for m in marks for p in m[1:]], "payload": payload}
    table, bits = decode_table(lengths)
    assert [d.tolist() for d in decode_block(block, table, bits)] == docs


def test_lengths_are_optimal_without_a_tight_limit():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 0, 34])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((code_lengths(counts, 18) * counts).sum()) == cost


def test_files_round_trip(spark, edge):
    path = shared_path(spark, "test")
    write_token_files(edge, path, PATH)
    got = sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(PATH)
    want = sorted(((r[0] is not None, r[0] or 0), whole.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in EDGE_ROWS)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), list(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_empty_file_set(spark, empty):
    path = shared_path(spark, "test")
    write_token_files(empty, path, PATH)
    assert read_token_files(spark, path).count() == 0


@pytest.mark.parametrize("shards", [1, 5])
def test_many_shards(spark, monkeypatch, shards):
    import ledgerline.llm.token_files as t

    monkeypatch.setattr(t, "SHARD_IDS", 4000 // shards)
    df = spark.createDataFrame([((i * 37) % 500, f"word{i} and some more words {i % 7}") for i in range(500)], "doc_id long, text string")
    path = shared_path(spark, "test")
    write_token_files(df.repartition(6), path, PATH)
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r.doc_id)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
