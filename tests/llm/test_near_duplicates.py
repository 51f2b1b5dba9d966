from __future__ import annotations

import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

import ledgerline.llm.line_dedup as line_dedup
from ledgerline.llm.common import connected_components
from ledgerline.llm.line_dedup import band_rows, dedup_lines
from ledgerline.llm.ngram_join import banding, keep_representatives, ngram_join
from ledgerline.llm.queries import op3_line_dedup
from tests.llm.conftest import EDGE_ROWS, words


def find_classes(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 560)]
    want = find_classes(600, pairs)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(600))
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def near_copies(n, seed=1):
    r = random.Random(seed)
    out = []
    for base in range(12):
        text = words(100 + base, 120).split()
        for k in range(r.choice([1, 1, 2, 9])):
            t = list(text)
            for _ in range(k % 3):
                t[r.randrange(len(t))] = f"changed{r.randrange(99)}"
            out.append(" ".join(t))
    return out[:n]


def test_join_matches_brute_force(spark):
    texts = near_copies(60) + [words(500 + i, 80) for i in range(20)]
    texts += [texts[0].upper() + "!", "", "tiny text", "Tiny, text"]
    sets = [grams(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = find_classes(len(texts), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (256, 3):
        got = {r.doc_id: r for r in ngram_join(df, block=block).collect()}
        assert [got[i].class_id for i in range(len(texts))] == want
        for i in range(len(texts)):
            others = {tuple(re.findall(r"\w+", texts[j].lower())) for a, b in links for j in (a, b) if i in (a, b) and j != i}
            assert got[i].n_links == len(others - {tuple(re.findall(r"\w+", texts[i].lower()))})


def test_chain_of_near_neighbours(spark):
    """Each text is near its neighbours only: links are counted once, whatever
    the size of blocks."""
    stream = words(77, 800).split()
    texts = [" ".join(stream[i : i + 60]) for i in range(0, 700, 3)]
    hub = words(78, 60).split()  # a tight group beside the chain, in component blocks
    for k in range(30):
        own = list(hub)
        own[k] = "other"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [grams(t) for t in texts]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = find_classes(len(texts), near)
    links = [sum(i in p for p in near) for i in range(len(texts))]
    for block in (256, 7):
        got = {r.doc_id: r for r in ngram_join(docs, block=block).collect()}
        found = sum(got[i].n_links for i in got)
        assert found <= sum(links) and found >= 0.99 * sum(links)
        assert all(got[i].n_links <= links[i] for i in got)
        assert all(got[i].class_id == want[i] for i in got)


def test_banding_reaches_its_recall():
    bands, rows = banding(0.8, 0.997)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.997


def test_join_edges(edge, empty):
    rows = ngram_join(edge).collect()
    assert len(rows) == len(EDGE_ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[1].class_id == got[2].class_id == 1 and got[1].n_copies == 3
    assert got[9].class_id == got[8].class_id == 8
    assert got[3].class_id == 3 and got[3].n_links == 0
    assert all(r.class_id is None for r in rows if r.doc_id is None)
    assert ngram_join(empty).count() == 0
    kept = [r.doc_id for r in keep_representatives(edge).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 4, 5, 6, 7, 8, 10]
    assert kept.count(None) == 2


def shingle_set(line, width=5):
    low = line.lower()
    return {low[i : i + width] for i in range(max(1, len(low) - width + 1))}


def brute_lines(docs):
    """{(id, text): dropped positions} of documents (id, text), by all pairs."""
    key = lambda d, t: (d is None, d or 0, (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64))
    places = sorted({(key(d, t), p, line.strip(" \t\r\v\f"), d, t) for d, t in docs for p, line in enumerate((t or "").split("\n")) if line.strip(" \t\r\v\f")}, key=lambda x: x[:2])
    lines = list(dict.fromkeys(x[2] for x in places))
    sets = [shingle_set(x) for x in lines]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    classes = dict(zip(lines, find_classes(len(lines), links), strict=True))
    first = {}
    for k, p, line, _, _ in places:
        first.setdefault(classes[line], (k, p))
    gone = {}
    for k, p, line, d, t in places:
        if first[classes[line]] != (k, p):
            gone.setdefault((d, t), []).append(p)
    return gone


#: Banding that finds any pair at the threshold, to test what follows it.
SURE = {"minima": 60, "rows": 2, "bands": 30}


def test_bands():
    for minima, rows, bands in ((60, 6, 16), (60, 2, 30), (60, 6, 10)):
        design = band_rows(minima, rows, bands)
        assert len(design) == bands and all(len(set(x)) == rows and max(x) < minima for x in design)
        assert all(len(set(a) & set(b)) <= 1 for a, b in itertools.combinations(design, 2))
    hits = np.random.default_rng(1).random((20_000, 60)) < 0.8
    assert np.any([hits[:, x].all(1) for x in band_rows(60, 6, 16)], 0).mean() > 0.975


def test_lines_match_brute_force(spark, monkeypatch):
    r = random.Random(7)
    pool = [words(900 + i, r.randint(8, 30)) for i in range(40)]
    for x in list(pool):
        t = x.split()
        t[r.randrange(len(t))] = "altered"
        pool.append(" ".join(t))
    docs = [(i, "\n".join(r.choice(pool) + ("  " if k % 2 else "") for k in range(r.randint(1, 6))) + "\n\n") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_lines(docs)
    for block in (64, 2):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        got = {(x.doc_id, x.text): x for x in dedup_lines(df.withColumn("dropped", F.lit(1)), **SURE).collect()}
        wanted = {(d, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want.get((d, t), ()))): want.get((d, t), []) for d, t in docs}
        assert {k: x.dropped for k, x in got.items()} == wanted


def test_components_grow_by_links_between_roots(spark):
    """Components joined by later links are those of all links at once, and only
    linked roots go through union-find again."""
    first = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)]
    classes = connected_components(spark.createDataFrame(first, "src long, dst long"))
    merged = line_dedup._merged(classes, spark.createDataFrame([(10, 1), (40, 20), (41, 40)], "src long, dst long"))
    want = {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 40: 20, 41: 20, 30: 30, 31: 30}
    assert sorted((x.node, x.root) for x in merged.collect()) == sorted(want.items())


def test_a_pair_of_lines_is_compared_once(spark):
    member = "struct<k1: long, root: long, grams: array<bigint>>"
    pairs = spark.createDataFrame([((1, 1, [1, 2, 3, 4, 5]), (2, 2, [1, 2, 3, 4, 5])), ((1, 1, [1, 2, 3, 4]), (3, 3, [1, 2, 9, 8])), ((4, 1, [1, 2]), (5, 1, [1, 2]))], f"a {member}, b {member}")
    assert [tuple(x) for x in line_dedup._near_pairs(pairs, line_dedup.Fraction(4, 5)).collect()] == [(1, 2)]


def test_candidates_of_a_bucket_are_few_and_lose_no_link(spark, monkeypatch):
    """Far lines of a large bucket are ruled out before any pair is a row, near
    ones never; a pair that shares many buckets comes once."""
    monkeypatch.setattr(line_dedup, "BLOCK", 7)
    pool = [words(5000 + i, 20) for i in range(60)]
    pool += [x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :] for x in pool[:20]] + [x[:-3] for x in pool[10:40]] + ["abc", "abd", "x" * 70, "x" * 80]
    rows = [(band, k, k, 0, len(pool)) for band in (1, 2, 3) for k in range(len(pool))]
    apart = spark.createDataFrame(rows, "band long, k1 long, root long, top long, n long")
    lines = spark.createDataFrame(list(enumerate(pool)), "k1 long, line string")
    sets = [{x.lower()[i : i + 5] for i in range(max(1, len(x) - 4))} for x in pool]
    near = {(i, j) for j in range(len(pool)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    found = [tuple(x) for x in line_dedup._candidates(apart, lines, line_dedup.Fraction(4, 5), 5).collect()]
    assert len(found) == len(set(found)) and near <= set(found) and len(found) < 2 * len(near) and len(near) > 40
    assert {tuple(sorted(x)) for x in line_dedup._blocks(apart, lines, line_dedup.Fraction(4, 5), 5).collect()} == near


def test_a_dense_group_makes_few_rows(spark, monkeypatch):
    """Lines that are all near each other, none linked yet, in several buckets: a few
    pairs a line are enough to join them, and no pair is made for each bucket."""
    monkeypatch.setattr(line_dedup, "BLOCK", 7)
    base = words(61, 60)
    pool = [base[: 3 * k] + "#" + base[3 * k + 1 :] for k in range(60)]
    apart = spark.createDataFrame([(band, k, k, -1, len(pool)) for band in (1, 2, 3) for k in range(len(pool))], "band long, k1 long, root long, top long, n long")
    lines = spark.createDataFrame(list(enumerate(pool)), "k1 long, line string")
    every = line_dedup._candidates(apart, lines, line_dedup.Fraction(4, 5), 5)
    assert every.count() == len(pool) * (len(pool) - 1) // 2
    thin = line_dedup._candidates(apart, lines, line_dedup.Fraction(4, 5), 5, thin=True)
    assert thin.count() <= 5 * len(pool)  # of 9 blocks at most 5 are met
    links = line_dedup._blocks(apart, lines, line_dedup.Fraction(4, 5), 5, thin=True)
    assert connected_components(links).select("root").distinct().count() <= 3


def test_pairs_compared_in_full_grow_with_the_lines(spark, monkeypatch):
    """Dense groups share buckets whose hubs are of two of them: of the others few
    pairs are rows, and the lines of each are one class."""
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    compared = []

    def counted(*args, was=line_dedup._candidates, **how):
        pairs = line_dedup.materialize(was(*args, **how), "counted")
        compared.append(pairs.count())
        return pairs

    monkeypatch.setattr(line_dedup, "_candidates", counted)
    common, lines = words(62, 25)[:120], []
    for g in range(8):
        own = words(700 + g, 12)[:40]
        lines += [common + own[:k] + "#" + own[k + 1 :] for k in range(40)]
    docs = list(enumerate(lines))
    got = {x.doc_id: x.dropped for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), with_text=False, minima=4, rows=1, bands=4).collect()}
    want = brute_lines(docs)
    assert {(d, lines[d]): x for d, x in got.items() if x} == want and len(want) == len(lines) - 8
    assert sum(compared) <= 5 * len(lines), compared


def test_chains_within_a_bucket(spark, monkeypatch):
    """Lines that drift apart one change at a time: ends are far from the
    bucket's hubs, so all three comparisons are needed."""
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    r = random.Random(3)
    chain = [list(words(50, 40))]
    for _ in range(40):
        t = list(chain[-1])
        t[r.randrange(len(t))] = r.choice("xyzq")
        chain.append(t)
    lines = ["".join(t) for t in chain]
    docs = [(i, x) for i, x in enumerate(lines)]
    got = {x.doc_id: x.dropped for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), with_text=False, **SURE).collect()}
    want = brute_lines(docs)
    assert {(d, lines[d]): x for d, x in got.items() if x} == want and len(want) == 40


def test_documents_are_told_apart_by_id_and_text(spark):
    """No line without a near copy goes, whatever the ids are."""
    shared = words(70, 12)
    docs = [(None, words(71, 9) + "\n" + shared), (None, words(72, 9) + "\n" + shared), (5, words(73, 9)), (5, words(74, 9) + "\n" + shared), (6, shared), (6, shared), (None, None), (7, "")]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), with_text=False).collect()
    assert len(got) == len(docs)
    want = sorted([sorted(brute_lines(docs).get(d, [])) for d in docs])
    assert sorted(x.dropped for x in got) == want == [[], [], [], [], [0], [0], [1], [1]]


def test_lines_edges(edge, empty):
    rows = dedup_lines(edge).collect()
    assert len(rows) == len(EDGE_ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[3].text is None and by[3].n_lines == 0 and by[4].n_dropped == 0 and by[5].n_dropped == 0
    assert by[2].n_dropped == 1 and by[1].n_dropped == 0
    assert dedup_lines(empty).count() == 0
    small = dedup_lines(edge, with_text=False)
    assert small.agg(F.sum("n_dropped")).first()[0] == sum(r.n_dropped for r in rows)


def test_lines_by_every_character(spark, tmp_path):
    """The query sees the whole of each line: with blanks or without, what
    differs past a first word or past twelve characters counts."""
    r = random.Random(11)
    letters = "".join(map(chr, range(0x4E00, 0x4F00)))
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(4, 6)))
    apart = [f"https://example.org/{''.join(r.choices('abcdefghij', k=40))}" for _ in range(4)]
    apart += ["2024-01-01\t1" + "".join(r.choices("0123456789\t", k=30)) + "7" for _ in range(4)]
    apart += ["同じ始まりの十二文字の文章は" + "".join(r.choices(letters, k=40)) for _ in range(4)]
    apart += ["a", "ab", "abcd", "\U0001f600" * 3, "\U0001f600" * 4 + "x"]
    near = []
    for n in (15, 17, 20, 22, 25):
        w = [word() for _ in range(n)]
        near.append((" ".join(w), " ".join(w[: n // 2] + ["xyzw"] + w[n // 2 + 1 :])))
    base = "".join(r.choices(letters, k=120))
    near.append((base, base[:3] + "変" + base[4:]))
    lines = apart + [x for pair in near for x in pair]
    spark.createDataFrame([(1, "\n".join(lines), "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    row = op3_line_dedup(spark, str(tmp_path)).first()
    sets = [{x[i : i + 5] for i in range(max(len(x) - 4, 1))} for x in lines]
    want = [b for a, b in itertools.combinations(range(len(lines)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert row.dropped == want == [len(apart) + 2 * i + 1 for i in range(len(near))]
