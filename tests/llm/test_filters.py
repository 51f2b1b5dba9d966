from __future__ import annotations

import json
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.chat_tools import exchanges, link_tool_calls, schema_table, tool_calls_and_exchanges, tool_messages
from ledgerline.llm.decontam import alphabet_masks, decontaminate, find_contamination, myers, normalise, pieces
from ledgerline.llm.mixing import mix
from ledgerline.llm.quality import quality_rules, repeated_words
from ledgerline.llm.queries import op8_chat_tools, vocabulary
from ledgerline.llm.toxicity import OrdinalModel, drop_toxic, fit, fit_on_labels, score
from ledgerline.llm.url_filter import LETTER, RULES, addresses_of_labelled, filter_urls, segmented, word_counts
from tests.llm.conftest import EDGE_ROWS, words

MODEL = vocabulary("piece_bpe_32k.model")


def substring_distance(p, t):
    before = list(range(len(p) + 1))
    best = before[-1]
    for c in t:
        now = [0]
        for i, x in enumerate(p, 1):
            now.append(min(before[i - 1] + (x != c), before[i] + 1, now[i - 1] + 1))
        before = now
        best = min(best, now[-1])
    return best


def test_myers_matches_the_table():
    r = random.Random(1)
    for _ in range(300):
        p, t = "".join(r.choices("abc ", k=r.randint(1, 90))), "".join(r.choices("abc ", k=r.randint(0, 60)))
        assert myers(alphabet_masks(p), len(p), t) == substring_distance(p, t)
    assert "".join(x for _, x in pieces("abcdefghij", 3)) == "abcdefghij"


def test_contamination_matches_brute_force(spark):
    r = random.Random(2)
    items = [(i, words(40 + i, 18)) for i in range(5)]
    docs = []
    for i in range(40):
        text = words(300 + i, 60).split()
        if i % 2:
            own = list(items[i % 5][1])
            for _ in range(r.choice([0, 3, 8, 25])):
                own[r.randrange(len(own))] = r.choice("xyz")
            text[20:20] = "".join(own).split()
        docs.append((i, "  ".join(text)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, x in items:
            p = normalise(x)
            n = substring_distance(p, normalise(t))
            if n <= int(0.08 * len(p)):  # no item here is so short that its budget is 0
                want.add((d, i, n))
    assert {tuple(x) for x in find_contamination(df, bench).collect()} == want
    assert {x.doc_id for x in decontaminate(df, bench).collect()} == {d for d, _ in docs} - {d for d, _, _ in want}


def test_contamination_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, words(3, 40)), (5, words(1, 60)), (5, words(1, 60))], "item_id long, text string")
    got = find_contamination(edge, bench).collect()
    assert sorted((x.doc_id or 0, x.item_id or 0) for x in got) == sorted([(1, 5), (2, 5), (2, 5)] * 2 + [(0, 0)] * 2)
    assert decontaminate(edge, bench).columns == edge.columns
    assert find_contamination(empty, bench).count() == 0
    assert find_contamination(edge, bench.limit(0)).count() == 0 and decontaminate(edge, bench.limit(0)).count() == len(EDGE_ROWS)


def test_short_items_and_blocks(spark, monkeypatch):
    """Items without a budget count as whole words, unchanged, those from 13
    characters may have one edit; many blocks of items give what one gives."""
    import ledgerline.llm.decontam as d

    items = [(1, "Nineteen chars, aha"), (2, "owl"), (3, "..."), (4, words(3, 20)), (5, words(4, 20)), (6, "quick brown foxes"), (7, "twelve chars")]
    docs = [(1, "so: nineteen CHARS aha!"), (2, "nineteen chars ahab"), (3, "an owl"), (4, "owls howl"), (5, words(3, 20) + " owl"), (6, "x " + words(4, 20)), (7, None), (8, "a quick brown foxs"), (9, "quick brwn foxs"), (10, "twelve charm"), (11, "x twelve chars y")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1, 0), (2, 1, 0), (3, 2, 0), (5, 2, 0), (5, 4, 0), (6, 5, 0), (8, 6, 1), (11, 7, 0)}
    for size in (4_000_000, 10):
        monkeypatch.setattr(d, "BLOCK_CHARS", size)
        assert {tuple(x) for x in find_contamination(df, bench).collect()} == want
        assert sorted(x.doc_id for x in decontaminate(df, bench).collect()) == [4, 7, 9, 10]


def brute_parts(url):
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


URLS = [None, "", "no url", "HTTP://WWW.Ex.com/A?b#c", "http://Éa.com?x", "http://a.com/x", "https://m.example.com/en/1", "https://www.example.com/en/1", "http://x.net/de/", "http://x.net/es/1"]
URLS += ["com://com", "a://xcom/", "a://", "http://net/fr/", "http://a.net/fr#/", "http://a.b://c/d", "http://x.org/a\nb/c?d", "http://WWW.EXAMPLE.COM/en/", "http://a.wwwexample.com/en/"]


def test_url_parts_and_rules(spark):
    rows = filter_urls(spark.createDataFrame([(i, u, 0) for i, u in enumerate(URLS)], "page_id long, url string, host int"), spark.createDataFrame([], "text string")).collect()
    for r in rows:
        host, path = brute_parts(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        rule, verdict = brute_rule(host, path)
        assert r.rule == rule and (verdict is None or r.verdict == verdict)


def brute_cost(run, counts):
    """Least cost over all ways to cut a run."""
    total = sum(counts.values())
    cost = lambda w: math.log(total / counts[w]) if w in counts else math.log(total + 1) + LETTER * len(w)
    cuts = [[0, *(i + 1 for i in range(len(run) - 1) if mask >> i & 1), len(run)] for mask in range(1 << (len(run) - 1))]
    return min(sum(cost(run[a:b]) for a, b in zip(c, c[1:], strict=False)) for c in cuts), cost


def test_segmentation_is_the_cheapest(spark):
    docs = [("spam farm free bets city news", ), ("Farm, farm; the bets x the news spam's",), (None,), ("a" * 30,)]
    counts = {r.word: r.n for r in word_counts(spark.createDataFrame(docs, "text string")).collect()}
    assert counts == {"spam": 2, "farm": 3, "free": 1, "bets": 2, "city": 1, "news": 2, "the": 2, "x": 1, "s": 1, "a" * 30: 1}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    runs = ["spamfarm", "freebets", "citynews", "xqfarmzz", "newsbets", "aaaa", "qq", "x", "spam" + "a" * 30 + "xfarm"]
    got = {r.run: r.words for r in segmented(spark.createDataFrame([(x,) for x in runs], "run string"), table).collect()}
    assert got.pop(runs.pop()) == ["spam", "a" * 30, "x", "farm"]
    for run in runs:
        least, cost = brute_cost(run, counts)
        assert abs(sum(map(cost, got[run])) - least) < 1e-9 and "".join(got[run]) == run
    assert got["spamfarm"] == ["spam", "farm"] and got["qq"] == ["qq"]


def test_naive_bayes_matches_brute_force(spark):
    """Scores of the query's operator against a plain count, the model fitted on
    what rules decide; then on given labels."""
    docs = spark.createDataFrame([("spam farm news city daily the",)] * 3, "text string")
    urls = [f"https://{h}.example.{t}/{p}/{i}" for i, (h, t, p) in enumerate([("spamfarm", "net", "es"), ("spamfarm", "net", "fr"), ("citynews", "com", "de"), ("dailynews", "com", "fr"), ("spamnews", "net", "es"), ("spamfarm", "org", "en"), ("dailycity", "org", "en"), ("zzz", "org", "x")])]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(7, urls[0]), (None, None)], "page_id long, url string")
    said = {"com", "net", "example", "www", "en", "es", "fr"}
    cut = {"spamfarm": ["spam", "farm"], "citynews": ["city", "news"], "dailynews": ["daily", "news"], "spamnews": ["spam", "news"], "dailycity": ["daily", "city"]}
    bag = lambda u: [w for r in re.findall("[a-z]+", " ".join(brute_parts(u))) for w in cut.get(r, [r])]
    labels = {u: v for u in urls if (v := brute_rule(*brute_parts(u))[1])}

    def brute(labels, drop):
        bad = [w for u, v in labels.items() if v == "block" for w in bag(u) if w not in drop]
        good = [w for u, v in labels.items() if v == "allow" for w in bag(u) if w not in drop]
        size = len(set(bad) | set(good))
        odds = {w: math.log((bad.count(w) + 0.5) / (len(bad) + 0.5 * size)) - math.log((good.count(w) + 0.5) / (len(good) + 0.5 * size)) for w in set(bad) | set(good)}
        return lambda u: sum(odds.get(w, 0) for w in bag(u))

    score = brute(labels, said)
    for r in filter_urls(pages, docs).collect():
        url = None if r.page_id is None else urls[0] if r.host.startswith("spamfarm.example.net") and r.page_id == 7 else urls[r.page_id]
        assert abs(r.log_odds - score(url)) < 1e-9
        assert r.verdict == (brute_rule(*brute_parts(url))[1] or "allow")  # too few held-out addresses to block anything
    given = {u: "block" if "daily" in u else "allow" for u in urls}
    table = spark.createDataFrame([(*brute_parts(u), v) for u, v in given.items()], "host string, path string, verdict string")
    score = brute(given, ())
    rows = filter_urls(pages, docs, labelled=table).where("page_id is not null").collect()
    assert all(abs(r.log_odds - score(urls[0] if r.host == "spamfarm.example.net" and r.path.endswith("/0") else urls[r.page_id])) < 1e-9 for r in rows)


def brute_held_out(labels, bag, fold):
    """Scores of labelled addresses by counts of the hosts of other folds."""
    out = []
    for u, v in labels.items():
        rest = {x: y for x, y in labels.items() if fold[brute_parts(x)[0]] != fold[brute_parts(u)[0]]}
        bad = [w for x, y in rest.items() if y == "block" for w in bag(x)]
        good = [w for x, y in rest.items() if y == "allow" for w in bag(x)]
        kinds = set(bad) | set(good)
        own = [w for w in bag(u) if w in kinds]
        odds = [math.log((bad.count(w) + 0.5) / (len(bad) + 0.5 * len(kinds))) - math.log((good.count(w) + 0.5) / (len(good) + 0.5 * len(kinds))) for w in own]
        if own:
            out.append((sum(odds), v == "block"))
    return out


@pytest.mark.parametrize("learnable", [True, False])
def test_held_out_hosts_decide_what_is_blocked(spark, learnable):
    r = random.Random(4)
    docs = spark.createDataFrame([("spam farm city news daily bets",)], "text string")
    labels = {}
    for i in range(60):
        bad = i % 2 == 0
        name = ("spamfarm" if bad else "citynews") if learnable else r.choice(["spamfarm", "citynews"])
        labels[f"http://{name}.h{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}.org/p/{i}"] = "block" if bad else "allow"
    asked = ["http://spamfarm.other.org/", "http://citynews.other.org/", "http://zzqq.nowhere.test/", "http://spamfarm.citynews.net/de/"]
    pages = spark.createDataFrame(list(enumerate([*labels, *asked])), "page_id long, url string")
    table = spark.createDataFrame([(*brute_parts(u), v) for u, v in labels.items()], "host string, path string, verdict string")
    report = {}
    got = {x.page_id: x for x in filter_urls(pages, docs, labelled=table, report=report).collect()}
    verdicts = [got[60 + i].verdict for i in range(4)]
    assert got[62].log_odds == 0.0 and verdicts[2] == "allow"  # no word of it is known
    assert verdicts[:2] == (["block", "allow"] if learnable else ["allow", "allow"])
    hosts = spark.createDataFrame([(brute_parts(u)[0],) for u in labels], "host string")
    fold = {x[0]: x[1] for x in hosts.select("host", F.pmod(F.xxhash64("host"), F.lit(5))).collect()}
    cut = {"spamfarm": ["spam", "farm"], "citynews": ["city", "news"]}
    bag = lambda u: [w for x in re.findall("[a-z]+", " ".join(brute_parts(u))) for w in cut.get(x, [x])]
    scores = [(math.floor(x / 0.1), bad) for x, bad in brute_held_out(labels, bag, fold)]
    pairs = [(b, g) for b, x in scores if x for g, y in scores if not y]
    area = sum((b > g) + (b == g) / 2 for b, g in pairs) / len(pairs)
    assert report["held_out"] == len(scores) and abs(report["area"] - area) < 1e-9 and report["labelled"] == 60
    assert (report["threshold"] is not None) == learnable and (not learnable or report["precision"] >= 0.9)


def test_addresses_of_labelled_documents(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.org/en/1", "http://a.org/en/2.html?x", "http://a.org/3/", "http://a.org/en/x", "http://a.org/en/4", None, "http://a.org/1", "http://b.org/" + "9" * 40])], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (3, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted((r.path, r.verdict) for r in addresses_of_labelled(pages, labels).collect())
    assert got == [("/1", "block"), ("/3/", "allow"), ("/en/1", "block"), ("/en/2.html", "block")]


def test_url_filter_edges(spark):
    rows = [(1, "https://spamfarm.example.org/en/1", 0), (2, None, 0), (None, "http://a.com/", 0), (4, "https://daily-news.example.org/" + "a" * 50_000, 0), (4, "http://x.net/es/1", 0), (4, "http://x.net/es/1", 0)]
    docs = spark.createDataFrame([("a daily",), (None,)], "text string")
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host int"), docs).collect()
    assert sorted((r.page_id or 0, r.rule or "", r.verdict) for r in got) == [(0, "com/", "allow"), (1, "", "allow"), (2, "", "allow"), (4, "", "allow"), (4, "net/es/", "block"), (4, "net/es/", "block")]
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), docs).count() == 0


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    before, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_base_matches_brute_force(spark, edge):
    r = random.Random(5)
    rows = [(i, "\n".join(" ".join(r.choices("ab c# d e f".split(), k=r.randint(0, 30))) for _ in range(r.randint(1, 5))), r.choice(["en", None, ""])) for i in range(60)]
    rows += [(100 + i, x[1], x[2]) for i, x in enumerate(EDGE_ROWS)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    for i, text, _ in rows:
        x, want = by[i], brute_base(text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (x.base_failed and x.kept)
    assert repeated_words(np.zeros(0, np.int32), np.array([0, 0])).tolist() == [0]


def test_quality_bands(spark, empty):
    prose = [(i, words(i, 80), "en") for i in range(60)]
    odd = [(1000, "☃☄★ " * 60 + words(1, 5), "en"), (1001, " ".join("qzx" * 30 for _ in range(40)) + words(2, 15), "en")]
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame(prose + odd, "doc_id long, text string, lang string"), MODEL).collect()}
    assert all(got[i].kept for i, _, _ in prose) and not got[1000].kept
    assert quality_rules(empty, MODEL).count() == 0


def test_quality_method_rejects_labelled_junk(spark):
    """Of the labelled documents that pass the base rules, the fences take junk
    and leave clean text: a floor under the width must not swallow them."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    rules = quality_rules(spark.read.parquet(f"{folder}/documents.parquet").repartition(8), MODEL).where("not base_failed")
    by = {(x.quality, x.kept): x["count"] for x in rules.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert by.get((0, False), 0) >= 0.3 * (by.get((0, False), 0) + by[0, True])
    assert by[1, True] >= 0.99 * (by[1, True] + by.get((1, False), 0))


def test_quality_fences_are_as_wide_as_the_quartiles(spark):
    """Prose of one language is tight: words with signs glued on are outside,
    and a group whose quartiles are equal still keeps itself."""
    prose = [(i, words(i, 300), "en") for i in range(60)]
    glued = [(1000 + i, " ".join(w + s for w in words(500 + i, 100).split()), "en") for i, s in enumerate(("$$$", "%%%", "###"))]
    same = [(2000 + i, words(7, 80), "de") for i in range(5)]
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame(prose + glued + same, "doc_id long, text string, lang string"), MODEL).collect()}
    assert all(got[i].kept for i, _, _ in prose + same)
    assert not any(got[i].base_failed or got[i].kept for i, _, _ in glued)


def toxic_sample(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = words(seed * 10_000 + i, r.randint(20, 80)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randint(2, 8)):
                w[r.randrange(len(w))] = r.choice(["vileone", "awfulest", "grimsu", "grimta", "grimlo"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_ordinal_regression_held_out():
    train, test = toxic_sample(600, 1), toxic_sample(400, 2)
    m = fit([t for _, t, _ in train], [y for _, _, y in train])
    assert m.thresholds == sorted(m.thresholds) and len(m.thresholds) == 3
    p = m.exceed(m.scores([t for _, t, _ in test]))
    assert (np.diff(p, axis=1) <= 1e-12).all()
    y = np.array([y for _, _, y in test])
    assert ((p[:, 0] >= 0.5) == y).mean() > 0.98
    more = m.exceed(m.scores(["vileone", "vileone awfulest", "vileone awfulest grimsu vileone vileone"])).sum(1)
    assert more[0] < more[1] < more[2]


def test_toxicity_edges(spark, edge, empty):
    rows = toxic_sample(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    m = fit_on_labels(docs, labels)
    got = {x.doc_id: x.rejected for x in score(docs, m).collect()}
    assert sum(got[i] == bool(y) for i, _, y in rows) > 295
    assert {x.doc_id for x in drop_toxic(docs, m).collect()} == {i for i, r in got.items() if not r}
    assert score(edge, m).count() == len(EDGE_ROWS) and not score(edge, m).where("rejected").count()
    assert drop_toxic(edge, m).count() == len(EDGE_ROWS) and score(empty, m).count() == 0
    assert fit_on_labels(edge, labels.limit(0)).exceed(np.zeros(1))[0, 0] == 0.0 or isinstance(fit_on_labels(edge, labels.limit(0)), OrdinalModel)


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "add", '{"y": 2, "x": 1}', []),
            (1, 2, "b", "add", '{"x": "one", "z": 1}', ["c"]),
            (1, 3, "c", "add", "[1]", ["a"]),
            (1, 4, "d", "nope", "{}", ["b"]),
            (1, 5, "a", "add", '{"x": 9, "y": 9}', []),
            (1, 6, "p", "add", '{"x": 1, "y": 1}', ["q"]),
            (1, 7, "q", "add", '{"x": 1, "y": 1}', ["p"]),
            (None, None, None, "add", None, None),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, 8, "a", "3"), (1, 9, "a", "4"), (1, 9, "zz", "?"), (1, 9, "d", "né\n")], "conv_id long, turn long, call_id string, content string")
    messages = spark.createDataFrame([(1, 0, "system", "hi")], "conv_id long, turn long, role string, content string")
    schemas = schema_table(spark, (("add", "x", "integer", True), ("add", "y", "integer", True)))
    rows = link_tool_calls(calls, results, messages, schemas, max_depth=8).collect()
    got = {(r.kind, r.call_id, r.turn): r for r in rows}
    seq = {r.call_id: r.seq for r in rows if r.kind == "call"}
    assert seq["a"] < seq["c"] < seq["b"] < seq["d"]
    assert json.loads(got["call", "a", 1].json) == {"arguments": {"x": 1, "y": 2}, "call_id": "a", "name": "add", "result": "3", "result_turn": 8, "turn": 1}
    assert got["call", "a", 1].json.startswith('{"arguments":{"x":1,"y":2},')
    assert got["call", "b", 2].errors == "missing y; wrong type x; unknown parameter z"
    assert got["call", "c", 3].errors == "arguments are no object" and got["call", "d", 4].errors == "unknown tool"
    assert got["repeated_call", "a", 5].linked is False and ("repeated_result", "a", 9) in got and ("orphan_result", "zz", 9) in got
    assert "cyclic dependency" in got["call", "p", 6].errors and "cyclic dependency" in got["call", "q", 7].errors
    assert got["call", None, None].errors == "arguments are no object" and len(rows) == 11
    assert sorted(r.seq for r in rows if r.conv_id == 1) == list(range(10))
    for r in rows:
        json.loads(r.json)


def test_exchanges_and_protocol(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u\"\n"), (1, 2, "assistant", None), (1, 2, "assistant", None), (2, 0, "assistant", "lone"), (3, 0, None, None), (None, 1, "user", ""), (4, 0, "user", "x" * 300_000)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1))
    got = link_tool_calls(*exchanges(conv), schema_table(spark)).collect()
    assert sorted(r.kind for r in got) == ["call", "call", "call", "message", "message", "orphan_result"]
    assert next(r for r in got if r.call_id == "1:1").linked
    protocol = [(1, 0, "assistant", '{"tool_calls": [{"id": "k", "name": "reply", "arguments": {"turn": 1, "text": "t"}}]}'), (1, 1, "tool", '{"tool_call_id": "k", "content": "ok"}'), (1, 2, "assistant", "{broken")]
    out = link_tool_calls(*tool_messages(spark.createDataFrame(protocol, "conv_id long, turn long, role string, text string")), schema_table(spark)).collect()
    call = next(r for r in out if r.kind == "call")
    assert call.linked and call.valid and len(out) == 2
    empty = conv.limit(0)
    assert link_tool_calls(*exchanges(empty), schema_table(spark)).count() == 0


def test_long_chains_are_ordered_exactly(spark):
    """One forward reference at the head of a chain of 200 calls moves all of
    them, whatever max_depth is; only what depends on itself is cyclic."""
    chain = [(1, i, f"c{i}", "t", "{}", [f"c{i - 1}"] if i else ["z"]) for i in range(200)] + [(1, 200, "z", "t", "{}", [])]
    ring = [(2, i, f"r{i}", "t", "{}", [f"r{(i + 1) % 3}"]) for i in range(3)] + [(2, 3, "w", "t", "{}", ["r0"]), (2, 4, "free", "t", "{}", [])]
    calls = spark.createDataFrame(chain + ring, CALLS)
    none = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, content string")
    for depth in (0, 3):
        rows = {r.call_id: r for r in link_tool_calls(calls, none, messages, schema_table(spark, (("t", "x", "string", False),)), max_depth=depth).collect()}
        assert all(rows[c[2]].valid and not rows[c[2]].errors for c in chain) and rows["free"].valid
        assert [rows[c].seq for c in ("z", *(f"c{i}" for i in range(200)))] == list(range(201))
        assert {c for c, r in rows.items() if r.errors == "cyclic dependency"} == {"r0", "r1", "r2", "w"}


def test_query_reads_tool_calls(spark, tmp_path):
    rows = [
        (1, 0, "user", "add"),
        (1, 1, "assistant", '{"tool_calls": [{"id": "k", "name": "add", "arguments": {"x": 1}}]}'),
        (1, 2, "tool", '{"tool_call_id": "k", "content": "3"}'),
        (1, 3, "user", "thanks"),
        (1, 4, "assistant", "welcome"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.call_id: r for r in op8_chat_tools(spark, str(tmp_path)).collect()}
    assert got["k"].linked and got["k"].name == "add" and json.loads(got["k"].json)["result"] == "3"
    assert got["1:3"].linked and not got["1:0"].linked and len(got) == 3


def test_ordinal_model_fits_the_likelihood():
    """Weights and thresholds against the plain penalised likelihood of the
    cumulative-link model: no nearby point is better; severity is its mean."""
    r = random.Random(4)
    bad, fine = ["vile", "grim", "awful", "nasty"], [words(i, 1) for i in range(40)]
    texts, toxic = [], []
    for i in range(300):
        n = r.choice([0, 0, 1, 2, 4])
        texts.append(" ".join(r.choices(fine, k=25) + r.choices(bad, k=n)))
        toxic.append(int(n > 0))
    model = fit(texts, toxic, steps=3000)
    names = sorted(model.weights)
    x = np.array([[np.log1p(sum(f in feats(w) for w in t.split())) for f in names] for t in texts])
    typical = np.array([sum(any(f in model.weights for f in feats(w)) for w in t.split()) for t in texts])
    y = np.array(toxic) > 0
    grade = np.where(y, 1 + np.searchsorted(np.quantile(typical[y], [1 / 3, 2 / 3]), typical, "right"), 0)

    def loss(w, t):
        reach = np.column_stack([np.ones(len(x)), 1 / (1 + np.exp(-(x @ w)[:, None] + t)), np.zeros(len(x))])
        p = reach[np.arange(len(x)), grade] - reach[np.arange(len(x)), grade + 1]
        return -np.log(np.maximum(p, 1e-12)).mean() + 0.05 * (w @ w) / len(x)

    w, t = np.array([model.weights[f] for f in names]), np.array(model.thresholds)
    assert (np.diff(t) > 0).all()
    best, rng = loss(w, t), np.random.default_rng(1)
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.05, len(w)), np.sort(t + rng.normal(0, 0.05, len(t)))) > best - 1e-4
    p = model.exceed(model.scores(texts))
    assert np.allclose(model.scores(texts), x @ w) and np.allclose(p.sum(1), (1 / (1 + np.exp(-(x @ w)[:, None] + t))).sum(1))


def feats(w):
    return {w} | {"^" + w[:n] for n in range(3, 10) if len(w) >= n}


def test_null_turns_stay_null(spark):
    turns = spark.createDataFrame([(1, None, "user", "x"), (1, -5, "user", "before"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, None, "system", None)], "conv_id long, turn long, role string, text string")
    rows = link_tool_calls(*tool_calls_and_exchanges(turns), schema_table(spark)).collect()
    got = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == 4 and got[1, None].seq == 0 and got[1, -5].seq == 1 and got[1, 0].seq == 2
    assert got[1, None].valid and json.loads(got[1, None].json) == {"arguments": {"text": "x"}, "name": "reply"}
    assert got[1, 0].linked and json.loads(got[None, None].json) == {"role": "system"}


def test_quality_measures_and_fences_match_brute_force(spark):
    """Fertility, byte share and entropy of each text by the library's pieces one
    by one, quartiles and fences by numpy, verdicts from these; one text lies on
    a fence itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(8)
    docs = []
    for i in range(160):
        lang = ["en", "de", None][i % 3]
        text = words(1000 + i, r.randint(25, 90))
        if i % 17 == 0:
            text += " " + "☃𓀀 " * r.randint(5, 40)
        if i % 23 == 0:
            text = "same word " * 40 + str(i)
        docs.append((i, text, lang))
    docs += [(900, None, "en"), (901, "", None), (902, "привет мир " * 20, None), (903, docs[5][1], "en")]
    rows = {x.doc_id: x for x in quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string"), MODEL).collect()}
    own = {}
    for i, text, lang in docs:
        text = text or ""
        ids = model.encode(text)
        counts = [ids.count(t) for t in set(ids)]
        entropy = -sum(c / len(ids) * math.log(c / len(ids)) for c in counts) / math.log(len(ids)) if len(ids) > 1 else 1.0
        byte = sum(model.is_byte(t) and model.id_to_piece(t) not in ("<0x0A>", "<0x0D>", "<0x09>", "<0x0B>", "<0x0C>") for t in ids)
        band = f"lang:{lang}" if lang else "script:" + ("none" if not text else "cyrillic" if "привет" in text else "latin")
        own[i] = (band, len(text) / len(ids) if ids else 0.0, byte / (len(ids) + 300) if ids else 0.0, entropy)
        got = rows[i]
        assert got.band.lower() == band and got.chars_per_token == pytest.approx(own[i][1]) and got.byte_share == pytest.approx(own[i][2]) and got.evenness == pytest.approx(own[i][3])
    kept = 0
    for i, (band, *measures) in own.items():
        group = [m for j, (b, *m) in own.items() if b == band and not rows[j].base_failed]
        inside = not rows[i].base_failed
        for k, (low, high) in enumerate(((True, True), (False, True), (True, False))):
            if not group or not inside:
                continue
            a, b = np.percentile([round(m[k], 4) for m in group], [25, 75])
            width = b - a if b > a else 0.01
            inside &= not (low and measures[k] < a - 4 * width - 1e-12) and not (high and measures[k] > b + 4 * width + 1e-12)
        assert rows[i].kept == inside
        kept += inside
    assert 0 < kept < len(docs) - 3


def test_ties_of_key_and_size_in_the_mix(spark):
    """Rows alike in id and text share a key: together they take what the plan
    gives, in any order."""
    docs = spark.createDataFrame([(1, "a b c", "x")] * 5 + [(2, "d e", "y")] * 3, "doc_id long, text string, source string")
    rows = mix(docs).collect()
    assert len(rows) == 8 and sorted(map(repr, rows)) == sorted(map(repr, mix(docs.repartition(3)).collect()))
    for source in (15, 6):
        part = [x for x in rows if x.source_size == source]
        assert sum(x.taken for x in part) == math.floor(part[0].target) and all(x.taken <= 3 * x.size for x in part)
