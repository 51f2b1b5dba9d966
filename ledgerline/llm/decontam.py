"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with at most k = floor(rate * m) edits. Cut
into k + 1 pieces, at least one piece must occur unchanged, so exact piece hits
(one Aho-Corasick pass over each whole text) find every candidate place, and
Myers' bit-parallel algorithm gives the distance there. An item without a budget
(under 1 / rate characters) must occur as it is, in whole words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, bound_arrow, materialize, text_slices, trimmed

#: Characters of benchmark text that one pass searches for; more text is
#: searched for in further passes, so what is sent to executors is bounded.
BLOCK_CHARS = 4_000_000
#: Budget of an item that must occur as it is.
_WHOLE = -1


def normalise(text: str) -> str:
    """Lower-cased words with single spaces: case, marks and layout don't count."""
    return " ".join(WORD.findall(text.lower()))


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of lengths that differ by one at most."""
    n = budget + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def alphabet_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def myers(masks: dict[str, int], m: int, text: str) -> int:
    """Least edit distance of a pattern to any substring of text; each column of
    the distance matrix is two bit vectors of m bits."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
    return best


class Searcher:
    """Finds benchmark items in texts: items are (item_id, text) rows."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items = []
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            clean = normalise(text or "")
            if not clean:
                continue
            k = int(rate * len(clean) + 1e-9) or _WHOLE
            for offset, piece in pieces(clean, max(k, 0)):
                found[piece].append((len(self.items), offset))
            self.items.append((item_id, clean, k, alphabet_masks(clean)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.known: dict[tuple[int, str], int] = {}

    def distance(self, item: int, window: str) -> int:
        key = (item, window)
        if key not in self.known:
            _, clean, _, masks = self.items[item]
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[key] = 0 if clean in window else myers(masks, len(clean), window)
        return self.known[key]

    def search(self, text: str) -> list[tuple[int, int]]:
        """(item_id, least distance) of the items that occur within their budgets."""
        if not self.items:
            return []
        clean = normalise(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.automaton.iter(clean):
            for item, offset in where:
                starts[item].add(end + 1 - size - offset)
        out = []
        for item, at in starts.items():
            item_id, own, k, _ = self.items[item]
            if k == _WHOLE:
                if any(clean[s - 1 : s] in ("", " ") and clean[s + len(own) : s + len(own) + 1] in ("", " ") for s in at):
                    out.append((item_id, 0))
                continue
            windows: list[list[int]] = []
            for s in sorted(at):
                a, b = max(0, s - k), min(len(clean), s + len(own) + k)
                if windows and a <= windows[-1][1] and b - windows[-1][0] <= 8 * len(own):
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            best = k + 1
            for a, b in windows:
                best = min(best, self.distance(item, clean[a:b]))
                if best == 0:
                    break
            if best <= k:
                out.append((item_id, best))
        return sorted(out)


_searchers: dict[int, Searcher] = {}


def _searcher(items: list[tuple[int, str]], rate: float) -> Searcher:
    """The searcher of a block, made once per worker; only the last is kept."""
    key = hash((tuple(items), rate))
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = Searcher(items, rate)
    found = _searchers[key]
    found.known.clear()
    return found


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in blocks of about BLOCK_CHARS, each with whether it is the only
    one; the driver holds two at a time."""
    some: list[tuple[int, str]] = []
    before: list[tuple[int, str]] | None = None
    held, several = 0, False
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        if held >= BLOCK_CHARS:
            if before is not None:
                several = True
                yield before, False
            before, some, held = some, [], 0
        some.append((row[0], row[1] or ""))
        held += len(some[-1][1])
    if before is not None:
        yield before, False
    if some:
        yield some, not several and before is None


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.08) -> DataFrame:
    """Rows (id_col, item_col, distance) for every document in which a benchmark
    item occurs with at most floor(rate * length) edits, over lower-cased words.

    Each whole text is read once per block of benchmark text; with several
    blocks the hits of each are written before the next is fetched. An item whose
    budget is 0 must occur unchanged and as whole words. Texts of any length are
    searched whole. Null and empty texts and items match nothing. Repeated
    rows give repeated results, null ids are reported as null; extra columns are
    ignored; an empty table on either side gives none."""
    spark = docs.sparkSession
    bound_arrow(spark)
    schema = f"{id_col} long, {item_col} long, distance long"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items, only in _item_blocks(benchmark, item_col, item_text_col):

        def run(batches: Iterable[pa.RecordBatch], items: list[tuple[int, str]] = items) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(items, rate)
            for part, texts in text_slices(batches, "text"):
                rows = [(i.as_py(), *hit) for i, t in zip(part.column(0), texts, strict=True) for hit in searcher.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], [id_col, item_col, "distance"])

        hits = source.mapInArrow(trimmed(run), schema)
        hits = hits if only else materialize(hits, "hits")
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.08) -> DataFrame:
    """The documents in which no benchmark item occurs (see find_contamination),
    all columns as they were: a narrow filter, so nothing is shuffled. With
    several blocks of items what each leaves is written before the next."""
    bound_arrow(docs.sparkSession)
    for items, only in _item_blocks(benchmark, item_col, item_text_col):

        def run(batches: Iterable[pa.RecordBatch], items: list[tuple[int, str]] = items) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(items, rate)
            for part, texts in text_slices(batches, text_col):
                yield part.filter(pa.array([not searcher.search(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
        docs = docs if only else materialize(docs, "clean")
    return docs
