"""Ids of whole texts by a public tokenizer, each distinct unit encoded once.

Texts are handled as UTF-8 in Arrow buffers: one pass of array operations finds
the units, a table of packed units gives their numbers, and the ids are gathered
by number. Only new units reach the tokenizers library."""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerline.llm.common import ASCII_WORD

#: Bytes of text in one pass: what stays in a core's cache.
SLICE_BYTES = 1 << 18
#: Words of texts that are not plain, of which a worker remembers the ids.
_KNOWN_WORDS = 200_000


class UnitTable:
    """Numbers of short byte strings without a zero byte: open addressing, the
    keys being the strings themselves, packed into two integers, so a hit is
    exact."""

    #: Longest string, slots, and strings held at most.
    WIDTH, SLOTS, ROOM = 16, 1 << 21, 1 << 20
    _low = np.array([*((1 << 8 * i) - 1 for i in range(9))], np.uint64)

    def __init__(self) -> None:
        self.keys = np.zeros((self.SLOTS, 2), np.uint64)
        self.numbers = np.zeros(self.SLOTS, np.int32)

    @classmethod
    def packed(cls, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The keys of strings of data, which has WIDTH further bytes behind them."""
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        keys = np.empty((len(starts), 2), np.uint64)
        keys[:, 0] = words[starts] & cls._low[np.minimum(sizes, 8)]
        keys[:, 1] = words[starts + 8] & cls._low[np.clip(sizes - 8, 0, 8)]
        return keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)).astype(np.int64) % self.SLOTS

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is not held."""
        slots = self._slots(keys)
        held = self.keys[slots]
        same = (held[:, 0] == keys[:, 0]) & (held[:, 1] == keys[:, 1])
        out = np.where(same, self.numbers[slots], -1)
        left = np.flatnonzero(~same & (held[:, 0] != 0))
        while len(left):
            slots[left] = (slots[left] + 1) % self.SLOTS
            held = self.keys[slots[left]]
            same = (held == keys[left]).all(1)
            out[left[same]] = self.numbers[slots[left[same]]]
            left = left[~same & (held[:, 0] != 0)]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Take in different keys that are not held yet."""
        slots = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left], 0] == 0]
            self.keys[slots[free]] = keys[free]
            self.numbers[slots[free]] = numbers[free]
            left = left[(self.keys[slots[left]] != keys[left]).any(1)]
            slots[left] = (slots[left] + 1) % self.SLOTS


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each byte of a plain text (as UTF-8), and the byte in lower case.
    Bytes that a plain text does not hold have the kind ODD."""
    kinds, lower = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
    kinds[[*range(0x09, 0x0E), 0x20]] = BLANK
    kinds[0x21:0x7F] = SIGN
    kinds[ord("'")] = ODD
    kinds[ord("0") : ord("9") + 1] = DIGIT
    for first, last in (("A", "Z"), ("a", "z")):
        kinds[ord(first) : ord(last) + 1] = LETTER
    lower[ord("A") : ord("Z") + 1] += 32
    kinds[0xC3] = LETTER  # the lead byte of the Latin-1 letters
    kinds[0x80:0xC0] = LETTER
    kinds[[0x97, 0xB7]] = ODD  # the signs of multiplication and division
    lower[0x80:0x9F] += 32
    return kinds, lower


BLANK, LETTER, DIGIT, SIGN, ODD = range(5)
_KINDS, _LOWER = _byte_kinds()


class WordTokenizer:
    """A tokenizer of the tokenizers library that drops white space and parts
    letters from signs before it merges: the ids of a text are those of its
    words in turn. Each distinct word is encoded by the library once and
    remembered, in bounded tables; tests/llm compare with whole texts.

    A text of plain characters only (ASCII and Latin-1 letters, no apostrophe,
    no mark of a special token) is cut into lower-cased runs of letters, digits
    and runs of signs, which are the library's own units; any other text is cut
    at ASCII white space only. Long texts are taken in pieces that end at white
    space."""

    _made: dict[str, WordTokenizer] = {}
    _letters = re.compile(r"[a-zß-öø-ÿ]+")
    #: Runs of letters that one call encodes together.
    _together = 32

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array.array(self.code).itemsize
        #: Ids of words of texts that are not plain.
        self.known: dict[str, bytes] = {}
        #: Numbers of units; unit i has ids[starts[i] : starts[i + 1]].
        self.units = UnitTable()
        self.held = 0
        self.starts, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, self.code)
        #: Whether an id ends a unit.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.last[i] = piece.endswith("</w>")

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @classmethod
    def forget(cls) -> None:
        """Free the tables of a worker that goes on to other work."""
        cls._made.clear()

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """By the library; runs of letters are one unit each, so one text holds many."""
        plain, other = [], []
        for w in words:
            (plain if self._letters.fullmatch(w) else other).append(w)
        made: dict[str, bytes] = {}
        if other:
            for w, e in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False), strict=True):
                made[w] = array.array(self.code, e.ids).tobytes()
        if plain:
            groups = [" ".join(plain[i : i + self._together]) for i in range(0, len(plain), self._together)]
            data = b"".join(array.array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False))
            ends = ((np.flatnonzero(self.last[np.frombuffer(data, self.code)]) + 1) * self.width).tolist()
            at = 0
            for w, end in zip(plain, ends, strict=True):
                made[w] = data[at:end]
                at = end
        return made

    def _by_words(self, text: str) -> bytes:
        """Ids of a text of any characters."""
        words = ASCII_WORD.findall(text)
        fresh = self._encode_words(list({w for w in words if w not in self.known}))
        ids = b"".join([fresh[w] if w in fresh else self.known[w] for w in words])
        if (room := _KNOWN_WORDS - len(self.known)) > 0:
            self.known.update(islice(fresh.items(), room))
        return ids

    def _number(self, words: list[bytes]) -> int:
        """Give the next numbers to new words, behind those that are held."""
        texts = [w.decode() for w in words]
        made = self._encode_words(texts)
        rows = [made[w] for w in texts]
        first, n = self.held, self.held + len(rows)
        ends = self.starts[first] + np.cumsum([len(r) // self.width for r in rows])
        if n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(n + 1, np.int64)])
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(int(ends[-1]), self.code)])
        self.starts[first + 1 : n + 1] = ends
        self.ids[self.starts[first] : ends[-1]] = np.frombuffer(b"".join(rows), self.code)
        return first

    def _numbers(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each unit; new ones are encoded, and kept while there is
        room for them."""
        long = np.flatnonzero(sizes > UnitTable.WIDTH)
        keys = UnitTable.packed(low, starts, sizes)
        found = self.units.find(keys)
        found[long] = -1
        gaps = np.flatnonzero(found < 0)
        if not len(gaps):
            return found
        gaps = gaps[sizes[gaps] <= UnitTable.WIDTH]
        gaps = gaps[np.lexsort((keys[gaps, 1], keys[gaps, 0]))]
        new = np.ones(len(gaps), bool)
        new[1:] = (keys[gaps[1:]] != keys[gaps[:-1]]).any(1)
        fresh = np.ascontiguousarray(keys[gaps[new]])
        words = fresh.view("S16").ravel().tolist()
        long_words = [low[a:b].tobytes() for a, b in zip(starts[long].tolist(), (starts[long] + sizes[long]).tolist(), strict=True)]
        places = {w: i for i, w in enumerate(dict.fromkeys(long_words), len(words))}
        first = self._number([*words, *places])
        found[gaps] = first + np.cumsum(new) - 1
        found[long] = [first + places[w] for w in long_words]
        kept = min(len(fresh), UnitTable.ROOM - self.held)
        if kept > 0:
            self.units.add(fresh[:kept], np.arange(first, first + kept, dtype=np.int32))
            self.held += kept
        return found

    def _by_units(self, data: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """Ids of the pieces of data between the cuts."""
        kinds = _KINDS[data]
        follows = (data & 0xC0) == 0x80
        odd = kinds == ODD
        odd[:-1] |= (data[:-1] == 0xC3) & ~follows[1:]
        odd[1:] |= follows[1:] & (data[:-1] != 0xC3)
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        places = np.flatnonzero(odd)
        others = np.unique(np.searchsorted(cuts, places, "right") - 1).tolist()
        for i in others:
            kinds[cuts[i] : cuts[i + 1]] = BLANK
        edge = kinds == DIGIT
        edge[1:] |= kinds[1:] != kinds[:-1]
        edge[cuts[:-1][cuts[:-1] < len(data)]] = True
        edge[0] = True
        starts = np.flatnonzero(edge)
        sizes = np.diff(starts, append=len(data))
        whole = kinds[starts] != BLANK
        starts, sizes = starts[whole], sizes[whole]
        low = np.concatenate([_LOWER[data], np.zeros(UnitTable.WIDTH, np.uint8)])
        numbers = self._numbers(low, starts, sizes)
        begins = self.starts[numbers]
        ends = np.cumsum(self.starts[numbers + 1] - begins)
        before = np.concatenate([[0], ends])
        ids = self.ids[np.repeat(begins - before[:-1], np.diff(before)) + np.arange(before[-1])].tobytes()
        at = (before[np.searchsorted(starts, cuts)] * self.width).tolist()
        rows = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in others:
            rows[i] = self._by_words(data[cuts[i] : cuts[i + 1]].tobytes().decode())
        return rows

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text (null: none), as little-endian integers of `width` bytes."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if column.null_count:
            column = pc.fill_null(column, "")
        if not len(column):
            return []
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if offsets[0] == offsets[-1]:
            return [b""] * len(column)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        out: list[bytes] = []
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            low, high = int(offsets[at]), int(offsets[end])
            if low == high:
                out += [b""] * (end - at)
            elif high - low <= SLICE_BYTES:
                out += self._by_units(data[low:high], offsets[at : end + 1] - low)
            else:
                out.append(b"".join(self._by_units(data[a:b], np.array([0, b - a]))[0] for a, b in _pieces(data, low, high)))
            at = end
        return out


def _pieces(data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Cut a long text at white space, each piece of SLICE_BYTES or up to the
    next white space after them."""
    while high - low > SLICE_BYTES:
        end = low + SLICE_BYTES
        while end < high:
            blanks = np.flatnonzero(_KINDS[data[end : min(high, end + 4096)]] == BLANK)
            if len(blanks):
                end += int(blanks[0])
                break
            end = min(high, end + 4096)
        yield low, end
        low = end
    if low < high:
        yield low, high
