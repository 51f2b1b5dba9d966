"""Canonical length-limited Huffman codes over integer ids, vectorised.

Lengths come from package-merge (optimal under the limit); codes are canonical,
so the lengths alone define them. Bits are written most significant first, and
every document starts at a byte. A document has a checkpoint, the bit offset
from its start, at every `SEGMENT` ids; segments decode independently and all
segments of a block decode in step through one lookup table."""

from __future__ import annotations

import numpy as np

#: Ids between two checkpoints of a document.
SEGMENT = 128


def code_lengths(counts: np.ndarray, limit: int = 18) -> np.ndarray:
    """Code length per id (0: does not occur), at most `limit` bits, or as many
    as the number of occurring ids needs. Package-merge."""
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    levels = []
    merged, is_leaf = leaves, np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(limit - 1):
        half = len(merged) // 2
        packages = merged[0 : 2 * half : 2] + merged[1 : 2 * half : 2]
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        merged, is_leaf = both[at], at < n
        levels.append(is_leaf)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        chosen = is_leaf[:take]
        own = int(chosen.sum())
        depth[:own] += 1
        take = 2 * (len(chosen) - own)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code per id: by length, then by id, counting up."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sizes = np.bincount(lengths[order], minlength=1)
    at = 0
    for length in range(1, len(sizes)):
        code <<= length - before
        n = int(sizes[length])
        codes[order[at : at + n]] = code + np.arange(n, dtype=np.uint32)
        code, at, before = code + n, at + n, length
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, bits): entry for each `bits`-bit prefix is id << 6 | length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = int(lengths.max(initial=1))
    spans = np.left_shift(np.int64(1), bits - lengths[order].astype(np.int64))
    table = np.zeros(1 << bits, np.int64)
    filled = np.repeat((order.astype(np.int64) << 6) | lengths[order], spans)
    table[: len(filled)] = filled
    return table, bits


def encode(ids: np.ndarray, starts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """Encode documents laid end to end (starts: first id of each, plus the
    end). Returns the payload, the byte offset of each document (plus the end)
    and for each document the bit offsets of its segments."""
    n_docs = len(starts) - 1
    if not len(ids):
        return b"", np.zeros(n_docs + 1, np.int64), [np.zeros(0, np.int64)] * n_docs
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    before = np.concatenate([[0], ends])[starts]
    doc_bytes = (np.diff(before) + 7) >> 3
    at_byte = np.concatenate([[0], np.cumsum(doc_bytes)])
    counts = np.diff(starts)
    within = ends - size - np.repeat(before[:-1], counts)
    at = within + np.repeat(at_byte[:-1] * 8, counts)
    checkpoints = [within[a:b:SEGMENT] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    code = codes[ids].astype(np.uint64)
    over = (at & 63) + size - 64
    crossing = np.flatnonzero(over > 0)
    own = code << np.maximum(-over, 0).astype(np.uint64)
    own[crossing] = code[crossing] >> over[crossing].astype(np.uint64)
    word = at >> 6
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((int(at_byte[-1]) >> 3) + 2, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(own, first)
    out[word[crossing] + 1] |= code[crossing] << (64 - over[crossing]).astype(np.uint64)
    return out.byteswap().tobytes()[: int(at_byte[-1])], at_byte, checkpoints


def decode(payload: bytes, offsets: np.ndarray, counts: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Ids of all segments of a payload in their order: bit offset and number of
    ids of each. All segments advance together, one id a step."""
    data = np.frombuffer(payload + b"\0" * 8, np.uint8)
    order = np.argsort(-counts, kind="stable")
    at, left = offsets[order].astype(np.int64), counts[order]
    place = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
    out = np.empty(int(counts.sum()), np.uint32)
    windows = data.astype(np.uint64)
    words = (windows[:-4] << np.uint64(32)) | (windows[1:-3] << np.uint64(24)) | (windows[2:-2] << np.uint64(16)) | (windows[3:-1] << np.uint64(8)) | windows[4:]
    words = words.view(np.int64)
    mask = (1 << bits) - 1
    live = len(at)
    alive = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), "right")
    for step, live in enumerate(alive.tolist()):
        pos = at[:live]
        entry = table[(words[pos >> 3] >> (40 - bits - (pos & 7))) & mask]
        out[place[:live] + step] = entry >> 6
        pos += entry & 63
    return out
