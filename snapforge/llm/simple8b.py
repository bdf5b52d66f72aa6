"""Simple-8b word-aligned coding of token ids.

A word has a selector in its top 4 bits and 60 bits of payload:

    selector  1  2  3  4  5  6  7  8  9 10 11 12 13 14
    ids      60 30 20 15 12 10  8  7  6  5  4  3  2  1
    bits      1  2  3  4  5  6  7  8 10 12 15 20 30 60

Selector 0 is the escape: the next word is one id of 64 bits, as it is. Ids lie in the payload from the lowest bit up.

File format (all integers little-endian):

    magic "S8B1"
    per document: records one after the other, each
        u32 number of ids, u32 number of blocks, u32 number of words
        per block of BLOCK ids: u32 offset of its first word from the record's first word
        words (u64)

A block begins at a word of its own, so blocks are decoded at once, a word's ids by one shift and mask for each place.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
#: Ids in a block.
BLOCK = 256
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)


_EDGES = np.array([1 << int(b) for b in BITS[1:]], np.uint64)
_BITS8 = BITS.astype(np.uint8)


def _bits_needed(ids: np.ndarray) -> np.ndarray:
    """The narrowest width of BITS that holds each id; 64 for those that need the escape."""
    top = int(ids.max()) if len(ids) else 0
    if top < 1 << 20:  # by table, for ids of a vocabulary
        table = _BITS8[np.searchsorted(_EDGES, np.arange(top + 1, dtype=np.uint64), side="right") + 1]
        return table[ids]
    at = np.searchsorted(_EDGES, ids, side="right") + 1
    return _BITS8[np.where(at > 14, 0, at)]


def encode(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Records of the documents whose ids stand one after the other in ``ids`` (unsigned), ``sizes`` each."""
    ids = np.ascontiguousarray(ids, np.uint64)
    sizes = np.asarray(sizes, np.int64)
    doc_start = np.cumsum(sizes) - sizes
    blocks = (sizes + BLOCK - 1) // BLOCK
    first_block = np.cumsum(blocks) - blocks
    n_blocks = int(blocks.sum())
    nth = np.arange(n_blocks) - np.repeat(first_block, blocks)
    size = np.minimum(np.repeat(sizes, blocks) - nth * BLOCK, BLOCK)
    # a row of the grid is a block, padded with ids that need no bits
    inside = np.arange(BLOCK) < size[:, None]
    grid = np.zeros((n_blocks, BLOCK + 60), np.uint64)
    grid[:, :BLOCK][inside] = ids
    bits = np.zeros((n_blocks, BLOCK), np.uint8)
    bits[inside] = _bits_needed(ids)
    selector = _selectors(bits)
    step = COUNTS[selector]
    # all blocks walk from word to word together
    row, at = np.arange(n_blocks), np.zeros(n_blocks, np.int64)
    begins = np.zeros((n_blocks, BLOCK), bool)
    while len(row):
        begins[row, at] = True
        at = at + step[row, at]
        more = at < size[row]
        row, at = row[more], at[more]
    owner, col = np.nonzero(begins)
    sel = selector[owner, col]
    escape = sel == 0
    width = np.where(escape, 2, 1)
    word_at = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[word_at] = sel.astype(np.uint64) << np.uint64(60)
    flat, place = grid.ravel(), owner * grid.shape[1] + col
    words[word_at[escape] + 1] = flat[place[escape]]
    for s in range(1, 15):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            w, p = np.zeros(len(mine), np.uint64), place[mine]
            for j in range(int(COUNTS[s])):
                w |= flat[p + j] << np.uint64(j * int(BITS[s]))
            words[word_at[mine]] |= w
    words_in_block = np.bincount(owner, weights=width, minlength=n_blocks).astype(np.int64)
    block_word = np.cumsum(words_in_block) - words_in_block
    raw, out = words.astype("<u8").tobytes(), []
    word_of = np.concatenate((block_word, [len(words)]))
    lo, hi = word_of[first_block], word_of[first_block + blocks]
    offsets = (block_word - np.repeat(lo, blocks)).astype("<u4").tobytes()
    for m, b, f, x, y in zip(sizes.tolist(), blocks.tolist(), first_block.tolist(), lo.tolist(), hi.tolist()):
        out.append(struct.pack("<III", m, b, y - x) + offsets[4 * f : 4 * (f + b)] + raw[8 * x : 8 * y])
    return out


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For every place of a block the selector that packs most ids from there on; a last word may be part full."""
    best = np.zeros(bits.shape, np.uint8)
    widest, span = bits.copy(), 1
    for s in range(14, 0, -1):
        k = int(COUNTS[s])
        while span < k:  # widest[i] = max(bits[i : i + span])
            grow = min(span, k - span)
            wider = widest.copy()
            np.maximum(widest[:, :-grow], widest[:, grow:], out=wider[:, :-grow])
            widest, span = wider, span + grow
        best[widest <= _BITS8[s]] = s
    return best


def decode(records: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the records (u64), and how many each has."""
    heads = [struct.unpack_from("<III", r) for r in records]
    sizes = np.array([h[0] for h in heads], np.int64)
    blocks = np.array([h[1] for h in heads], np.int64)
    counts = np.array([h[2] for h in heads], np.int64)
    words = np.frombuffer(b"".join(r[12 + 4 * h[1] :] for r, h in zip(records, heads)), "<u8").astype(np.uint64)
    offsets = np.frombuffer(b"".join(r[12 : 12 + 4 * h[1]] for r, h in zip(records, heads)), "<u4").astype(np.int64)
    if len(words) != counts.sum() or len(offsets) != blocks.sum():
        raise ValueError("a record is cut short")
    n = int(sizes.sum())
    out = np.zeros(n, np.uint64)
    if not n:
        return out, sizes
    sel = (words >> np.uint64(60)).astype(np.int64)
    # Raw words follow escapes; in a run of selectors 0 the escapes alternate with raw words, so runs are walked by block.
    raw = _raw_words(sel, offsets + np.repeat(np.cumsum(counts) - counts, blocks))
    head = np.flatnonzero(~raw)
    sel = sel[head]
    block_first = offsets + np.repeat(np.cumsum(counts) - counts, blocks)
    nth = np.arange(len(block_first)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_size = np.minimum(np.repeat(sizes, blocks) - nth * BLOCK, BLOCK)
    block_out = np.cumsum(block_size) - block_size
    owner = np.searchsorted(block_first, head, side="right") - 1
    full = COUNTS[sel]
    ends = np.cumsum(full)
    first_head = np.searchsorted(head, block_first)
    begun = (ends - full) - (ends - full)[first_head][owner]
    place = block_out[owner] + begun
    k = np.minimum(full, block_size[owner] - begun)
    esc = sel == 0
    out[place[esc]] = words[head[esc] + 1]
    for s in range(1, 15):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            w, mask = words[head[mine]], np.uint64((1 << int(BITS[s])) - 1)
            p, m = place[mine], k[mine]
            for j in range(int(COUNTS[s])):
                has = m > j
                if not has.all():
                    w, p, m = w[has], p[has], m[has]
                out[p + j] = (w >> np.uint64(j * int(BITS[s]))) & mask
    return out, sizes


def _raw_words(sel: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which words are the raw word behind an escape. Any word may look like an escape if it is a raw one."""
    raw = np.zeros(len(sel), bool)
    maybe = np.flatnonzero(sel == 0)
    if not len(maybe):
        return raw
    begins = set(starts.tolist())
    last = -2
    for i in maybe.tolist():
        if not (raw[i] and i not in begins):
            if i + 1 < len(raw):
                raw[i + 1] = True
        last = i
    return raw


def read_records(content: bytes) -> list[bytes]:
    """The records of a file."""
    if content[:4] != MAGIC:
        raise ValueError("not a Simple-8b file")
    at, out = 4, []
    while at < len(content):
        _, b, w = struct.unpack_from("<III", content, at)
        to = at + 12 + 4 * b + 8 * w
        if to > len(content):
            raise ValueError("the file is cut short")
        out.append(content[at:to])
        at = to
    return out
