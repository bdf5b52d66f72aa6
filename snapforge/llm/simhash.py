"""SimHash near-duplicates by anchor points.

The 64 bits are cut into so many segments that fingerprints within the distance differ in at most one bit of one of them:
3 segments of 22, 21 and 21 bits for ``DISTANCE``, 5 for 9 bits. For each segment the anchors are a covering code: a
perfect Hamming code on its first 15 bits (7 in segments under 15 bits), every word on the rest; each segment value has
exactly one anchor within the covering radius 1, its home. A fingerprint is sent to every anchor within radius plus
threshold (1 + 1) of each segment, 12 to 16, so two fingerprints that are near in a segment meet at the home of either.
At an anchor the fingerprints at home are compared with all that came, on all 64 bits.

Documents with equal fingerprints are one fingerprint from the start, so copies cost nothing further. Pairs do not leave a
worker: it joins linked fingerprints as it goes and gives one edge at most for each fingerprint it got, which keeps what
is connected connected. An anchor's members stream through in blocks, so a worker's memory is bounded by one anchor's
fingerprints (16 bytes each). Components come from large-star and small-star steps on these edges.

Words are runs of anything but space and U+0009-U+000D, with A-Z lower-cased; shingles are 4 words joined by a space, each
counted as often as it occurs; with fewer words the whole sequence is the only shingle. A bit is set if it is set in over
half of the shingles' XXH64 (seed 42). No words, or a null text: fingerprint 0, which links like any other. A null id is
carried; a component without any other id is null. Rows with equal ids are separate rows. Empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snapforge.llm.common import arrow_map, chunks, components, min_labels, written

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Shingles hashed at once.
_HASHES = 1 << 17
#: Pairs compared at once.
_PAIRS = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    votes, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, _HASHES):
        to = min(n, at + _HASHES)
        hashes = np.fromiter((xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())), np.uint64, to - at)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print): print holds the 64 bits as a signed long."""

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                prints = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, print long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment: enough of them for one to differ in a bit at most."""
    n = distance // 2 + 1
    edges = [-(-64 * i // n) for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


@functools.lru_cache(maxsize=4)
def _syndromes(code_bits: int) -> np.ndarray:
    """For each word, the xor of the (one-based) places of its bits: 0 for a codeword, else the place that is off."""
    words, out = np.arange(1 << code_bits), np.zeros(1 << code_bits, np.int64)
    for place in range(code_bits):
        out ^= np.where(words >> place & 1, place + 1, 0)
    return out


def anchors(prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into prints, at home) for all anchors that each fingerprint (u64) is sent to."""
    keys, index, home = [], [], []
    for seg, (low, bits) in enumerate(segments(distance)):
        code_bits = 15 if bits >= 15 else 7
        if bits < code_bits:
            raise ValueError("the distance is too large for these codes")
        value = (prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        code = (value & np.uint64((1 << code_bits) - 1)).astype(np.int64)
        rest = (value >> np.uint64(code_bits)).astype(np.int64)
        s = _syndromes(code_bits)[code]
        nearest = code ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)
        extra = bits - code_bits
        flips1 = [1 << i for i in range(extra)]
        flips2 = [1 << i | 1 << j for i, j in itertools.combinations(range(extra), 2)]

        def send(who: np.ndarray, word: np.ndarray, masks: list[int], at_home: bool) -> None:
            for m in masks:
                keys.append((np.int64(seg) << np.int64(40)) | ((rest[who] ^ m) << code_bits) | word)
                index.append(who)
                home.append(np.full(len(who), at_home))

        everyone = np.arange(len(prints))
        send(everyone, nearest, [0], True)
        exact, other = np.flatnonzero(s == 0), np.flatnonzero(s > 0)
        send(exact, nearest[exact], flips1 + flips2, False)
        send(other, nearest[other], flips1, False)
        for a in range(1, code_bits + 1):  # codewords two flips away: places a < b with a xor b = syndrome
            b = s[other] ^ a
            ok = b > a
            who = other[ok]
            send(who, code[who] ^ (1 << (a - 1)) ^ (1 << (b[ok] - 1)), [0], False)
    return np.concatenate(keys), np.concatenate(index), np.concatenate(home)


def _spread(prints: DataFrame, distance: int) -> DataFrame:
    def run(batches):
        for b in batches:
            p = b.column("print").to_numpy().view(np.uint64)
            if len(p):
                key, at, home = anchors(p, distance)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(p[at].view(np.int64)), pa.array(home)], names=["anchor", "print", "home"])

    return arrow_map(prints, run, "anchor long, print long, home boolean")


def _linked(homes: np.ndarray, others: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between near fingerprints of one anchor, compared in blocks; few of them: what is linked already is joined."""
    nodes = np.unique(np.concatenate((homes, others)))
    h, o = np.searchsorted(nodes, homes), np.searchsorted(nodes, others)
    label = np.arange(len(nodes))
    step = max(1, _PAIRS // max(1, len(o)))
    for at in range(0, len(h), step):
        near = np.bitwise_count(homes[at : at + step, None] ^ others[None, :]) <= distance
        i, j = np.nonzero(near)
        label = min_labels(len(nodes), np.concatenate((np.arange(len(nodes)), h[at : at + step][i])), np.concatenate((label, o[j])))
    apart = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[apart], nodes[label[apart]]


def _compare(distance: int):
    def run(batches):
        held_key, held_print, held_home = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool))
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held_key = np.concatenate((held_key, b.column("anchor").to_numpy()))
                held_print = np.concatenate((held_print, b.column("print").to_numpy().view(np.uint64)))
                held_home = np.concatenate((held_home, b.column("home").to_numpy(zero_copy_only=False)))
                if len(held_key) < 1 << 16 or held_key[0] == held_key[-1]:
                    continue
                end = int(np.searchsorted(held_key, held_key[-1]))  # the last anchor may go on
            else:
                end = len(held_key)
            if end:
                a, c = _edges(held_key[:end], held_print[:end], held_home[:end], distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["a", "b"])
            held_key, held_print, held_home = held_key[end:], held_print[end:], held_home[end:]

    return run


def _edges(key: np.ndarray, prints: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of many whole anchors, sorted by key."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.concatenate((first[1:], [len(key)]))
    n_home = np.add.reduceat(home.astype(np.int64), first)
    size = last - first
    work = n_home * size
    out_a, out_b = [], []
    for g in np.flatnonzero(work > _PAIRS):  # large anchors one by one
        p, h = prints[first[g] : last[g]], home[first[g] : last[g]]
        a, b = _linked(p[h], p, distance)
        out_a.append(a)
        out_b.append(b)
    small = np.flatnonzero((work <= _PAIRS) & (n_home > 0) & (size > 1))
    ends = np.cumsum(work[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        g = small[at:to]
        at = to
        members = np.concatenate([np.arange(first[x], last[x]) for x in g]) if len(g) < 64 else _ranges(first[g], last[g])
        group = np.repeat(np.arange(len(g)), size[g])
        homes = members[home[members]]
        hg = group[home[members]]
        reach = size[g][hg]
        i = np.repeat(homes, reach)
        j = np.repeat(first[g][hg], reach) + (np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach))
        near = (i != j) & (np.bitwise_count(prints[i] ^ prints[j]) <= distance)
        if near.any():
            x, y = prints[i[near]], prints[j[near]]
            nodes = np.unique(np.concatenate((x, y)))
            label = min_labels(len(nodes), np.searchsorted(nodes, x), np.searchsorted(nodes, y))
            apart = np.flatnonzero(label != np.arange(len(nodes)))
            out_a.append(nodes[apart])
            out_b.append(nodes[label[apart]])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def link(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest id reachable by links."""
    prints = written(fingerprints(docs, text, doc_id, shingle), "simhash-prints")
    distinct = written(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    met = _spread(distinct.select("print"), distance).repartition("anchor").sortWithinPartitions("anchor")
    roots = components(arrow_map(met, _compare(distance), "a long, b long"), "simhash-links")
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root"), "first")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
