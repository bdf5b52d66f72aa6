"""Substring dedup with suffix automata: words of passages that occurred before are removed.

A window is ``WINDOW`` words in a row. One whose words also start earlier (in a document before, or further up in the
same one) is a repeat, and the words that repeats cover are removed; windows are judged on the input.

Candidates: each window has an anchor, the least hash of the ``GRAM``-word groups in it, so equal windows have equal
anchors. Anchors that occur twice or more in the corpus are shared, and each has an owner, the first document that has
it. Runs of windows whose anchors have one owner form a segment, and segments go to their owner's shard: all occurrences
of a window meet there. A shard streams its segments in document order past a suffix automaton of what came before
(matching statistics: the longest match that ends at each word); windows that match whole are repeats, and only runs of
others enter the automaton, word by word, so that repeats within a run are seen too. So automata go to where matches can
be, not to every worker, and hold each passage once.

Bounds: an automaton takes ``SHARD_WORDS`` words; windows that it does not match after that are settled by their 128-bit
hashes, the earliest being kept, in a grouped minimum that is combined before the shuffle. Anchors that occur over
``HOT`` times are dealt by document over several shards; what is first in such a shard is settled in the same way.

Words are runs of anything but space and U+0009-U+000D, compared by 64-bit hashes. Nulls: a null text has no words; null
ids come before all others. Rows of one id with different texts come in the order of a hash of the text; rows equal in
both are one document, and each gets its result. Empty texts have nothing removed. Other columns are carried; those named
n_words, n_removed or kept are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from snapforge.llm.common import arrow_map, chunks, discard, written

WINDOW, GRAM = 20, 8
SHARD_WORDS = 150_000
HOT = 20_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: tuple = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = tuple(out)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """All words of some texts: hashes, byte places, and which words belong to which text."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.bytes = b" ".join(raw) + b" "
        begin = np.cumsum(size + 1) - size - 1
        buf = np.frombuffer(self.bytes, np.uint8)
        space = _SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(buf) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        power, inverse = _power_tables(len(buf) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)])))
        self.hash = _mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, begin)
        self.last = np.searchsorted(self.start, begin + size)
        self.text = np.repeat(np.arange(len(raw)), self.last - self.first)


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every n neighbours."""
    span = 1
    while span < n:
        step = min(span, n - span)
        x = op(x[: len(x) - step], x[step:])
        span += step
    return x


def _rolled(h: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """Hashes of every n words in a row."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = out * np.uint64(base) + h[j : len(h) - n + 1 + j]
    return _mix(out)


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all windows that lie in one text, the anchor of each, the places of distinct anchors as (text, anchor) rows)."""
    none = np.empty(0, np.int64)
    if len(w.hash) < WINDOW:
        return none, none.astype(np.uint64), none
    grams = _rolled(w.hash, GRAM)
    span = WINDOW - GRAM + 1
    least = _slide(grams, span, np.minimum)
    valid = w.text[: len(least)] == w.text[WINDOW - 1 :]
    pad = np.zeros(span - 1, np.uint64)
    cover = _slide(np.concatenate((pad, np.where(valid, least, np.uint64(0)), pad)), span, np.maximum)
    return np.flatnonzero(valid), least[valid], np.flatnonzero((cover == grams) & (cover > 0))


def _key(doc_id: str):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                w = Words(b.column("text").to_pylist())
                _, _, places = anchors(w)
                if len(places):
                    grams = _rolled(w.hash, GRAM)[places]
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(b.column("doc").to_numpy()[w.text[places]])], names=["anchor", "doc"])

    return arrow_map(docs.select("doc", "text"), run, "anchor long, doc long")


def _segments(found: DataFrame, hot: int) -> DataFrame:
    """Rows (owner, salt, doc, print, start, words) from (doc, print, text, hits)."""

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                w = Words(b.column("text").to_pylist())
                starts, anchor, _ = anchors(w)
                hits, docs, prints = b.column("hits"), b.column("doc").to_numpy(), b.column("print").to_numpy()
                lo, hi = np.searchsorted(w.text[starts], np.arange(b.num_rows)), np.searchsorted(w.text[starts], np.arange(b.num_rows), side="right")
                out = []
                for i in range(b.num_rows):
                    at, mine = starts[lo[i] : hi[i]], anchor[lo[i] : hi[i]]
                    known = hits[i].values
                    key = known.field("anchor").to_numpy().view(np.uint64)
                    order = np.argsort(key)
                    key = key[order]
                    place = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                    shared = key[place] == mine
                    owner = known.field("owner").to_numpy()[order][place]
                    deal = known.field("n").to_numpy()[order][place] // hot
                    salt = np.where(deal > 0, 1 + np.abs(docs[i] * 1_000_003 + prints[i]) % (deal + 1), 0)
                    run_end = np.flatnonzero((shared[:-1] != shared[1:]) | (owner[:-1] != owner[1:]) | (salt[:-1] != salt[1:])) + 1 if len(at) else np.empty(0, np.int64)
                    edges = [0, *run_end.tolist(), len(at)]
                    for x, y in zip(edges, edges[1:]):
                        if y > x and shared[x]:
                            s, e = int(at[x]), int(at[y - 1]) + WINDOW
                            out.append((int(owner[x]), int(salt[x]), int(docs[i]), int(prints[i]), s - int(w.first[i]), w.hash[s:e].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["owner", "salt", "doc", "print", "start", "words"])

    return arrow_map(found, run, "owner long, salt int, doc long, print long, start long, words binary")


class Automaton:
    """Suffix automaton of several word sequences, extended word by word."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def match(self, words: list[int]) -> list[int]:
        """For each word the length of the longest match that ends there."""
        nxt, link, size = self.next, self.link, self.len
        state, n, out = 0, 0, []
        for c in words:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = size[state]
                to = nxt[state].get(c)
            if to is not None:
                state, n = to, n + 1
            out.append(n)
        return out

    def add(self, words: list[int]) -> list[int]:
        """Adds a sequence; for each word, the longest match ending there that starts earlier, in the sequence itself too."""
        nxt, link, size = self.next, self.link, self.len
        last, state, n, out = 0, 0, 0, []
        for c in words:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = size[state]
                to = nxt[state].get(c)
            if to is not None:
                state, n = to, n + 1
            out.append(n)
            last = self._extend(last, c)
            while state and size[link[state]] >= n:  # the state may have been split
                state = link[state]
        return out

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None:
            return q if size[q] == size[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist()))


class Shard:
    """Segments of one owner in document order: which windows are repeats, and which stay open."""

    def __init__(self, salted: bool, limit: int):
        self.automaton, self.words, self.salted, self.limit = Automaton(), 0, salted, limit

    def take(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(repeat, open): flags of the segment's windows."""
        h = np.frombuffer(raw, np.uint64)
        n = len(h) - WINDOW + 1
        words = h.tolist()
        repeat = np.zeros(n, bool)
        if self.words:
            repeat = np.array(self.automaton.match(words)[WINDOW - 1 :]) >= WINDOW
        late = np.zeros(n, bool)
        for x, y in _runs(~repeat):
            if self.words > self.limit:
                late[x:y] = True
                continue
            self.words += y - x + WINDOW - 1
            again = np.array(self.automaton.add(words[x : y + WINDOW - 1])[WINDOW - 1 :]) >= WINDOW
            repeat[x:y] |= again
        return repeat, ~repeat if self.salted else late


def _shards(limit: int):
    schema = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("print", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        now, shard, before, out = None, None, None, [[] for _ in schema]
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("owner", "salt", "doc", "print", "start", "words"))):
                if row[:2] != now:
                    now, shard, before = row[:2], Shard(row[1] > 0, limit), None
                if row[2:5] == before:
                    continue
                before = row[2:5]
                doc, print_, start, raw = row[2:]
                repeat, late = shard.take(raw)
                for x, y in _runs(repeat):
                    for c, v in zip(out, (0, doc, print_, start + x, start + y, None, None)):
                        c.append(v)
                if late.any():
                    h = np.frombuffer(raw, np.uint64)
                    a, d = _rolled(h, WINDOW).view(np.int64), _rolled(h, WINDOW, 0xD1342543DE82EF95).view(np.int64)
                    for x in np.flatnonzero(late).tolist():
                        for c, v in zip(out, (1, doc, print_, start + x, start + x + 1, int(a[x]), int(d[x]))):
                            c.append(v)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in schema]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(doc, print, start, stop): runs of windows that occurred before; doc is the id (null: the least long), print a hash of the text."""
    rows = docs.select(_key(doc_id).alias("doc"), F.col(text).alias("text"))
    found = written(_anchor_rows(rows), "anchors")
    # written, so that both sides of the join come straight from a shuffle and a hot anchor's side can be split
    shared = written(found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc").alias("owner")).where("n > 1"), "shared-anchors")
    hits = written(found.join(shared, "anchor").groupBy("doc").agg(F.collect_list(F.struct("anchor", "owner", "n")).alias("hits")), "anchor-hits")
    discard(found)
    discard(shared)
    segments = _segments(rows.select("doc", F.xxhash64("text").alias("print"), "text").join(hits, "doc"), hot)
    dealt = segments.repartition("owner", "salt").sortWithinPartitions("owner", "salt", "doc", "print", "start")
    judged = written(arrow_map(dealt, _shards(shard_words), "kind byte, doc long, print long, start long, stop long, h1 long, h2 long"), "judged-windows")
    open_ = judged.where("kind = 1")
    first = open_.groupBy("h1", "h2").agg(F.min(F.struct("doc", "print", "start")).alias("first"))
    later = open_.join(first, ["h1", "h2"]).where(F.struct("doc", "print", "start") != F.col("first"))
    return judged.where("kind = 0").select("doc", "print", "start", "stop").unionByName(later.select("doc", "print", "start", "stop"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "words", **kw) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (binary: the kept words joined by one space)."""
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept")]
    spans = repeats(docs, text, doc_id, **kw).groupBy(F.col("doc").alias("d"), F.col("print").alias("p")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = docs.select(F.struct(*names).alias("row"), _key(doc_id).alias("doc"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    joined = rows.join(spans, (F.col("doc") == F.col("d")) & (F.col("print") == F.col("p")), "left")
    carried = [n for n in names if n != text] if text in names else names
    joined = joined.select(*[F.col("row").getField(n).alias(f"c{i}") for i, n in enumerate(carried)], F.col("text").alias("the_text"), "spans")

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "the_text"):
                w = Words(b.column("the_text").to_pylist())
                gone = np.zeros(len(w.hash) + 1, np.int64)
                spans_ = b.column("spans")
                for i in range(b.num_rows):
                    if spans_[i].is_valid:
                        s = spans_[i].values
                        at = w.first[i]
                        np.add.at(gone, at + s.field("start").to_numpy(), 1)
                        np.add.at(gone, at + s.field("stop").to_numpy() + WINDOW - 1, -1)
                drop = np.cumsum(gone)[:-1] > 0
                removed = np.bincount(w.text[drop], minlength=b.num_rows)
                kept = []
                for i in range(b.num_rows):
                    x, y = int(w.first[i]), int(w.last[i])
                    part = w.bytes[w.start[x] : w.end[y - 1]].split() if y > x else []
                    if removed[i]:
                        part = [p for p, d in zip(part, drop[x:y].tolist()) if not d]
                    kept.append(b" ".join(part))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], pa.array(w.last - w.first), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary())], names=[*b.schema.names[: len(carried)], "n_words", "n_removed", "kept"])

    schema = T.StructType(joined.schema.fields[: len(carried)] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])
    out = arrow_map(joined, run, schema)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(carried)], "n_words", "n_removed", "kept")
