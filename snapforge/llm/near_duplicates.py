"""Documents whose sets of shingles have a Jaccard similarity of THRESHOLD or more, each link verified on the whole sets.

Words are those of simhash.py; a shingle is its XXH64, and a text of fewer words than a shingle has one, all its words.
Texts with the same set are one node from the start. Candidates come by SimHash and anchor points, as in simhash.py, with
PRINTS independent fingerprints of each set: two sets at 0.8 differ in 15 % of all bits, and meet at the home of either in one
of a fingerprint's three segments with probability 0.54, so PRINTS of them miss a pair at just 0.8 with probability 1e-7
(sets of 4 and 5 shingles, 19 % of whose bits differ: 1e-4). What meets and is APART or fewer bits apart on that fingerprint
and the next is a candidate, and a link only if 9 |A & B| >= 4 (|A| + |B|).

First a node is compared with the smallest node only of those it is near to at an anchor, by STARS fingerprints; then all with
all that are near and still in different components, by all fingerprints, so that what is connected by verified links is
connected, and copies cost no pairs. That second time workers first give the nodes only that are near to any, one row a node,
and these alone go to their anchors again, with all their fingerprints: a pair leaves a worker only if all bits of all
fingerprints, and the sizes, allow a similarity of 0.8 (``most_apart``: a pair at 0.8 fails with probability 1e-7 at most), so a
large group of texts that are alike, but not that much, makes no table of its pairs.
Fingerprints go to their anchors a few at a time, which bounds the disk. Whole sets are
compared only where minima of the sets agree in LEAST_AGREEING places or more, judged by four bits of each, which a pair at 0.8
fails with probability 1e-6; most members of a large group of distant copies do. Rows without words are in no component.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snapforge.llm.common import arrow_map, chunks, components, discard, written
from snapforge.llm.simhash import anchors

SHINGLE = 5
SEED = 42
#: Independent fingerprints, and how many of them link what is near in the first place; bits of two of them that candidates differ in.
PRINTS, STARS, APART = 21, 2, 30
#: Fingerprints that are sent at once, and nodes up to which all are.
AT_ONCE, FEW_NODES = 3, 10_000
#: Minima, as BANDS times ROWS.
BANDS, ROWS = 36, 5
MISSED = 1e-6
#: The same for the bits of all fingerprints, and the size of sets from which one bound on them holds.
MISSED_BITS, _LARGE = 1e-7, 64
#: Bits kept of each minimum, and minima in a word.
_NIBBLE, _PER_WORD = 4, 16
_WORDS = -(-BANDS * ROWS // _PER_WORD)
#: Shingles permuted at once, shingles whose votes are counted at once, pairs compared at once, nodes sent and rows met at once.
_BLOCK, _VOTES, _PAIRS, _SENT, _HELD = 2048, 1 << 14, 1 << 21, 2048, 1 << 16


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    k = max(1, min(shingle, len(words)))
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    spans = zip((ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.unique(np.fromiter((xxh64_intdigest(line[i:j], SEED) for i, j in spans), np.uint64))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    factor = r.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
    return factor[:, None], r.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]


def minima(found: np.ndarray, factor: np.ndarray, plus: np.ndarray) -> np.ndarray:
    h = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), _BLOCK):
        np.minimum(out, (h[None, at : at + _BLOCK] * factor + plus).min(axis=1), out=out)
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """How many rows have each bit set, as binary digits, the lowest first: rows are added up three at a time."""
    out = []
    while len(x):
        carried = []
        while len(x) > 1:
            m = max(1, len(x) // 3)
            a, b = x[:m], x[m : 2 * m]
            u = a ^ b
            if len(x) == 2:
                carried.append(a & b)
                x = u
            else:
                c = x[2 * m : 3 * m]
                carried.append((a & b) | (u & c))
                x = np.concatenate((u ^ c, x[3 * m :]))
        out.append(x[0])
        x = np.concatenate(carried) if carried else x[:0]
    return np.array(out)


def prints(found: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints of a set of hashes: a bit is set if it is in over half of them, mixed anew for each fingerprint."""
    k = np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * PRINTS, np.int64)
    for at in range(0, len(found), _VOTES):
        x = (found[at : at + _VOTES, None] ^ k) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        digits = _planes(x)
        counts += (1 << np.arange(len(digits))) @ np.unpackbits(digits.view(np.uint8), axis=1).astype(np.int64)
    return np.packbits(counts * 2 > len(found)).view(np.uint64)


def least_agreeing(similarity: float = 0.8, missed: float = MISSED) -> int:
    """The minima in which all but a share ``missed`` of pairs at ``similarity`` agree at least, chance agreement included."""
    n, p, below = BANDS * ROWS, similarity + (1 - similarity) / 2**_NIBBLE, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > missed:
            return k
    return n


LEAST_AGREEING = least_agreeing()


def differing(n: int, m: int, shared: int) -> float:
    """The probability that a bit differs in the fingerprints of sets of n and m hashes, of which ``shared`` are in both."""
    coins = lambda k: np.array([math.comb(k, i) for i in range(k + 1)], float) / 2.0**k
    over = lambda k: np.array([coins(k - shared)[max(0, k // 2 + 1 - s) :].sum() for s in range(shared + 1)])
    a, b = over(n), over(m)
    return float(coins(shared) @ (a + b - 2 * a * b))


@functools.lru_cache(maxsize=1)
def most_apart() -> np.ndarray:
    """By the size of the smaller set, up to _LARGE for all that are larger: the bits of all fingerprints in which all but a
    share MISSED_BITS of links differ at most."""
    out = []
    for m in range(1, _LARGE + 1):
        worst = max(differing(n, m, -(-4 * (n + m) // 9)) for n in range(m, 5 * m // 4 + 1))
        k, bits, p, beyond = 64 * PRINTS, 64 * PRINTS, worst, 0.0
        while p and k > 0:
            beyond += math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log1p(-p))
            if beyond > MISSED_BITS:
                break
            k -= 1
        out.append(k if p else 0)
    out[-1] = max(out[_LARGE // 2 :])  # what larger sets come to swings less than between these
    return np.array([0, *out])


def nibbles(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, packed in signed longs; places that are left over are zero."""
    small = np.zeros((len(least), _WORDS * _PER_WORD), np.uint64)
    small[:, : least.shape[1]] = (least * np.uint32(2654435761)) >> np.uint32(32 - _NIBBLE)
    shift = np.arange(_PER_WORD, dtype=np.uint64) * np.uint64(_NIBBLE)
    return np.bitwise_or.reduce(small.reshape(len(least), _WORDS, _PER_WORD) << shift, axis=2).view(np.int64)


def _agreeing(a: str, b: str) -> Column:
    """In how many minima two packed arrays agree: the nibbles of their difference that are zero."""
    out = F.lit(BANDS * ROWS)
    for k in range(_WORDS):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        two = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        out = out - F.bit_count(two.bitwiseOR(F.shiftrightunsigned(two, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, n, prints) of each row: node names the set, n is its size."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for whole in batches:
            for b in chunks(whole, "text"):
                sets = [shingles(t) for t in b.column("text").to_pylist()]
                nodes = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(nodes), pa.array(list(map(len, sets)), pa.int32()), _lists(np.array([prints(s) for s in sets]).view(np.int64))], names=["doc_id", "mark", "node", "n", "prints"])

    return arrow_map(docs, run, "doc_id long, mark long, node long, n int, prints array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, n, minima, items) of rows (node, text)."""

    def run(batches):
        factor, plus = _permutations()
        for whole in batches:
            for b in chunks(whole, "text", 500_000):
                sets = [shingles(t) for t in b.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                small = _lists(nibbles(np.array([minima(s, factor, plus) for s in sets])))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.diff(ends)), small, items], names=["node", "n", "minima", "items"])

    return arrow_map(docs, run, "node long, n int, minima array<long>, items array<long>")


_SENT_SCHEMA = "anchor long, node long, root long, p long, q long, home boolean"
_WIDE_SCHEMA = f"{_SENT_SCHEMA}, n int, prints array<long>"
_BUSY_SCHEMA = f"{_SENT_SCHEMA}, known boolean"


def _sent(nodes: DataFrame, which: list[int], schema: str = _SENT_SCHEMA) -> DataFrame:
    """Nodes (node, root, n, prints) at all anchors of some of their fingerprints; q is the fingerprint after p. As ``schema``
    says, with their sizes and all their fingerprints, or whether they are known."""
    names = [x.split()[0] for x in schema.split(", ")]
    wide, block = "prints" in names, _SENT // 16 if "prints" in names else _SENT

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                node, root, n = (b.column(c).to_numpy() for c in ("node", "root", "n"))
                known = b.column("known").to_numpy(zero_copy_only=False) if "known" in names else None
                every = b.column("prints").flatten().to_numpy().view(np.uint64).reshape(-1, PRINTS)
                for k in which:
                    p, q = np.ascontiguousarray(every[:, k]), every[:, (k + 1) % PRINTS]
                    key, i, home = anchors(p)
                    columns = [pa.array(x) for x in (key | np.int64(k) << np.int64(44), node[i], root[i], p[i].view(np.int64), q[i].view(np.int64), home)]
                    more = [pa.array(n[i]), _lists(every[i].view(np.int64))] if wide else [] if known is None else [pa.array(known[i])]
                    yield pa.RecordBatch.from_arrays(columns + more, names=names)

    return arrow_map(nodes, run, schema)


def _nearby(key, root, p, q, home, known=None):
    """(i, j) of rows at home i and rows j that are near at an anchor and have different roots, a block at a time; rows are
    whole anchors, sorted by key. Rows that are both known are not compared."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    start, reach = np.repeat(first, size), np.repeat(size, size)
    homes = np.flatnonzero(home & (reach > 1))
    ends, at = np.cumsum(reach[homes]), 0
    while at < len(homes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        h = homes[at:to]
        at, n = to, reach[h]
        i = np.repeat(h, n)
        j = np.repeat(start[h], n) + (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
        some = np.flatnonzero(root[i] != root[j] if known is None else (root[i] != root[j]) & ~(known[i] & known[j]))
        i, j = i[some], j[some]
        ok = np.bitwise_count(p[i] ^ p[j]).astype(np.int64) + np.bitwise_count(q[i] ^ q[j]) <= APART
        yield i[ok], j[ok]


def _near(key, node, root, p, q, home, star: bool, n=None, every=None, most=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of nodes that are near at an anchor and have different roots. ``star``: of each node at home only that with
    the smallest of them. With sizes n and all fingerprints: only if these allow a link."""
    out = []
    for i, j in _nearby(key, root, p, q, home):
        if every is not None:
            less, more = np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
            fit = 5 * less >= 4 * more
            i, j, less = i[fit], j[fit], less[fit]
            apart = np.zeros(len(i), np.int64)
            for k in range(PRINTS):
                apart += np.bitwise_count(every[i, k] ^ every[j, k])
            ok = apart <= most[np.minimum(less, _LARGE)]
            i, j = i[ok], j[ok]
        if star and len(i):
            begin = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            a, b = node[i[begin]], np.minimum.reduceat(node[j], begin)
        else:
            a, b = node[i], node[j]
        out.append(np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1))
    return tuple(np.concatenate(out, axis=1)) if out else (node[:0], node[:0])


def _at_anchors(sent: DataFrame, compare, schema: str) -> DataFrame:
    """What ``compare(columns, memo)`` makes of all rows of some anchors, as columns; memo is a dictionary that each task has."""
    names = [x.split()[0] for x in schema.split(", ")]
    fields = [f.name for f in sent.schema.fields]

    def run(batches):
        held, rows, limit, memo = [], 0, _HELD, {}

        def done(table):
            columns = {c: table.column(c).to_numpy() for c in fields if c != "prints"}
            if "prints" in fields:
                columns["prints"] = table.column("prints").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PRINTS)
            out = compare(columns, memo)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("anchor").to_numpy()
            end = int(np.searchsorted(key, key[-1]))  # the last anchor may go on
            if end:
                yield from done(table.slice(0, end))
            held, rows = table.slice(end).to_batches(), len(key) - end
            limit = max(_HELD, 2 * rows)
        if rows:
            yield from done(pa.Table.from_batches(held))

    return arrow_map(sent.repartition("anchor").sortWithinPartitions("anchor"), run, schema)


def _met(nodes: DataFrame, which: list[int], star: bool) -> DataFrame:
    """(a, b), distinct, of nodes (node, root, n, prints), by some fingerprints; all but ``star`` only if all fingerprints allow
    a link."""
    most = most_apart()

    def compare(c, memo):
        return _near(*(c[x] for x in ("anchor", "node", "root", "p", "q", "home")), star, *(() if star else (c["n"], c["prints"], most)))

    return _at_anchors(_sent(nodes, which, _SENT_SCHEMA if star else _WIDE_SCHEMA), compare, "a long, b long").distinct()


def _busy(nodes: DataFrame, which: list[int]) -> DataFrame:
    """(node), distinct: nodes of (node, root, n, prints, known) that are near to any by some fingerprints, have another root
    and are not known yet."""

    def compare(c, memo):
        near = np.zeros(len(c["node"]), bool)
        for i, j in _nearby(*(c[x] for x in ("anchor", "root", "p", "q", "home", "known"))):
            near[i] = near[j] = True
        new = np.setdiff1d(c["node"][near & ~c["known"]], memo.get("seen", c["node"][:0]))
        memo["seen"] = np.union1d(memo["seen"], new) if "seen" in memo else new
        return (new,)

    return _at_anchors(_sent(nodes, which, _BUSY_SCHEMA), compare, "node long").distinct()


def _sizes_fit(a: str, b: str) -> Column:
    return F.expr(f"5 * least({a}, {b}) >= 4 * greatest({a}, {b})")


def _verified(pairs: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are links."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reps = nodes.join(asked, "node", "left_semi").select("node", F.col("row.doc_id").alias("rep"), F.col("row.mark").alias("mark"))
    found = own.join(reps, (own["mark"] == reps["mark"]) & own["doc_id"].eqNullSafe(reps["rep"])).select("node", "text")
    sets = written(_sets(found).dropDuplicates(["node"]), "near-sets")
    end = lambda x, columns: sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    both = pairs.join(end("a", ["n", "minima"]), "a").join(end("b", ["n", "minima"]), "b")
    alike = written(both.where(_sizes_fit("a_n", "b_n") & (_agreeing("a_minima", "b_minima") >= LEAST_AGREEING)).select("a", "b"), "near-alike")
    whole = alike.join(end("a", ["items"]), "a").join(end("b", ["items"]), "b")
    links = written(whole.where("9 * size(array_intersect(a_items, b_items)) >= 4 * (size(a_items) + size(b_items))").select("a", "b"), "near-links")
    for used in (sets, alike):
        discard(used)
    return links


def _sendings(each: int) -> list[list[int]]:
    each = max(1, min(PRINTS, each))
    return [list(range(k, min(PRINTS, k + each))) for k in range(0, PRINTS, each)]


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, component) of the rows of (doc_id, text) that have words; mark is the text's xxhash64."""
    own = docs.where(has_words(F.col("text"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    signed = written(_signed(own.select("doc_id", "mark", "text")), "near-signed")
    nodes = written(signed.groupBy("node").agg(F.first("n").alias("n"), F.first("prints").alias("prints"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("row")), "near-nodes")

    apart = nodes.select("node", F.col("node").alias("root"), "n", "prints")
    tried = written(_met(apart, list(range(STARS)), True), "near-tried")
    links = _verified(tried, own, nodes)
    roots = written(components(links, "near-star"), "near-roots")

    rooted = written(nodes.select("node", "n", "prints").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "prints"), "near-rooted")
    near: list[DataFrame] = []
    for which in _sendings(PRINTS if nodes.count() <= FEW_NODES else AT_ONCE):
        known = rooted.join(_union(near).withColumn("known", F.lit(True)), "node", "left").withColumn("known", F.coalesce("known", F.lit(False))) if near else rooted.withColumn("known", F.lit(False))
        near.append(written(_busy(known, which), "near-busy"))
    busy = written(rooted.join(_union(near), "node", "left_semi"), "near-again")
    met = [written(_met(busy, which, False), "near-met") for which in _sendings(AT_ONCE * FEW_NODES // max(1, busy.count()))]
    pairs = written(_union(met).distinct().join(tried, ["a", "b"], "left_anti"), "near-pairs")
    more = _verified(pairs, own, nodes)
    # what the stars connected stands as one edge a node
    known = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    whole = written(components(known.unionByName(more), "near-links"), "near-whole")
    for used in (nodes, tried, links, roots, rooted, *near, busy, *met, pairs, more):
        discard(used)
    return signed.select("doc_id", "mark", "node").join(whole, "node", "left").select("doc_id", "mark", F.coalesce("root", "node").alias("component"))
