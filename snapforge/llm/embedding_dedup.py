"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on ``m`` random directions. The window of a query is centred on it: the cap of the sphere within
``tail`` of a direction that the query itself lies in, that is either end of a sorted projection. Two vectors collide in
each end that holds both. Pairs with ``count`` collisions or more are verified by cosine in double precision. calibrate()
takes the share of all vectors that an end holds from their number, so that an end has about ``END_ROWS`` of them at any
size, and then as many directions as give a pair just at the threshold its count with the wanted recall. It integrates over
the sphere of the vectors' own dimension, so low dimensions, where caps must be wide to hold both of a near pair, are
calibrated like others. Beyond ``DIRECTIONS`` directions ends grow with the number of vectors instead.

Whole projections are not swept: at cosine 0.9 a window that holds both of a near pair holds a quarter of all vectors in the
middle of a projection, and counting there costs more than comparing all pairs.

Each row carries the numbers of all ends its vector is in, so that a pair's collisions are counted where it is met first,
and it is verified there only. What leaves a worker is, for each vector and end, a sum of links and one edge at most, never
pairs. Equal unit vectors are one vector with a multiplicity. Ends are counted before vectors are sent; those longer than
``LIST_ROWS`` are dealt in blocks, and each pair of blocks is a group of its own, so no worker holds more than two blocks.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do vectors of different length
with each other. A null id is carried; it is never kept, and its component is the smallest other id, or null. Rows of one
id are separate rows. Empty tables give empty results. Other columns are not read. The driver holds a number for each
dimension that occurs and for each end longer than LIST_ROWS.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snapforge.llm.common import arrow_map, components, min_labels, written

THRESHOLD = 0.9
RECALL = 0.99
#: Collisions that a pair needs.
COUNT = 2
#: Vectors in an end of a projection, about.
END_ROWS = 256
#: Directions at most.
DIRECTIONS = 8192
#: Longest end that is one group, and rows of the blocks of longer ones.
LIST_ROWS = 512
#: Pairs of a group that are counted at once.
_PAIRS = 1 << 18
_GRID = 20_001


def _angles(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A grid of angles to a direction, and the share of the sphere within each."""
    theta = np.linspace(0, math.pi, _GRID)
    density = np.sin(theta) ** (dim - 2)
    share = np.concatenate(([0.0], np.cumsum((density[1:] + density[:-1]) / 2)))
    return theta, share / share[-1]


def _both(dim: int, angle: float, threshold: float) -> float:
    """How often two vectors at the threshold both lie within ``angle`` of a random direction."""
    theta, share = _angles(dim)
    mid, weight = (theta[1:] + theta[:-1]) / 2, np.diff(share)
    inside = mid <= angle
    mid, weight = mid[inside], weight[inside]
    least = (math.cos(angle) - threshold * np.cos(mid)) / (math.sqrt(1 - threshold**2) * np.sin(mid))
    if dim == 2:
        also = np.where(least <= -1, 1.0, np.where(least <= 1, 0.5, 0.0))
    else:
        t, s = _angles(dim - 1)
        also = np.interp(np.arccos(np.clip(least, -1, 1)), t, s)
    return float((weight * also).sum())


@functools.lru_cache
def calibrate(dim: int, n: int, threshold: float = THRESHOLD, recall: float = RECALL, end_rows: int = END_ROWS, directions: int = DIRECTIONS) -> tuple[int, float]:
    """(directions, tail): ends of about end_rows vectors, wider where few near pairs or too many directions would do."""
    if dim == 1:
        return COUNT, 0.5
    theta, share = _angles(dim)
    q = min(0.25, end_rows / max(1, n))
    while True:
        angle = float(np.interp(q, share, theta))
        p = 2 * _both(dim, angle, threshold)  # both ends
        if p >= 0.4 * q:
            m = COUNT
            while 1 - (1 - p) ** m - m * p * (1 - p) ** (m - 1) < recall:
                m += max(1, m // 32)
            if m <= directions:
                return m, math.cos(angle)
        if q >= 0.5:
            raise ValueError("no calibration for this threshold")
        q = min(0.5, 1.25 * q)


@functools.lru_cache(maxsize=4)
def _directions(dim: int, m: int, seed: int = 11) -> np.ndarray:
    a = np.random.default_rng(seed + dim).normal(size=(dim, m))
    return a / np.linalg.norm(a, axis=0)


def _clean(vectors: DataFrame, vector: str) -> DataFrame:
    """vectors (vec_id, unit): unit holds the unit vector as little-endian doubles, null where it can link with nothing."""

    def run(batches):
        for b in batches:
            unit = []
            for v in b.column("v").to_pylist():
                ok = v is not None and len(v) and None not in v
                x = np.array(v, "<f8") if ok else None
                if not ok or not np.isfinite(x).all() or not x.any():
                    unit.append(None)
                    continue
                x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))  # so that neither very large nor very small ones are lost
                unit.append(((x / np.linalg.norm(x)) + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(unit, pa.binary())], names=["vec_id", "unit"])

    return arrow_map(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")), run, "vec_id long, unit binary")


def _matrix(unit: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(unit), "<f8").reshape(len(unit), -1)


def _ends(batch: pa.RecordBatch, plans: dict[int, tuple[int, float]]):
    """For each dimension of a batch: (dimension, its rows, which of them, in which end), a pair for each membership."""
    unit = batch.column("unit").to_pylist()
    size = np.fromiter(map(len, unit), np.int64, len(unit))
    for width in np.unique(size).tolist():
        rows, (m, tail) = np.flatnonzero(size == width), plans[width // 8]
        step = max(1, (1 << 22) // m)
        for at in range(0, len(rows), step):
            mine = rows[at : at + step]
            v = _matrix([unit[i] for i in mine]) @ _directions(width // 8, m)
            who, which = np.nonzero(np.concatenate((v >= tail, v <= -tail), axis=1))
            yield width // 8, mine, who, which.astype(np.int32)


def _sizes(reps: DataFrame, plans) -> DataFrame:
    """(dim, list, n) of all ends."""

    def run(batches):
        for b in batches:
            for dim, _, _, which in _ends(b, plans):
                lists, n = np.unique(which, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), dim, np.int32)), pa.array(lists), pa.array(n)], names=["dim", "list", "n"])

    return arrow_map(reps.select("unit"), run, "dim int, list int, n long").groupBy("dim", "list").agg(F.sum("n").alias("n"))


def _dealt(reps: DataFrame, plans, blocks: dict[tuple[int, int], int]) -> DataFrame:
    """A row for each end (and pair of blocks) of each vector: (dim, list, one, other, own, node, copies, lists, unit)."""

    def run(batches):
        for b in batches:
            node, copies = b.column("node").to_numpy(), b.column("copies").to_numpy()
            for dim, mine, who, which in _ends(b, plans):
                if not len(who):
                    continue
                n = np.array([blocks.get((dim, x), 1) for x in which.tolist()])
                # block x of n meets all n blocks, itself included
                rows = np.repeat(np.arange(len(who)), n)
                meets = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                own = ((node[mine[who]] & 0x7FFFFFFF) * 2654435761 >> 16) % n
                own = own[rows]
                cuts = np.flatnonzero(np.concatenate((np.diff(who, prepend=-1) > 0, [True])))
                every = {int(who[x]): which[x:y].tobytes() for x, y in zip(cuts, cuts[1:])}
                who, which = who[rows], which[rows]
                ids = mine[who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), dim, np.int32)), pa.array(which), pa.array(np.minimum(own, meets).astype(np.int32)), pa.array(np.maximum(own, meets).astype(np.int32)), pa.array(own.astype(np.int32)),
                     pa.array(node[ids]), pa.array(copies[ids]), pa.array([every[i] for i in who.tolist()], pa.binary()), b.column("unit").take(pa.array(ids))],
                    names=["dim", "list", "one", "other", "own", "node", "copies", "lists", "unit"],
                )

    return arrow_map(reps.select("node", "copies", "unit"), run, "dim int, list int, one int, other int, own int, node long, copies long, lists binary, unit binary")


def _bits(lists: list[bytes], here: int) -> tuple[np.ndarray, int]:
    """Memberships as bits, of the ends that two rows at least are in, in ascending order; and the place of end ``here``."""
    size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    flat = np.frombuffer(b"".join(lists), "<i4")
    known, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lists)), size)
    some = n[at] > 1
    place = np.cumsum(n > 1) - 1
    out = np.zeros((len(lists), -(-int((n > 1).sum()) // 64)), np.uint64)
    p = place[at[some]]
    np.bitwise_or.at(out, (row[some], p // 64), np.uint64(1) << (p % 64).astype(np.uint64))
    return out, int(place[np.searchsorted(known, here)])


def _group(here: int, one: int, other: int, own, node, copies, lists, unit, threshold: float):
    """(node, links, root) of the rows of one group that linked: pairs whose first common end this is, counted and verified."""
    bits, at = _bits(lists, here)
    x = _matrix(unit)
    left = np.arange(len(node)) if one == other else np.flatnonzero(own == one)
    right = left if one == other else np.flatnonzero(own == other)
    none = np.empty(0, np.int64)
    if not len(left) or not len(right):
        return none, none, none
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    word, lower = at // 64, np.uint64((1 << (at % 64)) - 1)
    step = max(1, _PAIRS // len(right))
    for k in range(0, len(left), step):
        mine = left[k : k + step]
        count, earlier = np.zeros((len(mine), len(right)), np.uint16), np.zeros((len(mine), len(right)), bool)
        for w in range(bits.shape[1]):
            both = bits[mine, None, w] & bits[None, right, w]
            count += np.bitwise_count(both)
            if w <= word:
                earlier |= (both if w < word else both & lower) != 0
        i, j = np.nonzero((count >= COUNT) & ~earlier)
        i, j = mine[i], right[j]
        if one == other:
            i, j = i[i > j], j[i > j]
        for c in range(0, len(i), 1 << 14):
            a, b = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[ok], b[ok]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            label = min_labels(len(node), np.concatenate((np.arange(len(node)), a)), np.concatenate((label, b)))
    some = np.flatnonzero(links)
    return node[some], links[some], node[label[some]]


def _judged(threshold: float):
    columns = ("own", "node", "copies", "lists", "unit")

    def flush(key, parts):
        held = [[v for p in c for v in p] if n in ("lists", "unit") else np.concatenate(c) for n, c in zip(columns, zip(*parts))]
        node, links, root = _group(*key[1:], *held, threshold)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])

    def run(batches):
        now, parts = None, []
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("dim", "list", "one", "other")], axis=1)
            if not len(key):
                continue
            edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]))
            for x, y in zip(edges.tolist(), edges[1:].tolist()):
                mine = tuple(key[x].tolist())
                if mine != now:
                    if parts:
                        yield flush(now, parts)
                    now, parts = mine, []
                part = b.slice(x, y - x)
                parts.append([part.column(c).to_pylist() if c in ("lists", "unit") else part.column(c).to_numpy() for c in columns])
        if parts:
            yield flush(now, parts)

    return run


def link(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", threshold: float = THRESHOLD, recall: float = RECALL, end_rows: int = END_ROWS, list_rows: int = LIST_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = written(_clean(vectors.withColumnRenamed(vec_id, "vec_id"), vector), "vectors")
    reps = rows.where("unit is not null").groupBy("unit").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    n = {r.dim: r.n for r in reps.groupBy((F.octet_length("unit") / 8).cast("int").alias("dim")).agg(F.count("*").alias("n")).collect()}
    plans = {dim: calibrate(dim, k, threshold, recall, end_rows) for dim, k in n.items()}
    long_ = _sizes(reps, plans).where(F.col("n") > list_rows).collect()
    blocks = {(r.dim, r.list): -(-r.n // list_rows) for r in long_}
    group = ["dim", "list", "one", "other"]
    dealt = _dealt(reps, plans, blocks).repartition(*group).sortWithinPartitions(*group)
    found = written(arrow_map(dealt, _judged(threshold), "node long, links long, root long"), "vector-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components").withColumnRenamed("root", "r")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.join(links, "node", "left").join(roots, "node", "left").select("unit", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("r", "node").alias("r"))
    smallest = known.groupBy("r").agg(F.min("first").alias("component_id"))
    known = known.join(smallest, "r").select("unit", "n_links", "component_id")
    linked = rows.where("unit is not null").join(known, "unit").select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
