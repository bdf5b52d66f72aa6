import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapforge.llm import common, embedding_dedup, line_dedup, simhash, substring


def components(n, edges):
    return common.min_labels(n, *(np.array(x, int) for x in (zip(*edges) if edges else ((), ()))))


def test_components_over_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and 200 not in got


def test_unfinished_components_are_an_error(spark):
    with pytest.raises(RuntimeError):
        common.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=2)


# SimHash


@pytest.mark.parametrize("distance", [4, 9])
def test_anchors_bring_near_fingerprints_together(distance):
    r = np.random.default_rng(distance)
    a = r.integers(0, 2**64, 800, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in r.choice(64, r.integers(0, distance + 1), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    homes, sent = [set() for _ in a], [set() for _ in a]
    for key, i, home in zip(*simhash.anchors(a, distance)):
        if home:
            homes[i].add(key)
    for key, i, _ in zip(*simhash.anchors(b, distance)):
        sent[i].add(key)
    assert all(x & y for x, y in zip(homes, sent))


def test_groups_are_those_of_all_pairs(docs, odd):
    r = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(30)]
    for i in range(30, 150):
        w = r.choice(rows[:30])[1].split()
        for _ in range(r.choice([0, 1, 2])):
            w[r.randrange(60)] = r.choice(words)
        rows.append((i, " ".join(w).title()))
    df = docs(rows).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    got = simhash.link(df).collect()
    texts = [(x.doc_id, x.text) for x in df.collect()]
    prints = [simhash.fingerprint(t) for _, t in texts]
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    label = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    least = {}
    for (i, _), c in zip(texts, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, format(p, "016x"), least.get(c)) for (i, _), p, c in zip(texts, prints, label)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_simhash_of_nothing(docs):
    assert simhash.link(docs([])).count() == 0


# Embeddings


def brute_links(rows, threshold=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, edges = [0] * len(rows), []
    for a in ok:
        for b in ok:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    edges.append((a, b))
    label = components(len(rows), edges)
    return [(rows[i][0], links[i], min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])) for i in range(len(rows))]


@pytest.mark.parametrize("list_rows", [50_000, 5])
def test_embedding_links(spark, list_rows):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=32).tolist()) for i in range(120)]
    for i in range(120, 300):
        v = np.array(rows[r.integers(0, 60)][1])
        rows.append((i, (v * r.uniform(0.1, 9) + r.normal(size=32) * 0.02).tolist()))
    rows += [(300, None), (301, [0.0] * 32), (302, [float("nan")] * 32), (303, [None] * 32), (304, []), (305, rows[0][1]), (306, [2.0]), (307, [5.0]), (308, [float("inf")] * 32)]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list_rows=list_rows).collect()
    want = brute_links(rows)
    found = {g.vec_id: g for g in got}
    assert len(got) == len(rows) and all(found[i].component_id <= i for i, _, _ in want)
    assert sum(g.n_links for g in got) >= 0.98 * sum(n for _, n, _ in want)
    assert all(found[i].n_links <= n for i, n, _ in want)
    assert sum(found[i].component_id == c for i, _, c in want) >= 0.98 * len(want)
    assert all(g.kept == (g.vec_id == g.component_id) for g in got)
    assert found[307].component_id == 306 and found[306].n_links == found[307].n_links == 1


def test_recall_just_over_the_threshold(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(400):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= a * (a @ b)
        c = r.uniform(0.9001, 0.92)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist())]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.95 * 800


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 8, 64, 384])
def test_recall_in_any_dimension(spark, dim):
    """Ends of 20 vectors about, so that calibration works as on large tables; all true pairs by brute force."""
    r = np.random.default_rng(dim)
    x = r.normal(size=(500, dim))
    if dim > 4:
        for k in range(200, 500):  # near pairs, many of them just over the threshold
            a = x[k - 200] / np.linalg.norm(x[k - 200])
            b = r.normal(size=dim)
            b -= a * (a @ b)
            c = r.uniform(0.9001, 0.95)
            x[k] = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    got = {g.vec_id: g for g in embedding_dedup.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), end_rows=20, list_rows=64).collect()}
    assert all(got[i].n_links <= near[i].sum() - 1 for i in range(500))
    assert sum(g.n_links for g in got.values()) >= 0.97 * (near.sum() - 500)


def test_ends_do_not_grow_with_the_table():
    for dim in (64, 384):
        for n in (1_000, 20_000, 200_000):
            m, tail = embedding_dedup.calibrate(dim, n)
            theta, share = embedding_dedup._angles(dim)
            assert m <= embedding_dedup.DIRECTIONS and np.interp(np.arccos(tail), theta, share) * n < 2.5 * embedding_dedup.END_ROWS


def test_no_vectors(spark):
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# Substrings


def brute_substrings(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, d in zip(w, gone) if not d))
    return out


@pytest.mark.parametrize("kw", [{}, {"hot": 3}, {"shard_words": 40}])
def test_substrings_against_brute_force(docs, kw):
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    passages = [" ".join(r.choice(words) for _ in range(r.randrange(15, 80))) for _ in range(6)]
    rows = [(i, "\n".join(r.choice(passages) if r.random() < 0.6 else " ".join(r.choice(words) for _ in range(r.randrange(40))) for _ in range(r.randrange(5)))) for i in range(150)]
    rows += [(150, "ab " * 90), (151, None), (152, ""), (153, " \t"), (154, "ab cd " * 30)]
    got = {x.doc_id: (x.n_words, x.n_removed, bytes(x.kept)) for x in substring.dedup(docs(rows).withColumn("kept", F.lit(1)), **kw).collect()}
    assert got == brute_substrings(rows)


def test_substring_rows_without_id_and_stated_twice(docs):
    text = " ".join(map(str, range(60)))
    got = substring.dedup(docs([(None, text), (3, text), (3, text), (9, text + " more")])).collect()
    assert sorted(((r.doc_id is None, r.n_removed) for r in got)) == [(False, 60), (False, 60), (False, 60), (True, 0)]
    assert substring.dedup(docs([])).count() == 0


# Lines


def brute_lines(rows):
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in [] if t is None else t.split("\n"):
            w = line.encode().split()
            s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None
            if s is None or not any(len(s & x) >= 0.8 * len(s | x) - 1e-9 for x in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = "\n".join(kept)
    return out


def test_lines_against_brute_force(docs):
    r = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    kinds = [[r.choice(words) for _ in range(r.randrange(1, 80))] for _ in range(10)]

    def line():
        w = list(r.choice(kinds)) if r.random() < 0.6 else [r.choice(words) for _ in range(r.randrange(20))]
        for _ in range(r.choice([0, 0, 1, 2])):
            if w:
                w[r.randrange(len(w))] = r.choice(words)
        return " ".join(w)

    rows = [(i, "\n".join(line() for _ in range(r.randrange(6)))) for i in range(120)] + [(120, ""), (121, "\n\n"), (122, "a\nb c\na\n"), (123, " a \t\r")]
    got = {x.doc_id: x.text for x in line_dedup.dedup(docs(rows)).collect()}
    assert got == brute_lines(rows)
    digest = {x.doc_id: x for x in line_dedup.digest(docs(rows)).collect()}
    assert all(digest[i].kept_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in got.items())


def test_line_prefixes_are_the_first_of_all_tokens(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    lines = [" ".join(r.choice(words[: r.choice([1, 2, 5, 40])]) for _ in range(r.randrange(1, 90))) for _ in range(200)] + ["a b c d e " * 30 + "f", "a", " \t", "a  b "]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "at long, line string")
    hashed = line_dedup._hashed(rows)
    classes = line_dedup._rarity(rows.select(F.col("line").alias("text")))
    every = hashed.withColumn("every", F.transform(line_dedup._firsts(), lambda _, i: line_dedup._shingle(i))).select("at", F.explode(F.arrays_zip(line_dedup._firsts().alias("first"), F.col("every"))).alias("z"))
    token = F.get(classes, line_dedup._bucket(F.col("z.first"))).bitwiseOR(F.shiftrightunsigned("z.every", 64 - line_dedup.REST_BITS))
    whole = {x.at: sorted(x.t) for x in every.groupBy("at").agg(F.collect_set(token).alias("t")).collect()}
    got = {x.at: x.prefix for x in line_dedup._prefixes(hashed, classes).collect()}
    assert sorted(got) == sorted(whole) == [i for i, x in enumerate(lines) if x.split()]
    for i, p in got.items():
        n = len(whole[i])
        assert n == len({tuple(w[k : k + 5]) for w in [lines[i].split()] for k in range(max(1, len(w) - 4))})
        assert p == whole[i][: len(p)] and len(p) >= n - -(-4 * n // 5) + 1


def test_lines_of_odd_rows(docs):
    got = line_dedup.dedup(docs([(1, None), (None, "one two"), (5, "one two"), (5, "one two"), (6, "x" * 4000)]).withColumn("at", F.lit(7))).collect()
    assert sorted(((r.doc_id, r.text, r.at) for r in got), key=repr) == sorted([(1, None, 7), (None, "one two", 7), (5, "", 7), (5, "", 7), (6, "x" * 4000, 7)], key=repr)
    assert line_dedup.dedup(docs([])).count() == 0
