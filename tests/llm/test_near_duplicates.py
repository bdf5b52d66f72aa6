import random

import numpy as np
from pyspark.sql import functions as F

from snapforge.llm import near_duplicates
from tests.llm.test_duplicates import components


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def brute_sets(texts):
    words = [(t or "").lower().encode().split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]


def stage(spark, df):
    import corpus_pipeline as c

    return c.near_duplicate_stage(spark, df, "").collect()


def at_threshold(r, n, new, k):
    """A text of n words and its copy with ``new`` other words at the end."""
    a = [f"{k}w{r.randrange(10**9)}" for _ in range(n)]
    return " ".join(a), " ".join(a[: n - new] + [f"{k}x{r.randrange(10**9)}" for _ in range(new)])


def test_pairs_just_over_the_threshold_are_linked(spark, docs):
    """At 90, 180 and 900 shingles: 10, 20 and 100 of them replaced, a similarity of 0.8 to the hundredth."""
    r = random.Random(2)
    rows = []
    for k in range(120):
        n, new = [(94, 10), (184, 20), (904, 100)][k % 3]
        rows += zip((2 * k, 2 * k + 1), at_threshold(r, n, new, k))
    sets = brute_sets(t for _, t in rows)
    assert all(0.8 <= jaccard(sets[i], sets[i + 1]) < 0.805 for i in range(0, len(rows), 2))
    assert sorted(x.doc_id for x in stage(spark, docs(rows))) == list(range(0, 240, 2))


def test_groups_are_those_of_brute_force_jaccard(spark, docs):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 7, 40, 150, 600])))) for i in range(40)]
    for i in range(40, 260):
        w = r.choice(rows)[1].split()
        for _ in range(r.choice([0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w).title()))
    sets = brute_sets(t for _, t in rows)
    label = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    assert len(set(label)) > 45
    assert sorted(x.doc_id for x in stage(spark, docs(rows))) == sorted(set(label.tolist()))


def test_unrelated_short_texts_and_texts_without_words_stay(spark, docs):
    """Two shingles make sparse fingerprints, near to those of texts without words."""
    rows = [(i, " ".join(f"t{i}w{k}" for k in range(6))) for i in range(400)] + [(400, None), (401, ""), (402, " \t\n")]
    assert sorted(x.doc_id for x in stage(spark, docs(rows))) == list(range(403))


def test_rows_of_a_repeated_id_stand_for_themselves(spark, docs):
    a, b = (" ".join(f"{k}w{i}" for i in range(60)) for k in "ab")
    got = stage(spark, docs([(1, a), (7, a + " more"), (7, b)]))
    assert sorted((x.doc_id, x.text) for x in got) == [(1, a), (7, b)]


def test_unique_rows_of_a_copied_id_and_rows_without_id(spark, docs):
    a, b, c = (" ".join(f"{k}w{i}" for i in range(60)) for k in "abc")
    got = stage(spark, docs([(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (8, a)]))
    assert sorted((x.doc_id or 0, x.text) for x in got) == [(0, c), (1, a), (5, b)]


def test_agreement_of_minima(spark):
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 32, (50, near_duplicates.BANDS * near_duplicates.ROWS), dtype=np.uint32)
    b = np.where(r.random(a.shape) < 0.8, a, r.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    four = lambda x: (x * np.uint32(2654435761)) >> np.uint32(28)
    rows = [(x.tolist(), y.tolist()) for x, y in zip(near_duplicates.nibbles(a), near_duplicates.nibbles(b))]
    got = [x[0] for x in spark.createDataFrame(rows, "a array<long>, b array<long>").select(near_duplicates._agreeing("a", "b")).collect()]
    assert got == (four(a) == four(b)).sum(axis=1).tolist()
    assert 110 < near_duplicates.LEAST_AGREEING < 130 <= min(got)


def test_fingerprints_are_votes_of_all_shingles(monkeypatch):
    """planes of binary digits count as a plain sum over bits does, also where votes are counted in parts."""
    monkeypatch.setattr(near_duplicates, "_VOTES", 64)
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 5, 63, 64, 65, 300):
        found = r.integers(0, 1 << 64, n, dtype=np.uint64)
        votes = sum(np.unpackbits(near_duplicates.prints(found[k : k + 1]).view(np.uint8)).astype(int) for k in range(n))
        assert near_duplicates.prints(found).tolist() == np.packbits(votes * 2 > n).view(np.uint64).tolist()


def test_candidates_are_what_is_near_at_anchors(monkeypatch):
    """SimHash and its anchor points make the candidates; pairs at a similarity of 0.8 meet, unrelated ones do not."""
    r = np.random.default_rng(3)
    a = [r.integers(0, 1 << 64, 90, dtype=np.uint64) for _ in range(60)]
    sets = a + [np.concatenate((x[10:], r.integers(0, 1 << 64, 10, dtype=np.uint64))) for x in a]
    every, node = np.array([near_duplicates.prints(s) for s in sets]), np.arange(120)
    root, met, stars = node.copy(), set(), set()
    root[60] = 0  # connected already
    for k in range(near_duplicates.PRINTS):
        p, q = np.ascontiguousarray(every[:, k]), every[:, (k + 1) % near_duplicates.PRINTS]
        key, i, home = near_duplicates.anchors(p)
        o = np.argsort(key, kind="stable")
        rows = [x[o] for x in (key, node[i], root[i], p[i], q[i], home)]
        with monkeypatch.context() as m:
            m.setattr(near_duplicates, "_PAIRS", 50)
            met |= set(zip(*(x.tolist() for x in near_duplicates._near(*rows, False))))
        stars |= set(zip(*(x.tolist() for x in near_duplicates._near(*rows, True))))
    assert met == {(x, x + 60) for x in range(1, 60)} and stars <= met and len(stars) > 50


def test_texts_that_are_alike_but_not_enough_make_no_pairs(spark, docs, monkeypatch):
    """F1: 300 texts share 96 of 140 shingles, a similarity of 0.52; before, thousands of their pairs were written out."""
    r = random.Random(6)
    common = [f"c{k}" for k in range(100)]
    rows = [(i, " ".join(common + [f"o{r.randrange(10**9)}" for _ in range(40)])) for i in range(300)]
    a, b = at_threshold(r, 94, 10, 0)
    rows += [(300, a), (301, b)]
    asked, verified = [], near_duplicates._verified
    monkeypatch.setattr(near_duplicates, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    assert sorted(x.doc_id for x in stage(spark, docs(rows))) == list(range(301))
    assert asked[1] < 300


def test_bits_that_links_differ_in():
    """the bound holds for links of all sizes; the calculated share of bits is that of drawn sets."""
    r, most = np.random.default_rng(5), near_duplicates.most_apart()
    for n, m, shared in ((4, 5, 4), (9, 9, 8), (18, 18, 16), (64, 80, 64), (180, 180, 160)):
        drawn = [r.integers(0, 1 << 64, n + m - shared, dtype=np.uint64) for _ in range(60)]
        apart = [int(np.bitwise_count(near_duplicates.prints(x[:n]) ^ near_duplicates.prints(x[n - shared :])).sum()) for x in drawn]
        p = near_duplicates.differing(m, n, shared)
        assert abs(np.mean(apart) / (64 * near_duplicates.PRINTS) - p) < 0.006
        assert max(apart) <= most[min(n, 64)] < 64 * near_duplicates.PRINTS * 0.25
    assert near_duplicates.differing(5, 5, 5) == 0
