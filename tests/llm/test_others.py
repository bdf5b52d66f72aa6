import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapforge.llm import avi, lossless_jpeg, media, mixing, quality, url_filter

# URL filters

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("a.b.net/x", "block"), (None, "block"), ("/only", "block"), ("EXAMPLE.net/en/deep/", "block")]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])] if tail.startswith("/") else ""
    best = None
    for rule, verdict in RULES:
        if rule and not rule.startswith("/"):
            h, p = rule.split("/", 1)
            h, p = h.lower(), "/" + p
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_rules_against_brute_force(spark):
    r = random.Random(2)
    hosts = ["example.net", "www.example.net", "badexample.net", "NET", "x.net", "example.com", "de.example.com", "a.b.net", "z.a.b.net", "fr.org", "localhost", "", "a\u0001b.net", "net."]
    urls = [f"{r.choice(['http', 'HTTPS', ''])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/deep/x', '/de/1', '/fr/#x', '?q=/en/', '/xyz?u=http://a', '#/en/'])}" for _ in range(400)] + [None, "", "no scheme", "http://", "://", "http://user@Example.NET:80/en/"]
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(df, spark.createDataFrame(RULES, "rule string, verdict string")).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert got[i] == (host, path, rule, verdict), u


def test_no_rules_and_no_urls(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert url_filter.judge(pages, none).first().verdict == "allow"
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(RULES, "rule string, verdict string")).count() == 0


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        add = {s: left * w[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += add[s]
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def test_targets_and_budgets(docs):
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(0, 60), r.choice(["a", "b", "Z", "é", None, "a"])) for i in range(400)] + [(900, None, "a"), (901, "x y z\u000b", "only")]
    df = docs(rows).select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = brute_targets(sizes)
    for s in sizes:
        mine = [x for x in got if x.source == s]
        assert mine[0].target == pytest.approx(want[s]) and mine[0].source_size == sizes[s]
        assert abs(sum(x.taken for x in mine) - want[s]) <= 1
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)


def test_mixed_documents_are_whole(docs):
    rows = [(i, "w " * (1 + i % 9), "big" if i % 3 else "small") for i in range(120)] + [(500, "w w", "big"), (500, "w w", "big"), (501, None, "big")]
    df = docs(rows)
    got = [x.text for x in mixing.mix_documents(df).collect()]
    assert set(got) <= {t for _, t, _ in rows} and mixing.mix_documents(df).columns == df.columns
    assert abs(sum(len(t.split()) for t in got if t) - 1.5 * sum(len((t or "").split()) for _, t, _ in rows)) < 20
    assert mixing.mix_documents(docs([])).count() == 0


# Quality


@pytest.fixture(scope="module")
def junk(spark):
    r = random.Random(7)
    syllables = ["la", "re", "to", "ni", "so", "mu"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    rows, labels = [], []
    for i in range(900):
        text = " ".join(word() for _ in range(r.randrange(20, 300))).capitalize() + "."
        bad = i % 4 == 1
        if bad:
            part = " ".join(f"{word().upper()}!!" if i % 8 == 1 else f"{word()} |" for _ in range(60))
            text = text[: r.randrange(len(text))] + "\n" + part
        rows.append((i, text))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(junk):
    docs, labels = junk
    model = quality.train(docs, labels, "quality", ~quality.held_out(F.col("doc_id")))
    out = quality.score(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)
    mine = [x for x in out if x.held_out]
    assert len(mine) > 150 and sum(x.predicted == x.quality for x in mine) > 0.95 * len(mine)
    again = quality.train(docs.repartition(5), labels, "quality", ~quality.held_out(F.col("doc_id")))
    assert all(np.array_equal(model.w[k], again.w[k]) for k in model.w)


def test_gradient():
    r = np.random.default_rng(0)
    m, x, doc, y = quality.AttentionMIL(), r.normal(size=(7, quality.DIM)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := m.score(x, doc, 3), 1 - p)))
    g = m.gradient(x, doc, 3, y)
    for k in m.w:
        flat, at = m.w[k].reshape(-1), int(np.argmax(np.abs(g[k])))
        old, h = flat[at], 1e-6
        flat[at] = old + h
        up = loss()
        flat[at] = old - h
        down = loss()
        flat[at] = old
        assert (up - down) / (2 * h) == pytest.approx(g[k].reshape(-1)[at], rel=1e-3, abs=1e-7)


def test_scores_of_odd_rows(odd, spark):
    out = quality.score(odd.withColumn("score", F.lit("old")), quality.AttentionMIL()).collect()
    assert len(out) == 9 and all(0 <= x.score <= 1 for x in out)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(odd, none, "quality", F.lit(True)) == 0.5
    assert {x.score for x in quality.score(odd, 0.5).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1), (None, 0), (7, None)], "doc_id long, quality int")
    assert quality.train(odd, one, "quality", F.lit(True)) == 1.0


# Media


@pytest.mark.parametrize("shape", [(1, 1, 64), (3, 5, 64), (2, 7, 13)])
def test_lossless_frames(shape):
    x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    frames = lossless_jpeg.encode_frames(x)
    assert (np.stack(lossless_jpeg.decode_frames(frames)) == x).all()
    height, width, table, predictor, scan, restart = lossless_jpeg._parse(frames[0])
    assert (lossless_jpeg._slow(height, width, table, predictor, scan, restart) == x[0]).all()
    with pytest.raises(ValueError):
        lossless_jpeg.decode_frame(frames[0][:40])


def test_index_and_frames_in_order():
    frames = lossless_jpeg.encode_frames(np.arange(256, dtype=np.uint8).reshape(2, 2, 64))
    data = avi.write(frames, 64, 2, b"note")
    assert avi.read(data)[0] == frames and avi.read(data)[4] == b"note"
    at = data.rindex(b"idx1")
    assert avi.read(data[:at])[0] == frames
    with pytest.raises(ValueError):
        avi.read(data[: len(data) // 2])


def test_media_come_back(odd):
    got = media.describe(media.store(odd)).collect()
    by = {r.doc_id: r for r in odd.collect()}
    for g in got:
        raw = (by[g.doc_id].text or "").encode()
        raw_padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(raw_padded), hashlib.sha256(raw_padded).hexdigest(), zlib.crc32(raw_padded[-64:]))
        assert g.media_error is None
    same = [g for g in got if g.doc_id == 5]
    assert same[0].media_sha256 == same[1].media_sha256 and same[0].feature == same[1].feature


def test_shots(spark):
    text = "aaaa" * 2560 + "ZZZZ" * 2560 + "    " * 2560
    clips = media.clips(media.store(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("clip").collect()
    assert [(c.first_frame, c.n_frames) for c in clips] == [(0, 10), (10, 10), (20, 10)]
    assert clips[1].start_s == pytest.approx(0.4) and clips[1].jump == 1.0


def test_damaged_media(spark):
    df = spark.createDataFrame([(1, b"RIFF"), (2, None), (3, b"x" * 50)], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.describe(df).collect()}
    assert got[1].media_error and got[3].media_error and got[2].media_error is None and got[2].payload_bytes is None
    assert media.clips(df).count() == 0 and media.describe(df.limit(0)).count() == 0


def test_mixing_carries_columns_of_any_name(spark):
    names = ["key", "rank", "part", "target", "carried", "before", "budget", "epochs", "rest", "row", "weight", "source_size"]
    rows = [(i, "ab"[i % 2], 3 + i % 5, *[f"{n}{i}" for n in names]) for i in range(40)]
    plain = spark.createDataFrame([r[:3] for r in rows], "doc_id long, source string, size long")
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, " + ", ".join(f"`{n}` string" for n in names))
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    want = {r.doc_id: r for r in mixing.mix(plain).collect()}
    kept = [n for n in names if n not in ("target", "source_size")]  # these are results
    assert all(got[i][n] == f"{n}{i}" for i in got for n in kept)
    assert all((got[i].taken, got[i].target, got[i].source_size) == (want[i].taken, want[i].target, want[i].source_size) for i in want)


def test_training_is_bounded_over_repeated_ids_and_long_texts(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.AttentionMIL, "fit", lambda self, x, doc, y, **kw: seen.append((len(x), len(y))))
    rows = [(1, f"text {i} " * (i + 1)) for i in range(300)] + [(1, "same")] * 50 + [(2, "word " * 4000)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    quality.train(docs(rows), labels, "quality", F.lit(True), sample=20)
    quality.train(docs(rows), labels, "quality", F.lit(True), most=60)
    assert seen[0][1] == 20 and 60 >= seen[1][0] > 0
    quality.train(docs([(1, "a"), (2, "word " * 4000)]), labels, "quality", F.lit(True))
    assert seen[2] == (2 + -(-20_000 // quality.PASSAGE), 3)  # all passages of the long text
