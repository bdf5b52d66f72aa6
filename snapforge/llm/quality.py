"""Quality classifier: attention-based multiple-instance learning over passages.

A text is cut into passages of ``PASSAGE`` bytes. Each passage becomes a vector of byte-class and hashed byte-pair shares
and of how concentrated they are, then a hidden vector h = tanh(W x + b). Gated attention gives it the weight
softmax(w . (tanh(V h) * sigmoid(U h))) among the passages of its document, and the weighted sum of h gives the score by a
logistic unit. All of W, V, U, w and the unit are learned together from document labels (Adam, cross-entropy); no passage
has a label of its own.

Training uses the ``SAMPLE`` labelled documents of smallest hash at most, and of these, in that order, no more than have
``MOST_PASSAGES`` passages together, but one at least (documented bounds: the driver holds their passage vectors). It sees
all passages of each, and no other column than text and label. It is deterministic. Scoring reads all passages of every text.

Nulls: a null text is the empty text, which is one passage of zeros; rows with a null label or id are not learned from;
of several labels for an id each counts, and so does each text of a repeated id, within the same bounds; equal rows count once. Without any labelled row, or with one class only, every score is the share of
label 1 (0.5 without rows). Repeated rows are scored alike. Columns named score, predicted or held_out are replaced, all
others are carried. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from snapforge.llm.common import arrow_map, chunks

PASSAGE = 512
SAMPLE = 6000
MOST_PASSAGES = 120_000
HIDDEN, ATTENTION = 24, 12
_PAIRS = 160


def _classes() -> np.ndarray:
    """Byte -> class: letters by vowel, consonant and case, digits, each ASCII sign, white space, and lead and trail bytes."""
    out, n = np.zeros(256, np.int64), 8
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = 0
        elif b >= 0x80:
            out[b] = 1
        elif c in "aeiou":
            out[b] = 2
        elif c.islower():
            out[b] = 3
        elif c in "AEIOU":
            out[b] = 4
        elif c.isupper():
            out[b] = 5
        elif c.isdigit():
            out[b] = 6
        elif b < 32 and c != "\n":
            out[b] = 7
        else:
            out[b], n = n, n + 1
    return out


_CLASS = _classes()
_N_CLASS = int(_CLASS.max()) + 1
DIM = _N_CLASS + _PAIRS + 4


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, document of each) of all passages of all texts."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    per = np.maximum(1, -(-size // PASSAGE))
    doc = np.repeat(np.arange(len(raw)), per)
    n = int(per.sum())
    buf = np.frombuffer(b"".join(raw), np.uint8)
    start = np.cumsum(size) - size
    first = np.cumsum(per) - per
    owner = np.repeat(np.arange(len(raw)), size)
    within = np.arange(len(buf)) - start[owner]
    passage = first[owner] + within // PASSAGE
    cls = _CLASS[buf]
    x = np.empty((n, DIM), np.float32)
    count = np.maximum(1, np.bincount(passage, minlength=n)).astype(np.float32)[:, None]
    x[:, :_N_CLASS] = np.bincount(passage * _N_CLASS + cls, minlength=n * _N_CLASS).reshape(n, -1) / count
    same = passage[1:] == passage[:-1] if len(buf) else np.empty(0, bool)
    code = buf.astype(np.int64)
    pair = ((code[:-1] * 131 + code[1:]) * 2654435761 >> 16) % 4096
    fine = np.bincount(passage[1:][same] * 512 + pair[same] % 512, minlength=n * 512).reshape(n, 512) / count if len(buf) else np.zeros((n, 512))
    both = cls[:-1] * _N_CLASS + cls[1:]
    x[:, _N_CLASS : _N_CLASS + _PAIRS] = np.bincount(passage[1:][same] * _PAIRS + (both[same] * 2654435761 >> 12) % _PAIRS, minlength=n * _PAIRS).reshape(n, -1) / count if len(buf) else 0
    x[:, -4] = (fine * fine).sum(axis=1) * 20
    x[:, -3] = fine.max(axis=1) * 5
    x[:, -2] = (fine > 0).sum(axis=1) / count[:, 0]
    x[:, -1] = np.log1p(count[:, 0]) / 6
    return np.sqrt(np.maximum(x, 0)), doc


def _softmax(s: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, s)
    e = np.exp(s - top[doc])
    return e / np.bincount(doc, e, minlength=n)[doc]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class AttentionMIL:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(DIM), np.ones(DIM)
        self.w = {
            "W": r.normal(0, DIM**-0.5, (DIM, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
            "a": r.normal(0, ATTENTION**-0.5, ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, doc: np.ndarray, n: int):
        w = self.w
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        att = _softmax((t * g) @ w["a"], doc, n)
        z = np.zeros((n, HIDDEN))
        np.add.at(z, doc, att[:, None] * h)
        return x, h, t, g, att, z, z @ w["c"] + w["d"]

    def score(self, x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return _sigmoid(self.forward(x, doc, n)[-1])

    def gradient(self, x, doc, n, label):
        w = self.w
        x, h, t, g, att, z, logit = self.forward(x, doc, n)
        err = (_sigmoid(logit) - label) / n
        dz = err[:, None] * w["c"]
        dh = att[:, None] * dz[doc]
        datt = (h * dz[doc]).sum(axis=1)
        ds = att * (datt - np.bincount(doc, att * datt, minlength=n)[doc])
        dtg = ds[:, None] * w["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh += dt @ w["V"].T + dg @ w["U"].T
        dp = dh * (1 - h * h)
        return {"W": x.T @ dp, "b": dp.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ err, "d": err.sum(keepdims=True)}

    def fit(self, x: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 2) -> None:
        """``doc`` ascends; ``label`` has a value for each document."""
        self.mean = x.mean(axis=0, dtype=np.float64)
        squares = sum(np.square(x[at : at + 4096], dtype=np.float64).sum(axis=0) for at in range(0, len(x), 4096))  # no second copy of x
        self.scale = np.sqrt(np.maximum(squares / len(x) - self.mean**2, 0)) + 1e-3
        first, last = np.searchsorted(doc, np.arange(len(label))), np.searchsorted(doc, np.arange(len(label)), side="right")
        m, v, step, r = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0, np.random.default_rng(seed)
        for epoch in range(epochs):
            order = r.permutation(len(label))
            now = rate * (1 - epoch / epochs) + rate / 50
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                rows = np.concatenate([np.arange(first[i], last[i]) for i in pick])
                own = np.repeat(np.arange(len(pick)), (last - first)[pick])
                step += 1
                for k, d in self.gradient(x[rows], own, len(pick), label[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.w[k] -= now * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * self.w[k])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str, use: Column, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, most: int = MOST_PASSAGES) -> AttentionMIL | float:
    """A model, or the share of label 1 where there is nothing to learn from. ``use``: which rows may be learned from."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).where(use)
    # the sample is bounded by `sample` rows, so it may be broadcast
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    n = F.greatest(F.ceil(F.octet_length("text") / PASSAGE), F.lit(1)).alias("passages")
    sized = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "print", n).distinct()
    picked, total = [], 0
    for r in sized.orderBy(F.xxhash64("doc_id"), "doc_id", "print", "y").limit(sample).collect():
        if picked and total + r.passages > most:
            break
        picked.append((r.doc_id, r.y, r.print))
        total += r.passages
    spark = docs.sparkSession
    picks = F.broadcast(spark.createDataFrame(picked, sized.select("doc_id", "y", "print").schema))
    rows = texts.join(picks, ["doc_id", "print"]).dropDuplicates(["doc_id", "y", "print"]).select("doc_id", "y", "text")

    def vectors(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                bags = [passages([t])[0].astype("<f4").tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array(bags, pa.binary())], names=["doc_id", "y", "bag"])

    got = arrow_map(rows, vectors, "doc_id long, y int, bag binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.y, bytes(r.bag)))
    y = np.array([r.y for r in got], np.float64)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    per = [len(r.bag) // (4 * DIM) for r in got]
    x = np.empty((sum(per), DIM), np.float32)
    at = 0
    while got:  # each row is let go of as it is copied
        r = got.pop()
        n = len(r.bag) // (4 * DIM)
        x[len(x) - at - n : len(x) - at] = np.frombuffer(r.bag, "<f4").reshape(-1, DIM)
        at += n
    model = AttentionMIL()
    model.fit(x, np.repeat(np.arange(len(per)), per), y)
    return model


def score(docs: DataFrame, model: AttentionMIL | float, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (double) and predicted (1 from ``threshold`` up)."""
    drop = {"score", "predicted"}
    schema = T.StructType([f for f in docs.schema.fields if f.name.lower() not in drop] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for whole in batches:
            for b in chunks(whole, text):
                x, doc = passages(b.column(text).to_pylist())
                p = np.full(b.num_rows, model) if isinstance(model, float) else model.score(x, doc, b.num_rows)
                cols = [(n, c) for n, c in zip(b.schema.names, b.columns) if n.lower() not in drop] + [("score", pa.array(p, pa.float64())), ("predicted", pa.array((p >= threshold).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([c for _, c in cols], names=[n for n, _ in cols])

    return arrow_map(docs, run, schema)
