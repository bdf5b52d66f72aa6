"""Media columns: AVI files with motion-JPEG frames in binary columns.

store() lays a text's bytes out as 8-bit samples, 64 to a row and ``ROWS`` rows to a frame, and writes them losslessly
as the frames of an AVI file; its strd chunk keeps the number of payload bytes. describe() reads any such file back: it
parses the RIFF index, decodes the frames, finds the shots and checks sums over the payload. clips() gives a row for each
shot with its times.

A cut lies between two frames whose 16-bin histograms differ (half the sum of absolute differences) by over ``FLOOR`` and
by over ``STEEP`` standard deviations more than the mean of the differences around (``NEAR`` on each side, itself left
out), so that busy stretches need a larger jump than calm ones.

Nulls: a null text is stored as the empty text (64 zero bytes); a null media value gives null results and no clips. Media
that is no AVI file, is cut short or has other frame types gives null results with the reason in media_error. Repeated
rows give a row each. Other columns are carried; those named like an output are replaced. Empty tables give empty results.
A worker holds the frames of about ``common.CHUNK_BYTES`` of text or media, or of one row if that is longer.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from snapforge.llm import avi, lossless_jpeg
from snapforge.llm.common import arrow_map, chunks

WIDTH, ROWS, ALIGN = 64, 16, 64
BINS = 16
FLOOR, STEEP, NEAR = 0.25, 3.0, 8
_NOTE = "<QQ"


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes, and how many belong to the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN), b"\0"), len(raw)


def to_media(payloads: list[tuple[bytes, int]]) -> list[bytes]:
    shapes = []
    for raw, _ in payloads:
        rows = len(raw) // WIDTH
        height = min(ROWS, rows)
        shapes.append((height, -(-rows // height)))
    frames: list = [None] * len(payloads)
    for height in {h for h, _ in shapes}:
        mine = [i for i, (h, _) in enumerate(shapes) if h == height]
        block = b"".join(payloads[i][0].ljust(shapes[i][1] * height * WIDTH, b"\0") for i in mine)
        coded = lossless_jpeg.encode_frames(np.frombuffer(block, np.uint8).reshape(-1, height, WIDTH))
        at = 0
        for i in mine:
            frames[i] = coded[at : at + shapes[i][1]]
            at += shapes[i][1]
    return [avi.write(f, WIDTH, h, struct.pack(_NOTE, n, len(raw))) for f, (h, _), (raw, n) in zip(frames, shapes, payloads)]


def differences(frames: np.ndarray) -> np.ndarray:
    """Histogram difference (0 to 1) of each frame from the one before; frames: (n, height, width)."""
    n = len(frames)
    level = (frames.reshape(n, -1) >> 4).astype(np.int64) + (np.arange(n) * BINS)[:, None]
    hist = np.bincount(level.ravel(), minlength=n * BINS).reshape(n, BINS)
    return np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * level.shape[1])


def cuts(diff: np.ndarray) -> np.ndarray:
    """Frames at which a new shot begins, by a threshold that follows the differences around."""
    n = len(diff)
    if not n:
        return np.empty(0, np.int64)
    total, squares = np.concatenate(([0.0], np.cumsum(diff))), np.concatenate(([0.0], np.cumsum(diff * diff)))
    lo, hi = np.maximum(np.arange(n) - NEAR, 0), np.minimum(np.arange(n) + NEAR + 1, n)
    k = hi - lo - 1
    some = np.maximum(k, 1)
    mean = (total[hi] - total[lo] - diff) / some
    var = np.maximum((squares[hi] - squares[lo] - diff * diff) / some - mean * mean, 0.0)
    return np.flatnonzero((diff > FLOOR) & (diff > mean + STEEP * np.sqrt(var))) + 1


def _open(media: list[bytes | None]) -> list:
    """For each value None, the reason why it can't be read, or (frames, fps, bytes of text, payload)."""
    opened, every = [], []
    for m in media:
        try:
            opened.append(None if m is None else (avi.read(m), len(every)))
            if m is not None:
                every += opened[-1][0][0]
        except (ValueError, struct.error, IndexError) as e:
            opened.append(f"{e}")
    try:
        decoded = lossless_jpeg.decode_frames(every)
    except (ValueError, struct.error, IndexError):
        decoded = None
    out = []
    for x in opened:
        if x is None or isinstance(x, str):
            out.append(x)
            continue
        (frames, _, _, fps, note), at = x
        try:
            got = decoded[at : at + len(frames)] if decoded is not None else lossless_jpeg.decode_frames(frames)
            if len({g.shape for g in got}) > 1:
                raise ValueError("frames differ in size")
            block = np.stack(got) if got else np.zeros((0, 1, 1), np.uint8)
            n, size = struct.unpack(_NOTE, note) if len(note) == struct.calcsize(_NOTE) else (block.size, block.size)
            if size > block.size:
                raise ValueError("frames are missing")
            out.append((block, fps, n, block.tobytes()[:size]))
        except (ValueError, struct.error, IndexError) as e:
            out.append(f"{e}")
    return out


def _others(batch: pa.RecordBatch, names: set[str]) -> list[tuple[str, pa.Array]]:
    return [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n.lower() not in names]


def _schema(df: DataFrame, drop: set[str], new: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in drop] + T._parse_datatype_string(new).fields)


def store(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with media (binary) in place of the text."""
    drop = {text.lower(), "media"}

    def run(batches):
        for whole in batches:
            for b in chunks(whole, text):
                media = to_media([payload(t) for t in b.column(text).to_pylist()])
                cols = _others(b, drop) + [("media", pa.array(media, pa.binary()))]
                yield pa.RecordBatch.from_arrays([c for _, c in cols], names=[n for n, _ in cols])

    return arrow_map(df, run, _schema(df, drop, "media binary"))


_DESCRIBED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_error string"


def describe(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` without the media column, with what reading it back gave."""
    new = T._parse_datatype_string(_DESCRIBED).fieldNames()
    drop = {media.lower(), *new}

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for whole in batches:
            for b in chunks(whole, media):
                values = b.column(media).to_pylist()
                rows = []
                for m, x in zip(values, _open(values)):
                    if x is None:
                        rows.append((None,) * 8)
                        continue
                    own = len(m), hashlib.sha256(m).hexdigest()
                    if isinstance(x, str):
                        rows.append((None, None, None, None, *own, None, x))
                        continue
                    frames, _, n, raw = x
                    diff = differences(frames)
                    begins = [0, *cuts(diff).tolist()] if len(frames) else []
                    feature = f"frames={len(frames)};shots={len(begins)};cuts={','.join(map(str, begins[1:]))};motion={diff.mean() if len(diff) else 0:.6f};level={frames.mean() if frames.size else 0:.6f}"
                    rows.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ALIGN:]), *own, feature, None))
                cols = _others(b, drop) + [(n, pa.array(list(v), k)) for n, v, k in zip(new, zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([c for _, c in cols], names=[n for n, _ in cols])

    return arrow_map(df, run, _schema(df, drop, _DESCRIBED))


def clips(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each shot: the columns of ``df`` but the media, and clip, first_frame, n_frames, start_s, end_s, jump
    (the histogram difference at its beginning)."""
    shape = "clip int, first_frame int, n_frames int, start_s double, end_s double, jump double"
    new = T._parse_datatype_string(shape).fieldNames()
    drop = {media.lower(), *new}

    def run(batches):
        kinds = [pa.int32()] * 3 + [pa.float64()] * 3
        for whole in batches:
            for b in chunks(whole, media):
                at, rows = [], []
                for i, x in enumerate(_open(b.column(media).to_pylist())):
                    if x is None or isinstance(x, str) or not len(x[0]):
                        continue
                    diff, fps = differences(x[0]), x[1]
                    edges = [0, *cuts(diff).tolist(), len(x[0])]
                    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                        at.append(i)
                        rows.append((k, lo, hi - lo, lo / fps, hi / fps, float(diff[lo - 1]) if lo else 0.0))
                if rows:
                    cols = [(n, c.take(pa.array(at, pa.int64()))) for n, c in _others(b, drop)] + [(n, pa.array(list(v), k)) for n, v, k in zip(new, zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([c for _, c in cols], names=[n for n, _ in cols])

    return arrow_map(df, run, _schema(df, drop, shape))
