"""Lossless JPEG frames (ITU-T T.81, process 14: SOF3) of 8-bit samples, one component.

Frames are predicted from the sample to the left (selection value 1; a row's first sample from the one above, the very
first from 128). A difference of category c takes a Huffman code and c further bits. The table used for writing gives
category c a code of 9 - c bits, so that every difference takes 9 bits in all: the codes of categories 0..8 fill 511/512
of the code space, which leaves the all-ones code free as the standard asks. Fields of one width are written and read by
whole-array operations. Frames of other writers, with any Huffman table and predictors 1-7, are read sample by sample.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

#: Numbers of codes of each length 1..16, then the categories in order of code length.
_LENGTHS = [1] * 9 + [0] * 7
_VALUES = [8, 7, 6, 5, 4, 3, 2, 1, 0]
WIDTH_BITS = 9


def _codes(lengths: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(code, bits, value) of a table as a file states it."""
    out, code, k = [], 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out.append((code, bits, values[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Field of each difference (index 255 + d), and difference of each field."""
    field, back = np.zeros(511, np.uint16), np.zeros(1 << WIDTH_BITS, np.int16)
    by_value = {v: (c, b) for c, b, v in _codes(_LENGTHS, _VALUES)}
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, bits = by_value[cat]
        assert bits + cat == WIDTH_BITS
        f = code << cat | (d if d >= 0 else d + (1 << cat) - 1)
        field[255 + d], back[f] = f, d
    return field, back


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(height: int, width: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xC4, bytes([0x00, *_LENGTHS, *_VALUES]))
        + _segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
    )


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG for each frame of ``samples`` (frames, height, width; uint8)."""
    n, height, width = samples.shape
    if not n:
        return []
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    fields = _tables()[0][diff.reshape(n, -1) + 255]
    count = fields.shape[1]
    pad = -count % 8
    if pad:
        fields = np.concatenate((fields, np.full((n, pad), 0x1FF, np.uint16)), axis=1)  # bits of 1 behind the last code
    packed = _pack9(fields)[:, : (count * WIDTH_BITS + 7) // 8]
    head, out = _header(height, width), []
    for row in packed:
        raw = row.tobytes()
        out.append(head + (raw.replace(b"\xff", b"\xff\x00") if b"\xff" in raw else raw) + b"\xff\xd9")
    return out


def _pack9(fields: np.ndarray) -> np.ndarray:
    """Eight fields of 9 bits are nine bytes."""
    f = fields.reshape(len(fields), -1, 8).astype(np.uint16)
    out = np.empty((*f.shape[:2], 9), np.uint8)
    out[..., 0] = f[..., 0] >> 1
    for i in range(1, 8):
        out[..., i] = (f[..., i - 1] << (8 - i)) & 0xFF | f[..., i] >> (i + 1)
    out[..., 8] = f[..., 7] & 0xFF
    return out.reshape(len(fields), -1)


def _unpack9(raw: np.ndarray) -> np.ndarray:
    b = raw.reshape(len(raw), -1, 9).astype(np.uint16)
    out = np.empty((*b.shape[:2], 8), np.uint16)
    for i in range(8):
        out[..., i] = (b[..., i] << (i + 1) | b[..., i + 1] >> (7 - i)) & 0x1FF
    return out.reshape(len(raw), -1)


def decode_frame(data: bytes) -> np.ndarray:
    """(height, width) uint8 of any lossless Huffman JPEG with one component of 8 bits."""
    return decode_frames([data])[0]


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """All frames; those with this module's table and equal shape are decoded together."""
    out: list = [None] * len(frames)
    same: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, data in enumerate(frames):
        height, width, table, predictor, scan, restart = _parse(data)
        if table == (tuple(_LENGTHS), tuple(_VALUES)) and predictor == 1 and not restart:
            raw = scan.replace(b"\xff\x00", b"\xff")
            need = (height * width * WIDTH_BITS + 7) // 8
            if len(raw) < need:
                raise ValueError("the frame is cut short")
            full = -(-height * width // 8) * 9
            same.setdefault((height, width), []).append((i, np.frombuffer(raw[:need].ljust(full, b"\xff"), np.uint8)))
        else:
            out[i] = _slow(height, width, table, predictor, scan, restart)
    for (height, width), rows in same.items():
        diff = _tables()[1][_unpack9(np.stack([r for _, r in rows]))][:, : height * width].reshape(-1, height, width)
        x = diff.astype(np.int32)
        x[:, 0, 0] += 128
        x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
        x = (np.cumsum(x, axis=2) & 0xFF).astype(np.uint8)
        for (i, _), frame in zip(rows, x):
            out[i] = frame
    return out


def _parse(data: bytes):
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, shape, restart = 2, {}, None, 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if at + 2 + size > len(data):
            raise ValueError("a segment is cut short")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("only one component of 8 bits is read")
            shape = height, width
        elif marker in (0xC0, 0xC1, 0xC2, *range(0xC5, 0xC8), *range(0xC9, 0xCC)):
            raise ValueError(f"frame type {marker:#x} is not lossless Huffman")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if shape is None or body[2] >> 4 not in tables or body[5] & 15:
                raise ValueError("the scan has no frame or table, or a point transform")
            end = data.rfind(b"\xff\xd9")
            if end < at:
                raise ValueError("the frame has no end")
            return *shape, tables[body[2] >> 4], body[3], data[at:end], restart


def _slow(height: int, width: int, table, predictor: int, scan: bytes, restart: int) -> np.ndarray:
    codes = {(b, c): v for c, b, v in _codes(list(table[0]), list(table[1]))}
    parts, at, start = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if at + 1 < len(scan) and 0xD0 <= scan[at + 1] <= 0xD7:
            parts.append(scan[start:at])
            start = at + 2
        at += 2
    parts.append(scan[start:])
    out, n = np.zeros((height, width), np.int64), 0
    per = restart or height * width
    for part in parts:
        raw = part.replace(b"\xff\x00", b"\xff")
        bits, pos = int.from_bytes(raw, "big"), 8 * len(raw)
        first_row = n // width
        for k in range(min(per, height * width - n)):
            code, size = 0, 0
            while (size, code) not in codes:
                size, pos = size + 1, pos - 1
                if size > 16 or pos < 0:
                    raise ValueError("the frame is damaged or cut short")
                code = code << 1 | bits >> pos & 1
            cat = codes[size, code]
            d = 0
            if cat == 16:
                d = 32768
            elif cat:
                pos -= cat
                if pos < 0:
                    raise ValueError("the frame is cut short")
                v = bits >> pos & ((1 << cat) - 1)
                d = v if v >> (cat - 1) else v - (1 << cat) + 1
            y, x = divmod(n, width)
            a = out[y, x - 1] if x else 0
            b = out[y - 1, x] if y else 0
            c = out[y - 1, x - 1] if x and y else 0
            if y == first_row:
                p = a if x else 128
            elif not x:
                p = b
            else:
                p = [0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1][predictor]
            out[y, x] = (p + d) & 0xFFFF
            n += 1
    return (out & 0xFF).astype(np.uint8)
