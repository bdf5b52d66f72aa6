"""AVI files with motion-JPEG frames: RIFF writing and reading."""

from __future__ import annotations

import struct

FPS = 25


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(parts))


def write(frames: list[bytes], width: int, height: int, note: bytes = b"", fps: int = FPS) -> bytes:
    """A file of frames of one size; ``note`` is kept as the stream's own data (strd)."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    kind = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    index, movi, at = [], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    strl = _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", kind), _chunk(b"strd", note))
    return _chunk(b"RIFF", b"AVI " + _list(b"hdrl", _chunk(b"avih", main), strl) + _list(b"movi", *movi) + _chunk(b"idx1", b"".join(index)))


def read(data: bytes) -> tuple[list[bytes], int, int, float, bytes]:
    """(video frames, width, height, frames a second, strd), the frames by the index, or in order where there is none.

    Index offsets may count from the movi list or from the file's beginning. ValueError on files cut short.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    width = height = 0
    fps, note, movi, index = float(FPS), b"", None, None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if body + size > len(data):
                raise ValueError("the file is cut short")
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = (body, body + size)
                else:
                    todo.append((body + 4, body + size))
            elif name == b"avih":
                width, height = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                fps = rate / scale if scale else fps
            elif name == b"strd":
                note = data[body : body + size]
            elif name == b"idx1":
                index = (body, body + size)
            at = body + size + size % 2
    if movi is None:
        raise ValueError("the file has no frames list")
    frames = []
    if index:
        entries = [struct.unpack_from("<4sIII", data, i) for i in range(index[0], index[1] - 15, 16)]
        base = movi[0]
        if entries and data[base + entries[0][2] : base + entries[0][2] + 4] != entries[0][0]:
            base = 0
        for name, _, offset, size in entries:
            if name[2:] in (b"dc", b"db"):
                if base + offset + 8 + size > len(data):
                    raise ValueError("the index points past the end")
                frames.append(data[base + offset + 8 : base + offset + 8 + size])
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name[2:] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return frames, width, height, fps, note
