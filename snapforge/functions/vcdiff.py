"""VCDIFF (RFC 3284) with the default code table, without secondary compression or application headers."""

from __future__ import annotations

import functools

MAGIC = b"\xd6\xc3\xc4\x00"
NEAR, SAME = 4, 3
NOOP, ADD, RUN, COPY = 0, 1, 2, 3
#: Bytes that a match must have; also the block that is indexed.
BLOCK = 16


@functools.lru_cache(maxsize=1)
def code_table() -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """The 256 pairs of (instruction, size, mode), by the rule of section 5.6."""
    none = (NOOP, 0, 0)
    table = [((RUN, 0, 0), none)]
    table += [((ADD, n, 0), none) for n in range(18)]
    table += [((COPY, n, m), none) for m in range(9) for n in (0, *range(4, 19))]
    table += [((ADD, a, 0), (COPY, c, m)) for m in range(6) for a in range(1, 5) for c in range(4, 7)]
    table += [((ADD, a, 0), (COPY, 4, m)) for m in range(6, 9) for a in range(1, 5)]
    table += [((COPY, 4, m), (ADD, 1, 0)) for m in range(9)]
    return table


def _number(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(128 | n & 127)
    return bytes(reversed(out))


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise ValueError("the delta is cut short")
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        n = 0
        while True:
            b = self.byte()
            n = n << 7 | b & 127
            if n >> 62:
                raise ValueError("a number in the delta is too large")
            if b < 128:
                return n

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the delta is cut short")
        self.at += n
        return self.data[self.at - n : self.at]


class _Cache:
    """Addresses used before (section 5.1)."""

    def __init__(self):
        self.near, self.slot, self.same = [0] * NEAR, 0, [0] * (SAME * 256)

    def update(self, address: int) -> None:
        self.near[self.slot] = address
        self.slot = (self.slot + 1) % NEAR
        self.same[address % (SAME * 256)] = address

    def read(self, mode: int, here: int, data: _Reader) -> int:
        if mode == 0:
            address = data.number()
        elif mode == 1:
            address = here - data.number()
        elif mode < 2 + NEAR:
            address = self.near[mode - 2] + data.number()
        else:
            address = self.same[(mode - 2 - NEAR) * 256 + data.byte()]
        if not 0 <= address < here:
            raise ValueError("an address lies outside the window")
        self.update(address)
        return address

    def write(self, address: int, here: int) -> tuple[int, bytes]:
        """The mode with the shortest form."""
        slot = address % (SAME * 256)
        if self.same[slot] == address:
            best = (2 + NEAR + slot // 256, bytes([slot % 256]))
        else:
            best = min(((m, _number(d)) for m, d in ((0, address), (1, here - address), *((2 + i, address - n) for i, n in enumerate(self.near))) if d >= 0), key=lambda x: len(x[1]))
        self.update(address)
        return best


def _matches(source: bytes, target: bytes):
    """(start in target, start in source, length), ascending and apart: blocks of the source found by their bytes."""
    index: dict[bytes, int] = {}
    for at in range(0, len(source) - BLOCK + 1, BLOCK):
        index.setdefault(source[at : at + BLOCK], at)
    at = done = 0
    while at + BLOCK <= len(target):
        found = index.get(target[at : at + BLOCK])
        if found is None:
            at += 1
            continue
        lo, s = at, found
        while lo > done and s > 0 and target[lo - 1] == source[s - 1]:
            lo, s = lo - 1, s - 1
        size = at - lo + BLOCK
        step = 4096
        while step:  # by large steps, then smaller ones
            while step and target[lo + size : lo + size + step] == source[s + size : s + size + step] and len(target) >= lo + size + step and len(source) >= s + size + step:
                size += step
            step //= 2
        yield lo, s, size
        at = done = lo + size


def encode(source: bytes, target: bytes) -> bytes:
    """One window with the whole source as its segment."""
    code = {}
    for n, (a, b) in enumerate(code_table()):
        if b[0] == NOOP:
            code.setdefault(a, n)
    data, inst, addr, cache = bytearray(), bytearray(), bytearray(), _Cache()

    def put(kind: int, size: int, mode: int = 0) -> None:
        short = code.get((kind, size, mode)) if size else None
        if short is not None:
            inst.append(short)
        else:
            inst.append(code[kind, 0, mode])
            inst.extend(_number(size))

    def literal(lo: int, hi: int) -> None:
        if hi > lo:
            part = target[lo:hi]
            if hi - lo > 8 and part.count(part[:1]) == hi - lo:
                data.append(part[0])
                put(RUN, hi - lo)
            else:
                data.extend(part)
                put(ADD, hi - lo)

    at = 0
    for lo, s, size in _matches(source, target):
        literal(at, lo)
        mode, form = cache.write(s, len(source) + lo)
        addr.extend(form)
        put(COPY, size, mode)
        at = lo + size
    literal(at, len(target))
    body = _number(len(target)) + b"\x00" + _number(len(data)) + _number(len(inst)) + _number(len(addr)) + bytes(data) + bytes(inst) + bytes(addr)
    segment = b"\x01" + _number(len(source)) + _number(0) if source else b"\x00"
    return MAGIC + b"\x00" + segment + _number(len(body)) + body


def decode(source: bytes, delta: bytes) -> bytes:
    """Any delta with the default table and no secondary compression."""
    r = _Reader(delta)
    if r.take(4)[:3] != MAGIC[:3]:
        raise ValueError("not a VCDIFF delta")
    flags = r.byte()
    if flags & 3:
        raise ValueError("secondary compression and own code tables are not read")
    if flags & 4:
        r.take(r.number())
    out = bytearray()
    while r.at < len(delta):
        out += _window(r, source, out)
    return bytes(out)


def _window(r: _Reader, source: bytes, before: bytearray) -> bytearray:
    kind = r.byte()
    segment = b""
    if kind & 3:
        size, at = r.number(), r.number()
        whole = source if kind & 1 else bytes(before)
        if at + size > len(whole):
            raise ValueError("the segment lies outside the source")
        segment = whole[at : at + size]
    r.number()
    length = r.number()
    if r.byte():
        raise ValueError("secondary compression is not read")
    n_data, n_inst, n_addr = r.number(), r.number(), r.number()
    if kind & 4:
        r.take(4)
    data, inst, addr = _Reader(r.take(n_data)), _Reader(r.take(n_inst)), _Reader(r.take(n_addr))
    out, cache, table = bytearray(), _Cache(), code_table()
    while inst.at < n_inst:
        for what, size, mode in table[inst.byte()]:
            if what == NOOP:
                continue
            size = size or inst.number()
            if len(out) + size > length:
                raise ValueError("the window is longer than it says")
            if what == ADD:
                out += data.take(size)
            elif what == RUN:
                out += data.take(1) * size
            else:
                address = cache.read(mode, len(segment) + len(out), addr)
                if address < len(segment):
                    part = segment[address : address + size]
                    out += part
                    address, size = len(segment), size - len(part)
                at = address - len(segment)
                while size:  # may overlap what it writes
                    part = bytes(out[at : at + size])
                    if not part:
                        raise ValueError("a copy reads what is not there")
                    out += part
                    at, size = at + len(part), size - len(part)
    if len(out) != length:
        raise ValueError("the window is shorter than it says")
    return out
