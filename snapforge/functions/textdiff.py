"""Unified diffs of UTF-8 texts, and the strict application of them."""

from __future__ import annotations

import difflib
import re

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_NO_END = "\\ No newline at end of file"


def _text(data: bytes, what: str) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ValueError(f"the {what} is not UTF-8") from e


def _lines(text: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def encode(source: bytes, target: bytes) -> bytes:
    old, new = _lines(_text(source, "source")), _lines(_text(target, "target"))
    out = []
    for n, line in enumerate(difflib.unified_diff(old, new, "original", "modified")):
        out.append(line if line.endswith("\n") else f"{line}\n{_NO_END}\n")
        if n < 2 and not out[-1].endswith("\n"):
            out[-1] += "\n"
    return "".join(out).encode()


def decode(source: bytes, patch: bytes) -> bytes:
    old = _lines(_text(source, "source"))
    lines = _lines(_text(patch, "patch"))
    if not lines:
        return source
    if len(lines) < 2 or not lines[0].startswith("--- ") or not lines[1].startswith("+++ "):
        raise ValueError("the patch has no header")
    out: list[str] = []
    at, i = 0, 2
    while i < len(lines):
        head = _HUNK.match(lines[i])
        if not head:
            raise ValueError(f"line {i + 1} of the patch is no hunk")
        start, n_old, n_new = int(head[1]), int(head[2] or 1), int(head[4] or 1)
        start = start if n_old == 0 else start - 1
        if start < at or start > len(old):
            raise ValueError("a hunk lies outside the source")
        out += old[at:start]
        at, i = start, i + 1
        while n_old > 0 or n_new > 0:
            if i >= len(lines):
                raise ValueError("a hunk is cut short")
            sign, body = lines[i][0], lines[i][1:]
            i += 1
            if i < len(lines) and lines[i].startswith("\\"):
                body, i = body.removesuffix("\n"), i + 1
            if sign in " -":
                if at >= len(old) or old[at] != body:
                    raise ValueError(f"line {at + 1} of the source is not what the patch expects")
                at, n_old = at + 1, n_old - 1
            elif sign != "+":
                raise ValueError("a line of the patch has no sign")
            if sign in " +":
                out.append(body)
                n_new -= 1
    return "".join(out + old[at:]).encode()
