"""Word tokens of many texts at once, as numpy arrays.

Words are the runs of bytes other than space and ``\\x09-\\x0D`` in the UTF-8 text with
A-Z lower-cased, i.e. the pattern ``[^\\x20\\x09-\\x0D]+``.  A word is identified by a
64-bit polynomial hash over a fixed random byte table.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np

PIECE = 2 << 20  # bytes hashed at once; longer texts are cut between words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def fold(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null is the empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def fold_words(text: str | None) -> bytes:
    """As ``fold``, with ASCII punctuation as spaces."""
    return fold(text).translate(_PUNCTUATION)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(2 * n, 1 << 16)  # grown as needed: every task builds its own
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), vectorised."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(raw) + 2, np.int8)
    space[1:-1] = _SPACE[raw]
    edge = np.diff(space)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hashed(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (byte offsets) of every word of ``buf`` (already folded)."""
    out, at = [], 0
    while at < len(buf):
        end = len(buf)
        if end - at > PIECE:
            window = np.frombuffer(buf, np.uint8, PIECE, at)
            cut = np.flatnonzero(_SPACE[window])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word longer than a piece: up to the next space
                rest = [p for p in (buf.find(bytes([c]), at) for c in (0x20, 9, 10, 11, 12, 13)) if p >= 0]
                end = min(rest) + 1 if rest else len(buf)
        raw = np.frombuffer(buf, np.uint8, end - at, at)
        up, down = _powers(len(raw) + 1)
        starts, ends = _spans(raw)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * up[: len(raw)], dtype=np.uint64, out=total[1:])
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        out.append((h, starts + at, ends + at))
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def chunks(texts: Iterable[tuple], size: int, fold: Callable[[str | None], bytes] = fold) -> Iterator[tuple[list, bytes, np.ndarray]]:
    """Rows whose last item is a text, in groups of about ``size`` bytes.

    Yields (rows without the text, joined buffer, start offset of each text); texts are
    joined by a line break, so no word spans two of them.
    """
    rows, parts, starts, total = [], [], [], 0
    for *row, text in texts:
        b = fold(text)
        if rows and total + len(b) > size:
            yield rows, b"\n".join(parts), np.array(starts, np.int64)
            rows, parts, starts, total = [], [], [], 0
        rows.append(tuple(row))
        parts.append(b)
        starts.append(total)
        total += len(b) + 1
    if rows:
        yield rows, b"\n".join(parts), np.array(starts, np.int64)
