"""Elias-Fano n-gram trie: contexts, pointers and successors as compact monotone sequences.

One shard file holds two levels.  Level one is the sorted context ids and, for each, a
pointer to its first successor; both grow monotonically and are Elias-Fano coded.  Level
two holds the successors of all contexts in a row: a successor is stored relative to its
context (rank of the context times the span, plus the successor's offset), so the whole
level is one monotone sequence too and "is w a successor of v" is one search in it.
Quantised log probabilities lie beside level two.  Files are mapped, not parsed.
"""

from __future__ import annotations

import json
import mmap

import numpy as np

from marketlens.llm.shared import open_fs

CODE_STEPS = 256  # quantisation steps per unit of log10
CODE_MAX = 65535


def quantise(log10p: np.ndarray) -> np.ndarray:
    """Codes of log10 probabilities in (-256, 0]; the error is at most half a step (0.002)."""
    return np.clip(np.rint(-log10p * CODE_STEPS), 0, CODE_MAX).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -CODE_STEPS


class EliasFano:
    """A sorted (repeats allowed) sequence of unsigned integers.

    The low ``l`` bits of each value are packed; the high parts are unary in a bit vector,
    value i setting bit ``high + i``.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.l = n, low_bits
        # 8-byte windows at every byte offset: one gather reads any packed field
        self._low = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,)) if len(low) >= 8 else None
        bits = np.unpackbits(high, bitorder="little")
        zeros = np.flatnonzero(bits == 0)
        self._ends = zeros - np.arange(len(zeros))  # values whose high part is at most h
        self._ones = None
        self._bits = bits

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(low bits per value, packed low bytes, packed high bytes)."""
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low_bits = min(low_bits, 56)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        unary = np.zeros((int(high[-1]) + n + 1) if n else 1, np.uint8)
        unary[high + np.arange(n)] = 1
        fields = np.empty((n, low_bits), np.uint8)
        for k in range(low_bits):
            fields[:, k] = (values >> np.uint64(k)).astype(np.uint8) & 1
        low = np.packbits(fields.reshape(-1), bitorder="little")
        return low_bits, np.concatenate([low, np.zeros(8, np.uint8)]), np.packbits(unary, bitorder="little")

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if self.l == 0:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.l
        return (self._low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.l) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        if self._ones is None:
            self._ones = np.flatnonzero(self._bits)
        high = (self._ones[i] - i).astype(np.uint64)
        return (high << np.uint64(self.l)) | self._low_at(i)

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Number of values below each ``x`` (the position of its successor)."""
        x = x.astype(np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        high = (x >> np.uint64(self.l)).astype(np.int64)
        top = len(self._ends) - 1
        beyond = high > top
        h = np.minimum(high, top)
        hi = self._ends[h].copy()
        lo = np.where(h > 0, self._ends[h - 1], 0)
        want = x & np.uint64((1 << self.l) - 1)
        while True:  # binary search among the values with the same high part
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low_at(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        lo[beyond] = self.n
        return lo


class Trie:
    """A shard: ``find`` gives the code of each (context, successor) or -1."""

    def __init__(self, buffer):
        raw = np.frombuffer(buffer, np.uint8)
        size = int(raw[:8].view("<u8")[0])
        self.head = json.loads(raw[8 : 8 + size].tobytes())
        base = 8 + size
        part = {k: raw[base + a : base + b] for k, (a, b) in self.head["parts"].items()}
        level = lambda k, n: EliasFano(n, self.head["bits"][k], part[f"{k}_low"], part[f"{k}_high"])
        self.contexts = level("contexts", self.head["n_contexts"])
        self.pointers = level("pointers", self.head["n_contexts"] + 1)
        self.successors = level("successors", self.head["n"])
        self.codes = np.frombuffer(part["codes"].tobytes(), np.uint16) if self.head["n"] else np.zeros(0, np.uint16)
        self.span = self.head["span"]

    @staticmethod
    def build(contexts: np.ndarray, successors: np.ndarray, codes: np.ndarray, span: int) -> bytes:
        """Contexts and successors sorted together, without repeats; successors are below ``span``."""
        heads, first = np.unique(contexts, return_index=True)
        ends = np.append(first, len(contexts))
        rank = np.repeat(np.arange(len(heads), dtype=np.uint64), np.diff(ends))
        levels = {
            "contexts": (heads, int(heads[-1]) + 1 if len(heads) else 1),
            "pointers": (ends, len(contexts) + 1),
            "successors": (rank * np.uint64(span) + successors.astype(np.uint64), max(1, len(heads) * span)),
        }
        bits, parts, body, at = {}, {}, [], 0
        for name, (values, universe) in levels.items():
            bits[name], low, high = EliasFano.encode(values, universe)
            for kind, a in (("low", low), ("high", high)):
                parts[f"{name}_{kind}"] = (at, at + a.nbytes)
                body.append(a.tobytes())
                at += a.nbytes
        parts["codes"] = (at, at + codes.nbytes)
        body.append(codes.astype(np.uint16).tobytes())
        head = json.dumps({"n": len(contexts), "n_contexts": len(heads), "span": span, "bits": bits, "parts": parts}).encode()
        head += b" " * (-len(head) % 8)
        return np.uint64(len(head)).tobytes() + head + b"".join(body)

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Code of each pair, -1 where the trie has none: context, its pointers, then the successor in its range."""
        out = np.full(len(contexts), -1, np.int32)
        if not self.head["n"]:
            return out
        node = self.contexts.rank(contexts)
        ok = np.flatnonzero(node < self.contexts.n)
        ok = ok[self.contexts.get(node[ok]) == contexts[ok].astype(np.uint64)]
        key = node[ok].astype(np.uint64) * np.uint64(self.span) + successors[ok].astype(np.uint64)
        at = self.successors.rank(key)
        inside = at < self.pointers.get(node[ok] + 1).astype(np.int64)
        ok, key, at = ok[inside], key[inside], at[inside]
        hit = self.successors.get(at) == key
        out[ok[hit]] = self.codes[at[hit]]
        return out


def write_shard(uri: str, data: bytes) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)


def open_shard(uri: str) -> Trie:
    """Map the file where the shared folder is mounted; else read it whole (a shard has a bounded size)."""
    fs, path = open_fs(uri)
    if fs.type_name == "local":
        with open(path, "rb") as f:
            return Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with fs.open_input_file(path) as f:
        return Trie(f.read())
