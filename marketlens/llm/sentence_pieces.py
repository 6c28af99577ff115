"""SentencePiece BPE encoding and decoding with spans of the original bytes.

The model file is read here (its pieces, flags and compiled character map).  ``Normaliser``
walks the text from left to right, replaces the longest prefix that the character map knows,
and records for every normalised byte where in the source it comes from.  ``Codec`` cuts the
normalised text into segments that no piece can cross, merges each by the highest-scored pair
first, falls back to byte pieces, and projects every piece through the recorded alignment to a span
of original bytes.  Decoding joins the pieces of the ids.

A segment is what lies between two neighbouring characters that stand side by side in no
piece of the vocabulary: no merge can join them, so merging segments alone gives the merges of
the whole text.  Segments repeat, so their ids are held in a table of bounded size; new ones
are merged many at a time, as rows of a matrix (a round joins the best pair of every row).  Texts
are worked on in blocks of ``BLOCK`` bytes; a block's last segment waits for the next block,
so memory follows the block, not the text.

Defined cases: a null text is the empty text (its only id is the end id); bytes that are no
UTF-8 become U+FFFD; repeated rows and null or equal ids give a row each; an empty
table gives no rows; other columns are not read, so their names may clash; models other than
BPE, with white space as a suffix or with a denormaliser are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20
TABLE_SEGMENTS, TABLE_IDS = 300_000, 3_000_000  # what a codec's table holds before it starts anew
ROW = 40  # characters of the segments that are merged as rows of a matrix; longer ones go one by one
SPACE = "▁"
# Kinds of pieces in the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
NONE = np.iinfo(np.int32).max


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What encoding needs of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        parts = {2: b"", 3: b"", 5: b""}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number in parts:
                parts[number] += value
        trainer, rules = dict(fields(parts[2])), dict(fields(parts[3]))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or dict(fields(parts[5])).get(2):
            raise ValueError("only BPE models with white space before words and no denormaliser are supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_surface = trainer[44].decode() if 44 in trainer else " ⁇ "
        self.end = self.pieces.index(trainer[47].decode() if 47 in trainer else "</s>")
        self.char_map = rules.get(2, b"")
        self.dummy_prefix, self.trim, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.users = sorted((p for p, k in zip(self.pieces, self.kinds) if k == USER), key=len, reverse=True)


class Normaliser:
    """Longest-prefix normalisation with the source offset of every normalised byte."""

    def __init__(self, model: Model):
        self.model = model
        self.space = (SPACE if model.escape else " ").encode()
        self.users = re.compile(b"|".join(re.escape(u.encode()) for u in model.users)) if model.users else None
        self.units: list[int] = []
        self.plain = None
        if model.char_map:
            (size,) = struct.unpack_from("<I", model.char_map)
            self.units = list(struct.unpack_from(f"<{size // 4}I", model.char_map, 4))
            self.replacements = model.char_map[4 + size :]
        inert = [c for c in range(0x21, 0x7F) if self._inert(c)]
        if inert and not self.users:
            # Runs of characters that start no key with what follows them; the last one before other bytes is looked up.
            self.plain = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in inert) + rb"]+(?![\x80-\xff])")

    def _step(self, node: int, byte: int) -> int | None:
        """The node after ``byte``, of the double array."""
        node ^= byte
        unit = self.units[node]
        return None if unit & 0x800000FF != byte else node ^ self._jump(unit)

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _inert(self, byte: int) -> bool:
        """No key is this ASCII character alone, or goes on from it with another one."""
        if not self.units:
            return True
        root = self._jump(self.units[0])
        at = root ^ byte
        if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
            return True
        if self.units[at] & 0x100:
            return False
        child = at ^ self._jump(self.units[at])
        return all((child ^ c) >= len(self.units) or self.units[child ^ c] & 0x800000FF != c for c in range(1, 0x80))

    def prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest known prefix at ``at`` and the length it replaces."""
        if self.users and (found := self.users.match(data, at)):
            return found.group(), found.end() - at
        if self.units:
            best, node = None, self._jump(self.units[0])
            for i in range(at, len(data)):
                unit_at = node ^ data[i]
                if unit_at >= len(self.units):
                    break
                unit = self.units[unit_at]
                if unit & 0x800000FF != data[i]:
                    break
                node = unit_at ^ self._jump(unit)
                if unit & 0x100:
                    best = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
            if best:
                begin = best[0]
                return self.replacements[begin : self.replacements.index(b"\0", begin)], best[1]
        size = char_size(data, at)
        return (data[at : at + size], size) if size else ("�".encode(), 1)

    def blocks(self, data: bytes, size: int = BLOCK) -> Iterator[tuple[bytes, np.ndarray, int]]:
        """Normalised bytes, the source offset of each, and the source offset after them, block by block."""
        if not data:
            return
        model = self.model
        simple = not self.units and not self.users and not model.trim and valid(data)
        before, at = model.trim, 0
        if model.trim:
            while at < len(data):
                text, used = self.prefix(data, at)
                if text != b" ":
                    break
                at += used
            if at == len(data):
                return
        lead = self.space if model.dummy_prefix else b""
        out, origin = [lead], [np.full(len(lead), at, np.int64)]
        if simple:
            while at < len(data):
                end = min(at + max(size, 4), len(data))
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end -= 1
                raw = np.frombuffer(data, np.uint8, end - at, at)
                out.append(data[at:end].replace(b" ", self.space))
                origin.append(np.repeat(np.arange(at, end), np.where(raw == 0x20, len(self.space), 1)))
                yield b"".join(out), np.concatenate(origin), end
                out, origin, at = [], [], end
            return
        made, where = bytearray(lead), [at] * len(lead)
        while at < len(data):
            if self.plain and (run := self.plain.match(data, at, at + size)):
                made += run.group()
                where.extend(range(at, run.end()))
                at, before = run.end(), False
            else:
                text, used = self.prefix(data, at)
                if before:
                    text = text.lstrip(b" ")
                if text:
                    new = text.replace(b" ", self.space)
                    made += new
                    where.extend([at] * len(new))
                    before = text.endswith(b" ")
                at += used
                before = before and model.trim
            if len(made) >= size:
                cut = self._kept(made)  # spaces at the end wait: those at the end of the text go
                if cut:
                    yield bytes(made[:cut]), np.array(where[:cut], np.int64), where[cut] if cut < len(where) else at
                    made, where = made[cut:], where[cut:]
        cut = self._kept(made)
        yield bytes(made[:cut]), np.array(where[:cut], np.int64), where[cut] if cut < len(where) else at

    def _kept(self, made: bytearray) -> int:
        end = len(made)
        while self.model.trim and made.endswith(self.space, 0, end):
            end -= len(self.space)
        return end


def valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def char_size(data: bytes, at: int) -> int:
    """Bytes of the code point at ``at``; 0 if they are no UTF-8."""
    lead = data[at]
    size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    return size if size and valid(data[at : at + size]) and at + size <= len(data) else 0


class Numbered(dict):
    """Numbers keys in the order they are first asked for; ``new`` lists those not seen before."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at


class Codec:
    """Ids and source spans of texts, and texts of ids, for one model."""

    def __init__(self, model: Model):
        self.model, self.normaliser = model, Normaliser(model)
        known = [(p, i) for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER, UNUSED)]
        self.merges = {p: (-model.scores[i], i) for p, i in known}
        self.ids = dict(known) | {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (UNKNOWN, CONTROL, BYTE)}
        self.unknown = model.kinds.index(UNKNOWN)
        self.unused = {p for p, i in known if model.kinds[i] == UNUSED}
        self.bytes = [self.ids.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.users = re.compile("|".join(map(re.escape, model.users)) + "|(?s:.)") if model.users else None
        self.decimal = [str(i) for i in range(len(model.pieces))]
        self._build_rows()
        self.clear()
        inside = {pair for p, _ in known for pair in itertools.pairwise(p)}
        # Commonly no piece goes on from another character to a space: then segments end before spaces, around
        # characters of no piece, and between a letter or digit and what follows none in any piece.
        self.words = None
        if not any(b == SPACE != a for a, b in inside):
            seen = {c for pair in inside for c in pair}
            lone = "".join(re.escape(chr(c)) for c in range(0x80) if chr(c) not in seen)
            follows = "".join(sorted(re.escape(b) for b in {b for a, b in inside if re.match(r"\w", a) and not re.match(r"\w", b)}))
            word = rf"[^\w{SPACE}{lone}]*\w*"
            self.words = re.compile((f"[{lone}]+|" if lone else "") + f"{SPACE}*{word}" + (f"(?:[{follows}]{word})*" if follows else ""))
        self.inside = inside
        # Decoding: what each id stands for.
        self.surface = [
            b"" if k == CONTROL else model.unknown_surface.encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()
            for p, k in zip(model.pieces, model.kinds)]
        self.is_byte = {i for i, k in enumerate(model.kinds) if k == BYTE}

    def segments(self, text: str) -> list[str]:
        if self.words:
            found = self.words.findall(text)
            return found[:-1] if found and not found[-1] else found
        edges = [0, *(i + 1 for i, pair in enumerate(itertools.pairwise(text)) if pair not in self.inside), len(text)]
        return [text[a:b] for a, b in itertools.pairwise(edges) if b > a]

    def merge(self, segment: str) -> list[str]:
        """The pieces of a segment: the pair with the highest score (the leftmost of equals) is joined until none is left."""
        parts = self.users.findall(segment) if self.users else list(segment)
        fixed = set(self.model.users)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap, made = [], {}

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or parts[a] in fixed or parts[b] in fixed:
                return
            joined = parts[a] + parts[b]
            found = self.merges.get(joined)
            if found:
                heapq.heappush(heap, (found[0], a, b, len(joined)))
                if joined in self.unused:
                    made[joined] = (parts[a], parts[b])

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size or right[a] != b:
                continue
            parts[a], parts[b] = parts[a] + parts[b], ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out = []
        for part in filter(None, parts):
            stack = [part]
            while stack:  # a piece that must not be used is taken apart again
                piece = stack.pop()
                if piece in made:
                    stack += reversed(made[piece])
                else:
                    out.append(piece)
        return out

    def spell(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Ids of merged pieces and the normalised bytes that each covers."""
        ids, sizes = [], []
        for piece in pieces:
            i, raw = self.ids.get(piece, self.unknown), piece.encode()
            if i == self.unknown and self.model.byte_fallback:
                ids += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]  # the last byte piece stands for the character
            elif i == self.unknown and ids and ids[-1] == i:
                sizes[-1] += len(raw)
            else:
                ids.append(i)
                sizes.append(len(raw))
        return ids, sizes

    def _build_rows(self) -> None:
        """Tables for merging many segments at once: every split of a piece into two symbols.

        A symbol is the id of a piece, or the number of pieces plus the code point of a
        character that is no piece.
        """
        v = len(self.model.pieces)
        self.by_rows = self.model.byte_fallback and not self.unused and not self.model.users

        def symbol(part: str) -> int | None:
            found = self.merges.get(part)
            return found[1] if found else v + ord(part) if len(part) == 1 else None

        order = {score: r for r, score in enumerate(sorted({score for score, _ in self.merges.values()}))}
        splits = [((a << 32) | b, order[score], i) for p, (score, i) in self.merges.items() for k in range(1, len(p))
                  if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None]
        table = np.array(sorted(splits), np.int64).reshape(-1, 3)
        self.split_key = np.append(table[:, 0], np.iinfo(np.int64).max)
        self.split_rank = np.append(table[:, 1], NONE).astype(np.int32)
        self.split_id = np.append(table[:, 2], 0).astype(np.int32)
        self.of_char = np.arange(v, v + 0x110000, dtype=np.int32)
        for p, (_, i) in self.merges.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.piece_bytes = np.array([len(p.encode()) for p in self.model.pieces], np.int32)
        self.byte_ids = np.array(self.bytes, np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of joining ``a`` and ``b`` (``NONE``: no such piece) and the piece they make."""
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.split_key, key)
        return np.where((self.split_key[at] == key) & (b >= 0), self.split_rank[at], NONE), self.split_id[at]

    def _merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merges every row of a matrix of symbols (-1: no more); returns the merged rows."""
        done = np.full_like(symbols, -1)
        row = np.arange(len(symbols))
        rank, made = self._pairs(symbols[:, :-1], symbols[:, 1:])
        place = np.arange(symbols.shape[1])
        while len(row):
            best = rank.argmin(axis=1)
            at = np.arange(len(row))
            open_ = rank[at, best] != NONE
            if not open_.all():
                done[row[~open_], : symbols.shape[1]] = symbols[~open_]
                row, symbols, rank, made, best = row[open_], symbols[open_], rank[open_], made[open_], best[open_]
                if not len(row):
                    break
                at = np.arange(len(row))
            symbols[at, best] = made[at, best]
            # The symbol after the pair's first one goes; what stands behind it moves up.
            source = place + (place > best[:, None])
            source[:, -1] = np.minimum(source[:, -1], len(place) - 1)
            symbols = np.take_along_axis(symbols, source, axis=1)
            symbols[:, -1] = -1
            source = place[:-1] + (place[:-1] >= best[:, None])
            source = np.minimum(source, len(place) - 2)
            rank, made = np.take_along_axis(rank, source, axis=1), np.take_along_axis(made, source, axis=1)
            rank[:, -1] = NONE
            for k in (best - 1, best):
                some = np.flatnonzero((k >= 0) & (k < len(place) - 1))
                k = k[some]
                rank[some, k], made[some, k] = self._pairs(symbols[some, k], symbols[some, k + 1])
        return done

    def clear(self) -> None:
        self.table = Numbered()
        self.flat_ids, self.flat_sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Adds the ids of new segments, numbered on from those that the table holds."""
        size = np.fromiter(map(len, new), np.int64, len(new))
        ids, sizes, counts, order = [], [], [], []
        low = 0
        for top in (4, 8, 12, 20, ROW) if self.by_rows else ():
            rows = np.flatnonzero((size > low) & (size <= top))
            low = top
            if len(rows):
                chars = np.frombuffer("".join([new[i] for i in rows]).encode("utf-32-le"), np.uint32)
                matrix = np.full((len(rows), top), -1, np.int32)
                matrix[np.arange(top) < size[rows, None]] = self.of_char[chars]
                for held, got in zip((ids, sizes, counts), self._spell_rows(self._merge_rows(matrix)), strict=True):
                    held.append(got)
                order.append(rows)
        for r in np.flatnonzero(size > low):
            i, z = self.spell(self.merge(new[r]))
            for held, got in zip((ids, sizes, counts, order), (i, z, [len(i)], [r]), strict=True):
                held.append(np.array(got, np.int32))
        counts, order = np.concatenate(counts).astype(np.int64), np.concatenate(order)
        begin, count = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        begin[order], count[order] = len(self.flat_ids) + np.cumsum(counts) - counts, counts
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        self.flat_ids, self.flat_sizes = np.concatenate([self.flat_ids, *ids]), np.concatenate([self.flat_sizes, *sizes])

    def _spell_rows(self, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``spell`` for the rows of a matrix of symbols: ids, bytes covered, ids a row."""
        v = len(self.model.pieces)
        some = merged >= 0
        symbol = merged[some]
        char = np.maximum(symbol - v, 0)
        width = np.where(symbol < v, 1, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000))
        rows = np.repeat(np.arange(len(merged)), some.sum(axis=1))
        counts = np.bincount(rows, weights=width, minlength=len(merged)).astype(np.int64)
        k = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        symbol, char, width = np.repeat(symbol, width), np.repeat(char, width), np.repeat(width, width)
        shifted = char >> (6 * (width - 1 - k))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width]
        byte = np.where(k > 0, 0x80 | (shifted & 0x3F), lead | shifted) & 0xFF
        known = symbol < v
        ids = np.where(known, symbol, self.byte_ids[byte]).astype(np.int32)
        sizes = np.where(known, self.piece_bytes[np.where(known, symbol, 0)], np.where(k == width - 1, width, 0)).astype(np.int32)
        return ids, sizes, counts

    def lookup(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of segments in order, the normalised bytes that each id covers, and the ids of each segment."""
        if len(self.table) >= TABLE_SEGMENTS or len(self.flat_ids) >= TABLE_IDS:
            self.clear()
        at = np.fromiter(map(self.table.__getitem__, segments), np.int64, len(segments))
        if self.table.new:
            self.learn(self.table.new)
            self.table.new = []
        count = self.count[at]
        total = np.cumsum(count)
        take = np.arange(total[-1] if len(total) else 0) + np.repeat(self.begin[at] - total + count, count)
        return self.flat_ids[take], self.flat_sizes[take], count

    def _ids_of(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of neighbouring segments and the normalised bytes that each covers."""
        ids, sizes, _ = self.lookup(segments)
        if not self.model.byte_fallback:  # unknown pieces that meet are one piece
            same = np.flatnonzero((ids[1:] == self.unknown) & (ids[:-1] == self.unknown)) + 1
            if len(same):
                keep = np.ones(len(ids), bool)
                keep[same] = False
                ids, sizes = ids[keep], np.add.reduceat(sizes, np.flatnonzero(keep))
        return ids, sizes

    def encode(self, data: bytes, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids with the begin and end of their source bytes, block by block; the last block is the end id."""
        rest, origin, after = "", np.zeros(0, np.int64), 0
        for item in itertools.chain(self.normaliser.blocks(data, block), [None]):
            if item:
                rest, origin, after = rest + item[0].decode(), np.concatenate([origin, item[1]]), item[2]
            segments = self.segments(rest)
            if item:
                # An unknown piece may go on in the next block, as a segment may.
                rest = segments.pop() if segments else ""
                while not self.model.byte_fallback and segments and self._ids_of(segments[-1:])[0][-1] == self.unknown:
                    rest = segments.pop() + rest
            ids, sizes = self._ids_of(segments)
            if len(ids):
                ends = np.cumsum(sizes)
                source = np.append(origin, after)
                yield ids, source[ends - sizes], source[ends]
                origin = origin[ends[-1]:]
        yield np.array([self.model.end]), np.array([len(data)]), np.array([len(data)])

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """Text of ids that come in parts."""

    def __init__(self, codec: Codec):
        self.codec, self.pending, self.first, self.empty = codec, b"", codec.model.dummy_prefix or codec.model.trim, True

    def feed(self, ids: list[int]) -> bytes:
        codec, out, at = self.codec, [], 0
        while self.first and at < len(ids):  # spaces before the first text
            i = ids[at]
            if i in codec.is_byte:
                self.first = False
                break
            at += 1
            text = codec.surface[i]
            if codec.model.kinds[i] not in (CONTROL, UNKNOWN) and text.startswith(b" "):
                text = text[1:]
                self.first = codec.model.trim
            if text:
                self.first = False
            out.append(text)
        end = len(ids)
        while end > at and ids[end - 1] in codec.is_byte:  # these may go on in the next part
            end -= 1
        body = list(map(codec.surface.__getitem__, ids[at:end]))
        joined = self.pending + b"".join(body)
        if valid(joined):  # pieces other than bytes are whole characters, so every run of bytes is valid too
            out.append(joined)
            self.pending = b""
        else:
            for i, text in zip(ids[at:end], body):
                if i in codec.is_byte:
                    self.pending += text
                else:
                    out += (self.close(), text)
            if end > at:
                out.append(self.close())
        self.pending += b"".join(map(codec.surface.__getitem__, ids[end:]))
        return b"".join(out)

    def close(self) -> bytes:
        """The text of the byte pieces read last; bytes that are no UTF-8 become U+FFFD one by one."""
        data, self.pending = self.pending, b""
        if valid(data):
            return data
        out, at = [], 0
        while at < len(data):
            size = char_size(data, at)
            out.append(data[at : at + size] if size else "\ufffd".encode())
            at += size or 1
        return b"".join(out)


def encode_documents(docs: DataFrame, id_col: str, text_col: str, model: bytes, pieces: bool = True) -> DataFrame:
    """One row per document: the number of ids (with the end id) and the digests of ids, source spans and decoded text.

    ``model`` is the model file's content.  ``pieces`` adds the ids, their spans (``begins``,
    ``ends``, byte offsets) and the decoded text; without it a text's ids are never held whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    shared = spark.sparkContext.broadcast(model)  # the size of the model file, whatever the corpus
    Model(model)  # a model that is not supported raises here
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"] + (["ids", "begins", "ends", "decoded"] if pieces else [])
    longs = pa.list_(pa.int64())
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), longs, longs, longs, pa.string()][: len(names)]
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + (
        ", ids array<bigint>, begins array<bigint>, ends array<bigint>, decoded string" if pieces else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Model(shared.value))
        for batch in batches:
            cols, texts = [[] for _ in names], [t.as_py() for t in batch["text"]]
            for group in _groups(texts):
                for row in _documents(codec, group, pieces):
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", *names])

    return rows.mapInArrow(run, schema)


def _groups(texts: list[bytes], size: int = BLOCK) -> Iterator[list[bytes]]:
    """The texts in groups of about ``size`` bytes."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def _documents(codec: Codec, texts: list[bytes], pieces: bool) -> Iterator[list]:
    """A row of results for each text; the segments of all texts of one block are looked up together."""
    whole = [i for i, t in enumerate(texts) if len(t) <= BLOCK] if codec.model.byte_fallback else []
    blocks = {i: list(codec.normaliser.blocks(texts[i], 8 * BLOCK + 8)) for i in whole}
    segments = {i: codec.segments("".join(b.decode() for b, _, _ in blocks[i])) for i in whole}
    ids, sizes, counts = codec.lookup(list(itertools.chain.from_iterable(segments.values())))
    segment = token = 0
    upto = np.append(0, np.cumsum(counts))
    for i, text in enumerate(texts):
        if i not in blocks:
            yield _document(codec, text, codec.encode(text), pieces)
            continue
        segment += len(segments[i])
        part = slice(token, token := int(upto[segment]))
        ends = np.cumsum(sizes[part])
        source = np.concatenate([*[o for _, o, _ in blocks[i]], [blocks[i][-1][2] if blocks[i] else 0]])
        end = np.array([len(text)])
        made = [np.append(ids[part], codec.model.end), np.append(source[ends - sizes[part]], end), np.append(source[ends], end)]
        yield _document(codec, text, [made], pieces)


def _document(codec: Codec, text: bytes, blocks: Iterator[tuple], pieces: bool) -> list:
    n, held = 0, [[], [], [], []]
    of_ids, of_text, of_spans = (hashlib.sha256() for _ in range(3))
    decoder = codec.decoder()
    for ids, begins, ends in blocks:
        of_spans.update(np.stack([begins, ends], axis=1).astype("<i8").tobytes())
        ids = ids.tolist()
        of_ids.update(((" " if n else "") + " ".join(map(codec.decimal.__getitem__, ids))).encode())
        n += len(ids)
        decoded = decoder.feed(ids)
        of_text.update(decoded)
        if pieces:
            for h, part in zip(held, (ids, begins.tolist(), ends.tolist(), [decoded]), strict=True):
                h += part
    last = decoder.close()
    of_text.update(last)
    out = [n, *[d.hexdigest() for d in (of_ids, of_text, of_spans)]]
    return [*out, *held[:3], b"".join([*held[3], last]).decode()] if pieces else out
