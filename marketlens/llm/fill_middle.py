"""Fill-in-the-middle documents from seekable compressed texts.

``store_frames`` writes every text as independent zstandard frames of at most ``FRAME`` bytes
into one file a task (a file is a plain zstandard stream), and returns the index: where each
frame lies and how many units (lines), code points and bytes come before it.  A cut after unit
k is found by a search in the cumulative counts; only the frame that holds it is decompressed.
The output is streamed frame by frame, in the order of its form, into its digest and into
frames of its own; the text is restored from those frames and the form alone, again as a stream.
So a task holds a frame or two and one compressed document, whatever the length of the text.

Units are ``[^\\n]*\\n|[^\\n]+``.  The cuts, the form and the rate come from the first four
8-digit groups of the sha256 of ``<seed>:<id>``, as column expressions.

Defined cases: a null text is the empty text; a null id hashes as the empty string; an empty
text, or one that holds a tag, stays plain; repeated rows and equal ids give a row each; an
empty table gives no rows; other columns are not read, so their names may clash; a line
longer than a frame spans several frames.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import open_fs

FRAME = 64 << 10
STORE_BYTES = 256 << 20
READ_AHEAD = 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDER = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}  # tag and part
SEED, RATE, SPM_RATE = "7", 100, 50

_LIST = pa.list_(pa.int64())
_INDEX = ("doc_id {id}, path string, n bigint, chars bigint, size bigint, tagged boolean, offsets array<bigint>, lengths array<bigint>, "
          "units array<bigint>, points array<bigint>, starts array<bigint>")


class Frames:
    """A byte string as compressed frames with cumulative counts before each frame.

    ``load(i)`` gives the compressed bytes of frame i; the last frame read stays decompressed.
    """

    def __init__(self, starts: list[int], size: int, load, units: list[int] = (), points: list[int] = ()):
        self.starts, self.size, self.load, self.units, self.points = starts, size, load, units, points
        self._held, self._data, self._zstd = -1, b"", zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        if i != self._held:
            self._data, self._held = self._zstd.decompress(self.load(i)), i
        return self._data

    def place(self, unit: int, n: int, chars: int) -> tuple[int, int]:
        """Bytes and code points before the end of unit number ``unit`` (of ``n``)."""
        if unit <= 0:
            return 0, 0
        if unit >= n:
            return self.size, chars
        i = bisect_left(self.units, unit) - 1  # the last frame with fewer line ends before it
        data = np.frombuffer(self.frame(i), np.uint8)
        end = int(np.flatnonzero(data == 10)[unit - self.units[i] - 1]) + 1
        return self.starts[i] + end, self.points[i] + code_points(data[:end])

    def stream(self, begin: int, end: int) -> Iterator[bytes]:
        """The bytes from ``begin`` to ``end``, a frame at a time."""
        i = bisect_right(self.starts, begin) - 1
        while begin < end:
            data = self.frame(i)
            at = begin - self.starts[i]
            part = data[at : at + end - begin] if at or end - begin < len(data) else data
            yield part
            begin += len(part)
            i += 1


class FrameWriter:
    """Collects a byte stream as compressed frames."""

    def __init__(self, size: int = FRAME):
        self.limit, self.held, self.buffer, self.frames, self.starts, self.size = size, 0, [], [], [], 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def write(self, data: bytes) -> None:
        self.buffer.append(data)
        self.held += len(data)
        if self.held >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.starts.append(self.size)
            self.frames.append(self.zstd.compress(b"".join(self.buffer)))
            self.size += self.held
            self.buffer, self.held = [], 0

    def done(self) -> Frames:
        self.flush()
        return Frames(self.starts, self.size, self.frames.__getitem__)


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _cut_frames(text: bytes, limit: int) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = min(at + limit, len(text))
        while at + 4 < end < len(text) and text[end] & 0xC0 == 0x80:  # not inside a code point
            end -= 1
        yield text[at:end]
        at = end


def store_frames(docs: DataFrame, id_col: str, text_col: str, folder: str, frame_bytes: int = FRAME) -> DataFrame:
    """Writes the texts below ``folder`` (a URI); the index has a row per row of ``docs``.

    Every task attempt writes files of its own names, so a rerun task leaves no mixed files.  The
    index has to be written (``cut``) before it is used.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        task = TaskContext.get()
        zstd = zstandard.ZstdCompressor(level=3)
        out, at, seq, path = None, 0, 0, None
        for batch in batches:
            cols = {k: [] for k in ("path", "n", "chars", "size", "tagged", "offsets", "lengths", "units", "points", "starts")}
            for text in batch["text"]:
                text = text.as_py()
                if out is None or at >= STORE_BYTES:
                    if out is not None:
                        out.close()
                    fs.create_dir(base, recursive=True)
                    path = f"{folder}/frames-{task.partitionId():05d}-{task.taskAttemptId()}-{seq}.zst"
                    out, at, seq = fs.open_output_stream(open_fs(path)[1], compression=None), 0, seq + 1
                offsets, lengths, units, points, starts = [], [], [], [], []
                lines = chars = start = 0
                for raw in _cut_frames(text, frame_bytes):
                    packed = zstd.compress(raw)
                    out.write(packed)
                    for a, v in ((offsets, at), (lengths, len(packed)), (units, lines), (points, chars), (starts, start)):
                        a.append(v)
                    at += len(packed)
                    lines += raw.count(b"\n")
                    chars += code_points(np.frombuffer(raw, np.uint8))
                    start += len(raw)
                n = lines + (len(text) > 0 and not text.endswith(b"\n"))
                for a, v in zip(cols.values(), (path, n, chars, len(text), any(t in text for t in (PREFIX, SUFFIX, MIDDLE)),
                                                offsets, lengths, units, points, starts), strict=True):
                    a.append(v)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()] + [_LIST] * 5
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)]], names=["doc_id", *cols])
        if out is not None:
            out.close()

    return rows.mapInArrow(run, _INDEX.format(id=kind))


def plan_cuts(index: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The index with ``form``, ``first`` and ``second`` (units before the two cuts)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)

    def draw(i: int, below: Column) -> Column:
        return F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("bigint") % below

    n = F.col("n") + 1
    plain = F.col("tagged") | (F.col("size") == 0) | (draw(2, F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(draw(3, F.lit(100)) < spm_rate, "spm").otherwise("psm")
    return index.withColumns({"form": form, "first": F.least(draw(0, n), draw(1, n)), "second": F.greatest(draw(0, n), draw(1, n))})


class _File:
    """Reads ranges of a stored file, a megabyte ahead."""

    def __init__(self):
        self.path, self.stream, self.at, self.data = None, None, 0, b""

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            fs, at = open_fs(path)
            self.path, self.stream, self.data = path, fs.open_input_file(at), b""
        if offset < self.at or offset + length > self.at + len(self.data):
            self.at, self.data = offset, self.stream.read_at(max(length, READ_AHEAD), offset)
        begin = offset - self.at
        return self.data[begin : begin + length]


def find_tag(text: Frames, tag: bytes, begin: int) -> int:
    """Offset of the first ``tag`` at or after ``begin``."""
    tail, at = b"", begin
    for part in text.stream(begin, text.size):
        data = tail + part
        found = data.find(tag)
        if found >= 0:
            return at - len(tail) + found
        at += len(part)
        tail = data[-(len(tag) - 1):]
    raise ValueError(f"no {tag.decode()} in the output")


def restore(output: Frames, form: str) -> Iterator[bytes]:
    """The original text as a stream, from an output and its form alone."""
    if form == "plain":
        yield from output.stream(0, output.size)
        return
    order = ORDER[form]
    begins = [0]
    for tag, _ in order[1:]:
        begins.append(find_tag(output, tag, begins[-1] + len(order[0][0])))
    spans = {part: (b + len(tag), e) for (tag, part), b, e in zip(order, begins, [*begins[1:], output.size], strict=True)}
    for part in sorted(spans):
        yield from output.stream(*spans[part])


def by_file(index: DataFrame) -> DataFrame:
    """The index dealt out with as many partitions as there are stored files, each file in order.

    Index rows are small beside the frames, so partitions of equal index bytes would be few.
    """
    files = index.select("path").distinct().count()
    return index.repartition(max(files, 1), "path").sortWithinPartitions("path", F.try_element_at("offsets", F.lit(1)))


def transform(planned: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document of ``plan_cuts``: its form, the lengths of prefix and middle, and both digests.

    ``with_text`` adds the output itself (``output``).
    """
    planned = by_file(planned)
    kind = planned.schema["doc_id"].dataType.simpleString()
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + (["output"] if with_text else [])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()][: len(names)]
    schema = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string" + (
        ", output string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _File()
        for batch in batches:
            cols = [[] for _ in names]
            for row in batch.drop_columns(["doc_id"]).to_pylist():
                source = Frames(row["starts"], row["size"], lambda i, r=row: file.read(r["path"], r["offsets"][i], r["lengths"][i]), row["units"], row["points"])
                form, prefix, middle = row["form"], None, None
                out, digest = FrameWriter(), hashlib.sha256()
                if form == "plain":
                    pieces = [(b"", (0, source.size))]
                else:
                    (a, chars_a), (b, chars_b) = (source.place(row[c], row["n"], row["chars"]) for c in ("first", "second"))
                    prefix, middle = chars_a, chars_b - chars_a
                    parts = ((0, a), (a, b), (b, source.size))
                    pieces = [(tag, parts[part]) for tag, part in ORDER[form]]
                for tag, span in pieces:
                    for data in chain((tag,), source.stream(*span)):
                        digest.update(data)
                        out.write(data)
                output, back = out.done(), hashlib.sha256()
                for data in restore(output, form):
                    back.update(data)
                values = [row["n"], form, prefix, middle, digest.hexdigest(), back.hexdigest()]
                if with_text:
                    values.append(b"".join(output.stream(0, output.size)).decode("utf-8", "replace"))
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", *names])

    return planned.mapInArrow(run, schema)

