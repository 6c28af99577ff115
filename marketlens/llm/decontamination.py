"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a mask over consecutive words: positions marked 1 are hashed, positions
marked 0 are ignored, so a substituted word under a 0 does not break the match.  Windows of
the benchmark items are hashed under every mask, and so is every window of every document;
equal hashes of the same mask are hits.  A hit fixes an item, a document and an alignment
(no gaps), and the words around it on that alignment are compared.

Words are lower-cased and ASCII punctuation counts as white space, so that changed marks or
capitals hide nothing.

Rule: a document is contaminated by an item if, on some alignment, ``WINDOW`` consecutive words
of the item (the whole item, if it has fewer, but at least ``LEAST_WORDS``) agree with the
document in at least 80 % of the positions.  The masks are chosen so that every such overlap
contains a hit: for each window length from ``LEAST_WORDS`` to ``WINDOW`` and each way to place the
allowed substitutions, some mask fits between them (``tests/llm`` checks all of them).
So the result does not depend on the hashes or on the number of documents.

A bitmap of the benchmark's hashes, of fixed size (``BITMAP_BITS``, 2 MB at any benchmark size),
goes to all tasks and only spares documents the exchange: windows whose two bits are not set
cannot be hits.  All others go to an ordinary join with the benchmark windows.  A document
sends the stretch of word hashes around its hits, as wide as the longest item, so the
comparison needs no second look at the texts.  A stretch has at most four times the words of the
longest item, so a long text full of hits sends data in proportion to its hits.

Defined cases: null and empty texts and items have no words and no hits; items with fewer
than ``LEAST_WORDS`` words are not looked for; repeated rows of a document (equal id and text) are
one document; repeated items are found under each of their ids; null item ids are kept;
an empty benchmark or table gives no rows in ``find`` and no document is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import cut
from marketlens.llm.tokens import chunks, fold_words, hashed, mix

WINDOW = 15
LEAST_WORDS = 8
AGREE = 0.8
MASKS = ("11111", "111011", "11001011")
BITMAP_BITS = 1 << 24
BITMAP_SHIFTS = (0, 32)  # a seed sets two bits, taken from its lower and upper half
CHUNK_BYTES = 2 << 20


def needed(words: int) -> int:
    """Agreeing words that an overlap window of an item with so many words needs."""
    size = min(words, WINDOW)
    return int(np.ceil(AGREE * size - 1e-9))


def seed_hashes(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of every window of a sequence of word hashes under a mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number, np.uint64)
    for k in range(len(mask)):
        if mask[k] == "1":
            out = out * np.uint64(0x9FB21C651E98DF25) + h[k : k + n]
    return mix(out)


def _word_lists(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Per group of texts: rows (without text), all word hashes, and each text's first word."""
    names = [c for c in batch.schema.names if c != "text"]
    rows = zip(*(batch[c].to_pylist() for c in names), batch["text"].to_pylist(), strict=True)
    for keys, buf, text_starts in chunks(rows, CHUNK_BYTES, fold_words):
        h, starts, _ = hashed(buf)
        yield keys, h, np.append(np.searchsorted(starts, text_starts), len(h))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.binary()), ("at", pa.int32()), ("seed", pa.int64())])
    for batch in batches:
        for keys, h, first in _word_lists(batch):
            out = {"item_id": [], "words": [], "at": [], "seed": []}
            for (item,), lo, hi in zip(keys, first, first[1:], strict=False):
                words = h[lo:hi]
                if len(words) < LEAST_WORDS:
                    continue
                for number, mask in enumerate(MASKS):
                    for at, seed in enumerate(seed_hashes(words, mask, number).view(np.int64).tolist()):
                        for k, v in zip(out, (item, words.tobytes(), at, seed), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id``, ``words`` (hashes of the whole item), ``at`` and ``seed`` of every window under every mask."""
    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_item_windows, "item_id bigint, words binary, at int, seed bigint")


def bitmap(windows: DataFrame) -> np.ndarray:
    """``BITMAP_BITS`` flags (packed), set for the seeds present: 512 rows of 4 KB reach the driver at most."""
    both = F.explode(F.array(*[F.pmod(F.shiftrightunsigned("seed", k), F.lit(BITMAP_BITS)) + 1 for k in BITMAP_SHIFTS]))
    rows = windows.select(both.alias("slot")).select(F.bitmap_bucket_number("slot").alias("bucket"), F.bitmap_bit_position("slot").alias("bit"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _stretches(flags: np.ndarray, reach: int):
    """Stretches of documents around windows whose seed may be in the benchmark."""
    schema = pa.schema([("doc", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("words", pa.binary()),
                        ("hits", pa.list_(pa.struct([("at", pa.int64()), ("seed", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("doc", "t", "start", "words", "hits")}
            for keys, h, first in _word_lists(batch):
                at, seeds = [], []
                for number, mask in enumerate(MASKS):
                    seed = seed_hashes(h, mask, number)
                    hit = np.arange(len(seed))
                    for shift in BITMAP_SHIFTS:
                        slot = ((seed[hit] >> np.uint64(shift)) % np.uint64(BITMAP_BITS)).astype(np.int64)
                        hit = hit[((flags[slot >> 3] >> (slot & 7)) & 1).astype(bool)]
                    hit = hit[first[np.searchsorted(first, hit, side="right")] >= hit + len(mask)]  # inside one text
                    at.append(hit)
                    seeds.append(seed[hit])
                at, seeds = np.concatenate(at), np.concatenate(seeds).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, seeds = at[order], seeds[order]
                if not len(at):
                    continue
                of = np.searchsorted(first, at, side="right") - 1
                # hits nearer than two reaches in one text share a stretch
                cuts = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(at, prepend=-(10**9)) > 2 * reach))
                pieces = []
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                    # a long stretch is cut: each hit has one reach of words on both sides, and copies no more than four
                    while lo < hi:
                        end = lo + int(np.searchsorted(at[lo:hi], at[lo] + 2 * reach, side="right"))
                        pieces.append((lo, end))
                        lo = end
                for lo, hi in pieces:
                    doc = of[lo]
                    a, b = max(first[doc], at[lo] - reach), min(first[doc + 1], at[hi - 1] + reach)
                    out["doc"].append(keys[doc][0])
                    out["t"].append(keys[doc][1])
                    out["start"].append(int(a - first[doc]))
                    out["words"].append(h[a:b].tobytes())
                    out["hits"].append([{"at": int(x - a), "seed": s} for x, s in zip(at[lo:hi].tolist(), seeds[lo:hi].tolist(), strict=True)])
            yield pa.RecordBatch.from_pydict(out, schema=schema)
    return run


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Best window on the alignment where item word 0 stands at document word ``shift``.

    Returns (agreeing words, start in the item, size) of the first best window, or None if it agrees too little.
    """
    size = min(len(item), WINDOW)
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < size:
        return None
    same = np.concatenate([[0], np.cumsum(item[lo:hi] == doc[lo + shift : hi + shift])])
    agree = same[size:] - same[:-size]
    best = int(np.argmax(agree))
    return (int(agree[best]), lo + best, size) if agree[best] >= needed(len(item)) else None


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("t", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("words_agreeing", pa.int32())])
    for batch in batches:
        out = {k: [] for k in schema.names}
        for doc, t, start, words, item_id, item, shift in zip(*(batch[c].to_pylist() for c in ("doc", "t", "start", "words", "item_id", "item_words", "shift")), strict=True):
            found = overlap(np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64), shift)
            if found:
                for k, v in zip(out, (doc, t, item_id, start + shift + found[1], found[0]), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def find(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str) -> DataFrame:
    """``doc``, ``t`` (hash of the text), ``item_id``, ``start`` (document word), ``words_agreeing``: one row per document, item and alignment."""
    windows = cut(benchmark_windows(items, item_id_col, item_text_col), "benchmark-windows")
    flags = bitmap(windows)
    reach = (windows.agg(F.max(F.length("words"))).first()[0] or 0) // 8
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(F.col(text_col)).alias("t"), text.alias("text"))
    stretches = rows.mapInArrow(_stretches(flags, reach), "doc bigint, t bigint, start bigint, words binary, hits array<struct<at:bigint,seed:bigint>>")
    hits = stretches.select("doc", "t", "start", "words", F.explode("hits").alias("hit")).select("doc", "t", "start", "words", F.col("hit.at").alias("hit_at"), F.col("hit.seed").alias("hit_seed"))
    met = hits.join(windows.withColumnRenamed("words", "item_words"), hits["hit_seed"] == F.col("seed"))
    met = met.select("doc", "t", "start", "words", "item_id", "item_words", (F.col("hit_at") - F.col("at")).alias("shift"))
    # Many hits of one alignment are one comparison.
    alone = met.groupBy("doc", "t", "start", "item_id", F.xxhash64("item_words").alias("i"), "shift").agg(F.first("words").alias("words"), F.first("item_words").alias("item_words"))
    return alone.mapInArrow(_verify, "doc bigint, t bigint, item_id bigint, start bigint, words_agreeing int").distinct()


def contaminated(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str) -> DataFrame:
    """``doc``, ``t`` and the sorted ``items`` found, one row per contaminated document."""
    return find(docs, id_col, text_col, items, item_id_col, item_text_col).groupBy("doc", "t").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.count(F.lit(1)).alias("n_overlaps"))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """The two columns that ``contaminated`` names a row by."""
    return doc_id.cast("bigint"), F.xxhash64(text)
