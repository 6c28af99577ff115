"""Bigram language model over a corpus, scored through a sharded Elias-Fano trie.

Training texts give the counts c(w), c(v, w); a text starts in the context of the end
token.  The model is the hierarchical Dirichlet one, a proper distribution over the V
known tokens and one unknown token:

    P(w)   = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P(w|v) = (c(v, w) + mu P(w)) / (c(v) + mu)

Work is done on blocks of about ``BLOCK_BYTES`` of text.  A block keeps its texts as local
word numbers (by falling frequency, so they pack well) and later passes never tokenise again.
Two exchanges of packed arrays follow.  In the first a block sends its words with their
training counts to word shards, by hash; a shard adds the counts up by the words' bytes and
answers with dense numbers and counts.  In the second it sends its distinct word pairs to trie
shards; a shard merges the counts, builds its trie, writes it to the shared folder, maps and
queries it, and only quantised codes go back.  Pairs are dealt by tiles of ``TILE_V`` contexts and
``TILE_W`` successors, so a frequent context is spread over many shards.  All counts cover all
training texts; the number of shards follows the number of tokens.

Defined cases: a null or empty text has the end token only; rows with equal ids are
scored apart; a null id counts as the empty text in the split; no training text: N = V = 0
and every probability is that of the unknown token (base and score 0 for an end token
that was never seen: log10(0.5 / 0.5)); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.ngram_trie import Trie, dequantise, open_shard, quantise, write_shard
from marketlens.llm.shared import cut, pack, run_folder, smallest_uint, unpack
from marketlens.llm.tokens import chunks, hashed, mix

MU = 300.0
SPAN = 4096
TILE_V, TILE_W = 64, 16 * SPAN
BLOCK_BYTES = 8 << 20
SHARD_TOKENS = 2_000_000
WORD_SHARDS = 2000  # at most; their sizes are the only list that reaches the driver

_BLOCK = "block string, docs binary, tokens binary, words binary, n_tokens bigint"
_ANSWER = "block string, kind int, shard int, payload binary, size bigint, total bigint"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: packed ids and lengths, local word numbers (0 is the end token), the words and their training counts."""
    part, seq = TaskContext.get().partitionId(), 0
    rows = ((i, t, x) for b in batches for i, t, x in zip(b["id"].to_pylist(), b["train"].to_pylist(), b["text"].to_pylist(), strict=True))
    for docs, buf, doc_starts in chunks(rows, BLOCK_BYTES):
        h, starts, ends = hashed(buf)
        uniq, first, local, seen = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-seen, kind="stable")
        number = np.empty(len(uniq), np.int32)
        number[order] = np.arange(1, len(uniq) + 1, dtype=np.int32)
        of = np.searchsorted(doc_starts, starts, side="right") - 1
        lengths = np.bincount(of, minlength=len(docs)) + 1
        stops = np.cumsum(lengths)
        tokens = np.zeros(int(stops[-1]), np.int32)
        word = np.ones(len(tokens), bool)
        word[stops - 1] = False
        tokens[word] = number[local]
        train = np.array([bool(t) for _, t in docs])
        counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(uniq) + 1)
        first = first[order]
        words = b"\n".join([b"", *(buf[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True))])
        known = np.array([i is not None for i, _ in docs])
        ids = np.array([0 if i is None else i for i, _ in docs], np.int64)
        yield pa.RecordBatch.from_pydict({
            "block": [f"{part}-{seq}"], "docs": [pack(ids, known.view(np.uint8), train.view(np.uint8), lengths.astype(np.int64))],
            "tokens": [pack(smallest_uint(tokens))], "words": [pack(np.frombuffer(words, np.uint8), smallest_uint(counts))], "n_tokens": [len(tokens)]},
            schema=pa.schema([("block", pa.string()), ("docs", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("n_tokens", pa.int64())]))
        seq += 1


def _word_fragments(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"shard": [], "block": [], "frag": []}
            for row in batch.to_pylist():
                raw, counts = unpack(row["words"])
                words = raw.tobytes().split(b"\n")
                # the end token is the empty word, number 0; the others hash as they stand
                shard = np.concatenate([[0], (hashed(raw.tobytes())[0] % np.uint64(shards)).astype(np.int64)])
                order = np.argsort(shard, kind="stable")
                edges = [*np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order)]
                for lo, hi in itertools.pairwise(edges):
                    at = order[lo:hi]
                    out["shard"].append(int(shard[at[0]]))
                    out["block"].append(row["block"])
                    out["frag"].append(pack(smallest_uint(np.diff(at, prepend=0)), counts[at], np.frombuffer(b"\n".join([words[i] for i in at.tolist()]), np.uint8)))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("shard", pa.int32()), ("block", pa.string()), ("frag", pa.binary())]))
    return run


def _word_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of the shard's words; each fragment gets places, numbers within the shard (0: never trained) and counts."""
    pdf = pdf.sort_values("block", kind="stable")
    vocab: dict[bytes, int] = {}
    parts = []
    for frag in pdf["frag"]:
        places, counts, raw = unpack(frag)
        words = raw.tobytes().split(b"\n")
        parts.append((places, np.array([vocab.setdefault(w, len(vocab)) for w in words], np.int64), counts))
    total = np.zeros(len(vocab), np.int64)
    for _, at, counts in parts:
        total[at] += counts.astype(np.int64)  # a fragment has each word once
    number = np.where(total > 0, np.cumsum(total > 0), 0)
    answers = [pack(places, smallest_uint(number[at]), smallest_uint(total[at])) for places, at, _ in parts]
    return pd.DataFrame({"block": pdf["block"].to_numpy(), "kind": 0, "shard": int(key[0]), "payload": answers,
                         "size": int((total > 0).sum()), "total": int(total.sum())})


class _Block:
    """A block with the corpus numbers of its words: what both passes over it share."""

    def __init__(self, row: dict, words: pd.DataFrame, offsets: dict[int, int], n: int, v: int):
        self.doc_ids, self.known, self.train, self.lengths = unpack(row["docs"])
        (tokens,) = unpack(row["tokens"])
        tokens = tokens.astype(np.int32)
        width = int(tokens.max()) + 1
        ids, self.c = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for shard, payload in zip(words["shard"].tolist(), words["payload"], strict=True):
            places, number, count = unpack(payload)
            at = np.cumsum(places.astype(np.int64))
            ids[at] = np.where(number > 0, number.astype(np.int64) + offsets[shard], 0)
            self.c[at] = count
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        prev = np.empty_like(tokens)
        prev[1:] = tokens[:-1]
        prev[self.starts] = 0  # a text starts in the context of the end token
        self.p = (self.c + 0.5) / (n + 0.5 * (v + 1))
        self.tokens, self.prev = tokens, prev
        # pairs of two known words go to the trie; local numbers keep the sort small
        self.routed = np.flatnonzero((ids[tokens] > 0) & (ids[prev] > 0))
        uniq, self.inverse = np.unique(prev[self.routed].astype(np.int64) * width + tokens[self.routed], return_inverse=True)
        self.a, self.b = uniq // width, uniq % width
        self.v, self.w = ids[self.a].astype(np.uint64), ids[self.b].astype(np.uint64)
        self.key = self.v * np.uint64(_ranges(v) * SPAN) + self.w

    def order(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard of each pair, and the pairs by shard and key."""
        tile = mix(self.v // np.uint64(TILE_V)) + self.w // np.uint64(TILE_W)
        shard = (mix(tile) % np.uint64(shards)).astype(np.int64)
        return shard, np.lexsort((self.key, shard))


def _ranges(v: int) -> int:
    """Ranges of ``SPAN`` word numbers that hold all of 1..v."""
    return v // SPAN + 1


def _first_of_context(key: np.ndarray, v: int) -> np.ndarray:
    """Whether each of some sorted pairs has another first word than the one before."""
    word = key // np.uint64(_ranges(v) * SPAN)
    return np.concatenate([[True], word[1:] != word[:-1]]) if len(key) else np.zeros(0, bool)


def _fragments(offsets: dict[int, int], n: int, v: int, shards: int):
    def run(key: tuple, blocks: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = {"shard": [], "block": [], "frag": []}
        for row in blocks.to_dict("records"):
            b = _Block(row, words, offsets, n, v)
            trained = np.repeat(b.train.astype(bool), b.lengths)[b.routed]
            count = np.bincount(b.inverse[trained], minlength=len(b.key))
            shard, order = b.order(shards)
            edges = [*np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order)]
            for lo, hi in itertools.pairwise(edges):
                o = order[lo:hi]
                k = b.key[o]
                first = _first_of_context(k, v)
                out["shard"].append(int(shard[o[0]]))
                out["block"].append(row["block"])
                # c(v) once a context, c(w) for each pair
                out["frag"].append(pack(k[:1], smallest_uint(np.diff(k)), smallest_uint(count[o]), smallest_uint(b.c[b.a[o[first]]]), smallest_uint(b.c[b.b[o]])))
        return pd.DataFrame(out).astype({"shard": "int32", "block": object, "frag": object})
    return run


def _shard(folder: str, n: int, v: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Merge the fragments, build and map the shard, answer every fragment with the codes of its pairs."""
        pdf = pdf.sort_values("block", kind="stable")
        keys, counts, totals, lowers = [], [], [], []
        for frag in pdf["frag"]:
            head, steps, count, total, lower = unpack(frag)
            k = np.cumsum(np.concatenate([head, steps.astype(np.uint64)]), dtype=np.uint64)
            keys.append(k)
            counts.append(count)
            totals.append(total[np.cumsum(_first_of_context(k, v)) - 1].astype(np.int64))
            lowers.append(lower.astype(np.int64))
        uniq, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(uniq))
        del inverse
        smooth = lambda count, c_v, c_w: quantise(np.log10((count + MU * (c_w + 0.5) / (n + 0.5 * (v + 1))) / (c_v + MU)))
        seen = count > 0
        first = first[seen]
        smoothed = smooth(count[seen], np.concatenate(totals)[first], np.concatenate(lowers)[first])
        at = f"{folder}/shard-{int(key[0])}-{TaskContext.get().taskAttemptId()}.trie"
        write_shard(at, Trie.build(uniq[seen] // np.uint64(SPAN), uniq[seen] % np.uint64(SPAN), smoothed, SPAN))
        trie = open_shard(at)
        answers = []
        for k, tot, low in zip(keys, totals, lowers, strict=True):
            code = trie.find(k // np.uint64(SPAN), k % np.uint64(SPAN))
            answers.append(pack(np.where(code >= 0, code, smooth(0, tot, low)).astype(np.uint16)))
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "kind": 1, "shard": int(key[0]), "payload": answers, "size": int(seen.sum()), "total": 0})
    return run


def _finish(offsets: dict[int, int], n: int, v: int, shards: int):
    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.to_dict("records"):
            b = _Block(row, answers[answers["kind"] == 0], offsets, n, v)
            _, order = b.order(shards)
            got = answers[answers["kind"] == 1].sort_values("shard")["payload"]
            value = np.empty(len(order))
            value[order] = dequantise(np.concatenate([unpack(x)[0] for x in got]) if len(got) else np.zeros(0, np.uint16))
            base = np.log10(b.p)[b.tokens]
            c = b.c[b.prev]
            score = np.where(c > 0, np.log10(MU) - np.log10(c + MU), 0.0) + base
            score[b.routed] = value[b.inverse]
            sums = lambda x: np.add.reduceat(x, b.starts)  # noqa: E731, B023
            known = b.known.astype(bool)
            out.append(pd.DataFrame({
                "doc_id": pd.Series(b.doc_ids, dtype="Int64").where(known), "held_out": ~b.train.astype(bool), "n_tokens": b.lengths,
                "n_known": sums((b.c[b.tokens] > 0).astype(np.int64)), "train_tokens": n, "base_score": sums(base), "score": sums(score)}))
        return pd.concat(out)
    return run


def train_and_score(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """Train on the rows where ``train`` holds and score every row.

    Returns ``doc_id``, ``held_out``, ``n_tokens`` and ``n_known`` (tokens, and tokens with a
    training count), ``train_tokens``, ``base_score`` (unigram) and ``score`` (bigram), both
    log10.  The trie shards stay in the run's folder under ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    blocks = cut(rows.mapInArrow(_blocks, _BLOCK), "lm-blocks")
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-tokens // SHARD_TOKENS))
    frags = blocks.select("block", "words").mapInArrow(_word_fragments(min(shards, WORD_SHARDS)), "shard int, block string, frag binary")
    words = cut(frags.groupBy("shard").applyInPandas(_word_shard, _ANSWER), "lm-words")
    # Dense word numbers: the number within the shard after the sizes of the shards before it.
    sizes = words.groupBy("shard").agg(F.max("size").alias("size"), F.max("total").alias("total")).orderBy("shard").collect()
    ahead = itertools.accumulate((r["size"] for r in sizes), initial=0)
    offsets = {r["shard"]: a for r, a in zip(sizes, ahead, strict=False)}
    known = (offsets, sum(r["total"] for r in sizes), sum(r["size"] for r in sizes))
    if (known[2] + SPAN) ** 2 >= 1 << 64:
        raise ValueError("more than 4 billion words: the pair keys need more than 64 bits")
    texts = blocks.select("block", "docs", "tokens")
    pairs = texts.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(_fragments(*known, shards), "shard int, block string, frag binary")
    folder = run_folder(spark, "lm-trie")
    answers = cut(pairs.groupBy("shard").applyInPandas(_shard(folder, *known[1:]), _ANSWER), "lm-answers")
    return texts.groupBy("block").cogroup(words.unionByName(answers).groupBy("block")).applyInPandas(
        _finish(*known, shards),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
