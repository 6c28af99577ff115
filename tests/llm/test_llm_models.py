"""N-gram trie, LM scoring, vector dedup, components."""

import collections
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.llm import lm_scoring, vector_dedup
from marketlens.llm.components import connected_components
from marketlens.llm.ngram_trie import EliasFano, Trie, dequantise, quantise
from marketlens.llm.queries import QUERIES
from marketlens.llm.shared import pack, unpack
from marketlens.llm.tokens import PIECE, chunks, fold, hashed

SMALL = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=200), st.lists(st.integers(0, 2**41), max_size=50))
def test_elias_fano_round_trip(values, queries):
    a = np.array(sorted(values), np.uint64)
    ef = EliasFano(len(a), *EliasFano.encode(a, int(a[-1]) + 1 if len(a) else 1))
    assert ef.get(np.arange(len(a))).tolist() == a.tolist()
    q = np.array(queries, np.uint64)
    assert ef.rank(q).tolist() == np.searchsorted(a, q).tolist()


def test_trie_finds_exactly_its_pairs():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 5000 * 64, 4000).astype(np.uint64))
    codes = rng.integers(0, 60000, len(keys)).astype(np.uint16)
    data = Trie.build(keys // 64, keys % 64, codes, 64)
    trie = Trie(data)
    every = np.arange(5001 * 64, dtype=np.uint64)
    got = trie.find(every // 64, every % 64)
    want = np.full(len(every), -1)
    want[keys.astype(int)] = codes
    assert got.tolist() == want.tolist()
    assert len(data) < 8 * len(keys)  # 16 bytes a pair uncoded
    empty = Trie(Trie.build(keys[:0], keys[:0], codes[:0], 64))
    assert empty.find(every[:5], every[:5]).tolist() == [-1] * 5


def test_quantisation_and_packing():
    x = -np.linspace(0, 31, 1000)
    assert np.abs(dequantise(quantise(x)) - x).max() <= 0.5 / 256 + 1e-12
    for back, a in zip(unpack(pack(np.arange(5, dtype=np.uint16), np.zeros(0, np.int64), x)), (np.arange(5), [], x), strict=True):
        assert back.tolist() == list(a)


def test_tokens_match_split():
    texts = ["A b\tC\n\n é\x0bÉ  x y", "", None, " ", "w" * (PIECE + 10) + " end", "ab " * PIECE]
    for keys, buf, starts in chunks([(i, t) for i, t in enumerate(texts)], 1 << 20):
        h, a, b = hashed(buf)
        found = [buf[x:y] for x, y in zip(a.tolist(), b.tolist())]
        assert found == [w for (i,) in keys for w in fold(texts[i]).split()]
        assert len(set(zip(h.tolist(), found))) == len(set(found)) == len(set(h.tolist()))


def lm_brute(rows, train):
    c, pair = collections.Counter(), collections.Counter()
    seqs = [fold(t).split() + [b""] for t in rows]
    for w, t in zip(seqs, train):
        if t:
            c.update(w)
            pair.update(zip([b"", *w], w))
    n, v = sum(c.values()), len(c)
    p = lambda t: (c[t] + 0.5) / (n + 0.5 * (v + 1))
    for w in seqs:
        yield (len(w), sum(c[t] > 0 for t in w), n, sum(math.log10(p(t)) for t in w),
               sum(math.log10((pair[u, t] + lm_scoring.MU * p(t)) / (c[u] + lm_scoring.MU)) for u, t in zip([b"", *w], w)))


def test_lm_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    got = QUERIES["op2_lm_scoring"](spark, SMALL).toPandas().set_index("doc_id")
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in docs["doc_id"]]
    better = 0
    for i, h, (tokens, known, n, base, score) in zip(docs["doc_id"], held, lm_brute(docs["text"], [not h for h in held])):
        r = got.loc[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and abs(r["score"] - score) <= tokens / 512 + 1e-6
        better += h * (r["score"] - r["base_score"])
    assert better > 0  # held-out texts gain from the bigrams


def test_lm_probabilities_sum_to_one(spark):
    vocab = ["a", "b", "c", "d"]
    rows = [(i, t, True) for i, t in enumerate(["a b a", "b c", "d a b", "c"])] + [(100 + i, f"a {w}", False) for i, w in enumerate([*vocab, "unknown"])] + [(200, "a", False)]
    got = lm_scoring.train_and_score(spark.createDataFrame(rows, "id bigint, text string, t boolean"), "id", "text", F.col("t")).toPandas().set_index("doc_id")["score"]
    # P(a w end) = P(a|start) P(w|a) P(end|w); divide the ends out with texts "w" scored alone in the brute version
    seqs = [t for _, t, _ in rows]
    want = [x[4] for x in lm_brute(seqs, [t for *_, t in rows])]
    assert got.loc[[i for i, *_ in rows]].tolist() == pytest.approx(want, abs=3 / 512 + 1e-6)
    c = collections.Counter(w for s, (_, _, t) in zip(seqs, rows) if t for w in [*s.split(), ""])
    n, v = sum(c.values()), len(c)
    p = {w: (c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in [*c, "unknown"]}
    assert sum(p.values()) == pytest.approx(1)


def test_lm_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "A b", 1), (3, "a B", 1), (3, "a B", 1), (4, "z " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, block int").withColumn("tokens", F.lit(1))
    got = lm_scoring.train_and_score(docs, "doc_id", "text", F.lit(True)).collect()
    want = list(lm_brute([t for _, t, _ in rows], [True] * 6))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], round(r["base_score"], 6)) for r in got) == sorted((i or -1, w[0], round(w[3], 6)) for (i, *_), w in zip(rows, want))
    none = lm_scoring.train_and_score(docs, "doc_id", "text", F.lit(False)).collect()
    assert len(none) == 6 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in none)
    assert lm_scoring.train_and_score(docs.limit(0), "doc_id", "text", F.lit(True)).count() == 0


def vectors_brute(rows, threshold=0.98):
    ids, units = [], []
    for i, v, g in rows:
        ok = v is not None and g is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float64) / np.abs(np.array(v, np.float64)).max() if ok else None
        ids.append(i)
        units.append((g, a / np.linalg.norm(a)) if ok else None)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            if units[x] and units[y] and units[x][0] == units[y][0] and len(units[x][1]) == len(units[y][1]) and units[x][1] @ units[y][1] >= threshold:
                links[x] += 1
                links[y] += 1
                p, q = sorted((find(x), find(y)))
                root[q] = p
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return sorted((ids[k], links[k], least[find(k)]) for k in range(len(rows)))


def test_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        base = rng.normal(size=64)
        rows += [(100 * k + j, (base + rng.normal(size=64) * 0.09).astype(np.float32).tolist(), k % 3) for j in range(8)]
    rows += [(9000 + j, rows[0][1], 0) for j in range(30)] + [(9100, rows[0][1], None), (9101, rows[0][1], 1), (9102, None, 0), (9103, [0.0] * 64, 0), (9104, [float("nan")] * 64, 0),
             (9105, [None] * 64, 0), (9106, [float("inf")] * 64, 0), (9107, [], 0), (9108, [1.0, 2.0], 0), (9109, [2.0, 4.0], 0), (9110, [1e300, 1.0], 2), (9111, [-0.0, 1.0], 2), (9112, [0.0, 1.0], 2)]
    monkeypatch.setattr(vector_dedup, "PART", 4)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("v", F.lit(1))
    got = vector_dedup.near_duplicates(frame, "vec_id", "embedding", "label").collect()
    want = vectors_brute(rows)
    assert len(got) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(w[1] for w in want)
    mine = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert all(a[1] <= b[1] for a, b in zip(mine, want)) and [a[2] for a in mine] == [b[2] for b in want]
    assert [a for a in mine if a[0] >= 9102] == [b for b in want if b[0] >= 9102]
    assert vector_dedup.near_duplicates(frame.limit(0), "vec_id", "embedding", "label").count() == 0


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5000, 5000), (7000, 7001), (7001, 7000)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + k: 1000 for k in range(300)}, 7000: 7000, 7001: 7000}
    assert connected_components(edges.limit(0)).count() == 0
