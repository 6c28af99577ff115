"""Language ID, line dedup, SimHash, decontamination, secrets and mixing against brute force and on edge rows."""

import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from marketlens.llm import decontamination, language_id, line_dedup, mixing, secret_ledger, simhash
from marketlens.llm.queries import QUERIES
from marketlens.llm.shared import run_folder

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def edge_docs(spark):
    return docs_of(spark, [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, "  \n\t ", "en", "a", 5), (None, "word", "en", "a", 4), (4, "12 34", "en", "b", 5),
        (5, "same text here", "en", "b", 14), (5, "same text here", "en", "b", 14), (6, "same text here", None, None, 14), (7, "x" * 300_000, "en", "a", 300_000)])


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()


def words(text):
    return (text or "").encode().lower().split()


# language ID

def test_language_held_out_accuracy(spark):
    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    assert len(got) == 1000 and set(got["lang_pred"]) <= {"en", "de", "fr", "es", "und"} and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"]))
    held = got[got["held_out"]]
    assert (held["doc_id"].map(lang) == held["lang_pred"]).mean() > 0.97
    assert got["rejected"].mean() < 0.02


def test_language_edges(spark):
    docs = edge_docs(spark)
    dictionaries = language_id.train_dictionaries(docs, "doc_id", "text", "lang", F.lit(True))
    assert set(dictionaries) == {"en"}
    got = docs.select("doc_id", language_id.identify(F.col("text"), dictionaries).alias("p")).select("doc_id", "p.*").collect()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and all(by[i]["rejected"] and by[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert by[5]["lang_pred"] == "en" and by[7]["score"] == 1.0
    none = language_id.train_dictionaries(docs.limit(0), "doc_id", "text", "lang", F.lit(True))
    assert none == {} and docs.select(language_id.identify(F.col("text"), none).alias("p")).filter("p.lang_pred <> 'und'").count() == 0


def test_no_learned_language_rejects_only_texts_without_letters(spark):
    docs = docs_of(spark, [(1, "a clean text", None, "a", 12), (2, "12 34", None, "a", 5), (3, None, None, "a", None), (4, "", None, "a", 0)])
    none = language_id.train_dictionaries(docs, "doc_id", "text", "lang", F.lit(True))
    got = {r["doc_id"]: tuple(r["p"]) for r in docs.select("doc_id", language_id.identify(F.col("text"), none).alias("p")).collect()}
    assert none == {} and got == {1: ("und", 0.0, False), 2: ("und", 0.0, True), 3: ("und", 0.0, True), 4: ("und", 0.0, True)}


def test_texts_that_open_without_letters_teach(spark):
    docs = docs_of(spark, [(i, f"{i}. <1> " + "1234 " * 1000 + "ein deutscher Satz steht hier", "de", "a", 1) for i in range(5)])
    found = language_id.train_dictionaries(docs, "doc_id", "text", "lang", F.lit(True))
    assert list(found) == ["de"] and b"deutscher satz" in found["de"]


def test_language_reads_whole_text():
    dictionaries = {"a": b"alpha beta gamma delta " * 50, "b": b"lorem ipsum dolor sit " * 50}
    coders = [language_id._coder(dictionaries[x]) for x in "ab"]
    text = "alpha beta gamma delta " * 20 + "lorem ipsum dolor sit " * 2000
    assert language_id.classify(text, ["a", "b"], coders, 0.0)[0] == "b"


# line dedup

def lines_brute(rows, window=3, long_words=50):
    """{(id, text): (clean, removed, total)} by comparing every window with all earlier ones."""
    keyed = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, {}
    for i, t in keyed:
        every = t.split("\n")
        used = [(k, x.strip(" \t\r")) for k, x in enumerate(every) if x.strip(" \t\r")]
        gone = set()
        for s in range(len(used)):
            for n in range(1, window + 1):
                part = [x for _, x in used[s : s + n]]
                if len(part) < n or (n < window and sum(len(x.split()) for x in part) < long_words):
                    continue
                if tuple(part) in seen:
                    gone |= set(range(s, s + n))
                seen.setdefault(tuple(part), (i, s))
        drop = {used[k][0] for k in gone}
        out[(i, t)] = ("\n".join(x for k, x in enumerate(every) if k not in drop), len(gone), len(used))
    return out


def test_line_dedup_on_planted_runs(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, f"p\n{long}\nq"), (4, f"{long}"), (5, "a\nb"), (6, "z\nz\nz\nz\nz"), (7, "a\n\nb\n \t\nc"),
            (8, ""), (9, None), (10, "a\nb\nc\nd"), (10, "a\nb\nc\nd")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("gone", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n_lines", F.lit(-1))
    got = line_dedup.dedup_lines(docs, "doc_id", "text").collect()
    want = lines_brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["clean_text"], r["n_removed"], r["n_lines"]) == want.get((r["doc_id"], r["text"]), (None, 0, 0))
    by = {r["doc_id"]: r["clean_text"] for r in got}
    assert by[2] == "x\ny" and by[4] == "" and by[3] == f"p\n{long}\nq" and by[6] == "z" and by[7] == "\n \t" and by[5] == "a\nb"
    assert line_dedup.dedup_lines(docs.limit(0), "doc_id", "text").count() == 0


def test_line_dedup_against_brute_force(spark, small):
    got = QUERIES["op5_line_dedup"](spark, SMALL).collect()
    want = lines_brute(list(zip(small["doc_id"], small["text"])))
    texts = dict(zip(small["doc_id"], small["text"]))
    assert len(got) == len(small) and sum(r["n_removed"] for r in got) > 0
    for r in got:
        assert (r["clean_text"], r["n_removed"], r["n_lines"]) == want[(r["doc_id"], texts[r["doc_id"]])]


def test_line_dedup_keeps_blank_lines_in_place(spark):
    lines = ["one a", "", "two b", "  ", "three c", ""]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["own", *lines, "last"]))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, "doc_id", "text").collect()}
    assert got[1]["clean_text"] == docs.filter("doc_id = 1").first()["text"]
    assert got[2]["clean_text"] == "own\n\n  \n\nlast" and got[2]["n_removed"] == 3 and got[2]["n_lines"] == 5


def test_line_dedup_of_200_000_lines(spark):
    n = 200_000
    text = "\n".join(f"line {i} of the long text" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, text + "\nits own end")], "doc_id bigint, text string")
    begun = time.monotonic()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, "doc_id", "text").collect()}
    assert got[1]["clean_text"] == text and got[2]["clean_text"] == "its own end" and got[2]["n_removed"] == n
    assert time.monotonic() - begun < 120  # a fold that copies its array a line takes hours


def test_line_dedup_runs_no_python(spark):
    plan = QUERIES["op5_line_dedup"](spark, SMALL)._jdf.queryExecution().toString() + QUERIES["op7_mixing"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)


# SimHash

def simhash_brute(text):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_brute(pairs):
    """{id: smallest id} for (id, fingerprint) pairs linked at three bits."""
    root = {i: i for i, _ in pairs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations(pairs, 2):
        if (x ^ y).bit_count() <= 3:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in root}


def test_simhash_against_brute_force(spark, small):
    got = QUERIES["op8_simhash"](spark, SMALL).collect()
    prints = {i: simhash_brute(t) for i, t in zip(small["doc_id"], small["text"])}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == components_brute(sorted(prints.items()))


def test_simhash_links_are_exact_over_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, 1 + n % 4, replace=False)) for n, b in enumerate(np.repeat(base, 5))]
    prints = sorted({*map(int, base), *near, 0, 7, 15, 2**64 - 1})
    monkeypatch.setattr(simhash, "TILE", 2)
    rows = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)], "doc_id bigint, fp bigint")
    got = simhash.components(rows, "doc_id", "fp").join(rows, "fp").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_brute(list(enumerate(prints)))


def test_simhash_edges(spark):
    docs = edge_docs(spark).withColumn("fp", F.lit("clash")).withColumn("sig", F.lit(0))
    got = simhash.near_duplicates(docs, "doc_id", "text").collect()
    assert len(got) == 9
    by = {r["doc_id"]: (r["fp"], r["component_id"]) for r in got}
    assert by[1] == by[2] == by[3] == (0, 1)
    assert by[5] == by[6] and by[5][1] == 5 and by[None][1] is None
    assert simhash.near_duplicates(docs.limit(0), "doc_id", "text").count() == 0


# decontamination

def plain_words(text):
    return re.sub(rb"[!-/:-@\[-`{-~]", b" ", (text or "").encode().lower()).split()


def decontamination_brute(texts, items):
    out = {}
    for d, text in texts.items():
        w, found = plain_words(text), []
        for i, item in items.items():
            if len(item) < decontamination.LEAST_WORDS:
                continue
            size = min(15, len(item))
            need = math.ceil(0.8 * size - 1e-9)
            for shift in range(-len(item), len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(item)]
                if any(0 <= k + shift and k + size + shift <= len(w) and sum(same[k : k + size]) >= need for k in range(len(item) - size + 1)):
                    found.append(i)
                    break
        out[d] = sorted(found)
    return out


def test_masks_lose_no_overlap():
    """Every placement of the allowed substitutions leaves some mask a clean fit."""
    for n in range(decontamination.LEAST_WORDS, decontamination.WINDOW + 1):
        for bad in itertools.combinations(range(n), n - decontamination.needed(n)):
            assert any(not any(m[k] == "1" and s + k in bad for k in range(len(m))) for m in decontamination.MASKS for s in range(n - len(m) + 1))


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(40)]
    items = {k: [rng.choice(vocab) for _ in range(n)] for k, n in enumerate((4, 8, 9, 13, 15, 22, 40))}
    texts = {1: None, 2: "", 3: "short"}
    for d in range(10, 60):
        body = [rng.choice(vocab) for _ in range(30)]
        item = list(items[d % 7])
        for k in rng.choice(len(item), min(len(item), d % 5), replace=False):
            item[k] = "zzz"
        texts[d] = ", ".join(body[:11] + item + body[11:]).upper() if d % 2 else " ".join(item)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("seed", F.lit(0)).withColumn("doc", F.lit(0))
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in items.items()), (90, None), (91, "")], "item_id bigint, text string")
    got = {r["doc"]: r["items"] for r in decontamination.contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect()}
    want = decontamination_brute(texts, {i: [x.encode() for x in w] for i, w in items.items()})
    assert got == {d: f for d, f in want.items() if f} and len(got) > 20
    assert decontamination.find(docs, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0
    assert decontamination.find(docs.limit(0), "doc_id", "text", bench, "item_id", "text").count() == 0


def test_long_text_full_of_hits_sends_data_in_proportion(spark):
    item = [f"w{k}" for k in range(20)]
    short = [f"v{k}" for k in range(9)]
    text = " ".join(item * 300 + short + ["x"] * 30 + short * 2)
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(short))], "item_id bigint, text string")
    got = decontamination.contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect()
    assert [(r["doc"], r["items"], r["n_overlaps"]) for r in got] == [(1, [7, 8], 303)]
    flags = decontamination.bitmap(decontamination.benchmark_windows(bench, "item_id", "text"))
    batch = pa.RecordBatch.from_pydict({"doc": [1], "t": [1], "text": [text]})
    rows = [x for b in decontamination._stretches(flags, len(item))(iter([batch])) for x in b.to_pylist()]
    hits = sum(len(x["hits"]) for x in rows)
    assert hits > 10_000 and max(len(x["words"]) for x in rows) <= 4 * len(item) * 8
    # every hit has the words of any alignment with the longest item
    n = len(text.split())
    assert all(h["at"] >= min(len(item), x["start"] + h["at"]) and len(x["words"]) // 8 - h["at"] >= min(len(item), n - x["start"] - h["at"]) for x in rows for h in x["hits"])


def test_decontamination_query(spark, small):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    got = {r["doc_id"]: r["items"] for r in QUERIES["op10_decontamination"](spark, SMALL).collect()}
    full = {d: [b["item_id"] for b in bench if b" ".join(plain_words(b["text"])) in b" ".join(plain_words(t))] for d, t in zip(small["doc_id"], small["text"])}
    assert set(got) == set(full) and all(set(f) <= set(got[d]) for d, f in full.items()) and any(full.values())


# secrets

def secrets_brute(text):
    text = text or ""
    found = [("assign", *m.span()) for m in re.finditer(
        r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = ("assign", "access", "hex").index
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], rank(s[0]))))


SECRETS = ["password = 'abc123'", "TOKEN:abcdefgh é API_KEY=\"x/y+z=1\"", "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "0" * 24 + "g" + "a" * 23, "token=" + "0f" * 16,
           "ſecret=abcdef", "secret=abc", None, "", "apikey = abc.def-ghi passwd:'''", "é" * 5 + "secret : abcdef", "secretsecret=token=abcdef"]


def test_secret_query_and_ledger(spark, small):
    got = {r["doc_id"]: r for r in QUERIES["op3_secrets"](spark, "/root/testdata/sf0.01").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts) and any(r["n_hex"] for r in got.values())
    for r in texts:
        want = secrets_brute(r["text"])
        assert got[r["doc_id"]]["spans"] == want and got[r["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_ledger_scans_only_what_is_new(spark):
    ledger = secret_ledger.Ledger(spark, run_folder(spark, "test-ledger"))
    rows = [(i, s) for i, s in enumerate(SECRETS)] + [(100, SECRETS[0]), (100, SECRETS[0]), (None, SECRETS[1])]
    docs = spark.createDataFrame(rows, "path bigint, text string").withColumn("blob", F.lit(1)).withColumn("spans", F.lit(1))
    ledger.scan(docs.limit(0), "text")
    assert ledger.report(docs.limit(0), "path", "text").count() == 0
    ledger.scan(docs, "text")
    report = ledger.report(docs, "path", "text").select("path", secret_ledger.span_text(F.col("spans")).alias("s")).collect()
    assert sorted((r["path"] is None, r["path"] or 0, r["s"]) for r in report) == sorted((i is None, i or 0, secrets_brute(s)) for i, s in rows)
    scans = ledger.scans().count()
    assert scans == len({s or "" for _, s in rows})  # one per content, null and empty together
    ledger.scan(docs, "text")
    assert ledger.scans().count() == scans  # nothing left to scan
    newer = (*secret_ledger.BASE_RULES[:2], secret_ledger.Rule("hex", 2, r"[0-9a-f]{32,}", 0, 32))
    more = docs.unionByName(spark.createDataFrame([(200, "b" * 40)], "path bigint, text string").withColumns({"blob": F.lit(1), "spans": F.lit(1)}))
    ledger.scan(more, "text", newer)
    latest = ledger.scans().subtract(ledger.scans().filter(F.size("rules") == 3)).collect()
    assert {tuple(r["rules"]) for r in latest} == {("hex@2",)} and ledger.scans().count() == 2 * scans + 1
    got = {r["path"]: r["s"] for r in ledger.report(more, "path", "text", newer).select("path", secret_ledger.span_text(F.col("spans")).alias("s")).collect()}
    assert got[200] == "hex:0:40" and got[4] == "" and got[5] == "assign:0:38,hex:6:38"


# mixing

def test_mixing_targets_and_bounds(spark):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 5}" if i % 5 else None, 0) for i in range(1000)] + [(2000, None, "en", "s1", 0), (2001, "a b", "en", "tiny", 0), (2002, None, None, "void", None)]
    rows += [(3000, "one two", "en", "s2", 7)] * 3 + [(None, "x y z", "en", "s3", 5)]
    docs = docs_of(spark, rows).withColumn("size", F.lit("clash")).withColumn("cell", F.lit(1)).withColumn("target", F.lit(1))
    got = mixing.mix(docs, "doc_id", "text", "source").select("doc_id", "size", "source_size", "target", "copies", F.col("row.source").alias("source")).toPandas()
    assert len(got) == len(rows) and got["copies"].between(0, 3).all()
    total = got["size"].sum()
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    size = {n: got.loc[got["source"].isna() if n is None else got["source"] == n, "size"].sum() for n in names}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(total)
    while True:  # share by weight, fix what is over its cap, share again
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if level * weight[n] > 3 * size[n]}
        if not over:
            break
        for n in over:
            target[n] = 3.0 * size[n]
            left -= target[n]
        open_ -= over
    target |= {n: level * weight[n] for n in open_}
    for n in names:
        part = got[got["source"].isna() if n is None else got["source"] == n]
        assert part["target"].iloc[0] == pytest.approx(target[n])
        taken = (part["copies"] * part["size"]).sum()
        assert abs(taken - target[n]) <= 2 * part["size"].max() + 1e-6 * total
    assert target["tiny"] == 6 and got.loc[got["source"] == "tiny", "copies"].tolist() == [3]
    again = mixing.mix(docs.repartition(7), "doc_id", "text", "source").select("doc_id", "size", "copies").toPandas()
    key = lambda f: sorted(map(str, f[["doc_id", "size", "copies"]].to_numpy().tolist()))
    assert key(again) == key(got)
    assert mixing.mix(docs.limit(0), "doc_id", "text", "source").count() == 0


@pytest.mark.parametrize("ids, kind", [
    ([-(2**63) + 1, 2**63 - 1, 0, 5, None, 5], "bigint"), (["b", "a", "", "a", None, "zz"], "string")])
def test_mixing_takes_wide_ids_and_other_types(spark, ids, kind):
    docs = spark.createDataFrame([(i, "same size here", "s") for i in ids], f"doc_id {kind}, text string, source string")
    got = mixing.mix(docs, "doc_id", "text", "source").collect()
    assert len(got) == len(ids) and {r["size"] for r in got} == {3}
    assert sum(r["copies"] for r in got) == len(ids)


def test_mixing_borders_part_rows_evenly_beside_an_outlier(spark):
    docs = spark.range(20_000).selectExpr("CASE WHEN id = 7 THEN 9223372036854775807 ELSE id END AS doc_id")
    borders = mixing.id_borders(docs, "doc_id")
    sizes = docs.groupBy(mixing.id_range(F.col("doc_id"), borders).alias("c")).count().toPandas()["count"]
    assert len(sizes) == mixing.ID_RANGES and sizes.max() < 3 * 20_000 / mixing.ID_RANGES
