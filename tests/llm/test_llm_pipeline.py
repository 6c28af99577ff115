"""The pipeline's stages against brute force, on edge rows, and the entry point without the subpackage."""

import importlib.abc
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from marketlens.llm import language_id
from marketlens.llm.shared import cut, text_crc_mod
from marketlens.llm.tokens import fold
from tests.llm.test_llm_text_ops import components_brute, decontamination_brute, lines_brute, plain_words, simhash_brute

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Rows of the small table plus nulls in every column, empty and long texts, repeated rows and clashing columns."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    text = docs.orderBy("doc_id").first()["text"]
    extra = [(None, text, "en", "src0", 1), (9001, None, "en", "src1", None), (9002, "", None, None, 0), (9003, "the of and " * 30_000, None, None, 330_000),
             (9004, text, "fr", "src0", 5), (9004, text, "fr", "src0", 5), (9005, "the and " + item + " of the", "en", None, 9)]
    more = spark.createDataFrame(extra, docs.schema)
    return cut(docs.unionByName(more).withColumns({"fp": F.lit("x"), "Copies": F.lit(1), "copy": F.lit(2), "n_removed": F.col("doc_id") % 3, "row": F.lit(None).cast("string")}), "test-docs")


def test_stages_in_order_and_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "mixing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


def test_language_stage_without_labels_keeps_texts(spark, edge_docs):
    docs = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    got = STAGES["language_id"](spark, docs, SMALL)
    want = [r for r in docs.collect() if language_id.has_letter(r["text"] or "")]
    assert want and sorted(map(str, got.collect())) == sorted(map(str, want))


def test_language_stage(spark, edge_docs):
    got = STAGES["language_id"](spark, edge_docs, SMALL)
    assert got.columns == edge_docs.columns
    dictionaries = language_id.train_dictionaries(edge_docs, "doc_id", "text", "lang", text_crc_mod(F.col("doc_id"), 4) != 2)
    languages = sorted(dictionaries)
    coders = [language_id._coder(dictionaries[x]) for x in languages]
    want = [r for r in edge_docs.collect() if not language_id.classify(r["text"], languages, coders, language_id.MIN_MARGIN)[2]]
    assert rows_of(got) == sorted(map(tuple, want), key=str)
    assert not {9001, 9002} & {r["doc_id"] for r in want} and len(want) >= 0.97 * edge_docs.count()


def test_line_stage(spark, edge_docs):
    got = STAGES["line_dedup"](spark, edge_docs, SMALL)
    assert got.columns == edge_docs.columns
    clean = lines_brute([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    want = []
    for r in edge_docs.collect():
        text, removed, total = clean.get((r["doc_id"], r["text"]), (None, 0, 0))
        if not removed or removed < total:
            want.append(tuple(r[c] if c not in ("text", "n_chars") or not removed else text if c == "text" else len(text) for c in edge_docs.columns))
    assert rows_of(got) == sorted(want, key=str)


def test_simhash_stage(spark, edge_docs):
    got = STAGES["simhash"](spark, edge_docs, SMALL).collect()
    rows = edge_docs.collect()
    pairs = sorted({(i if i is not None else 10**9, simhash_brute(t)) for i, t, *_ in rows})
    root = components_brute(pairs)
    assert sorted(r["doc_id"] for r in got) == sorted({root[i] for i, _ in pairs} - {10**9})
    assert {tuple(r) for r in got} <= {tuple(r) for r in rows}


def test_simhash_stage_keeps_every_group_without_ids(spark):
    rows = [(None, "one two three four"), (None, "one two three four"), (None, "something else entirely here"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = STAGES["simhash"](spark, docs, SMALL).collect()
    assert sorted(r["text"] for r in got) == ["", "one two three four", "something else entirely here"]


def test_decontamination_stage(spark, edge_docs):
    got = STAGES["decontamination"](spark, edge_docs, SMALL)
    items = {r["item_id"]: plain_words(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    small = [r for r in edge_docs.collect() if r["doc_id"] is None or r["doc_id"] >= 9000 or r["doc_id"] % 4 == 0]
    found = decontamination_brute({n: r["text"] if len(r["text"] or "") < 10_000 else None for n, r in enumerate(small)}, items)
    kept = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert got.columns == edge_docs.columns
    for n, r in enumerate(small):
        if len(r["text"] or "") < 10_000:
            assert ((r["doc_id"], r["text"]) in kept) == (not found[n])
    assert 9005 not in {i for i, _ in kept} and {9001, 9002} <= {i for i, _ in kept}


def test_mixing_stage(spark, edge_docs):
    got = STAGES["mixing"](spark, edge_docs, SMALL)
    assert got.columns[:-1] == edge_docs.columns and got.columns[-1] == "copy_"
    copies = {}
    for r in got.collect():
        copies.setdefault((r["doc_id"], r["text"], r["source"]), []).append(r["copy_"])
    assert all(max(c) <= 3 for c in copies.values())
    total = sum(len(fold(r["text"]).split()) for r in edge_docs.collect())
    assert abs(sum(len(fold(t).split()) * len(c) for (_, t, _), c in copies.items()) - total) < 0.2 * total + 70_000


def test_whole_pipeline_on_edge_rows_and_on_nothing(spark, edge_docs):
    for docs in (edge_docs, edge_docs.limit(0)):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            before = out
            out = cut(stage(spark, out, SMALL), "test")
            assert name == "mixing" or out.columns == before.columns
            assert name == "mixing" or out.count() <= before.count()
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_entry_without_the_subpackage(monkeypatch):
    """The other queries stay when the subpackage and the pipeline are deleted; other import errors are raised."""
    full = set(entry.queries())
    gone = [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("marketlens.llm")]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)

    class Hidden(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path, target=None):
            if name == "corpus_pipeline" or name == "marketlens.llm" or name.startswith("marketlens.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    import marketlens
    monkeypatch.delattr(marketlens, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    left = set(entry.queries())
    assert left and left == {q for q in full if q != "pipeline" and not q.startswith("op")} and set(entry.oracle_sql()) <= left
