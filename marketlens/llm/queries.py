"""Registered queries of the subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import (
    decontamination, fill_middle, importance, language_id, line_dedup, lm_scoring, mixing, page_text, secret_ledger, sentence_pieces, simhash, vector_dedup, warc)
from marketlens.llm.shared import cut, run_folder, text_crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, normalise the archives, read them back by offset."""
    pages = _table(spark, sf_dir, "pages")
    folder = run_folder(spark, "warc")
    planned = warc.plan_records(pages, "page_id", "url", "html", least_bytes=0)
    mono = cut(warc.write_archives(planned, f"{folder}/mono"), "warc-mono")
    index = cut(warc.normalise(mono, f"{folder}/records"), "warc-index")
    back = warc.read_records(warc.by_stretch(index), with_payload=False)
    return back.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the documents outside fold 1 of 5, score all."""
    docs = _table(spark, sf_dir, "documents")
    return lm_scoring.train_and_score(docs, "doc_id", "text", text_crc_mod(F.col("doc_id"), 5) != 1)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every document through a new ledger and report the findings of all paths."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_ledger.Ledger(spark, run_folder(spark, "ledger"))
    ledger.scan(docs, "text")
    found = ledger.report(docs, "doc_id", "text")
    text = secret_ledger.span_text(F.col("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
                        F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries from the folds other than 2 of 4; a prediction for every document."""
    docs = _table(spark, sf_dir, "documents")
    fold = text_crc_mod(F.col("doc_id"), 4)
    dictionaries = language_id.train_dictionaries(docs, "doc_id", "text", "lang", fold != 2)
    return docs.select("doc_id", (fold == 2).alias("held_out"), language_id.identify(F.col("text"), dictionaries).alias("p")).select("doc_id", "held_out", "p.*")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines from every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, "doc_id", "text").select("doc_id", "clean_text", "n_lines", "n_removed")


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link all vectors of equal label with cosine 0.98 or more."""
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document under the source weights 5, 2, 1."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, "doc_id", "text", "source")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and the components at three bits or fewer."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = page_text.extract(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontamination.contaminated(docs, "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")
    doc, t = decontamination.row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select("doc_id", doc.alias("key_doc"), t.alias("key_text"))  # the text itself need not move
    joined = keyed.join(hits, keyed["key_doc"].eqNullSafe(hits["doc"]) & keyed["key_text"].eqNullSafe(hits["t"]), "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
                         F.coalesce("n_overlaps", F.lit(0)).cast("bigint").alias("n_overlaps"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as seekable frames, cut it by lines and stream it out in its form."""
    docs = _table(spark, sf_dir, "documents")
    index = cut(fill_middle.store_frames(docs, "doc_id", "text", run_folder(spark, "frames")), "frames-index")
    return fill_middle.transform(fill_middle.plan_cuts(index), with_text=False)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Encode every text with the public BPE model (``model_path``: another one) and decode it again."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    with open(model_path, "rb") as f:
        model = f.read()
    return sentence_pieces.encode_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", model, pieces=False)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw 5 % of the documents towards the benchmark's features."""
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return importance.resample(docs, "doc_id", "text", target, "text").select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_lm_scoring, op3_secrets, op4_language_id, op5_line_dedup, op6_vector_dedup, op7_mixing, op8_simhash, op9_page_text, op10_decontamination,
    op11_fill_middle, op12_sentence_pieces, op13_importance)}


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_OP5 = rf"""
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
every AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS idx FROM cut),
used AS (
  SELECT doc_id, idx, trim(line, ' ' || chr(9) || chr(13)) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos
  FROM every WHERE length(trim(line, ' ' || chr(9) || chr(13))) > 0),
next AS (
  SELECT doc_id, pos, line, w, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3, lead(w, 1) OVER d AS w2
  FROM used WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
windows AS (
  SELECT doc_id, pos, 3 AS size, [line, l2, l3] AS same FROM next WHERE l3 IS NOT NULL
  UNION ALL SELECT doc_id, pos, 2, [line, l2] FROM next WHERE l2 IS NOT NULL AND w + w2 >= {line_dedup.LONG_WORDS}
  UNION ALL SELECT doc_id, pos, 1, [line] FROM next WHERE w >= {line_dedup.LONG_WORDS}),
ranked AS (
  SELECT doc_id, pos, size, row_number() OVER (PARTITION BY same ORDER BY doc_id, pos) AS turn FROM windows),
gone AS (
  SELECT DISTINCT doc_id, pos + unnest(range(size)) AS pos FROM ranked WHERE turn > 1),
marked AS (
  SELECT e.doc_id, e.idx, e.line, u.pos IS NOT NULL AS used, g.pos IS NOT NULL AS gone
  FROM every e LEFT JOIN used u ON e.doc_id = u.doc_id AND e.idx = u.idx LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.pos = g.pos),
done AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (NOT gone), '') AS clean_text,
         count(*) FILTER (used) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, x.clean_text, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN done x ON d.doc_id = x.doc_id
"""

_OP7 = rf"""
WITH sized AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
capped AS (
  SELECT *, {mixing.MAX_COPIES} * source_size AS cap, sum(source_size) OVER () AS total FROM weighed),
filled AS (
  SELECT *, total - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM capped WINDOW f AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
flagged AS (
  SELECT *, cap * open <= rest * weight AS is_full FROM filled),
level AS (
  SELECT rest AS level_rest, open AS level_open FROM flagged WHERE NOT is_full ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE level_rest::DOUBLE * weight / level_open END AS target
  FROM flagged LEFT JOIN level ON true),
steps AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(round(target / source_size * {mixing.UNIT}), {mixing.MAX_COPIES * mixing.UNIT}) ELSE 0 END::BIGINT AS per_doc,
         floor(('0x' || substr(md5(coalesce(source, '') || '#{mixing.SEED}'), 1, 8))::BIGINT * {mixing.UNIT} / 4294967296.0)::BIGINT AS start
  FROM targets),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.per_doc, t.start,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS idx
  FROM sized d JOIN steps t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((idx * per_doc + start) // {mixing.UNIT} - ((idx - 1) * per_doc + start) // {mixing.UNIT}) * size AS taken
FROM placed
"""

_OP11 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(units) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS d FROM cut),
planned AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
              WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM planned)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

ORACLE_SQL = {"op5_line_dedup": _OP5, "op7_mixing": _OP7, "op11_fill_middle": _OP11}
