"""Language identification by compression with per-language zstandard dictionaries.

Training takes a bounded, documented sample: for each language the ``SAMPLE_DOCS`` labelled
documents with a letter and the smallest hash of (id, text), each from its first letter on, cut
to ``DICTIONARY_BYTES`` in all, as a raw-content dictionary.  Texts are lower-cased and runs of anything but letters become one
space, so that punctuation, digits and capitals say nothing.  A text is cut into pieces of
``PIECE_BYTES`` (whole text, all pieces), every piece is compressed once with each dictionary, and the language with the
fewest bytes over all pieces wins; equal sizes go to the first language by code point.
Pieces keep a long text from compressing against itself instead of the dictionary, so the
margin means the same at every length.

``score`` is the relative margin ``(second - best) / second``, from 0 to 1 (1 when a single
language was learned).  A text is rejected when it has no letter, or when its margin is
below ``MIN_MARGIN``.  With no language learned nothing can be told apart, so texts with a
letter are ``und``, score 0, and not rejected.

Defined cases: null text and text without a letter give ``und``, score 0, rejected; null
language rows teach nothing; equal rows get equal results; with no training rows every
text is ``und``; an empty table gives no rows.  Language, source and id never reach the
prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_DOCS = 200
DICTIONARY_BYTES = 128 << 10
PIECE_BYTES = 2 << 10
LEVEL = 5
MIN_MARGIN = 0.002
MAX_LANGUAGES = 1000
UNDETERMINED = "und"

_OTHER = re.compile(r"[\W\d_]+")

RESULT = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def train_dictionaries(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column,
                       sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """One raw-content dictionary per language, from the bounded sample described above.

    At most ``sample_docs`` texts a language, each cut to its share of the dictionary, reach the driver.
    """
    share = max(64, dictionary_bytes // 128)
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    # From the first letter on: an opening of digits or markup teaches nothing.
    rows = rows.filter(F.col("text").rlike(r"\p{L}")).withColumn("text", F.substring(F.regexp_replace("text", r"\A\P{L}+", ""), 1, share))
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample_docs)
    found: dict[str, list] = {}
    for r in sample.toLocalIterator():
        found.setdefault(r["lang"], []).append((r["rank"], r["text"]))
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages; is {lang_col} a language column?")
    # The end of a raw dictionary is the part nearest to the data, so the sample's order hardly matters.
    return {lang: letters_only("\n".join(t for _, t in sorted(texts)))[:dictionary_bytes] for lang, texts in sorted(found.items())}


def letters_only(text: str) -> bytes:
    """The lower-cased letters of a text as UTF-8, other runs as one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=PIECE_BYTES, dict_size=len(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def compressed_sizes(text: str, coders: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the whole text under each dictionary, piece by piece."""
    data = memoryview(letters_only(text))
    pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
    return [sum(len(c.compress(p)) for p in pieces) for c in coders]


def classify(text: str | None, languages: list[str], coders: list, min_margin: float) -> tuple[str, float, bool]:
    if text is None or not has_letter(text):
        return UNDETERMINED, 0.0, True
    if not languages:
        return UNDETERMINED, 0.0, False
    sizes = compressed_sizes(text, coders)
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    margin = 1.0 if len(sizes) == 1 else (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
    return languages[order[0]], margin, margin < min_margin


def identify(text: Column, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> Column:
    """Struct column (lang_pred, score, rejected) of a text column."""
    languages = sorted(dictionaries)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = [_coder(dictionaries[x]) for x in languages]
        for texts in batches:
            found = [classify(x if isinstance(x, str) else None, languages, coders, min_margin) for x in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    return run(text)
