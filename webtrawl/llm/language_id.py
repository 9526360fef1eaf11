"""Language identification by compression.

Each language known from labelled rows gets a zstandard raw-content dictionary, as long as its
rows allow up to a bound. A text has the language whose dictionary makes it smallest, after
what a dictionary gains by its length alone is taken back; where the second best is nearly as
small, the choice is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import id_text, text_chunks
from webtrawl.llm.compression import LengthGains, Sizes, dictionaries, sampled

UNDETERMINED = "und"
#: The second best must be larger by this share, else the choice is rejected.
LEAST_MARGIN = 0.004
#: The margin at which the score is one half.
HALF_MARGIN = 0.02

_OUT = "doc_id long, lang_pred string, score double, margin double, accepted boolean"


def _letters(text: Column) -> Column:
    """The runs of letters, lower-cased, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def learn_languages(docs: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language among the labelled ``rows`` of ``docs``, from a sample
    bounded by ``compression.SAMPLE_DOCS``, ``SAMPLE_CHARS`` and ``DICTIONARY_BYTES``. Rows
    with a null language or a text that is null or has no letter are left out, so a language
    of such rows only is not learned. A language with few rows has a shorter dictionary than
    others and takes nothing from theirs."""
    known = docs.where(rows & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    labelled = known.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        _letters(F.col(f"`{text_col}`")).alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("label"),
    )
    return dictionaries([tuple(r) for r in sampled(labelled.where(F.col("text") != "")).collect()])


def identify(docs: DataFrame, languages: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1, grows with the margin), margin
    (by how much larger the second best size is, both corrected for the lengths of the dictionaries), accepted (false where the margin is narrow).

    Only the text is used. A text that is null or has no letter is ``und`` with score 0 and not
    accepted, as is every text if no language was learned. With one language the margin is 1.
    Equal sizes go to the first language in alphabetical order. Repeated rows and null ids
    keep a row each.
    """

    gains = LengthGains(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(languages)
        for chunk in text_chunks(batches):
            found = []
            for text in chunk.column("text").to_pylist():
                if not text or not sizes.labels:
                    found.append((UNDETERMINED, 0.0, 0.0, False))
                    continue
                data = text.encode()
                each = sizes(data) / gains(len(data))
                best = int(each.argmin())
                others = [float(s) for i, s in enumerate(each) if i != best]
                margin = min(others) / float(each[best]) - 1 if others else 1.0
                found.append((sizes.labels[best], margin / (margin + HALF_MARGIN), margin, margin >= LEAST_MARGIN))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "margin", "accepted"])

    letters = id_text(docs, id_col, text_col).withColumn("text", _letters(F.col("text")))
    return letters.mapInArrow(run, _OUT)
