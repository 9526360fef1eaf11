"""Quality classification by compression.

Zstandard raw-content dictionaries are built from texts labelled good and bad, once of the
texts as they are and once of the forms of their words (letter runs shortened to their case, a
repeated word to a sign). The difference of a text's two compressed sizes, divided by its
length, says which kind it resembles in either respect; a logistic curve fitted on other
labelled texts turns the differences into a calibrated score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrawl.llm.common import CACHE_WORDS, id_text, text_chunks
from webtrawl.llm.compression import Sizes, dictionaries

#: Texts of each label for the dictionaries, and characters of each.
DICT_DOCS, DICT_CHARS = 400, 300
#: Bytes of a dictionary of texts and of one of word forms.
TEXT_BYTES, FORM_BYTES = 112 << 10, 8 << 10
#: Texts of each label, and characters of each, on which the curve is fitted.
FIT_DOCS, FIT_CHARS = 400, 4_000
#: A score from here on counts as good.
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """``weights``: offset of the curve, then the factors of the two differences. Without
    dictionaries every text gets the offset's score."""

    texts: dict[int, bytes]
    forms: dict[int, bytes]
    weights: tuple[float, float, float]


class WordForms:
    """Texts as the forms of their words: A, a or Aa for letters by case, 0 for digits, other
    characters as they are, ``=`` for a word equal to the one before."""

    def __init__(self) -> None:
        self.seen: dict[str, str] = {}

    def _form(self, word: str) -> str:
        out = []
        for c in word:
            kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if not out or out[-1] != kind or kind not in "Aa0":
                out.append(kind)
        return "".join(out)

    def __call__(self, text: str) -> str:
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        seen, out, last = self.seen, [], ""
        for line in text.split("\n"):
            for word in line.split(" "):
                if not word:
                    continue
                if word == last:
                    out.append("=")
                    continue
                form = seen.get(word)
                if form is None:
                    form = self._form(word)
                    if len(word) <= 40:
                        seen[word] = form
                out.append(form)
                last = word
            out.append("\n")
        return "".join(out)


class Differences:
    """The two differences of a text: positive for what the good dictionary fits better."""

    def __init__(self, texts: dict[int, bytes], forms: dict[int, bytes]) -> None:
        self.texts, self.forms, self.form = Sizes(texts), Sizes(forms), WordForms()

    def __call__(self, text: str) -> tuple[float, float]:
        raw = text.encode()
        a, b = self.texts(raw), self.forms(self.form(text).encode())
        return float(a[0] - a[1]) / len(raw), float(b[0] - b[1]) / len(raw)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """A logistic curve by Newton steps, with a small ridge."""
    scale = np.array([1.0, *(np.abs(x).max(axis=0, initial=0) + 1e-12)])
    rows = np.concatenate([np.ones((len(x), 1)), x], axis=1) / scale
    beta = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (weight * (y - p)) - 1e-3 * beta
        bend = rows.T @ (rows * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(3)
        step = np.clip(np.linalg.solve(bend, slope), -4, 4)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(w) for w in beta / scale)


def learn_quality(docs: DataFrame, labels: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model from the documents that ``labels`` marks 0 or 1 and whose id (column doc_id)
    satisfies ``rows``.

    Texts in the dictionaries: ``DICT_DOCS`` of each label; texts for the curve: ``FIT_DOCS``
    others of each label (of fewer texts a half each), weighted to the labels' share among all
    labelled rows. Null and empty texts and null labels are left out; an id with both labels
    counts for each. Without both labels every text scores the share of good ones (one half, if
    there are none).
    """
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1)).where(rows)
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    texts = id_text(docs, id_col, text_col).where(rows & F.col("text").isNotNull() & (F.col("text") != ""))
    marked = marks.distinct().join(texts.select("doc_id").distinct(), "doc_id")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = marked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= DICT_DOCS + FIT_DOCS)
    # at most two labels times the sample's bound: ids go to the texts, not texts to the ids
    wanted = F.broadcast(picked.select("doc_id", "label"))
    sample = texts.join(wanted, "doc_id").select("doc_id", "label", F.substring("text", 1, FIT_CHARS).alias("text"))
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chosen: dict[int, list[str]] = {0: [], 1: []}
    for r in sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect():
        chosen[r["label"]].append(r["text"])
    into = {label: min(DICT_DOCS, -(-len(texts) // 2)) for label, texts in chosen.items()}
    if not all(chosen.values()):
        return QualityModel({}, {}, (float(np.log(share / (1 - share))), 0.0, 0.0))
    mixed = {label: sorted(t, key=lambda x: (zlib.crc32(x.encode()), x)) for label, t in chosen.items()}
    heads = [(label, t[:DICT_CHARS]) for label, texts in mixed.items() for t in texts[: into[label]]]
    rest = [(label, t) for label, texts in mixed.items() for t in texts[into[label] :] or texts]
    form = WordForms()
    by_text, by_form = dictionaries(heads, TEXT_BYTES), dictionaries([(k, form(t)) for k, t in heads], FORM_BYTES)
    differences = Differences(by_text, by_form)
    x = np.array([differences(text) for _, text in rest])
    y = np.array([label for label, _ in rest], float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return QualityModel(by_text, by_form, _fit(x, y, weight))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, difference (of the weighted differences), score (0 to 1: that
    the label is 1), good.

    Only the text is used. A null or empty text has difference 0. ``keep`` names columns of
    ``docs`` that are passed on after these four, under their names. Repeated rows and null
    ids keep a row each.
    """
    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in keep if c != text_col], F.lit(0).alias("_")).alias("kept"),
    )

    passed = [*(["text"] if text_col in keep else []), *(["kept"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differences = Differences(model.texts, model.forms) if model.texts else None
        offset, *factors = model.weights
        for chunk in text_chunks(batches):
            texts = chunk.column("text").to_pylist()
            each = [differences(t) if t and differences else (0.0, 0.0) for t in texts]
            diff = np.array(each).reshape(-1, 2) @ np.array(factors)
            score = 1 / (1 + np.exp(-np.clip(offset + diff, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(diff), pa.array(score), pa.array(score >= THRESHOLD), *[chunk.column(c) for c in passed]],
                ["doc_id", "difference", "score", "good", *passed],
            )

    kinds = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in passed)
    scored = source.mapInArrow(run, f"doc_id long, difference double, score double, good boolean{kinds}")
    kept = [F.col("text" if c == text_col else f"kept.`{c}`").alias(c) for c in keep]
    return scored.select("doc_id", "difference", "score", "good", *kept)
