"""Compressed sizes of texts under zstandard raw-content dictionaries, one per class.

A dictionary is the joined text of a bounded sample of its class. A text is compressed in
pieces of ``PIECE_BYTES``, each piece with the bare dictionary, so that the whole of a long
text is judged by the dictionaries and not by its own beginning.
"""

from __future__ import annotations

import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a dictionary's sample: documents of a class, characters of each, bytes in all.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 160, 1_000, 112 << 10
PIECE_BYTES = 2 << 10
#: The library's least size of a dictionary; shorter ones are filled up with blanks.
LEAST_BYTES = 8
#: Foreign pieces of each length on which a dictionary's gain by length is measured.
FOREIGN_PIECES = 16
LEVEL = 3


def sampled(rows: DataFrame, per_class: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """From rows (doc_id, text, label) the beginnings of ``per_class`` texts of each label, the
    ones whose id hashes lowest, so that any run takes the same."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    cut = rows.select("doc_id", "label", F.substring("text", 1, chars).alias("text"))
    return cut.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).select("label", "text")


def dictionaries(samples: list[tuple], limit: int = DICTIONARY_BYTES) -> dict:
    """Label to dictionary bytes, from (label, text) pairs, up to ``limit`` bytes of each label
    whatever the others have. Dictionaries so differ in length where a label has few texts, and
    a longer one saves more on any text: comparisons have to allow for that."""
    joined: dict = {}
    for label, text in samples:
        joined.setdefault(label, []).append(text)
    mixed = lambda texts: sorted(texts, key=lambda t: (zlib.crc32(t.encode()), t))
    raw = {label: "\n".join(mixed(texts)).encode() for label, texts in sorted(joined.items())}
    return {label: data[:limit].rjust(LEAST_BYTES) if data else data for label, data in raw.items()}


class Sizes:
    """Compressed sizes of a text, one per dictionary, in the order of ``labels``."""

    def __init__(self, by_label: dict) -> None:
        self.labels = list(by_label)
        self.coders = []
        for data in by_label.values():
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            kind = None
            if len(data) >= LEAST_BYTES:
                kind = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                kind.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=kind, compression_params=params))

    def __call__(self, text: bytes) -> np.ndarray:
        out = np.zeros(len(self.coders), np.int64)
        for start in range(0, len(text), PIECE_BYTES):
            piece = text[start : start + PIECE_BYTES]
            out += [len(c.compress(piece)) for c in self.coders]
        return out


class LengthGains:
    """What the mere length of a dictionary takes off the size of a text, as a factor of at most
    1, for each of the dictionaries and by the length of the text.

    Measured on pieces of the other labels' dictionaries, which are foreign to this one: each
    dictionary is cut to a half, a quarter and so on, and the logarithms of the steps from one
    length to the next are averaged over the dictionaries that are long enough for both.
    Dictionaries of one length have one factor, so that their sizes compare as they are.
    """

    def __init__(self, by_label: dict) -> None:
        own = [len(data) for data in by_label.values()]
        self.factors = np.ones((1, len(own)))
        self.lengths = np.zeros(1)
        if len(set(own)) < 2:
            return
        cuts = [max(own)]
        while cuts[0] // 2 >= LEAST_BYTES:
            cuts.insert(0, cuts[0] // 2)
        lengths, rows = [], []
        for length in (PIECE_BYTES >> k for k in range(7, -1, -1)):
            steps: list[list[float]] = [[] for _ in cuts]
            for label, data in by_label.items():
                pieces = _pieces([d for k, d in by_label.items() if k != label], length)
                if not pieces:
                    continue
                fit = [c for c in cuts if c <= len(data)]
                sizes = np.sum([Sizes({0: b""} | {c: data[:c] for c in fit})(p) for p in pieces], axis=0)
                for k, step in enumerate(np.diff(np.log(sizes))):
                    steps[k].append(float(step))
            if not any(steps):
                continue
            gains = np.cumsum([min(0.0, float(np.mean(s))) if s else 0.0 for s in steps])
            lengths.append(length)
            rows.append(np.exp(np.interp(np.log1p(own), np.log1p([0, *cuts]), [0.0, *gains])))
        if rows:
            self.lengths, self.factors = np.array(lengths), np.array(rows)

    def __call__(self, length: int) -> np.ndarray:
        """The factors for a text of ``length`` bytes: those of the nearest measured length."""
        return self.factors[int(np.abs(np.log(self.lengths + 1) - np.log(length + 1)).argmin())]


def _pieces(texts: list[bytes], length: int) -> list[bytes]:
    """At most ``FOREIGN_PIECES`` pieces of ``length`` bytes, spread over the texts that have as
    many and evenly over each."""
    long = [t for t in texts if len(t) >= length]
    if not long:
        return []
    long = [long[i * len(long) // min(len(long), FOREIGN_PIECES)] for i in range(min(len(long), FOREIGN_PIECES))]
    each = -(-FOREIGN_PIECES // len(long))
    out = []
    for t in long:
        n = min(each, len(t) // length)
        out += [t[at : at + length] for at in (i * (len(t) - length) // max(1, n - 1) for i in range(n))]
    return out[:FOREIGN_PIECES]
