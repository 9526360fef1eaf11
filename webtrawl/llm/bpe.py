"""Byte-level BPE encoding and decoding of whole texts.

A text is cut at special tokens and then into pieces by the vocabulary's pattern. The bytes of
a piece are symbols in a doubly linked list; a priority queue holds the merge ranks of
neighbouring pairs. The lowest rank is merged first (the leftmost among equal ranks), the two
new neighbour pairs are pushed, and entries whose symbols have changed meanwhile are skipped
when they are popped. Decoding joins the byte strings of the vocabulary.

Each Python worker keeps the ids of the short pieces it has met in a bounded cache of two
generations: when the newer one is full it becomes the older one, and a piece found there moves
back. Pieces in use stay, so the merges run about once per distinct piece.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from webtrawl.llm.common import id_text, kept_in_worker, text_chunks

#: Fixed values of the byte-level vocabulary format: the pattern of its pieces.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Longer pieces are merged each time; they hardly repeat.
CACHED_BYTES = 48
#: Pieces a worker's cache holds, half of them in each generation.
CACHE_PIECES = 150_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {letter: b for b, letter in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items() if token not in self.special}
        strings |= {i: token.encode() for token, i in self.special.items()}
        self.strings = pa.array([strings.get(i) for i in range(max(strings) + 1)], pa.large_binary())
        self.first = [vocab[letter] for _, letter in sorted(byte_letters().items())]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cuts = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids: list[int | None] = [self.first[b] for b in piece]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            if (found := merges.get((ids[i], ids[i + 1]))) is not None:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapify(queue)
        while queue:
            _, i, left, right, new = heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two symbols has been merged since
            ids[i], ids[j] = new, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            h, k = before[i], after[i]
            if h >= 0 and (found := merges.get((ids[h], new))) is not None:
                heappush(queue, (found[0], h, ids[h], new, found[1]))
            if k < n and (found := merges.get((new, ids[k]))) is not None:
                heappush(queue, (found[0], i, new, ids[k], found[1]))
        return [x for x in ids if x is not None]

    def _piece(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            raw = piece.encode()
            packed = array("I", self.merged(raw)).tobytes()
            if len(raw) > CACHED_BYTES:
                return packed
        if len(self.cache) >= CACHE_PIECES // 2:
            self.older = self.cache.copy()
            self.cache.clear()  # not a new one: ``_plain`` is looking pieces up in it
        self.cache[piece] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        known = self.cache.get
        return b"".join([known(p) or self._piece(p) for p in PIECES.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cuts is None or not self.cuts.search(text):
            return self._plain(text)
        out, start = [], 0
        for cut in self.cuts.finditer(text):
            out += [self._plain(text[start : cut.start()]), array("I", [self.special[cut[0]]]).tobytes()]
            start = cut.end()
        return b"".join([*out, self._plain(text[start:])])

    def decode(self, ids: bytes) -> str:
        if not ids:
            return ""
        found = self.strings.take(pa.array(np.frombuffer(ids, "<u4")))
        _, offsets, data = found.buffers()
        end = np.frombuffer(offsets, np.int64, len(found) + 1)[-1]
        return str(memoryview(data)[:end], "utf-8", "replace") if end else ""


def _loaded(path: str) -> ByteBPE:
    return kept_in_worker(f"bpe {path}", lambda: ByteBPE(path))


def encode_and_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers),
    decoded (the text got back from the ids).

    ``vocabulary`` is the path of a byte-level BPE file that every executor has. A null text
    counts as empty and gives no ids. Special tokens that stand in a text become their id.
    Rows keep their number: repeated rows and null ids give a row each. Other columns are left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for chunk in text_chunks(batches):
            ids = [bpe.encode(t or "") for t in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([bpe.decode(x) for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
