"""Katz backoff scoring: bigrams over unigrams, with Good-Turing discounts.

p(w | h) = d(c(hw)) c(hw) / c(h) for a bigram seen in training, else alpha(h) p(w), and p(w) in
turn is d(c) c / N for a known word, else the mass the discounts leave. alpha(h) makes the
probabilities after h sum to one exactly, over all known words and one class of unknown ones. A
history whose followers are all too frequent to be discounted counts one more, which is the
mass its other followers get.

Tokens travel as arrays, not as rows. A batch of documents holds its distinct words and the
codes of its tokens. Counts and backoff weights are tables partitioned by ranges of 64-bit
n-gram keys; a batch asks each partition about its distinct keys once, and the partition
answers in the order asked:

1. Batches send their distinct words and bigrams with their training counts. Partitions sum
   them into the stored count tables and answer with the totals. The first batch that holds a
   training bigram is named its owner.
2. Owners send, per history, what their bigrams take of its mass. Partitions sum that into the
   stored backoff weights and answer where a batch wants the weight.
3. Each batch completes its scores.

A batch meets its counts once, in step 2. It evaluates all that does not depend on backoff weights
there, and what is left (a few numbers per document, and the histories of bigrams not seen in
training) goes on beside the sums, through the same shuffle. So the tokens are shuffled once.

Frequent n-grams are one entry per batch, so no key is hot. The number of partitions follows the
number of tokens, so a partition has a bounded number of entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import chained, id_text, text_chunks, word_hashes, words
from webtrawl.plans.staging import stage

#: Counts up to here are discounted.
MOST_DISCOUNTED = 5
TOKENS_PER_BATCH = 2_000_000
TOKENS_PER_PART = 3_000_000
#: Keys that no word has: words hold no blank.
END = xxhash.xxh3_64_intdigest(b"end of text")
START = xxhash.xxh3_64_intdigest(b"start of text")

_BATCH = "batch string, doc_ids binary, no_id binary, held binary, lengths binary, words binary, codes binary, tokens long"
_ASK = "part int, batch string, kind int, keys binary, numbers binary"
_ANSWER = "what string, part int, batch string, kind int, keys binary, numbers binary, flags binary, known long, total long, ones array<long>"
_SUMS = "part int, batch string, kind int, keys binary, numbers binary, sums binary, wanted binary, rest array<binary>"
_WEIGHTS = "what string, part int, batch string, kind int, keys binary, numbers binary, rest array<binary>"
_WORD, _PAIR, _HISTORY, _REST = 1, 2, 3, 4


def pack(values: np.ndarray) -> bytes:
    """Fixed-width numbers byte plane by byte plane, compressed: high planes hardly cost."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


@dataclass(frozen=True)
class Discounts:
    """Factors of counts 1 to ``MOST_DISCOUNTED``; larger counts keep theirs."""

    factors: tuple[float, ...]

    @staticmethod
    def from_counts(n: list[int]) -> Discounts:
        """``n[r]``: number of n-grams seen r times, r up to one more than the largest
        discounted. Where the Good-Turing factors are not between 0 and 1, as in small tables,
        half a count is taken off instead."""
        k = MOST_DISCOUNTED
        factors = []
        if all(n[1:]):
            cut = (k + 1) * n[k + 1] / n[1]
            if cut < 1:
                factors = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) for r in range(1, k + 1)]
        if not factors or not all(0 < d < 1 for d in factors):
            factors = [(r - 0.5) / r for r in range(1, k + 1)]
        return Discounts(tuple(factors))

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        table = np.array([0.0, *(r * d for r, d in enumerate(self.factors, 1))])
        small = counts <= MOST_DISCOUNTED
        return np.where(small, table[np.where(small, counts, 0)], counts.astype(float))


@dataclass(frozen=True)
class Model:
    """Numbers of the whole training corpus; the tables are in the answers."""

    known: int
    total: int
    documents: int
    word: Discounts
    pair: Discounts
    unknown: float

    scale: float

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Of known words their discounted share, else the mass of the unknown class."""
        return np.where(counts > 0, self.scale * self.word.kept(counts) / max(1, self.total), self.unknown)


class Batch:
    """Documents of a batch: token codes into its own words (END included)."""

    def __init__(self, row: dict) -> None:
        self.name = row["batch"]
        self.lengths = unpack(row["lengths"], np.int64)
        self.held = unpack(row["held"], np.bool_)
        self.words = unpack(row["words"], np.uint64)
        self.codes = unpack(row["codes"], np.int32).astype(np.int64)
        self.row = row
        n = len(self.words)
        self.start = n  # the code of the history before a text
        before = np.concatenate([[n], self.codes[:-1]])
        firsts = np.cumsum(self.lengths) - self.lengths
        before[firsts] = n
        self.training = np.repeat(~self.held, self.lengths)
        pairs, self.pair_of = np.unique(before * (n + 1) + self.codes, return_inverse=True)
        self.left, self.right = pairs // (n + 1), pairs % (n + 1)
        hashes = np.append(self.words, np.uint64(START))
        self.word_order = np.argsort(self.words)
        pair_keys = chained(hashes[self.left], hashes[self.right])
        self.pair_order = np.argsort(pair_keys)
        self.keys = {_WORD: self.words[self.word_order], _PAIR: pair_keys[self.pair_order]}
        self.history_order = np.argsort(hashes)
        self.keys[_HISTORY] = hashes[self.history_order]

    def training_counts(self, kind: int) -> np.ndarray:
        """In the order of the keys."""
        codes, n, order = (self.codes, len(self.words), self.word_order) if kind == _WORD else (self.pair_of, len(self.left), self.pair_order)
        return np.bincount(codes, self.training, n).astype(np.int64)[order]

    def answered(self, answers: list[dict], kind: int, dtype) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and flags per word or bigram code from the partitions' answers."""
        own = sorted((a for a in answers if a["kind"] == kind), key=lambda a: a["part"])
        order = {_WORD: self.word_order, _PAIR: self.pair_order}[kind]
        numbers, flags = np.zeros(len(order), dtype), np.zeros(len(order), bool)
        numbers[order] = np.concatenate([unpack(a["numbers"], dtype) for a in own])
        if own[0]["flags"] is not None:
            flags[order] = np.concatenate([unpack(a["flags"], np.bool_) for a in own])
        return numbers, flags


def _asks(batch: Batch, kind: int, parts: int, keys: np.ndarray, **columns: np.ndarray) -> Iterator[dict]:
    """One row per partition that holds some of the keys."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    for part in range(parts):
        a, b = cuts[part], cuts[part + 1]
        if a < b:
            packed = {name: pack(values[a:b]) for name, values in columns.items()}
            yield {"part": part, "batch": batch.name, "kind": kind, "keys": pack_keys(keys[a:b]), **packed}


def _rows(rows, schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.Table.from_pylist(list(rows), schema=pa.schema([(name, kinds[kind]) for name, kind in fields]))


def batches(docs: DataFrame, held_out: Column) -> DataFrame:
    """Documents in batches of about ``TOKENS_PER_BATCH`` tokens."""
    rows = id_text(docs).withColumn("held", F.coalesce(held_out, F.lit(False)))

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bool] = []
        tokens: list[np.ndarray] = []
        size = 0

        def batch() -> pa.RecordBatch:
            found, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            row = {
                "batch": f"{part}-{made}",
                "doc_ids": pack(np.array([i or 0 for i in ids], np.int64)),
                "no_id": pack(np.array([i is None for i in ids], np.bool_)),
                "held": pack(np.array(held, np.bool_)),
                "lengths": pack(np.array([len(t) for t in tokens], np.int64)),
                "words": pack(found[order]),
                "codes": pack(rank[inverse]),
                "tokens": size,
            }
            return _rows([row], _BATCH).to_batches()[0]

        for chunk in text_chunks(chunks):
            for i, text, h in zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "text", "held")), strict=True):
                ids.append(i)
                held.append(h)
                tokens.append(np.append(word_hashes(words(text)), np.uint64(END)))
                size += len(tokens[-1])
                if size >= TOKENS_PER_BATCH:
                    yield batch()
                    ids, held, tokens, size, made = [], [], [], 0, made + 1
        if ids:
            yield batch()

    return rows.mapInArrow(run, _BATCH)


def _count(asks: pa.Table) -> pa.Table:
    """Totals of one partition: its part of the count tables, and an answer to each batch."""
    out = []
    for kind in (_WORD, _PAIR):
        rows = sorted((r for r in asks.to_pylist() if r["kind"] == kind), key=lambda r: r["batch"])
        if not rows:
            continue
        keys = [unpack_keys(r["keys"]) for r in rows]
        counts = np.concatenate([unpack(r["numbers"], np.int64) for r in rows])
        sizes, flat = [len(k) for k in keys], np.concatenate(keys)
        unique, inverse = np.unique(flat, return_inverse=True)
        totals = np.bincount(inverse, counts, len(unique)).astype(np.int64)
        seen = np.nonzero(counts > 0)[0]
        first = np.unique(inverse[seen], return_index=True)[1]
        owner = np.zeros(len(flat), bool)
        owner[seen[first]] = True
        kept = totals > 0
        ones = np.bincount(totals[kept & (totals <= MOST_DISCOUNTED + 1)], minlength=MOST_DISCOUNTED + 2)
        part = rows[0]["part"]
        out.append(
            {"what": "table", "part": part, "kind": kind, "keys": pack_keys(unique[kept]), "numbers": pack(totals[kept]),
             "known": int(kept.sum()), "total": int(totals.sum()), "ones": ones.tolist()}
        )
        at = 0
        answer = totals[inverse]
        for row, size in zip(rows, sizes, strict=True):
            flags = pack(owner[at : at + size]) if kind == _PAIR else None
            out.append({"what": "answer", "part": part, "batch": row["batch"], "kind": kind, "numbers": pack(answer[at : at + size]), "flags": flags})
            at += size
    return _rows(out, _ANSWER)


def backoff_weights(taken: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """alpha of histories: from the discounted counts of their followers, the followers' lower
    probabilities, and the histories' counts. Negative where no follower is discounted: its
    magnitude then goes with one more in the history's count. 1 for an unseen history."""
    plain = (counts - taken) / np.maximum(counts, 1)
    none = plain < 1e-12
    alpha = np.where(none, -1 / (counts + 1.0), plain) / np.maximum(1 - lower, 1e-300)
    return np.where(counts > 0, alpha, 1.0)


def _weigh(asks: pa.Table, model: Model) -> pa.Table:
    """Weights of one partition: its part of the table, and an answer to each batch that wants
    some. What is left of batches passes."""
    found = sorted(asks.to_pylist(), key=lambda r: r["batch"])
    out = [{"what": "rest", "part": r["part"], "batch": r["batch"], "rest": r["rest"]} for r in found if r["kind"] == _REST]
    rows = [r for r in found if r["kind"] == _HISTORY]
    if not rows:
        return _rows(out, _WEIGHTS)
    keys = [unpack_keys(r["keys"]) for r in rows]
    counts = np.concatenate([unpack(r["numbers"], np.int64) for r in rows])
    sums = np.concatenate([unpack(r["sums"], np.complex128) for r in rows])
    unique, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    taken, lower = (np.bincount(inverse, x, len(unique)) for x in (sums.real, sums.imag))
    lower *= model.scale / max(1, model.total)  # every follower is a known word
    alpha = backoff_weights(taken, lower, counts[first]).astype(np.float32)
    part, at = rows[0]["part"], 0
    seen = counts[first] > 0
    out.append({"what": "table", "part": part, "kind": _HISTORY, "keys": pack_keys(unique[seen]), "numbers": pack(alpha[seen])})
    for row, k in zip(rows, keys, strict=True):
        wanted = unpack(row["wanted"], np.bool_)
        if wanted.any():
            out.append({"what": "answer", "part": part, "batch": row["batch"], "kind": _HISTORY, "numbers": pack(alpha[inverse[at : at + len(k)][wanted]])})
        at += len(k)
    return _rows(out, _WEIGHTS)


def _history_counts(batch: Batch, word_counts: np.ndarray, model: Model) -> np.ndarray:
    return np.append(word_counts, model.documents)


def _history_sums(batch: Batch, answers: list[dict], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the batch's histories, and what its own bigrams take of them: discounted counts
    as real, the followers' own discounted counts as imaginary parts (lower probabilities but for
    a factor, with which they would hardly compress); in the order of the history keys."""
    word_counts, _ = batch.answered(answers, _WORD, np.int64)
    pair_counts, owned = batch.answered(answers, _PAIR, np.int64)
    own = np.nonzero(owned)[0]
    n = len(batch.words) + 1
    taken = np.bincount(batch.left[own], model.pair.kept(pair_counts[own]), n)
    lower = np.bincount(batch.left[own], model.word.kept(word_counts[batch.right[own]]), n)
    order = batch.history_order
    return _history_counts(batch, word_counts, model)[order], (taken + 1j * lower)[order]


@dataclass(frozen=True)
class Rest:
    """What is left of a batch when its counts are known. Per document: the numbers of its row,
    ``sure`` (the score but for backoff weights) and ``open``, how many of its tokens wait for the
    weight of their history. Per such token: ``history``, a place among the ``counts`` of the
    histories waited for, in the order of their keys, and ``seen``, whether the bigram is known."""

    doc_ids: np.ndarray
    no_id: np.ndarray
    held: np.ndarray
    lengths: np.ndarray
    known: np.ndarray
    base: np.ndarray
    sure: np.ndarray
    open: np.ndarray
    history: np.ndarray
    seen: np.ndarray
    counts: np.ndarray

    def packed(self) -> list[bytes]:
        return [pack(getattr(self, name)) for name in _REST_TYPES]

    @staticmethod
    def unpacked(columns: list[bytes]) -> Rest:
        return Rest(*(unpack(c, t) for c, t in zip(columns, _REST_TYPES.values(), strict=True)))


_REST_TYPES = {
    "doc_ids": np.int64, "no_id": np.bool_, "held": np.bool_, "lengths": np.int64, "known": np.int64, "base": np.float64,
    "sure": np.float64, "open": np.int64, "history": np.int32, "seen": np.bool_, "counts": np.int64,
}


def _rest(batch: Batch, answers: list[dict], model: Model) -> tuple[Rest, np.ndarray]:
    """What is left of the batch, and which of its histories, in the order of their keys, have to
    be weighed for that. A known bigram waits where the batch's own bigrams do not show that its
    history has a discounted follower, an unknown one where its history was seen at all."""
    word_counts, _ = batch.answered(answers, _WORD, np.int64)
    pair_counts, _ = batch.answered(answers, _PAIR, np.int64)
    counts = _history_counts(batch, word_counts, model)
    histories, kept = counts[batch.left], model.pair.kept(pair_counts)
    known = pair_counts > 0
    free = np.bincount(batch.left, pair_counts - kept, len(counts)) / np.maximum(counts, 1)
    waits = np.where(known, free[batch.left] < 1e-9, histories > 0)
    wanted = np.zeros(len(counts), bool)
    wanted[batch.left[waits]] = True
    wanted_keys = wanted[batch.history_order]
    place = np.zeros(len(counts), np.int32)
    place[batch.history_order[wanted_keys]] = np.arange(wanted_keys.sum(), dtype=np.int32)

    sure = np.log10(np.where(known, kept / np.maximum(histories, 1), model.unigram(word_counts[batch.right])))
    base = np.log10((word_counts + 0.5) / (model.total + 0.5 * (model.known + 1)))
    document = np.repeat(np.arange(len(batch.lengths)), batch.lengths)
    per_document = lambda values: np.bincount(document, values, len(batch.lengths))
    waiting = waits[batch.pair_of]
    pairs = batch.pair_of[waiting]
    rest = Rest(
        doc_ids=unpack(batch.row["doc_ids"], np.int64),
        no_id=unpack(batch.row["no_id"], np.bool_),
        held=batch.held,
        lengths=batch.lengths,
        known=per_document(word_counts[batch.codes] > 0).astype(np.int64),
        base=per_document(base[batch.codes]),
        sure=per_document(sure[batch.pair_of]),
        open=per_document(waiting).astype(np.int64),
        history=place[batch.left[pairs]],
        seen=known[pairs],
        counts=counts[batch.history_order[wanted_keys]],
    )
    return rest, wanted_keys


def _sums_and_rest(batch: Batch, answers: list[dict], model: Model, parts: int) -> Iterator[dict]:
    """To each partition the batch's sums of its histories, and to one what is left of the batch."""
    counts, sums = _history_sums(batch, answers, model)
    rest, wanted = _rest(batch, answers, model)
    sent = wanted | (sums.real > 0)
    yield from _asks(batch, _HISTORY, parts, batch.keys[_HISTORY][sent], numbers=counts[sent], sums=sums[sent], wanted=wanted[sent])
    yield {"part": xxhash.xxh3_64_intdigest(batch.name) % parts, "batch": batch.name, "kind": _REST, "rest": rest.packed()}


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _completed(rest: Rest, answers: list[dict]) -> pa.Table:
    own = sorted(answers, key=lambda a: a["part"])
    alpha = np.concatenate([np.zeros(0), *(unpack(a["numbers"], np.float32).astype(float) for a in own)])
    # of a known bigram: one more in the history's count where that has no discounted follower
    more = np.where(alpha < 0, np.log10(rest.counts / (rest.counts + 1.0)), 0.0)
    tokens = np.where(rest.seen, more[rest.history], np.log10(np.abs(alpha))[rest.history])
    n = len(rest.lengths)
    return pa.table(
        {
            "doc_id": pa.array(rest.doc_ids, mask=rest.no_id),
            "held_out": pa.array(rest.held),
            "n_tokens": pa.array(rest.lengths),
            "n_known": pa.array(rest.known),
            "base_score": pa.array(rest.base),
            "score": pa.array(rest.sure + np.bincount(np.repeat(np.arange(n), rest.open), tokens, n)),
        }
    )


def _with_answers(asking: DataFrame, answers: DataFrame, use: Callable[[dict, list[dict]], pa.Table], schema: str) -> DataFrame:
    def run(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        return pa.concat_tables([use(row, rows) for row in left.to_pylist()])

    return asking.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def _grouped(asks: DataFrame, use: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(_key: tuple, asked: pa.Table) -> pa.Table:
        return use(asked)

    return asks.groupBy("part").applyInArrow(run, schema)


def katz_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows of ``docs`` that are not ``held_out`` (a condition on doc_id), and score
    all: doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (add-half unigrams), score (log10 of the text's probability). Runs when called, all but the
    last step.

    Tokens are the words of the whole text, A-Z lower-cased, and one end. A null text counts as
    empty: one token. Rows with a null id are learned from; repeated rows count each. Without
    training rows every token is unknown with probability 1. An empty table gives no rows.
    """
    made = stage(batches(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), held_out), "batches")
    parts = max(4, -(-(made.agg(F.sum("tokens")).first()[0] or 0) // TOKENS_PER_PART))

    def count_asks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                batch = Batch(row)
                for kind in (_WORD, _PAIR):
                    for ask in _asks(batch, kind, parts, batch.keys[kind], numbers=batch.training_counts(kind)):
                        yield from _rows([ask], _ASK).to_batches()

    counted = stage(_grouped(made.mapInArrow(count_asks, _ASK), _count, _ANSWER), "ngram-counts", drop_shuffles=True)
    model = _model(counted, docs, held_out, id_col)
    answers = counted.where("what = 'answer'").select("batch", "part", "kind", "numbers", "flags")
    sums = _with_answers(made, answers, lambda row, rows: _rows(_sums_and_rest(Batch(row), rows, model, parts), _SUMS), _SUMS)
    weights = stage(_grouped(sums, lambda asked: _weigh(asked, model), _WEIGHTS), "backoff-weights", drop_shuffles=True)
    left = weights.where("what = 'rest'").select("batch", "rest")
    weighed = weights.where("what = 'answer'").select("batch", "part", "numbers")
    scores = _with_answers(left, weighed, lambda row, rows: _completed(Rest.unpacked(row["rest"]), rows), _SCORE)
    return scores.withColumn("train_tokens", F.lit(model.total).cast("long"))


def _model(counted: DataFrame, docs: DataFrame, held_out: Column, id_col: str) -> Model:
    tables = counted.where("what = 'table'")
    sums = [F.sum(F.get("ones", i)).alias(f"n{i}") for i in range(MOST_DISCOUNTED + 2)]
    found = {r["kind"]: r for r in tables.groupBy("kind").agg(F.sum("known").alias("known"), F.sum("total").alias("total"), *sums).collect()}
    ones = lambda kind: [int(found[kind][f"n{i}"] or 0) if kind in found else 0 for i in range(MOST_DISCOUNTED + 2)]
    word, pair = Discounts.from_counts(ones(_WORD)), Discounts.from_counts(ones(_PAIR))
    known, total = (int(found[_WORD][c] or 0) if _WORD in found else 0 for c in ("known", "total"))
    left = sum(r * n * (1 - word.factors[r - 1]) for r, n in enumerate(ones(_WORD)) if 1 <= r <= MOST_DISCOUNTED)
    keys = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    documents = keys.where(~F.coalesce(held_out, F.lit(False))).count()
    # where no word is discounted, the unknown class takes the place of one more token
    unknown, scale = (left / total, 1.0) if left else (1 / (total + 1), total / (total + 1))
    return Model(known, total, documents, word, pair, unknown, scale)
