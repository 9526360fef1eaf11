"""Ranked lexical search with Block-Max MaxScore over an index of document shards.

``build_index`` cuts the documents into shards of bounded size. A shard holds the sorted terms of
its documents, and for each term a posting list in document order: blocks of ``BLOCK`` postings
with compressed gaps and frequencies, and beside them, readable without decompression, each
block's last document, highest frequency and shortest document. Nothing in a shard depends on
counts over the whole corpus, so shards are built in one pass and never change.

A search first adds up the document frequencies of the queries' terms. Each task then walks its
shards and keeps a heap of the k best documents per query. From the frequencies and lengths
follow the most a list, and a block, can give. Lists whose greatest contributions together stay
below the heap's k-th score are non-essential: a document found in them alone cannot enter. The
others, the essential lists, yield the candidates; blocks that cannot lift any document to the
k-th score are left packed. Candidates are then looked up in the non-essential lists, the
strongest first, and only where the maximum of the block they fall in still lets them reach the
k-th score is that block decompressed. The tasks' heaps are merged in two steps, by a part of the
documents and then over all parts, so no task gets a heap of every shard.

Scores are integers: a term of weight w adds w * ((10**9 * tf) div (1000 * tf + 12 * m)), where
m = 75 + (25 * n * N) div L for a document of n terms, N documents and L terms in all, and
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtrawl.llm.common import CHUNK_BYTES, id_text
from webtrawl.plans.staging import new_folder, stage

BLOCK = 128
#: Bytes of text and documents of one shard.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 65_535
#: Bytes of query text one search job takes, about.
QUERY_BYTES = 4 << 20
#: Parts of the documents by which heaps are merged first.
MERGE_PARTS = 64

#: Term characters are ASCII letters and digits and everything beyond ASCII; A-Z are lower-cased.
_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))

_SHARD = "docs long, terms long, words binary, dfs binary, lists binary"
_HITS = "query int, item_id long, doc_id long, score long"
_ARRAYS = ("ids", "lengths", "starts", "last", "most_tf", "least_n", "gap_width", "gap_at", "tf_width", "tf_at", "gaps1", "gaps2", "tfs1", "tfs2", "tfs4")
_KINDS = dict(zip(_ARRAYS, "i8 u4 u4 u2 u4 u4 u1 u4 u1 u4 u1 u2 u1 u2 u4".split(), strict=True))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _pieces(text: bytes, limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The text in pieces of about ``limit`` bytes that cut no term."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + limit)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


# ------------------------------------------------------------------------------ shards


class _ShardBuilder:
    """Counts of the terms of some documents, taken up in chunks."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.bytes = 0
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.words: list[bytes] = []
        self.owners: list[tuple[int, int]] = []
        self.waiting = 0

    def add(self, doc_id: int, text: bytes) -> None:
        n = 0
        for piece in _pieces(text):
            words = piece.split()
            if words:
                self.words += words
                self.owners.append((len(self.ids), len(words)))
                n += len(words)
            self.waiting += len(piece)
            if self.waiting >= CHUNK_BYTES:
                self._count()
        self.bytes += len(text)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)

    def _count(self) -> None:
        if self.words:
            coded = pa.array(self.words, pa.binary()).dictionary_encode()
            known = self.vocabulary
            numbers = np.array([known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()], np.int64)
            term = numbers[coded.indices.to_numpy(zero_copy_only=False)]
            owner, sizes = np.array(self.owners, np.int64).T
            keys, tfs = np.unique(term << 32 | np.repeat(owner, sizes), return_counts=True)
            self.found.append((keys >> 32, keys & 0xFFFFFFFF, tfs))
        self.words, self.owners, self.waiting = [], [], 0

    def packed(self) -> pa.RecordBatch | None:
        self._count()
        if not self.ids:
            return None
        words = np.array(list(self.vocabulary), dtype=object)
        order = np.argsort(words, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        term, doc, tf = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keys, at = np.unique(place[term] << 32 | doc, return_inverse=True)  # a document may span chunks
        tf = np.bincount(at, weights=tf).astype(np.int64)
        term, doc = keys >> 32, keys & 0xFFFFFFFF
        dfs = np.bincount(term, minlength=len(words))
        lists = _packed_lists(doc, tf, dfs, np.array(self.ids, np.int64), np.array(self.lengths, np.int64))
        row = [len(self.ids), sum(self.lengths), b" ".join(words[order]), dfs.astype("u4").tobytes(), lists]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["docs", "terms", "words", "dfs", "lists"]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)


def _packed_lists(doc: np.ndarray, tf: np.ndarray, dfs: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """All posting lists of a shard. Gaps and frequencies of a block take one, two or four bytes
    each, as its largest needs; blocks of one width stand one behind the other."""
    starts = np.cumsum(dfs) - dfs
    first_block = np.concatenate([[0], np.cumsum(-(-dfs // BLOCK))])
    heads = np.concatenate([np.arange(s, s + d, BLOCK) for s, d in zip(starts, dfs, strict=True)])
    sizes = np.diff(np.append(heads, len(doc)))
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = doc[starts]
    arrays = {
        "ids": ids,
        "lengths": lengths,
        "starts": first_block,
        "last": doc[heads + sizes - 1],
        "most_tf": np.maximum.reduceat(tf, heads),
        "least_n": np.minimum.reduceat(lengths[doc], heads),
    }
    for name, values, widths in (("gap", gaps, (1, 2)), ("tf", tf, (1, 2, 4))):
        most = np.maximum.reduceat(values, heads)
        width = np.select([most < 256, most < 65536], [1, 2], 4)
        at = np.zeros(len(heads), np.int64)
        for w in widths:
            of_width = np.where(width == w, sizes, 0)
            at += np.where(width == w, np.cumsum(of_width) - of_width, 0)
            arrays[f"{name}s{w}"] = values[np.repeat(width == w, sizes)]
        arrays |= {f"{name}_width": width, f"{name}_at": at}
    parts = [arrays[k].astype(_KINDS[k]).tobytes() for k in _ARRAYS]
    return b"".join([np.array([len(p) for p in parts], np.int64).tobytes(), *parts])


def _unpacked(stored) -> dict[str, np.ndarray]:
    ends = 8 * len(_ARRAYS) + np.cumsum(np.frombuffer(stored, np.int64, len(_ARRAYS)))
    out, at = {}, 8 * len(_ARRAYS)
    for name, end in zip(_ARRAYS, ends.tolist(), strict=True):
        kind = np.dtype(_KINDS[name])
        out[name] = np.frombuffer(stored, kind, (end - at) // kind.itemsize, at)
        at = end
    return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = _ShardBuilder()
    for batch in batches:
        texts = batch.column("text")
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            shard.add(doc_id, text.as_py())
            if shard.bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
                if (done := shard.packed()) is not None:
                    yield done
                shard = _ShardBuilder()
    if (done := shard.packed()) is not None:
        yield done


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of all documents with at least one term, written to the shared folder."""
    rows = id_text(docs, id_col, text_col).where("doc_id is not null and text is not null")
    return stage(rows.select("doc_id", F.col("text").cast("binary")).mapInArrow(_build, _SHARD), "search-shards")


# ------------------------------------------------------------------------------ search


class _List:
    """One posting list of a shard, unpacked block by block."""

    def __init__(self, a: dict[str, np.ndarray], term: int, df: int, m: np.ndarray, m_of) -> None:
        self.a, self.m = a, m
        self.blocks = slice(int(a["starts"][term]), int(a["starts"][term + 1]))
        self.last = a["last"][self.blocks].astype(np.int64)
        most = a["most_tf"][self.blocks].astype(np.int64)
        self.block_max = part(most, m_of(a["least_n"][self.blocks].astype(np.int64)))
        self.max = int(self.block_max.max())
        sizes = np.full(len(self.last), BLOCK)
        sizes[-1] = df - BLOCK * (len(sizes) - 1)
        self.ends = np.cumsum(sizes)
        self.docs = np.repeat(self.last, sizes)  # stands in order also where a block is packed
        self.parts = np.zeros(df, np.int64)
        self.open = np.zeros(len(sizes), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.open[blocks]].tolist():
            at, end = (int(self.ends[b - 1]) if b else 0), int(self.ends[b])
            n, k = end - at, self.blocks.start + b
            gap_at, tf_at = int(self.a["gap_at"][k]), int(self.a["tf_at"][k])
            gaps = self.a[f"gaps{self.a['gap_width'][k]}"][gap_at : gap_at + n]
            tf = self.a[f"tfs{self.a['tf_width'][k]}"][tf_at : tf_at + n].astype(np.int64)
            docs = np.cumsum(gaps, dtype=np.int64) + (self.last[b - 1] if b else 0)
            self.docs[at:end] = docs
            self.parts[at:end] = part(tf, self.m[docs])
            self.open[b] = True

    def rows(self, blocks: np.ndarray) -> np.ndarray | slice:
        """Positions of the postings of these blocks, which are unpacked."""
        self.unpack(blocks)
        if len(blocks) == len(self.ends):
            return slice(None)
        starts = np.concatenate([[0], self.ends[:-1]])
        return np.concatenate([np.arange(starts[b], self.ends[b]) for b in blocks.tolist()])


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class _Heap:
    """The k best documents so far, by score and then by smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """The score a document must reach to matter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]


def search_shard(lists: list[tuple[_List, int]], heap: _Heap, ids: np.ndarray) -> None:
    """One query over one shard. ``lists`` has its terms' lists and what a list's parts count."""
    lists = sorted(lists, key=lambda x: x[0].max * x[1])
    bounds = np.cumsum([x.max * w for x, w in lists])
    least = heap.least()
    essential = int(np.searchsorted(bounds, least))  # the lists before it stay below together
    if essential == len(lists):
        return
    total = np.zeros(len(ids), np.int64)
    for x, w in lists[essential:]:
        worth = np.flatnonzero(x.block_max * w + (bounds[-1] - x.max * w) >= least)
        if len(worth):
            rows = x.rows(worth)
            total[x.docs[rows]] += w * x.parts[rows]
    rest = int(bounds[essential - 1]) if essential else 0
    candidates = np.flatnonzero((total > 0) & (total + rest >= least))
    for at in range(essential - 1, -1, -1):
        if not len(candidates):
            return
        x, w = lists[at]
        rest = int(bounds[at - 1]) if at else 0
        block = np.searchsorted(x.last, candidates)
        inside = block < len(x.last)
        most = np.where(inside, x.block_max[np.where(inside, block, 0)] * w, 0)
        alive = total[candidates] + rest + most >= least
        asked = candidates[alive & inside]
        x.unpack(np.unique(block[alive & inside]))
        place = np.searchsorted(x.docs, asked)
        hit = x.docs[place] == asked
        total[asked[hit]] += w * x.parts[place[hit]]
        candidates = candidates[alive]
        candidates = candidates[total[candidates] + rest >= least]
    candidates = candidates[total[candidates] >= least]
    if len(candidates):
        heap.offer(total[candidates], ids[candidates])


def _frequencies(vocabulary: dict[bytes, int]):
    """Document frequencies of the vocabulary's terms, one sum a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfs = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for words, stored in zip(batch.column("words"), batch.column("dfs"), strict=True):
                own = np.frombuffer(stored.as_py(), np.uint32)
                for at, word in enumerate(words.as_py().split(b" ")):
                    if (term := vocabulary.get(word)) is not None:
                        dfs[term] += own[at]
        known = np.flatnonzero(dfs)
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array(dfs[known])], ["term", "df"])

    return count


def _searcher(queries: list[tuple[int | None, dict[int, int]]], vocabulary: dict[bytes, int], weights: dict[int, int], n_docs: int, n_terms: int, k: int):
    """Searches shards for all queries and returns the task's heaps. A query is its item_id and
    how often it has each term, by the term's number."""

    def m_of(lengths: np.ndarray) -> np.ndarray:
        return 75 + 25 * lengths * n_docs // n_terms

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [_Heap(k) for _ in queries]
        for batch in batches:
            for words, stored_dfs, stored in zip(batch.column("words"), batch.column("dfs"), batch.column("lists"), strict=True):
                a, dfs = _unpacked(stored.as_py()), np.frombuffer(stored_dfs.as_py(), np.uint32)
                m = m_of(a["lengths"].astype(np.int64))
                lists = {}
                for at, word in enumerate(words.as_py().split(b" ")):
                    term = vocabulary.get(word)
                    if term is not None and weights.get(term, 0):
                        lists[term] = _List(a, at, int(dfs[at]), m, m_of)
                for heap, (_, counts) in zip(heaps, queries, strict=True):
                    own = [(lists[t], n * weights[t]) for t, n in counts.items() if t in lists]
                    if own:
                        search_shard(own, heap, a["ids"])
        sizes = [len(h.ids) for h in heaps]
        if sum(sizes):
            items = [queries[q][0] for q, n in enumerate(sizes) for _ in range(n)]
            columns = [
                pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()),
                pa.array(items, pa.int64()),
                pa.array(np.concatenate([h.ids for h in heaps])),
                pa.array(np.concatenate([h.scores for h in heaps])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["query", "item_id", "doc_id", "score"])

    return search


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` best documents of the index for every item: item_id, rank (from 1), doc_id, score.

    Only scores above 0 count; equal scores go to the smaller doc_id. Items are searched in jobs
    of about ``query_bytes`` of their text, which is all of them the driver holds at once.

    * Null or empty items, and those without a known term, have no rows.
    * Items that repeat another's id and text count once; items that share an id but not the text
      are ranked apart, each from 1. An item without an id is ranked under a null id.
    * Documents with a null text or no term are not indexed and not counted; documents without an
      id take no part. Rows that repeat a document are documents of their own.
    * Empty tables give an empty result. Other columns are not looked at.
    """
    spark = index.sparkSession
    wanted = id_text(items, id_col, text_col).where("text is not null").distinct()
    wanted = stage(wanted, "search-items")
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_docs, n_terms = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    jobs = -(-size // query_bytes)
    folder = new_folder(spark, "search-hits")
    for job in range(max(1, jobs)):
        some = wanted.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, jobs))) == job).collect()
        counted = [(row.doc_id, Counter(terms(row.text.encode()))) for row in some]
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, c in counted for w in c}))}
        dfs = index.select("words", "dfs").mapInArrow(_frequencies(vocabulary), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weights = {r.term: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * r.df + 1)))) for r in dfs.collect()}  # one row a term of the queries
        queries = [(item, {vocabulary[w]: n for w, n in c.items()}) for item, c in counted]
        hits = index.select("words", "dfs", "lists").mapInArrow(_searcher(queries, vocabulary, weights, n_docs, n_terms, k), _HITS)
        for group in (["query", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))], ["query"]):
            best = Window.partitionBy(*group).orderBy(F.desc("score"), "doc_id")
            hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        hits.select("item_id", "rank", "doc_id", "score").write.parquet(f"{folder}/job={job}")
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(*[f"{folder}/job={j}" for j in range(max(1, jobs))])
