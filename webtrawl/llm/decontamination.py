"""Benchmark decontamination: every training passage is a query against an inverted index of
test items.

The index holds BM25 impacts of the items' words. An item's impacts are divided by the score a
passage must reach for it, a share of the score of the item's own text, so the one threshold for
all items is 1. Passages are windows of ``WINDOW`` words that overlap by half. All items above
the threshold are retrieved by block-max WAND: the posting lists are walked together, blocks
whose maxima cannot reach the threshold are skipped. The pivot test of most passages is made
for a whole batch at once: the short posting lists are added up exactly and the long ones enter
with what they can give an item at most; only passages in which some item can still reach the
threshold are walked.

A retrieved item counts as leaked if both its question and its answer overlap with the passage's
surroundings in word n-grams.

Document frequencies, number and mean length of the items are counted over the whole benchmark.
The items are cut into indexes of bounded bytes, which Spark tasks build and write below the
shared folder; the tasks on passages read them one after another. The driver holds counts and
file names only, and no score depends on the number of indexes.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import id_text, text_chunks, words
from webtrawl.llm.token_files import _place
from webtrawl.plans.staging import new_folder, stage

K1, B = 1.2, 0.75
WINDOW, STEP = 96, 48
#: Share of an item's own score that a passage must reach, and of its n-grams found again.
SCORE_SHARE, OVERLAP, NGRAM = 0.5, 0.5, 4
BLOCK = 64
#: Bytes of items in one index.
INDEX_BYTES = 8 << 20
#: Chunks of passages for which each of several indexes is read once.
GROUP_CHUNKS = 8

HIT = "item_id: bigint, score: double, question: double, answer: double"
_PASS = f"doc_id long, text string, kept {{kept}}, passages long, hits array<struct<{HIT}>>"


def parts(tokens: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: the answer is its last sentence, or the last quarter of
    its words if it has one sentence."""
    ends = [i + 1 for i, w in enumerate(tokens[:-1]) if w[-1:] in b".?!:"]
    cut = ends[-1] if ends else len(tokens) - max(1, len(tokens) // 4)
    return tokens[:cut] or tokens, tokens[cut:] or tokens


def ngrams(tokens: list[bytes], n: int = NGRAM) -> set[tuple]:
    """Word n-grams; of fewer words the whole sequence."""
    return {tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))} if tokens else set()


def found_share(part: list[bytes], passage: list[bytes]) -> float:
    grams = ngrams(part)
    return len(grams & ngrams(passage, min(NGRAM, len(part)))) / len(grams) if grams else 0.0


class PostingList:
    """Items (ascending) and their impacts, with the last item and the maximum of each block."""

    __slots__ = ("items", "impacts", "most", "block_last", "block_most", "at")

    def __init__(self, items: list[int], impacts: list[float]) -> None:
        self.items, self.impacts, self.most, self.at = items, impacts, max(impacts), 0
        starts = range(0, len(items), BLOCK)
        self.block_last = [items[min(len(items), s + BLOCK) - 1] for s in starts]
        self.block_most = [max(impacts[s : s + BLOCK]) for s in starts]

    def item(self) -> float:
        return self.items[self.at] if self.at < len(self.items) else math.inf

    def seek(self, item: float) -> None:
        """To the first posting of ``item`` or a later one, block by block."""
        items, at, n = self.items, self.at, len(self.items)
        while at < n and self.block_last[at // BLOCK] < item:
            at = (at // BLOCK + 1) * BLOCK
        while at < n and items[at] < item:
            at += 1
        self.at = min(at, n)

    def block_of(self, item: int) -> tuple[float, float]:
        """Maximum and last item of the block that may hold ``item``, without moving."""
        block = min(self.at, len(self.items) - 1) // BLOCK
        while block < len(self.block_last) and self.block_last[block] < item:
            block += 1
        return (self.block_most[block], self.block_last[block]) if block < len(self.block_last) else (0.0, math.inf)


def block_max_wand(lists: list[PostingList], threshold: float = 1.0) -> list[tuple[int, float]]:
    """All items whose summed impacts reach the threshold, with their sums."""
    eps, out = 1e-9, []
    threshold -= eps
    for p in lists:
        p.at = 0
    while True:
        lists = sorted((p for p in lists if p.at < len(p.items)), key=PostingList.item)
        bound, pivot = 0.0, -1
        for i, p in enumerate(lists):
            bound += p.most
            if bound >= threshold:
                pivot = i
                break
        if pivot < 0:
            return out
        item = lists[pivot].item()
        while pivot + 1 < len(lists) and lists[pivot + 1].item() == item:
            pivot += 1
        blocks = [p.block_of(item) for p in lists[: pivot + 1]]
        if sum(most for most, _ in blocks) < threshold:
            after = min(min(last for _, last in blocks) + 1, lists[pivot + 1].item() if pivot + 1 < len(lists) else math.inf)
            for p in lists[: pivot + 1]:
                p.seek(after)
        elif lists[0].item() == item:
            score = math.fsum(p.impacts[p.at] for p in lists[: pivot + 1])  # in any order the same
            if score >= threshold:
                out.append((item, score))
            for p in lists[: pivot + 1]:
                p.at += 1
        else:
            for p in lists[: pivot + 1]:
                p.seek(item)


class ItemIndex:
    """Inverted index of some items: (item_id, text) pairs. ``df`` has the number of items with
    a word, for all words of these items, out of all ``total`` items of mean length ``mean``."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], total: int, mean: float) -> None:
        cut = sorted((i, words(text)) for i, text in items)
        self.ids, self.tokens = [i for i, _ in cut], [w for _, w in cut]
        counts = [Counter(w) for w in self.tokens]
        n, lengths = len(cut), [len(w) for w in self.tokens]
        idf = {t: math.log(1 + (total - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.terms]
        for i, c in enumerate(counts):
            norm = K1 * (1 - B + B * lengths[i] / mean)
            impact = {t: idf[t] * tf * (K1 + 1) / (tf + norm) for t, tf in c.items()}
            # a passage surely holds STEP words of a longer item, so that share is asked of it
            need = SCORE_SHARE * sum(impact.values()) * min(1.0, STEP / lengths[i])
            for t, value in impact.items():
                postings[self.terms[t]][0].append(i)
                postings[self.terms[t]][1].append(value / need)
        self.lists = [PostingList(*p) for p in postings]
        self.parts = [parts(w) for w in self.tokens]
        sizes = np.array([len(p.items) for p in self.lists], np.int64)
        self.short = np.append(sizes <= max(4, n // 40), False)  # the last entry stands for other words
        self.sizes = np.append(sizes * self.short[:-1], 0)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        short = [p for p, s in zip(self.lists, self.short, strict=False) if s]
        self.flat_items = np.array([i for p in short for i in p.items], np.int64)
        self.flat_impacts = np.array([x for p in short for x in p.impacts], float)
        self.rest = np.zeros(n)  # what the long lists give an item at most
        for p, s in zip(self.lists, self.short, strict=False):
            if not s:
                np.add.at(self.rest, p.items, p.impacts)

    def term_ids(self, tokens: list[bytes]) -> np.ndarray:
        get, other = self.terms.get, len(self.terms)
        return np.fromiter((get(t, other) for t in tokens), np.int64, len(tokens))

    def possible_windows(self, terms: np.ndarray, windows: int) -> list[int]:
        """Windows in which an item may reach the threshold."""
        n, other = len(self.ids), len(self.terms)
        at = np.nonzero(self.short[terms])[0]
        step = at // STEP  # a word lies in the windows that begin at its step and the one before
        keys = np.concatenate([step, step - 1]) * (other + 1) + np.tile(terms[at], 2)
        keys = np.unique(keys[np.concatenate([step < windows, step >= 1])])
        window, term = keys // (other + 1), keys % (other + 1)
        size = self.sizes[term]
        first = np.repeat(self.starts[term] - np.concatenate([[0], np.cumsum(size)])[:-1], size)
        flat = first + np.arange(size.sum())
        pairs, back = np.unique(np.repeat(window, size) * n + self.flat_items[flat], return_inverse=True)
        sums = np.bincount(back, self.flat_impacts[flat], len(pairs))
        open_pairs = pairs[sums + self.rest[pairs % n] >= 1 - 1e-9]
        found = set((open_pairs // n).tolist())
        if (self.rest >= 1 - 1e-9).any():  # an item of frequent words only
            found.update(range(windows))
        return sorted(found)

    def hits(self, tokens: list[bytes]) -> tuple[int, list[dict]]:
        """Number of passages, and the leaked items with their best passage's score."""
        windows = max(1, -(-(len(tokens) - STEP) // STEP)) if tokens else 0
        best: dict[int, dict] = {}
        if not windows or not self.ids:
            return windows, []
        terms = self.term_ids(tokens)
        for w in self.possible_windows(terms, windows):
            start = w * STEP
            query = set(terms[start : start + WINDOW].tolist()) - {len(self.terms)}
            for i, score in block_max_wand([self.lists[t] for t in query]):
                reach = max(WINDOW, len(self.tokens[i]))
                near = tokens[max(0, start - reach) : start + WINDOW + reach]
                question, answer = (found_share(p, near) for p in self.parts[i])
                if question >= OVERLAP and answer >= OVERLAP:
                    hit = {"item_id": self.ids[i], "score": score * SCORE_SHARE, "question": question, "answer": answer}
                    if i not in best or (hit["score"], question, answer) > tuple(best[i][k] for k in ("score", "question", "answer")):
                        best[i] = hit
        return windows, [best[i] for i in sorted(best)]


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches):
        each = [words(t) for t in chunk.column("text").to_pylist()]
        sizes, terms = pa.array([len(w) for w in each], pa.int64()), pa.array([list(set(w)) for w in each], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([*chunk.columns, sizes, terms], [*chunk.schema.names, "n_words", "terms"])


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Writes indexes of about ``INDEX_BYTES`` of items each below the shared folder and returns
    their paths. Repeats of an item count once; items with a null id or no word are left out."""
    rows = id_text(items, id_col, text_col).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).distinct()
    cut = rows.mapInArrow(_words_of, "doc_id long, text string, n_words long, terms array<binary>").where("n_words > 0")
    cut = stage(cut, "leak-items")
    size = F.sum(F.octet_length("text").cast("long") + 64)
    total, mean, n_bytes = cut.agg(F.count("*"), F.avg("n_words"), size).first()
    if not total:
        return []
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-n_bytes // INDEX_BYTES))).alias("part")
    words_in = cut.select(part, F.explode("terms").alias("term"))
    frequencies = words_in.groupBy("part", "term").agg(F.count("*").alias("n"))
    over_all = frequencies.groupBy("term").agg(F.sum("n").alias("df"))
    known = frequencies.select("part", "term").join(over_all, "term").select("part", "term", "df")
    folder = new_folder(items.sparkSession, "leak-indexes")

    def build(of_part: pa.Table, terms: pa.Table) -> pa.Table:
        pairs = zip(of_part.column("doc_id").to_pylist(), of_part.column("text").to_pylist(), strict=True)
        df = dict(zip(terms.column("term").to_pylist(), terms.column("df").to_pylist(), strict=True))
        name, (fs, root) = uuid.uuid4().hex, _place(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}.index") as f:
            f.write(cloudpickle.dumps(ItemIndex(list(pairs), df, total, mean)))
        return pa.table({"part": of_part.column("part").slice(0, 1), "name": [name]})

    by_part = cut.select(part, "doc_id", "text").groupBy("part").cogroup(known.groupBy("part"))
    written = by_part.applyInArrow(build, "part long, name string").collect()  # one short row per index
    return [f"{folder}/{r.name}.index" for r in sorted(written, key=lambda r: r.part)]


def _index(path: str) -> ItemIndex:
    fs, where = _place(path)
    with fs.open_input_file(where) as f:
        return pickle.loads(f.read())


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, passages (their number), hits (array of item_id, score as a
    share of the item's own score, question and answer overlap, by item_id), and the columns of
    ``docs`` named in ``keep``.

    Null, empty and wordless texts have no passage and no hit, as have all without any item.
    Rows that share an id, and rows with a null id, keep a row each. Equal items with different
    ids are all reported.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep if c != text_col], F.lit(0).alias("_")).alias("kept")
    key, text = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    found = docs.select(key, text, kept)
    schema = _PASS.format(kept=found.schema["kept"].dataType.simpleString())
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    paths = indexes(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, index = text_chunks(batches), None
        while group := list(islice(chunks, GROUP_CHUNKS if len(paths) > 1 else 1)):
            passages, hits = [[0] * c.num_rows for c in group], [[[] for _ in range(c.num_rows)] for c in group]
            for path in paths:
                index = index if index and len(paths) == 1 else _index(path)
                for k, chunk in enumerate(group):
                    each = [index.hits(words(t)) for t in chunk.column("text").to_pylist()]
                    passages[k] = [n for n, _ in each]
                    hits[k] = [[*old, *new] for old, (_, new) in zip(hits[k], each, strict=True)]
            for chunk, n, found in zip(group, passages, hits, strict=True):
                columns = [chunk.column(c) for c in ("doc_id", "text", "kept")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n, pa.int64()), pa.array(found, kind)], ["doc_id", "text", "kept", "passages", "hits"]
                )

    found = found.mapInArrow(run, schema)
    passed = [F.col("text" if c == text_col else f"kept.`{c}`").alias(c) for c in keep]
    return found.select("doc_id", "passages", F.array_sort("hits").alias("hits"), *passed)
