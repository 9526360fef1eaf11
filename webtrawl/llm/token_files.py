"""Token ids in flat binary files, and reading them back through memory maps.

Format: a folder with shards. A shard is a file of unsigned integers (16 bits where the
vocabulary and the end id fit, else 32; little-endian), a file of unsigned 64-bit offsets (one
more than it has documents, counted in ids from the shard's start) and a file of the 64-bit
document ids. ``shards`` lists them in order with the number of documents and ids before each:
the prefix sums of the counts, so a document's place in the whole corpus is its shard's base
plus its offset.

The documents are range-partitioned and sorted by id, so that shard order is document order.
A task writes under names of its own attempt and reports them; only what Spark has accepted
gets into the list, so a repeated or speculative attempt leaves no trace in the result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from webtrawl.llm.common import id_text, kept_in_worker, text_chunks

#: Words a worker keeps the ids of (about 200 bytes each), and the longest word kept.
CACHE_WORDS, CACHED_BYTES = 1_200_000, 40
#: Words that are encoded as one text, and texts that are encoded in one call.
WORDS_AT_ONCE, TEXTS_AT_ONCE = 500, 16
#: Bytes of text that are cut into words together.
TEXT_BYTES = 2 << 20
#: A word of Latin letters, which normalisation leaves letters, and ASCII signs after them.
LETTERS_THEN_SIGNS = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-/:-@[-`{-~]+)")

_SHARD = "part int, docs long, ids long, name string"
SHARDS = "shard int, docs long, ids long, first_doc long, first_id long, path string, dtype string"


class WordEncoder:
    """Encodes whole texts with the tokenizers library, one call for all words not met before.

    The vocabulary drops white space before it forms tokens, so a text's ids are those of its
    words in turn; the words are cut only at ASCII white space, which no rule of the
    vocabulary looks across. Where the vocabulary marks the last token of a piece and takes
    letters and the signs after them as two pieces, a word like ``end."`` is put together from both.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, bytes] = {}
        # A sign of one id to stand between words that are encoded in one text.
        ids = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in "|~^§¤"}
        self.sign = next(((c, i[0]) for c, i in ids.items() if len(i) == 1), None)
        self.closes = self._closing()

    def _closing(self) -> np.ndarray | None:
        """Of each id whether its token ends a piece; None where that or the cut between letters and
        signs can't be told from the vocabulary."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        pieces = self.tokenizer.pre_tokenizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # an added token stands in no word of letters and signs if a letter follows a sign in it
        apart = all(re.search(r"[\W\d_][^\W\d_]", c) and not re.search(r"\s", c) for c in added)
        if not suffix or not apart or pieces is None or [p for p, _ in pieces.pre_tokenize_str('ab.")')] != ["ab", '.")']:
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        closes = np.zeros(max(vocabulary.values()) + 1, bool)
        closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return closes

    def _together(self, words: list[str], between: str, dtype: np.dtype) -> Iterator[tuple[list[str], np.ndarray]]:
        """Groups of words and the ids of each group's text; a few texts are with the library at a time,
        as what it returns takes much more room than the ids."""
        groups = [words[at : at + WORDS_AT_ONCE] for at in range(0, len(words), WORDS_AT_ONCE)]
        for at in range(0, len(groups), TEXTS_AT_ONCE):
            few = groups[at : at + TEXTS_AT_ONCE]
            found = self.tokenizer.encode_batch_fast([between.join(g) for g in few], add_special_tokens=False)
            for group, encoding in zip(few, found, strict=True):
                yield group, np.array(encoding.ids, dtype)

    def _encoded(self, words: list[str], dtype: np.dtype) -> Iterator[tuple[str, bytes]]:
        """Ids of words. Hundreds of them go to the library as one text, which takes half the time.
        Words of letters, mostly one piece, need nothing between them; the others get a sign there, and
        words that hold that sign are encoded alone."""
        letters = [w for w in words if w.isalpha()] if self.closes is not None else []
        rest = [w for w in words if not w.isalpha()] if letters else list(words)
        for group, ids in self._together(letters, " ", dtype):
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) != len(group):  # some word has more than one piece
                rest += group
                continue
            raw, size = ids.tobytes(), ids.itemsize
            for word, start, end in zip(group, [0, *ends], ends):
                yield word, raw[start * size : end * size]
        alone, joined = rest, []
        if self.sign is not None:
            alone = [w for w in rest if self.sign[0] in w]
            joined = [w for w in rest if self.sign[0] not in w]
            for group, ids in self._together(joined, f" {self.sign[0]} ", dtype):
                cuts = np.flatnonzero(ids == self.sign[1]).tolist()
                if len(cuts) != len(group) - 1:  # some other sign has the same id
                    alone += group
                    continue
                raw, size = ids.tobytes(), ids.itemsize
                for word, start, end in zip(group, [-1, *cuts], [*cuts, len(ids)], strict=True):
                    yield word, raw[(start + 1) * size : end * size]
        encoded = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        for word, found in zip(alone, encoded, strict=True):
            yield word, np.array(found.ids, dtype).tobytes()

    def _new(self, words: list[str], dtype: np.dtype) -> dict[str, bytes]:
        """Ids of words that are not in the cache, and of the parts some of them are made of."""
        two = {w: m.groups() for w in words if (m := LETTERS_THEN_SIGNS.fullmatch(w))} if self.closes is not None else {}
        parts = {p for pair in two.values() for p in pair}
        whole = dict.fromkeys(w for w in words if w not in two) | dict.fromkeys(p for p in parts if p not in self.cache)
        new = dict(self._encoded(list(whole), dtype))
        for word, pair in two.items():
            new[word] = b"".join([new[p] if p in new else self.cache[p] for p in pair])
        return new

    def __call__(self, texts: pa.Array, dtype: np.dtype, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's closed by the end id, and how many each text has. The
        texts' words are numbered as one array; only different words are looked up."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = self._new([w for w in words if w not in self.cache], dtype)
        found = [new[w] if w in new else self.cache[w] for w in words]
        self.cache.update((w, ids) for w, ids in new.items() if len(w) <= CACHED_BYTES)
        pool = pa.array([*found, np.array([end_id], dtype).tobytes()], pa.large_binary())
        ends = cut.offsets.to_numpy()[1:].astype(np.int64)
        flow = pool.take(pa.array(np.insert(coded.indices.to_numpy(), ends, len(words))))
        _, offsets, data = flow.buffers()
        after = np.frombuffer(offsets, np.int64, len(flow) + 1)[ends + np.arange(1, len(ends) + 1)] // dtype.itemsize
        return np.frombuffer(data, dtype, int(after[-1])), np.diff(after, prepend=0)


def _encoder(path: str) -> WordEncoder:
    return kept_in_worker(f"words {path}", lambda: WordEncoder(path))


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def _id_type(vocabulary: str, end_id: int) -> str:
    largest = max(end_id, Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) - 1)
    return "<u2" if largest < 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, write the files below ``folder`` (which all executors share), and
    return the list of shards. Runs when called.

    A null text counts as empty: only the end id. Rows with equal ids stay, in any order among
    themselves; null ids come first and read back as null. No documents give no shards. Other
    columns are left.
    """
    dtype = _id_type(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        encode, (fs, root) = _encoder(vocabulary), _place(folder)
        sizes, keys, n_ids, flat = [0], [], 0, None
        for chunk in text_chunks(batches, limit=TEXT_BYTES):
            if flat is None:
                fs.create_dir(root, recursive=True)
                flat = fs.open_output_stream(f"{root}/{name}.ids")
            ids, counts = encode(chunk.column("text"), np.dtype(dtype), end_id)
            flat.write(ids.tobytes())
            sizes += (n_ids + np.cumsum(counts)).tolist()
            n_ids += len(ids)
            keys += chunk.column("doc_id").to_pylist()
        if flat is None:
            return
        flat.close()
        with fs.open_output_stream(f"{root}/{name}.offsets") as f:
            f.write(np.array(sizes, "<u8").tobytes())
        with fs.open_output_stream(f"{root}/{name}.docs") as f:
            f.write(np.array([k or 0 for k in keys], "<i8").tobytes())
            f.write(np.array([k is None for k in keys], bool).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([name])],
            ["part", "docs", "ids", "name"],
        )

    ordered = id_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    written = ordered.mapInArrow(run, _SHARD).collect()  # one short row per shard
    shards, first_doc, first_id = [], 0, 0
    for i, row in enumerate(sorted(written, key=lambda r: r.part)):
        shards.append((i, row.docs, row.ids, first_doc, first_id, f"{folder}/{row.name}", dtype))
        first_doc, first_id = first_doc + row.docs, first_id + row.ids
    return docs.sparkSession.createDataFrame(shards, SHARDS)


def _mapped(path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is a file system's, else read."""
    fs, where = _place(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(where, dtype, "r") if fs.get_file_info(where).size else np.zeros(0, dtype)
    with fs.open_input_file(where) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, shards: DataFrame, docs_per_batch: int = 500) -> DataFrame:
    """The documents of the listed shards: doc_id, start (ids of all documents before it),
    n_tokens, ids (little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                n = shard["docs"]
                ids = _mapped(shard["path"] + ".ids", shard["dtype"])
                offsets = _mapped(shard["path"] + ".offsets", "<u8").astype(np.int64)
                raw = _mapped(shard["path"] + ".docs", "u1")
                keys, null = raw[: 8 * n].view("<i8"), raw[8 * n :].astype(bool)
                for a in range(0, n, docs_per_batch):
                    b = min(n, a + docs_per_batch)
                    parts = [ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[a:b].astype(np.int64), mask=null[a:b]),
                            pa.array(offsets[a:b] + shard["first_id"]),
                            pa.array(np.diff(offsets[a : b + 1])),
                            pa.array(parts, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    spread = shards.repartition(max(1, shards.count()))  # a number that adaptive execution keeps
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
