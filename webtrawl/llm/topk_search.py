"""Exact top-k search by inner product over a bit-sliced index.

The rows are cut into blocks of bounded size. A block keeps each quantised attribute as bit
slices: slice *b* of attribute *d* is a bitmap over the block's rows with bit *b* of the
attribute. For a query, the slices are added as bitmaps (carry-save adders over whole
bitmaps), which gives the slices of all scores of the block. The best rows are then selected
from the most significant score slice downward: rows that have the bit stay while they are
more than k, else they are safe and the search goes on among the others. Rows that tie at the
boundary are told apart exactly, by score and vec_id.

Every pair of a query block and a row block is one row of an equality join on the two block
numbers, so both sides are bounded and no side is broadcast. Each pair returns at most k rows
per query, and a ranking per query merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
ROWS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 512
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1

_BLOCK = "block int, ids binary, dim int, matrix binary, lows binary, width int, slices binary"
_HITS = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """One row per vector; vectors shorter than the longest end in zeros."""
    dim = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), dim), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps in 64-bit words from rows of booleans."""
    spare = -bits.shape[-1] % 64
    padded = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, spare)])
    return np.ascontiguousarray(np.packbits(padded, axis=-1, bitorder="little")).view(np.uint64)


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[0]


def _build_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    matrix = _matrix(rows["vector"])
    lows = matrix.min(axis=0) if matrix.size else np.zeros(matrix.shape[1], np.int64)
    spans = [int(h) - int(low) for h, low in zip(matrix.max(axis=0), lows, strict=True)]
    width = max((s.bit_length() for s in spans), default=0)
    above = matrix.view(np.uint64) - lows.view(np.uint64)  # modulo 2**64, so any span fits
    slices = [_packed((above >> np.uint64(b)).T & np.uint64(1) == 1) for b in range(width)]
    stacked = np.stack(slices, axis=1) if slices else np.zeros((matrix.shape[1], 0, 0), np.uint64)
    return pd.DataFrame(
        {
            "block": [key[0]],
            "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
            "dim": [matrix.shape[1]],
            "matrix": [matrix.tobytes()],
            "lows": [lows.tobytes()],
            "width": [width],
            "slices": [stacked.tobytes()],
        }
    )


def _build_queries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    matrix = _matrix(rows["vector"])
    ids = rows["vec_id"].to_numpy(np.int64).tobytes()
    return pd.DataFrame(
        {"q_block": [key[0]], "q_ids": [ids], "q_dim": [matrix.shape[1]], "q_matrix": [matrix.tobytes()]}
    )


def _add(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Slices of the sum of all bitmaps, those under key p counting 2**p each."""
    out, p = [], 0
    while p <= max(columns, default=-1):
        stack = columns.pop(p, [])
        rows = np.concatenate(stack) if stack else np.zeros((0, words), np.uint64)
        carries = columns.setdefault(p + 1, [])
        while len(rows) > 2:
            full = len(rows) // 3 * 3
            a, b, c = rows[0:full:3], rows[1:full:3], rows[2:full:3]
            both = a ^ b
            carries.append((a & b) | (both & c))
            rows = np.concatenate([both ^ c, rows[full:]])
        if len(rows) == 2:
            carries.append((rows[0] & rows[1])[None])
            rows = (rows[0] ^ rows[1])[None]
        out.append(rows[0] if len(rows) else np.zeros(words, np.uint64))
        if not carries:
            del columns[p + 1]
        p += 1
    return out


class _Block:
    def __init__(self, row) -> None:
        self.ids = np.frombuffer(row.ids, np.int64)
        self.dim, self.width = row.dim, row.width
        self.matrix = np.frombuffer(row.matrix, np.int64).reshape(len(self.ids), self.dim)
        self.lows = np.frombuffer(row.lows, np.int64)
        self.words = -(-len(self.ids) // 64)
        plain = np.frombuffer(row.slices, np.uint64).reshape(self.dim * self.width, self.words)
        self.slices = np.concatenate([plain, ~plain])
        self.valid = _packed(np.ones((1, len(self.ids)), bool))[0]
        self.most = [max(abs(int(a)), abs(int(b))) for a, b in zip(self.matrix.max(0), self.matrix.min(0), strict=True)]

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of every row's score above the block's least possible score. A negative
        factor takes the complemented slices, so that all terms are added."""
        columns: dict[int, list[np.ndarray]] = {}
        size, side = np.abs(query), np.where(query < 0, self.dim * self.width, 0)
        for j in range(int(size.max(initial=0)).bit_length()):
            rows = np.nonzero(size >> j & 1)[0]
            if len(rows):
                for b in range(self.width):
                    columns.setdefault(b + j, []).append(self.slices[side[rows] + rows * self.width + b])
        return _add(columns, self.words)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        query = np.pad(query[: self.dim], (0, max(0, self.dim - len(query))))
        open_rows = self.valid.copy()
        own = np.nonzero(self.ids == query_id)[0]
        if len(own):
            open_rows &= ~_packed(np.isin(np.arange(len(self.ids)), own)[None])[0]
        if sum(abs(int(q)) * m for q, m in zip(query, self.most, strict=True)) >= 2**62:
            return self._best_of_long_numbers(_positions(open_rows), query, k)
        safe, n_safe = np.zeros_like(open_rows), 0
        for bitmap in reversed(self.score_slices(query)):
            having = open_rows & bitmap
            n = n_safe + int(np.bitwise_count(having).sum())
            if n > k:
                open_rows = having
            else:
                safe, n_safe, open_rows = safe | having, n, open_rows & ~bitmap
                if n == k:
                    break
        rows = _positions(safe)
        if n_safe < k:  # what is open ties in every slice
            ties = _positions(open_rows)
            ties = ties[np.lexsort((ties, self.ids[ties]))][: k - n_safe]
            rows = np.concatenate([rows, ties])
        return rows, (self.matrix[rows] @ query).tolist()

    def _best_of_long_numbers(self, rows: np.ndarray, query: np.ndarray, k: int):
        exact = [sum(int(a) * int(b) for a, b in zip(self.matrix[r], query, strict=True)) for r in rows]
        scores = [min(max(x, LONG_MIN), LONG_MAX) for x in exact]
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        return rows[order], [scores[i] for i in order]


def _searcher(k: int):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block = _Block(row)
                ids = np.frombuffer(row.q_ids, np.int64)
                queries = np.frombuffer(row.q_matrix, np.int64).reshape(len(ids), row.q_dim)
                for query_id, query in zip(ids, queries, strict=True):
                    rows, scores = block.best(int(query_id), query, k)
                    yield pd.DataFrame({"query_id": int(query_id), "vec_id": block.ids[rows], "score": scores}).astype("int64")

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product for each row of ``queries``.

    Components are first turned into floor(scale * x), as double and then long. Returns
    query_id, rank (from 1), vec_id, score.

    * Null vectors, vectors with a null or non-finite component and rows without an id take no
      part, neither as query nor as candidate. An empty vector scores 0 with every other.
    * Ties go to the smaller vec_id. A row never finds rows of its own id.
    * Exact repeats of a row count once. Rows that share an id but not the vector stay separate.
    * Vectors of different lengths: the missing components count as 0.
    * Numbers beyond 64 bits saturate. Empty inputs give an empty result.
    """

    def prepared(df: DataFrame) -> DataFrame:
        df = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
        kept = df.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
        return kept.select("vec_id", quantised(F.col("v"), scale).alias("vector")).distinct()

    def blocks_of(df: DataFrame, rows: int) -> int:
        return max(1, -(-df.count() // rows))

    place = F.xxhash64("vec_id", "vector")
    rows, wanted = prepared(vectors), prepared(queries)
    n_rows, n_queries = blocks_of(vectors, ROWS_PER_BLOCK), blocks_of(queries, QUERIES_PER_BLOCK)
    index = (
        rows.withColumn("block", F.pmod(place, F.lit(n_rows)).cast("int"))
        .groupBy("block")
        .applyInPandas(_build_block, _BLOCK)
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    )
    packed_queries = (
        wanted.withColumn("q_block", F.pmod(place, F.lit(n_queries)).cast("int"))
        .groupBy("q_block")
        .applyInPandas(_build_queries, "q_block int, q_ids binary, q_dim int, q_matrix binary")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    )
    hits = index.join(packed_queries, ["q_block", "block"]).mapInPandas(_searcher(k), _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
