"""Vector codes by product quantisation, with codebooks learned by Ball k-means.

Every vector is cut into parts, and each part position has a codebook of integer entries. All
distances are exact integers. An entry's ball reaches from the entry to its farthest part. Only
entries whose centres lie within twice that radius are neighbours, no other entry can be
nearest to a part of the ball. Half the way to the closest neighbour bounds the stable core:
parts in it keep their entry without a further distance. Outside it the neighbours, in order of
their distance, cut the ball into rings, and a part is compared with the neighbours of the rings
up to its own only, those within twice its distance from its entry.

Rows are packed once into blocks of bounded size. A round reads the blocks, assigns their parts
and writes them with the new codes and the sums of each entry's parts; Spark adds the sums. The
driver holds the codebooks, one sum per entry, and the first vectors, all of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.topk_search import usable
from webtrawl.plans.staging import stage

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of one packed block.
BLOCK_ROWS = 32_768
#: Components beyond this are taken as this, so that no squared distance leaves 64 bits.
LARGEST = 2**24
#: Distances a task holds at once.
PAIRS_AT_ONCE = 1 << 21
#: Ring numbers at which the parts of a ball are told apart.
RING_STEPS = (8, 32, 128)

_PACKED = "ids array<long>, labels array<string>, dim int, matrix binary"
_CODED = f"{_PACKED}, codes binary, sums array<struct<part int, entry int, n long, reach long, total array<long>>>"
_SUMS = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("reach", pa.int64()), ("total", pa.list_(pa.int64()))]))
_ROWS = "vec_id long, label string, code string, error long"


def quantised(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def _packer(scale: int, block_rows: int):
    def packed(ids: list, labels: list, lengths: list, values: list) -> pa.RecordBatch:
        size, flat = np.concatenate(lengths), np.concatenate(values)
        matrix = np.zeros((len(size), int(size.max(initial=0))), np.int32)
        starts = np.cumsum(size) - size
        column = np.arange(len(flat)) - np.repeat(starts, size)
        matrix[np.repeat(np.arange(len(size)), size), column] = flat
        if np.abs(flat).max(initial=0) < 2**15:
            matrix = matrix.astype(np.int16)
        row = [[sum(ids, [])], [sum(labels, [])], [matrix.shape[1]], [matrix.tobytes()]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["ids", "labels", "dim", "matrix"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = ([], [], [], []), 0
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                batch = whole.slice(at, block_rows)
                if rows and rows + batch.num_rows > block_rows:
                    yield packed(*held)
                    held, rows = ([], [], [], []), 0
                vectors = batch.column("vector")
                held[0].append(batch.column("vec_id").to_pylist())
                held[1].append(batch.column("label").to_pylist())
                held[2].append(vectors.value_lengths().to_numpy(zero_copy_only=False))
                held[3].append(quantised(vectors.flatten().to_numpy(zero_copy_only=False), scale))
                rows += batch.num_rows
        if rows:
            yield packed(*held)

    return pack


def square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``. Products of numbers whose
    sums stay below 2**53 are left to floating point, which is exact there."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * largest**2 * x.shape[1] < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        return d.astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        gap = x[:, j, None] - c[None, :, j]
        out += gap * gap
    return out


class Balls:
    """One codebook with its entries' neighbours. ``reach`` bounds each ball's radius."""

    def __init__(self, entries: np.ndarray, reach: np.ndarray | None) -> None:
        self.entries = entries
        if reach is None:
            return
        between = square_distances(entries, entries)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        near = np.argsort(between, axis=1, kind="stable")[:, :-1]
        self.rings = np.take_along_axis(between, near, axis=1)
        within = (self.rings <= 4 * reach[:, None] ** 2 * (1 + 1e-9) + 1).sum(1)
        self.neighbours = [row[:n] for row, n in zip(near, within, strict=True)]

    def nearest_of_all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, squares = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        step = max(1, PAIRS_AT_ONCE // len(self.entries))
        for at in range(0, len(x), step):
            d = square_distances(x[at : at + step], self.entries)
            codes[at : at + step] = d.argmin(1)  # the first of several
            squares[at : at + step] = d.min(1)
        return codes, squares

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part and its squared distance, from the entry it had."""
        codes = before.astype(np.int64)
        gap = x - self.entries[codes]
        squares = (gap * gap).sum(1)
        order = np.argsort(codes, kind="stable")
        owners, starts = np.unique(codes[order], return_index=True)
        for owner, members in zip(owners, np.split(order, starts[1:]), strict=True):
            around = self.neighbours[owner]
            ring = np.searchsorted(self.rings[owner, : len(around)], 4 * squares[members], side="right")
            low = 0
            for high in (*RING_STEPS, len(around)):
                part = members[(ring > low) & (ring <= high)]  # ring 0 is the stable core
                candidates = np.sort(np.append(around[:high], owner))
                low = max(low, high)
                step = max(1, PAIRS_AT_ONCE // len(candidates))
                for at in range(0, len(part), step):
                    rows = part[at : at + step]
                    d = square_distances(x[rows], self.entries[candidates])
                    codes[rows], squares[rows] = candidates[d.argmin(1)], d.min(1)
        return codes, squares


def _assigner(codebooks: np.ndarray, reach: np.ndarray | None, final: bool):
    """For each block the codes of its parts; ``final`` returns the rows, else the block with its
    entries' sums."""
    n_parts, _, width = codebooks.shape

    def coded(block: pa.RecordBatch, balls: list[Balls]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, dim, stored = len(block.column("ids").flatten()), block.column("dim")[0].as_py(), block.column("matrix")[0].as_buffer()
        matrix = np.zeros((n, n_parts * width), np.int64)
        kind = np.int16 if stored.size == 2 * n * dim else np.int32
        matrix[:, :dim] = np.frombuffer(stored, kind).reshape(n, dim)
        before = np.frombuffer(block.column("codes")[0].as_buffer(), np.uint16).reshape(n_parts, n) if reach is not None else None
        codes, squares = np.zeros((n_parts, n), np.int64), np.zeros((n_parts, n), np.int64)
        for p, ball in enumerate(balls):
            x = matrix[:, p * width : (p + 1) * width]
            codes[p], squares[p] = ball.nearest_of_all(x) if before is None else ball.nearest(x, before[p])
        return matrix, codes, squares

    def sums(matrix: np.ndarray, codes: np.ndarray, squares: np.ndarray) -> list[dict]:
        out = []
        for p in range(n_parts):
            order = np.argsort(codes[p], kind="stable")
            entries, starts, counts = np.unique(codes[p][order], return_index=True, return_counts=True)
            total = np.add.reduceat(matrix[order, p * width : (p + 1) * width], starts, axis=0)
            far = np.maximum.reduceat(squares[p][order], starts)
            out += [
                {"part": p, "entry": int(e), "n": int(n), "reach": int(r), "total": t}
                for e, n, r, t in zip(entries, counts, far, total.tolist(), strict=True)
            ]
        return out

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(codebooks[p], None if reach is None else reach[p]) for p in range(n_parts)]
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.slice(at, 1)
                matrix, codes, squares = coded(block, balls)
                if final:
                    hexes = pa.array(["".join(f"{e:02x}" for e in row) for row in codes.T.tolist()], pa.string())
                    columns = [block.column("ids").flatten(), block.column("labels").flatten(), hexes, pa.array(squares.sum(0))]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])
                    continue
                kept = ["ids", "labels", "dim", "matrix"]
                made = [pa.array([codes.astype(np.uint16).tobytes()], pa.binary()), pa.array([sums(matrix, codes, squares)], _SUMS)]
                yield pa.RecordBatch.from_arrays([*map(block.column, kept), *made], [*kept, "codes", "sums"])

    return assign


def _moved(codebooks: np.ndarray, coded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The entries after a round, floor(sum / count) of their parts, and a bound of each ball's
    radius around its new entry: the old radius and the way the entry has moved."""
    width = codebooks.shape[2]
    added = coded.select(F.explode("sums").alias("s")).groupBy("s.part", "s.entry").agg(
        F.sum("s.n").alias("n"), F.max("s.reach").alias("reach"), F.array(*[F.sum(F.col("s.total")[j]) for j in range(width)]).alias("total")
    )
    new, reach = codebooks.copy(), np.zeros(codebooks.shape[:2])
    for row in added.collect():  # one row per entry
        new[row.part, row.entry] = [t // row.n for t in row.total]
        way = (new[row.part, row.entry] - codebooks[row.part, row.entry]).astype(np.float64)
        reach[row.part, row.entry] = (np.sqrt(float(row.reach)) + np.sqrt((way * way).sum())) * (1 + 1e-9)
    return new, reach


def encode_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per usable vector: vec_id, code (two hex digits a part), error (squared distances to
    its entries), label_error (errors added over the rows of the same label), codebooks_sha256.

    Components become floor(scale * x). Each codebook starts as the parts of the vectors with the
    smallest ids; in each round all parts are assigned and the entries move, and in the end all
    parts are assigned once more. Ties go to the entry of the lower index.

    * Null vectors and vectors with a null or non-finite component take no part. Rows without an
      id or a label do, with null in its place; null ids come after all others.
    * Of rows with one id, all take part, in the order of their vectors. Repeated rows stay.
    * Vectors shorter than the longest, or than a multiple of ``parts``, end in zeros; empty
      vectors have distance 0 from entry 0.
    * Components beyond 2**24 after scaling are taken as 2**24, of either sign.
    * With fewer vectors than ``entries`` the codebooks are that much smaller. Empty tables give
      an empty result. Other columns are not looked at.
    """
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    ).where(usable(F.col("vector")))
    packed = stage(rows.mapInArrow(_packer(scale, block_rows), _PACKED), "vector-blocks")
    dim = packed.agg(F.max("dim")).first()[0]
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = -(-dim // parts)
    first = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    seeds = np.zeros((len(first), parts * width), np.int64)
    for at, row in enumerate(first):
        seeds[at, : len(row.vector)] = quantised(np.array(row.vector, np.float64), scale)
    codebooks = np.ascontiguousarray(seeds.reshape(len(first), parts, width).transpose(1, 0, 2))
    blocks, reach = packed, None
    for n in range(rounds):
        blocks = stage(blocks.mapInArrow(_assigner(codebooks, reach, False), _CODED), f"vector-round-{n}")
        codebooks, reach = _moved(codebooks, blocks)
    found = stage(blocks.mapInArrow(_assigner(codebooks, reach, True), _ROWS), "vector-codes")
    errors = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    return found.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
