"""Near-duplicate groups from SetSketch registers of word shingles.

A register is the minimum of exponentially distributed hashes of a set's shingles, kept only as
the truncated exponent of its place on a geometric scale. Registers of a union are the maxima of
the registers, and two sets agree in a register about as often as their similarity. Register
values are banded: sets that agree in a whole band meet in a bucket.

1. Documents with the same shingle set are one node, their smallest id.
2. In each bucket of the first bands every node meets the bucket's smallest node, and keeps of
   these partners the one it shares most buckets with. A joint likelihood of the two register
   rows estimates the similarity; pairs clearly below the threshold go, the others are verified
   on full shingle sets. The links' components are formed.
3. Buckets of all bands that hold nodes of several components stay open. As long as that finds
   many links, one node of each component meets one of the bucket's largest component, in every other
   round the one that meets most nodes in all its buckets: the centre, where a family has one. So a
   large group becomes one component by a few links for each node.
4. The nodes in buckets that are open still meet by their rare shingles. Shingles are put in one order
   for all sets, first those that only one component holds, then by how many sets hold them. Two sets
   are not similar enough if too few shingles follow in either set on the first they share, so a set
   is found by its first shingles, and by each only where enough follow. No link is lost that could
   join two components, pairs inside a component are never made, and a set with enough shingles of
   its own makes no pair, however many sets share the others with it.
5. The components of all links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import among, chained, id_text, text_chunks, word_hashes, words
from webtrawl.llm.components import components
from webtrawl.plans.staging import stage

SHINGLE, PERCENT = 5, 80
#: Two sets of similarity 0.8 miss each other in all bands once in more than ten million times.
BANDS, ROWS = 40, 5
#: Bands whose buckets all nodes look at first.
FIRST_BANDS = 4
REGISTERS = BANDS * ROWS
#: The geometric scale of the registers: ratio, rate of the hashes, largest value. Unlike sets of
#: one size agree in a register with a chance of about a quarter of the ratio's excess over 1, by
#: mere rounding, and in a band with its fifth power: three in 10^12 for this ratio. So the pairs
#: that meet by chance stay fewer than the sets up to billions of sets.
BASE, RATE, TOP = 1.02, 20.0, 65_534
#: Rounds of step 3 go on while one pair in so many is a link; step 4 finds what they leave.
WORTHWHILE = 50
#: Ratio of the classes of set sizes in which sets meet by a shingle.
SIZE_CLASS = 1.05
#: Pairs estimated lower than this are not verified: about five standard errors below 0.8, which
#: is as rare as missing each other in all bands.
LEAST_ESTIMATE = 0.66
#: Shingles hashed at once.
_SLICE = 1024
_REGISTER = np.dtype("<u2")
_BAND_BYTES = ROWS * _REGISTER.itemsize


def _constants() -> tuple[np.ndarray, np.ndarray]:
    flips = np.array([xxhash.xxh32_intdigest(b"flip", i) for i in range(REGISTERS)], np.uint32)
    odd = np.array([xxhash.xxh32_intdigest(b"odd", i) | 1 for i in range(REGISTERS)], np.uint32)
    return flips[:, None], odd[:, None]


def shingle_set(tokens: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit keys of the word n-grams; of fewer words the whole sequence."""
    if not tokens:
        return np.zeros(0, np.uint64)
    each, size = word_hashes(tokens), min(n, len(tokens))
    keys = each[: len(each) - size + 1].copy()
    for k in range(1, size):
        keys = chained(keys, each[k : len(each) - size + 1 + k])
    return np.unique(keys)


def registers(shingles: np.ndarray, constants: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Two bytes per register, from 32 bits of each key under one bijection a register."""
    flips, odd = constants
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(short), _SLICE):
        part = short[None, start : start + _SLICE] ^ flips
        part *= odd
        np.minimum(least, part.min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(float) + 0.5) * 2.0**-32) / RATE
    return np.clip(1 + np.floor(-np.log(exponential) / np.log(BASE)), 0, TOP).astype(_REGISTER)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (size of the shingle set), set_id (its 128-bit key), registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants = _constants()
        for chunk in text_chunks(batches):
            sizes, keys, rows = [], [], []
            for text in chunk.column("text").to_pylist():
                found = shingle_set(words(text), shingle)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                rows.append(registers(found, constants).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())],
                ["doc_id", "n", "set_id", "registers"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, set_id binary, registers binary")


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sets from their register rows and sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * most
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = chance(u - v * grid), chance(v - u * grid)
    safe = lambda p: np.log(np.maximum(p, 1e-12))
    same = a.shape[1] - more - less
    likelihood = more * safe(up) + less * safe(down) + same * safe(1 - up - down)
    return np.take_along_axis(grid, likelihood.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sides(pairs: DataFrame) -> DataFrame:
    """The ids in (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def likely_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate leaves the threshold open."""
    asked = among(nodes, "node", _sides(pairs))
    side = lambda x: asked.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return _estimated(rows.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")))


def _estimated(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``rows``, with sizes n_ and register rows r_, that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), _REGISTER).reshape(-1, REGISTERS)  # noqa: B023, E731
            size = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            kept = likely_similarity(row("r_a"), row("r_b"), size("n_a"), size("n_b")) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    return rows.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets are similar enough."""
    texts = among(docs, "doc_id", _sides(pairs))
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None, None
        for chunk in text_chunks(batches, "t_a"):
            kept = []
            for t_a, t_b in zip(chunk.column("t_a").to_pylist(), chunk.column("t_b").to_pylist(), strict=True):
                if last[0] != t_b:
                    last = t_b, shingle_set(words(t_b), shingle)
                x, y = shingle_set(words(t_a), shingle), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield chunk.select(["a", "b"]).filter(pa.array(kept))

    return rows.mapInArrow(run, "a long, b long")


def _bands(count: int = BANDS) -> Column:
    """The keys of the first ``count`` buckets of a register row."""
    return F.array(*[F.xxhash64(F.lit(j), F.substring("registers", j * _BAND_BYTES + 1, _BAND_BYTES)) for j in range(count)])


def _closest(pairs: DataFrame) -> DataFrame:
    """Of the partners b of each a the one that comes up most often; of these the smallest."""
    often = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    return often.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))


def _first_pairs(nodes: DataFrame) -> DataFrame:
    members = nodes.select("node", F.explode(_bands(FIRST_BANDS)).alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high").drop("high")
    return _closest(members.join(pivots, "bucket").where("node <> b").select(F.col("node").alias("a"), "b"))


def _placed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` with g, the component of their node."""
    known = groups.select("node", F.col("component").alias("g"))
    return members.join(known, "node", "left").withColumn("g", F.coalesce("g", "node"))


def _still_open(placed: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components."""
    split = placed.groupBy("bucket").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high")
    return among(placed, "bucket", stage(split.select("bucket"), "split"))


def _weighted(members: DataFrame) -> DataFrame:
    """``members`` with weight, the number of times that their node meets a node in its buckets."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    weights = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("weight"))
    return members.join(weights, "node")


def _pairs_of_groups(members: DataFrame, turn: int) -> DataFrame:
    """A node of each component of a bucket with a node of the bucket's largest component: of the
    one any node, of the other any node in odd turns and that of the largest weight in even ones."""
    order = F.struct(F.xxhash64("node", F.lit(turn)), "node")
    first = F.min_by("node", order) if turn % 2 else F.max_by("node", F.struct("weight", -F.col("node")))
    ones = members.groupBy("bucket", "g").agg(F.min_by("node", order).alias("a"), first.alias("b"), F.count("*").alias("size"))
    largest = ones.groupBy("bucket").agg(F.max_by(F.struct("b", "g"), F.struct("size", -F.col("g"))).alias("top"))
    met = ones.drop("b").join(largest, "bucket").where(F.col("g") != F.col("top.g"))
    return _closest(met.select("a", F.col("top.b").alias("b")))


def _shingle_keys(docs: DataFrame, shingle: int) -> DataFrame:
    """set_id, keys (64-bit integers, little-endian) of every text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            sets = [shingle_set(words(text), shingle) for text in chunk.column("text").to_pylist()]
            ids = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            keys = pa.ListArray.from_arrays(
                np.cumsum([0, *map(len, sets)], dtype=np.int32), np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            )
            yield pa.RecordBatch.from_arrays([ids, keys], ["set_id", "keys"])

    return docs.mapInArrow(run, "set_id binary, keys array<long>")


def _first_shingles(members: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The shingles of step 4 by which the nodes of ``members`` are found: key, node, g, n, i (the
    number of shingles before it in its set), major (the component with most rows of the key)."""
    open_nodes = stage(members.select("node", "g").distinct(), "residue")
    asked = among(nodes.select("set_id", "node", "n"), "node", open_nodes.select("node")).join(open_nodes, "node")
    keys = _shingle_keys(among(docs, "doc_id", open_nodes.select("node")), shingle)
    one_each = keys.groupBy("set_id").agg(F.first("keys").alias("keys"))
    held = stage(asked.join(one_each, "set_id"), "held").select("set_id", "node", "n", "g", F.explode("keys").alias("key"))
    by_key = held.groupBy("key").agg(F.count("*").alias("sets"), F.min("g").alias("low"), F.max("g").alias("high"))
    shared = by_key.where("low < high").select("key", "sets")
    of_set = held.join(shared, "key").groupBy("set_id", "node", "n", "g").agg(F.sort_array(F.collect_list(F.struct("sets", "key"))).alias("last"))
    placed = of_set.select("node", "n", "g", (F.col("n") - F.size("last")).alias("own"), F.posexplode("last").alias("at", "it"))
    rows = placed.select(F.col("it.key").alias("key"), "node", "g", "n", (F.col("own") + F.col("at")).alias("i"))
    first = stage(rows.where(100 * (F.col("n") - F.col("i")) >= percent * F.col("n")), "first")
    most = first.groupBy("key", "g").agg(F.count("*").alias("size")).groupBy("key")
    return first.join(most.agg(F.max_by("g", F.struct("size", -F.col("g"))).alias("major")), "key")


def _pairs_across(first: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components that meet by a shingle in ``first``, each once.

    In one of the two sets the shingle is outside the key's major component, so a shingle of nearly
    all members of a component makes no more rows than others need. Sets meet in classes of sizes;
    the larger set looks into those where the shingles that follow on the shared one are enough."""
    whole, n, i = 100 + percent, F.col("n"), F.col("i")
    size_class = lambda size: F.floor(F.log(size.cast("double")) / float(np.log(SIZE_CLASS)))
    side = lambda df, s: df.select("key", "class", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "g", "n", "i")])
    minor = F.col("g") != F.col("major")
    below = first.where(whole * (n - i) >= 2 * percent * n).withColumn("class", size_class(n))
    least, most = F.ceil(percent * n / 100), F.least(n, F.floor((100 * n - whole * i) / percent))
    above = first.where(least <= most).withColumn("class", F.explode(F.sequence(size_class(least), size_class(most))))

    def met(large: DataFrame, small: DataFrame) -> DataFrame:
        x, y = side(large, "x"), side(small, "y")
        follow = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y"))
        enough = whole * follow >= percent * (F.col("n_x") + F.col("n_y"))
        on = (x.key == y.key) & (x["class"] == y["class"]) & (F.col("n_x") >= F.col("n_y")) & (F.col("g_x") != F.col("g_y")) & enough
        return x.join(y, on).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))

    return met(above.where(minor), below).union(met(above.where(~minor), below.where(minor))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its shingle set), component_id (the
    smallest id reachable over links, its own included), kept (doc_id = component_id).

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``shingle``-word sequences (fewer words: the whole sequence). Null, empty and wordless texts
    have an empty set and no link. Rows with one id are one node: a link of either is a link of
    both. A null id is never linked, has a null component and is kept. ``percent`` is 80 or
    more: the bands are chosen for that. Empty tables give an empty result.
    """
    rows = id_text(docs, id_col, text_col)
    known = stage(sketches(rows, shingle), "sketches")
    usable = known.where("n > 0 and doc_id is not null")
    nodes = stage(
        usable.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("registers").alias("registers")),
        "sets",
    )
    # rows that share an id tie their sets together, whatever these are
    of_row = usable.select("doc_id", "set_id").join(nodes.select("set_id", "node"), "set_id").select("doc_id", "node")
    several = of_row.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("high")).where("u <> high").select("doc_id", "u")
    tied = of_row.join(several, "doc_id").where("u <> node").select("u", F.col("node").alias("v")).distinct()

    def links(likely: DataFrame) -> DataFrame:
        found = verified(stage(likely, "likely"), rows, shingle, percent)
        return stage(found, "verified").select(F.col("a").alias("u"), F.col("b").alias("v"))

    def joined(groups: DataFrame, more: DataFrame) -> DataFrame:
        stars = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
        return stage(components(stars.union(more)), "groups")

    groups = stage(components(links(likely_pairs(stage(_first_pairs(nodes), "pairs"), nodes)).union(tied)), "groups")
    members = _placed(nodes.select("node", "n", "registers"), groups).select("node", "n", "g", F.explode(_bands()).alias("bucket"))
    members = stage(_weighted(stage(_still_open(members), "open")), "weighted")
    turn, asked, found = 0, 1, 1
    while asked < WORTHWHILE * found:
        turn += 1
        pairs = stage(_pairs_of_groups(members, turn), "pairs")
        more = links(likely_pairs(pairs, nodes))
        groups = joined(groups, more)
        members = stage(_still_open(_placed(members.drop("g"), groups)), "open")
        asked, found = pairs.count(), more.count()
    across = _pairs_across(_first_shingles(members, nodes, rows, shingle, percent), percent)
    final = joined(groups, links(likely_pairs(stage(across, "pairs"), nodes)))
    of_set = nodes.join(final, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    found = known.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(of_set, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
