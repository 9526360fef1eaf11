"""Ranked search, vector codes and exact copies against brute force, and on rows at the edges."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from webtrawl.llm import exact_dedup, ranked_search, vector_codes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, _text string, rank int, bytes int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, 8) for r in rows], DOCS)


# ------------------------------------------------------------------------------ copies


def brute_copies(rows):
    groups = defaultdict(list)
    for at, (doc_id, text) in enumerate(rows):
        groups[re.sub("[ \t-\r]+", " ", text or "")].append((doc_id is None, doc_id or 0, at))
    out = []
    for text, members in groups.items():
        none, smallest, _ = min(members)
        keep = None if none else smallest
        for is_null, doc_id, _ in members:
            own = None if is_null else doc_id
            out.append((own, keep, len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def check_copies(df, rows, **sizes):
    found = exact_dedup.exact_duplicates(df, **sizes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute_copies(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) <= {1} and len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    return found


def test_copies_whose_prefixes_meet_at_every_stride(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ab \n\té"), 400))
    rows = [(int(i), base[: int(n)] + "ab"[int(i) % 2] * int(m)) for i, (n, m) in enumerate(rng.integers(0, 40, (300, 2)) * [9, 1])]
    rows += [(1000 + i, base) for i in range(400)]  # a third of all rows and more
    rows += [(2000 + i, base + "x" * 5000 + "yz"[i % 2]) for i in range(40)]
    check_copies(documents(spark, rows), rows, first=4, growth=2)
    check_copies(documents(spark, rows), rows)


def test_copies_at_the_edges(spark):
    rows = [(5, None), (4, ""), (9, " "), (8, "\x0b\n "), (7, " "), (6, "\x1c"), (3, "a\tb"), (2, "a  b"), (2, "a b"), (None, "a b")]
    rows += [(None, "no id"), (None, "no id"), (11, "é" * 40_000), (10, "é" * 40_000), (12, "é" * 39_999 + "e")]
    found = check_copies(documents(spark, rows), rows)
    assert {r.keep_id for r in found if r.doc_id in (4, 5)} == {4}
    assert {r.keep_id for r in found if r.doc_id in (8, 9)} == {8}
    assert exact_dedup.exact_duplicates(documents(spark, []).limit(0)).count() == 0


# ------------------------------------------------------------------------------- codes


def brute_codes(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in kept), default=0)
    width = -(-dim // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                x = v[p * width : (p + 1) * width]
                members[nearest(p, x)[1]].append(x)
            for e, xs in members.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        best = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        out.append((i, "".join(f"{e:02x}" for _, e in best), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def check_codes(spark, rows, entries=256, **sizes):
    as_floats = [(i, None if v is None else [None if x is None else float(x) for x in v], label, 1) for i, v, label in rows]
    df = spark.createDataFrame(as_floats, "vec_id long, embedding array<float>, label int, dim int")
    found = vector_codes.encode_vectors(df, entries=entries, **sizes).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_codes(rows, entries)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.3, (12, 8))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 12] + rng.normal(0, 0.05, 8))], [None, 1, 2][i % 3]) for i in rng.permutation(400)]
    check_codes(spark, rows, entries=32, block_rows=64)
    check_codes(spark, rows[:100], entries=256)  # fewer vectors than entries


def test_codes_with_ties_and_copies(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) / 1024 for x in rng.integers(-2, 3, 8)], i % 2) for i in range(300)]
    rows += [(1000 + i, [0.0] * 8, 1) for i in range(300)]
    check_codes(spark, rows, entries=16)


def test_codes_at_the_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1, 2, 3, 4], None), (2, None, 1), (3, [nan, 1, 1, 1, 1], 1), (4, [inf, 0, 0, 0, 0], 1), (5, [None, 0, 0, 0, 0], 1), (None, [1.0], 1)]
    rows += [(6, [], 1), (1, [0.5, 1, 2, 3, 4], None), (1, [0.25, 1, 2, 3, 4], 2)]
    check_codes(spark, rows)
    check_codes(spark, rows, entries=2)
    check_codes(spark, [(1, [], 1), (2, [], None)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.encode_vectors(empty).collect() == []


def test_balls_leave_out_entries_that_cannot_be_nearest():
    rng = np.random.default_rng(7)
    entries = rng.integers(-500, 500, (256, 4))
    x = entries[rng.integers(0, 256, 3000)] + rng.integers(-60, 60, (3000, 4))
    before = rng.integers(0, 256, 3000)
    before[:2000] = vector_codes.Balls(entries, None).nearest_of_all(x[:2000])[0]
    gap = x - entries[before]
    squares, reach = (gap * gap).sum(1), np.zeros(256)
    np.maximum.at(reach, before, np.sqrt(squares))
    balls = vector_codes.Balls(entries, reach)
    codes, found = balls.nearest(x, before)
    expected = vector_codes.Balls(entries, None).nearest_of_all(x)
    assert (codes == expected[0]).all() and (found == expected[1]).all()
    well_placed = np.zeros(256)
    np.maximum.at(well_placed, before[:2000], np.sqrt(squares[:2000]))
    assert np.mean([len(n) for n in vector_codes.Balls(entries, well_placed).neighbours]) < 60


def test_distances_of_large_numbers_are_exact():
    x, c = np.array([[2**24, -(2**24)]]), np.array([[-(2**24), 2**24 - 1]])
    assert vector_codes.square_distances(x, c)[0, 0] == (2**25) ** 2 + (2**25 - 1) ** 2


# ------------------------------------------------------------------------------ search


def brute_search(docs, items, k):
    counted = []
    for doc_id, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        if words and doc_id is not None:
            counted.append((doc_id, Counter(words), len(words)))
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, tf, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            s = 0
            for w in WORD.findall((text or "").translate(LOWER)):
                if tf[w]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m))
            if s > 0:
                scores.append((-s, doc_id))
        out += [(item_id, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def check_search(spark, docs, items, k=20, **sizes):
    index = ranked_search.build_index(documents(spark, docs).repartition(3))
    wanted = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    found = ranked_search.search(index, wanted, k, **sizes).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_search(docs, items, k)
    return found


def skewed_texts(rng, n, vocabulary=60):
    share = 1 / np.arange(1, vocabulary + 1)
    return [" ".join(f"W{w}" for w in rng.choice(vocabulary, rng.integers(0, 50), p=share / share.sum())) for _ in range(n)]


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    docs = list(enumerate(skewed_texts(rng, 700)))
    docs += [(1000 + i, "w3 w40 w41") for i in range(200)]  # equal scores
    items = list(enumerate(skewed_texts(rng, 12))) + [(50, "w3 w40 w59 w59"), (51, "w40")]
    check_search(spark, docs, items, 5)
    monkeypatch.setattr(ranked_search, "BLOCK", 4)
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 4000)
    monkeypatch.setattr(ranked_search, "CHUNK_BYTES", 300)
    check_search(spark, docs, items, 5, query_bytes=400)
    check_search(spark, docs, items)


def test_search_at_the_edges(spark):
    docs = [(1, None), (2, ""), (3, "--- !?"), (None, "alpha"), (4, "Alpha ALPHA beta"), (4, "alpha"), (5, "Ünï ünï ß_x\x7fy é"), (6, "long " * 70_000), (7, "alpha")]
    items = [(1, None), (2, ""), (3, "alpha beta"), (3, "alpha beta"), (3, "alpha"), (None, "x y é"), (4, "Ünï LONG"), (5, "unknown")]
    found = check_search(spark, docs, items)
    assert {r.doc_id for r in found if r.item_id == 4} == {5, 6}
    check_search(spark, [], items)
    check_search(spark, docs, [])


def test_blocks_that_cannot_lift_a_document_stay_packed():
    builder = ranked_search._ShardBuilder()
    for i in range(20_000):
        builder.add(i, b"common " * (9 if 300 <= i < 340 else 1) + (b"rare " if i % 700 == 0 else b"") + b"x%d" % i)
    batch = builder.packed()
    a = ranked_search._unpacked(batch.column("lists")[0].as_py())
    words = batch.column("words")[0].as_py().split(b" ")
    m_of = lambda n: 75 + 25 * n * 20_000 // 50_000
    dfs = np.frombuffer(batch.column("dfs")[0].as_py(), np.uint32)
    lists = {w: ranked_search._List(a, words.index(w), int(dfs[words.index(w)]), m_of(a["lengths"].astype(np.int64)), m_of) for w in (b"common", b"rare")}
    heap = ranked_search._Heap(5)
    ranked_search.search_shard([(lists[b"rare"], 1000)], heap, a["ids"])
    ranked_search.search_shard([(lists[b"rare"], 1000), (lists[b"common"], 1)], heap, a["ids"])
    assert 0 < lists[b"common"].open.sum() <= 29 < len(lists[b"common"].open)
