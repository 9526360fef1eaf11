"""Search operators against plain Python on small texts."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from webtrawl.functions.stemming import stem
from webtrawl.functions.text import fold_text, highlight, query_terms, sanitize_query, tokens
from webtrawl.operators import search as s

SCHEMA = "url string, title string, metaDescription string, ogTitle string, ogDescription string, domain string"


def docs_df(spark, rows):
    return spark.createDataFrame([(u, t, m, "", "", d) for u, t, m, d in rows], SCHEMA)


def queries_df(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, q string")


def test_text_functions(spark):
    cases = [" <b>it's \"x\" (y) {z} [w] \\ ; | & $ ` ok ", "a" * 600, None, "foo-bar +baz ~q^2", "  "]
    df = spark.createDataFrame([(c,) for c in cases], "q string").select(
        sanitize_query("q").alias("q")).withColumn("t", query_terms("q"))
    got = df.collect()
    assert got[0].q == "bits x y z w" + " " * 7 + "ok"
    assert got[1].q == "a" * 500 and got[2].q == "" and got[2].t == [] and got[4].t == []
    assert got[3].t == ["foo", "bar", "baz", "q", "2"]
    one = spark.createDataFrame([("ÉÀ straße_x2 N",)], "t string")
    assert one.select(fold_text("t")).first()[0] == "ea straße_x2 n"
    assert one.select(tokens("t")).first()[0] == ["ea", "straße", "x2", "n"]


def test_highlight(spark):
    df = spark.createDataFrame([("A <b> ab & Cat", ["a", "ab"]), ("x", []), ("1+1", ["1+"])],
                               "t string, w array<string>")
    assert [r[0] for r in df.select(highlight("t", "w")).collect()] == [
        "<em>A</em> &lt;b&gt; <em>ab</em> &<em>a</em>mp; C<em>a</em>t", "x", "<em>1+</em>1"]


def test_stemmer():
    pairs = {
        "consigned": "consign", "consistency": "consist", "knightly": "knight", "knots": "knot",
        "generally": "general", "skies": "sky", "dying": "die", "hopping": "hop", "hoping": "hope",
        "relational": "relat", "conditional": "condit", "happiness": "happi", "crying": "cri",
        "cried": "cri", "ties": "tie", "running": "run", "national": "nation", "adjustment": "adjust",
        "controll": "control", "probate": "probat", "cease": "ceas", "by": "by", "say": "say",
        "inning": "inning", "communism": "communism", "databases": "databas",
        "gas": "gas", "kiwis": "kiwi", "sized": "size", "luxuriating": "luxuri", "bed": "bed",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_postings(spark):
    df = docs_df(spark, [("u1", "b a b", "", "d.com"), ("u2", None, "", None)])
    got = {(r.url, r.field, r.term): (r.tf, r.field_len, r.doc_len, r.first_term)
           for r in s.build_postings(df, ["title", "domain"]).collect()}
    assert got == {("u1", "title", "a"): (1, 3, 5, True), ("u1", "title", "b"): (2, 3, 5, False),
                   ("u1", "domain", "com"): (1, 2, 5, True), ("u1", "domain", "d"): (1, 2, 5, False)}


def _bm25_prefix(docs, words):
    n = len(docs)
    avg = sum(len(d) for d in docs.values()) / n
    scores = {}
    for url, toks in docs.items():
        total = 0.0
        for w in words:
            hit = {u: sum(t.startswith(w) for t in d) for u, d in docs.items()}
            df = sum(1 for x in hit.values() if x)
            if not hit[url]:
                break
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
            f = hit[url]
            total += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks) / avg))
        else:
            scores[url] = total
    return scores


def test_prefix_search_matches_plain_scores(spark):
    rng = random.Random(2)
    vocab = ["test", "tester", "page", "pages", "integration", "data", "dat", "x1"]
    rows = [(f"u{i}", " ".join(rng.choices(vocab, k=rng.randrange(1, 9))), rng.choice(vocab), "d")
            for i in range(30)]
    docs = docs_df(spark, rows)
    texts = ["test pa", "integration", "dat dat", "nothing", "", "x", "Té(st)"]
    fields = ["title", "metaDescription"]
    hits = s.search_prefix(s.build_index(docs, fields), queries_df(spark, *texts)).collect()
    plain = {u: (t + " " + m).split() for u, t, m, _ in rows}
    for q, words in enumerate([["test", "pa"], ["integration"], ["dat", "dat"], ["nothing"], None,
                               ["x"], ["test"]]):
        want = _bm25_prefix(plain, words) if words else {}
        got = {h.url: -h.rank for h in hits if h.query_id == q}
        assert set(got) == set(want) or len(got) == 30
        assert all(abs(got[u] - want[u]) < 1e-6 for u in got)


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_expansion_is_exact(spark):
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = sorted({make(rng.randrange(1, 12)) for _ in range(400)})
    words = sorted({make(rng.randrange(1, 11)) for _ in range(40)})
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    got = {tuple(r) for r in s.expand_fuzzy(t, w).collect()}
    edits = lambda x: 0 if len(x) <= 2 else 1 if len(x) <= 5 else 2
    want = {(a, b, d) for a in words for b in terms if (d := _levenshtein(a, b)) <= edits(a)}
    assert got == want


def test_fuzzy_search(spark):
    docs = docs_df(spark, [("u1", "python language", "about snakes", "d"),
                           ("u2", "java", "pyhton and python", "d"), ("u3", "cooking", "", "d")])
    docs = docs.withColumn("popularity", F.lit(7))
    index = s.build_index(docs, ["title", "metaDescription"])
    hits = s.search_fuzzy(index, queries_df(spark, "pythan", "zzzzzz")).collect()
    assert {h.url for h in hits} == {"u1", "u2"} and hits[0].popularity == 7
    assert max(hits, key=lambda h: h.rank).url == "u1"


def _stemmed_rank(positions):
    if len(positions) == 1:
        return sum(0.1 / n**2 for n in range(1, len(positions[0]) + 1)) / 1.64493406685
    miss = 1.0
    for i, a in enumerate(positions):
        for b in positions[:i]:
            for x in a:
                for y in b:
                    near = 1 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2))
                    miss *= 1 - 0.1 * math.sqrt(near if abs(x - y) <= 100 else 1e-30)
    return 1 - miss


def test_stemmed_search(spark):
    rows = [("u1", "running the dogs", "a dog runs daily", "ex.com"), ("u2", "dog", "", "ex.com"),
            ("u3", "run", "runner of a dog and another dog", "run.org")]
    docs = docs_df(spark, rows)
    hits = s.search_stemmed(docs, queries_df(spark, "the dogs running", "dog", "the of", "zebra"))
    got = {(h.query_id, h.url): h.rank for h in hits.collect()}
    assert set(got) == {(0, "u1"), (0, "u3"), (1, "u1"), (1, "u2"), (1, "u3")}
    for (q, url), rank in got.items():
        u, t, m, d = next(r for r in rows if r[0] == url)
        words = [stem(x) for x in f"{t} {m}  {d}".replace(".", " ").split()]
        wanted = ["dog", "run"] if q == 0 else ["dog"]
        positions = [[i for i, x in enumerate(words) if x == w] for w in wanted]
        assert abs(rank - _stemmed_rank(positions)) < 1e-8
    assert abs(got[1, "u2"] - 0.0607927) < 1e-6


def test_search_dispatch_and_view(spark):
    docs = docs_df(spark, [("u1", "Test Page for Integration", "good <x>", "d.com")])
    queries = queries_df(spark, "integration")
    for engine in s.ENGINES:
        rows = s.search(docs, queries, available=(engine,)).collect()
        assert [(r.url, r.source) for r in rows] == [("u1", engine)]
    view = s.search_view(s.search(docs, queries, "prefix"), queries).first()
    assert view.view_title == "Test Page for <em>Integration</em>" and view.snippet == "good &lt;x&gt;"
    assert s.search(docs, queries_df(spark, "()", " ")).count() == 0
    stats = s.index_stats(docs, ["title"]).first()
    assert stats.doc_count == 1
    assert s.index_needs_rebuild(docs, docs.limit(0)).first().rebuild
    assert Counter(r.field for r in s.corpus_stats(s.build_postings(docs, ["title"])).collect()) == {
        "title": 1}
