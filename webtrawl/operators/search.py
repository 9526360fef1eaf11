"""Batched full-text search: many queries against many documents in one job.

All engines work on a stored index (``operators.search_index``). Words are matched against its
dictionaries first, by equality keys, and the counts that scoring needs are read there, so a search
reads the postings of the few terms its words expand to and never scans document text. Where all
words must match, the documents of the rarest word are found first and the postings of the other
words are only kept for these.
"""

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webtrawl.functions.stemming import STOP_WORDS
from webtrawl.functions.text import query_terms, sanitize_query, tokens
from webtrawl.operators.pages import result_view
from webtrawl.operators.search_index import (
    NODE_FIELDS,
    PREFIX_LETTERS,
    STEMMED_FIELDS,
    SearchIndex,
    build_postings,
    create_index,
    head_of,
    near_keys,
    starting_with,
    stem_words,
    word_keys,
)
from webtrawl.plans.staging import stage
from webtrawl.settings import HITS_PER_QUERY

# The fields of the fuzzy search and what each counts.
FUZZY_BOOSTS = {
    "title": 3.0, "metaDescription": 2.0, "ogTitle": 2.0, "ogDescription": 1.0, "content": 1.0,
}
HIT_COLUMNS = ["url", "title", "metaDescription", "ogTitle", "ogDescription", "domain"]
K1, B = 1.2, 0.75
#: Words of queries that are looked for as prefixes in the postings; more are looked up by the terms they cover.
FEW_WORDS = 10_000
#: Places beyond which two words do not count as near each other.
PLACES = 100


def build_index(docs: DataFrame, fields: list[str] | None = None, **names) -> SearchIndex:
    """A stored index of ``docs`` with ``fields`` searched as one document; see ``create_index``."""
    return create_index(docs, fields=fields or NODE_FIELDS, document_fields=fields, **names)


def corpus_stats(postings: DataFrame) -> DataFrame:
    """Per field: documents with text, tokens, average length, distinct terms."""
    return postings.groupBy("field").agg(
        F.count_if("first_term").alias("docs"),
        F.sum("tf").alias("tokens"),
        (F.sum("tf") / F.count_if("first_term")).alias("avg_len"),
        F.count_distinct("term").alias("terms"),
    )


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency per field and term."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def index_stats(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Document count and stored text size in MB."""
    size = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in columns[1:]),
               F.octet_length(F.coalesce(columns[0], F.lit(""))))
    return docs.agg(
        F.count("*").alias("doc_count"), F.round(F.sum(size) / 1048576.0, 1).alias("size_mb")
    )


def index_needs_rebuild(nodes: DataFrame, indexed: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Whether the index holds fewer than ``ratio`` of the nodes. ``indexed`` has a row per url."""
    n = nodes.agg(F.count("*").alias("n"))
    return indexed.agg(F.count("*").alias("indexed")).select(
        "indexed", n.scalar().alias("nodes"), (F.col("indexed") < n.scalar() * ratio).alias("rebuild")
    )


def _indexed(index: SearchIndex | DataFrame) -> SearchIndex:
    """The index, or one of these documents that serves all engines."""
    if isinstance(index, DataFrame):
        return create_index(index, fields=[*dict.fromkeys([*NODE_FIELDS, *STEMMED_FIELDS, *FUZZY_BOOSTS])])
    return index


# --------------------------------------------------------------------------- queries


def clean_queries(queries: DataFrame) -> DataFrame:
    """``query_id``, the sanitised ``q`` and its ``words``; queries without words are dropped."""
    return (
        queries.select("query_id", sanitize_query("q").alias("q"))
        .withColumn("words", query_terms("q"))
        .filter(F.size("words") > 0)
    )


def query_words(queries: DataFrame) -> DataFrame:
    """``(query_id, pos, word)`` with the words analysed like document text."""
    return clean_queries(queries).select(
        "query_id", F.posexplode(tokens(F.array_join("words", " "))).alias("pos", "word")
    )


def top_hits(scores: DataFrame, k: int = HITS_PER_QUERY) -> DataFrame:
    """The best ``k`` rows per query by ``score``, ties by url. The cut runs before the
    shuffle too, so a query that matches everywhere sends ``k`` rows per task."""
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "url")
    ranked = scores.withColumn("_rn_", F.row_number().over(best))
    return ranked.filter(F.col("_rn_") <= k).drop("_rn_")


def _ranked(scores: DataFrame, index: SearchIndex, k: int, extra: list[str] | None = None) -> DataFrame:
    """The ``k`` best documents per query of ``(query_id, doc, score)`` with their columns; ties by
    url. The k-th score comes first, cut to ``k`` rows per query and task before the shuffle; urls
    are looked up for the documents that reach it, and a second cut orders those that tie."""
    scores = stage(scores, "scores", drop_shuffles=True)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    first = scores.withColumn("_rn_", F.row_number().over(best)).filter(F.col("_rn_") <= k)
    least = first.groupBy("query_id").agg(F.min("score").alias("_least_"))
    close = scores.join(least, "query_id").filter(F.col("score") >= F.col("_least_"))
    docs = index.docs()
    wanted = [*HIT_COLUMNS, *(extra or [])]
    have = [F.col(c) if c in docs.columns else F.lit("").alias(c) for c in wanted]
    named = stage(top_hits(close.join(docs.select("doc", "url"), "doc"), k), "named", drop_shuffles=True).drop("url")
    return named.join(docs.select("doc", *have), "doc").select("query_id", *wanted, "score")


def expand_prefixes(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """``(word, term)`` for every vocabulary term that starts with a word."""
    return starting_with(vocabulary.select("term"), words).select("word", "term")


def matching_all(postings: DataFrame | Callable[[DataFrame], DataFrame], wanted: DataFrame, expanded: DataFrame | None) -> DataFrame:
    """The postings of the documents that may hold all words of a query: ``query_id, word`` and the
    columns of ``postings``, which may be a function that gives those of a table of terms, or without
    ``expanded`` those of a table of words, with its other columns. ``wanted`` is ``(query_id, word, n)`` with the number of documents that hold
    the word, ``expanded`` the ``(word, term)`` pairs.

    Each query starts from its rarest word. The others' postings are looked up by (word, document)
    and only those of documents found so far go on; a frequent word's list is never grouped.
    """
    by_n = W.partitionBy("query_id").orderBy("n", "word")
    ordered = stage(wanted.withColumn("_at_", F.row_number().over(by_n)), "ordered", drop_shuffles=True)
    lead = ordered.filter(F.col("_at_") == 1).select("query_id", "word")
    rest = ordered.filter(F.col("_at_") > 1).select("query_id", "word")
    look = (lambda terms: postings.join(terms, "term")) if isinstance(postings, DataFrame) else postings
    of = lambda words: look(words if expanded is None else expanded.join(words, "word"))
    first = stage(of(lead), "lead", drop_shuffles=True)
    asked = rest.join(first.select("query_id", "doc").distinct(), "query_id")
    others = of(rest.select("word").distinct()).join(asked, ["word", "doc"])
    return first.unionByName(others.select(first.columns))


def _document_counts(index: SearchIndex, words: DataFrame, expanded: DataFrame) -> DataFrame:
    """``(word, n)``: how many documents hold a word that starts with it, from the dictionary; words
    longer than the prefixes it has are counted."""
    counted = words.join(index.prefixes(), F.col("word") == F.col("prefix")).select("word", F.col("docs").alias("n"))
    long = expanded.filter(F.length("word") > PREFIX_LETTERS)
    if long.isEmpty():
        return counted
    return counted.unionByName(index.document_postings(long).groupBy("word").agg(F.count_distinct("doc").alias("n")))


def search_prefix(index: SearchIndex, queries: DataFrame, k: int = HITS_PER_QUERY) -> DataFrame:
    """Every word is a prefix and every word must match; BM25 over the whole document.

    A word's matches count as one phrase: its frequency is that of all terms it covers. The
    inverse document frequency has a floor of 1e-6. ``rank`` is the negated score.
    """
    every = query_words(queries).groupBy("query_id", "word").agg(F.count("*").alias("times"))
    words = stage(every, "words")
    expanded = stage(expand_prefixes(index.vocabulary(), words.select("word").distinct()), "expanded", drop_shuffles=True)
    counts = _document_counts(index, words.select("word").distinct(), expanded)
    known = words.join(counts, "word", "left").withColumn(
        "words", F.count("*").over(W.partitionBy("query_id"))
    ).withColumn("known", F.count("n").over(W.partitionBy("query_id")))
    known = stage(known.filter(F.col("words") == F.col("known")).drop("known"), "known")
    few = known.count() <= FEW_WORDS
    found = matching_all(index.document_postings, known.select("query_id", "word", "n"), None if few else expanded).groupBy("query_id", "doc", "word").agg(
        F.sum("tf").alias("f"), F.max("doc_len").alias("dl")
    )
    whole = index.field_counts().filter(F.col("field") == "")
    docs_n = whole.agg(F.sum("docs").cast("double")).scalar()
    tokens_n = whole.agg(F.sum("tokens").cast("double")).scalar()
    idf = F.greatest(F.ln((docs_n - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    norm = K1 * (1 - B + B * F.col("dl") / (tokens_n / docs_n))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + norm)
    scores = (
        found.join(known, ["query_id", "word"])
        .groupBy("query_id", "doc")
        .agg(F.count("*").alias("_got_"), F.max("words").alias("words"), F.round(F.sum(F.col("times") * part), 9).alias("score"))
        .filter(F.col("_got_") == F.col("words"))
        .select("query_id", "doc", "score")
    )
    return _ranked(scores, index, k).withColumn("rank", -F.col("score")).drop("score")


# --------------------------------------------------------------------------- stemmed


def search_stemmed(index: SearchIndex | DataFrame, queries: DataFrame, k: int = HITS_PER_QUERY) -> DataFrame:
    """English analysis of the joined phrase fields; every non-stop word must match by its stem.

    The stems of terms and the places of words are in the index. One word: each occurrence adds
    0.1 / n^2. Several words: pairs of occurrences of different words add up as probabilities that
    fall with their distance in the text.
    """
    index = _indexed(index)
    wanted = stage(
        query_words(queries)
        .filter(~F.col("word").isin(*STOP_WORDS))
        .withColumn("word", stem_words("word"))
        .select("query_id", "word")
        .distinct(),
        "stems",
    )
    expanded = stage(
        index.vocabulary().filter(~F.col("term").isin(*STOP_WORDS)).withColumnRenamed("stem", "word")
        .join(wanted.select("word").distinct(), "word").select("word", "term"),
        "stem_terms", drop_shuffles=True,
    )
    in_phrase = F.col("field").isin(index.phrase_fields)
    dfs = index.terms().filter(in_phrase).join(expanded, "term").groupBy("word").agg(F.sum("df").alias("n"))
    known = wanted.join(dfs, "word", "left").withColumn("words", F.count("*").over(W.partitionBy("query_id")))
    known = known.withColumn("known", F.count("n").over(W.partitionBy("query_id")))
    known = stage(known.filter(F.col("words") == F.col("known")).drop("known"), "known")
    found = (
        matching_all(index.phrase_postings, known.select("query_id", "word", "n"), expanded)
        .groupBy("query_id", "doc")
        .agg(F.collect_list(F.struct("word", "at")).alias("_m_"))
        .join(known.groupBy("query_id").agg(F.max("words").alias("words")), "query_id")
    )
    different = F.array_distinct(F.transform("_m_", lambda m: m["word"]))
    matched = found.filter(F.size(different) == F.col("words"))
    scores = matched.select("query_id", "doc", F.round(_stemmed_rank(F.col("_m_"), F.col("words")), 9).alias("score"))
    return _ranked(scores, index, k).withColumnRenamed("score", "rank")


def _stemmed_rank(matches: Column, words: Column) -> Column:
    """From ``(word, at)`` entries. A pair's weight is nothing beyond 100 places, and a place holds
    one word, so each place is compared with the hundred entries before it in the text."""
    zero = F.lit(0.0)
    entries = F.array_sort(
        F.flatten(F.transform(matches, lambda m: F.transform(m["at"], lambda p: F.struct(p.alias("p"), m["word"].alias("w")))))
    )
    single = F.aggregate(
        F.sequence(F.lit(1), F.size(entries)), zero, lambda acc, n: acc + 0.1 / (n * n)
    ) / 1.64493406685

    def miss(a: Column, b: Column) -> Column:
        gap = a["p"] - b["p"]
        near = 1.0 / (F.lit(1.005) + F.lit(0.05) * F.exp(gap / 1.5 - 2))
        return F.when((a["w"] != b["w"]) & (gap <= PLACES), F.ln(1.0 - 0.1 * F.sqrt(near))).otherwise(zero)

    def sweep(e: Column) -> Column:
        behind = lambda n: F.slice(e, F.greatest(n - PLACES, F.lit(0)) + 1, F.least(n, F.lit(PLACES)))
        logs = F.transform(e, lambda a, n: F.aggregate(behind(n), zero, lambda acc, b: acc + miss(a, b)))
        return F.aggregate(logs, zero, lambda acc, x: acc + x)

    # The entries are bound to a name once, as an array of one element.
    logs = F.transform(F.array(entries), sweep)
    return F.when(words == 1, single).otherwise(1.0 - F.exp(F.element_at(logs, 1)))


# --------------------------------------------------------------------------- fuzzy


def allowed_edits(word) -> Column:
    """0 edits up to two characters, 1 up to five, else 2."""
    n = F.length(word)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def expand_fuzzy(vocabulary: DataFrame, words: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``(word, term, dist)`` for all pairs within the word's allowed edits (exact). ``near`` has
    the first letters of the vocabulary's terms by their deletion keys, if they are stored."""
    terms = vocabulary.select("term", head_of("term").alias("head")).distinct()
    if near is None:
        near = near_keys(terms.select(F.col("head").alias("term")).distinct()).withColumnRenamed("term", "head")
    keyed = word_keys(words).withColumn("e", allowed_edits("word")).filter(F.col("edits") <= F.col("e")).select("word", "e", "key")
    distance = F.levenshtein("word", "term", 2)
    # Heads near a word are few next to the vocabulary; as a table, their size decides the join strategy.
    heads = near.join(keyed, "key").filter(F.col("edits") <= F.col("e")).select("word", "e", "head").distinct()
    return (
        terms.join(stage(heads, "heads", drop_shuffles=True), "head")
        .filter(F.abs(F.length("word") - F.length("term")) <= F.col("e"))
        .select("word", "term", "e", distance.alias("dist"))
        .filter((F.col("dist") >= 0) & (F.col("dist") <= F.col("e")))
        .select("word", "term", "dist")
    )


def search_fuzzy(
    index: SearchIndex, queries: DataFrame, k: int = HITS_PER_QUERY, boosts: dict | None = None
) -> DataFrame:
    """Any word may match, with edits; the best single field of a document counts.

    Field score: boost x idf x tf part, summed over words and the terms they expand to, each
    scaled by its similarity 1 - dist / shorter length. A swap of two letters is two edits.
    """
    boosts = {f: b for f, b in (boosts or FUZZY_BOOSTS).items() if f in index.fields}
    words = stage(query_words(queries), "words")
    expanded = expand_fuzzy(index.vocabulary(), words.select("word").distinct(), index.near())
    shorter = F.least(F.length("word"), F.length("term"))
    similarity = 1.0 - F.col("dist") / shorter
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field"))
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    by_term = words.join(expanded, "word").groupBy("query_id", "term").agg(F.sum(similarity).alias("weight"))
    fields = index.field_counts().select("field", "docs", (F.col("tokens") / F.col("docs")).alias("avg_len"))
    # Query terms are few next to postings; as a table, their size decides the join strategy.
    weighted = stage(
        index.terms().filter(F.col("field").isin(list(boosts))).join(by_term, "term").join(F.broadcast(fields), "field")
        .select("query_id", "term", "field", "avg_len", (boost * idf * F.col("weight")).alias("weight")),
        "query_terms", drop_shuffles=True,
    )
    part = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("field_len") / F.col("avg_len")))
    postings = index.postings(terms=weighted.select("term").distinct(), columns=["term", "field", "doc", "tf", "field_len"])
    scored = postings.join(weighted, ["term", "field"]).select("query_id", "doc", "field", (F.col("weight") * part).alias("s"))
    # One sum per field side by side: a single shuffle gives the best field of each document.
    sums = [F.sum(F.when(F.col("field") == f, F.col("s"))).alias(f"_{f}_") for f in boosts]
    best = F.greatest(*[f"_{f}_" for f in boosts]) if len(boosts) > 1 else F.col(f"_{[*boosts][0]}_")
    scores = scored.groupBy("query_id", "doc").agg(*sums).select("query_id", "doc", F.round(best, 9).alias("score"))
    return _ranked(scores, index, k, ["popularity"]).withColumnRenamed("score", "rank")


# --------------------------------------------------------------------------- front door


ENGINES = ("fuzzy", "stemmed", "prefix")


def search(
    index: SearchIndex | DataFrame,
    queries: DataFrame,
    engine: str = "auto",
    available: tuple = ENGINES,
    k: int = HITS_PER_QUERY,
) -> DataFrame:
    """Search an index, or documents that are indexed first, with one engine or with the first
    available of fuzzy, stemmed and prefix that answers.

    With ``auto`` an engine's hits are written before they are returned, so that an engine that
    fails is found out here and the next one is asked; if all fail, the last one's error is
    raised. The hits carry the engine's name in ``source``; a query without words gives no hits.
    """
    index = _indexed(index)
    engines = {"fuzzy": search_fuzzy, "stemmed": search_stemmed, "prefix": search_prefix}
    columns = ["query_id", *HIT_COLUMNS, "rank"]
    if engine != "auto":
        return engines[engine](index, queries, k).select(*columns, F.lit(engine).alias("source"))
    failed = ValueError("no engine is available")
    for name in ENGINES:
        if name in available:
            try:
                return stage(search(index, queries, name, k=k), "hits")
            except (PySparkException, Py4JJavaError) as error:
                failed = error
    raise failed


def search_view(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with display title and snippet, the query's words highlighted."""
    words = queries.select(
        "query_id", F.split(F.lower(F.trim("q")), r"\s+").alias("_words_")
    )
    return result_view(hits.join(words, "query_id"), F.col("_words_")).drop("_words_")
