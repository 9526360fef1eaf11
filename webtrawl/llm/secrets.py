"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's expression follows a Boolean query of trigrams that a text must hold for the
rule to match (``trigrams``). Postings are built for these trigrams only: per block of
documents, the ids that hold the trigram. Intersecting and uniting the posting lists gives each
rule's candidates, and only these texts are verified with the expression itself. A rule
without a mandatory trigram is run on every text.

Blocks are ranges of ``BLOCK_IDS`` ids, which bounds a posting list. Texts are shuffled at most
once, to meet their candidates.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import id_text
from webtrawl.llm.trigrams import trigram_query

BLOCK_IDS = 1 << 14
#: Group length for running sums in a row.
STRIDE = 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches from left to right without overlap; of them count those whose
    group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    query: list = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "query", trigram_query(self.pattern))


#: The three base rules, in the order of their kinds.
BASE_RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
        r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # a run is matched whole, so asking for its least length here leaves out short runs only
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
#: More forms of secrets; their spans are added to those of the base rules.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("source_token", r"gh[opsur]_[A-Za-z0-9]{36,255}"),
    Rule("chat_token", r"xox[abprs]-[0-9A-Za-z-]{10,250}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("signed_token", r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def _trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in r.query for alternative in clause for t in alternative})


def trigram_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """block, trigram, ids: the distinct ids of a block whose text holds the trigram."""
    lowered = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    pairs = lowered.select("doc_id", F.explode(held).alias("trigram"))
    block = F.floor(F.coalesce(F.col("doc_id"), F.lit(0)) / BLOCK_IDS).alias("block")
    return pairs.groupBy(block, "trigram").agg(F.collect_set(F.coalesce("doc_id", F.lit(0))).alias("ids"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, kinds: the rules with a trigram query that the document satisfies. A null id
    counts as 0 here, which only adds candidates."""
    indexed = [r for r in rules if r.query]
    postings = trigram_postings(docs, _trigrams(indexed))
    by_block = postings.groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists")
    )
    nothing = F.array().cast("array<bigint>")

    def list_of(trigram: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(trigram)), nothing)

    def of(rule: Rule) -> Column:
        clauses = [
            reduce(F.array_union, [reduce(F.array_intersect, map(list_of, a)) for a in clause])
            for clause in rule.query
        ]
        return F.transform(reduce(F.array_intersect, clauses), lambda i: F.struct(i.alias("doc_id"), F.lit(rule.kind).alias("kind")))

    found = by_block.select(F.explode(F.concat(*map(of, indexed))).alias("c"))
    return found.groupBy("c.doc_id").agg(F.collect_set("c.kind").alias("kinds"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(lengths: Column) -> Column:
    """Running sums of an array, in strides, so that the work in a row stays far from square."""

    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            total = acc["at"] + x
            return F.struct(total.alias("at"), F.concat(acc["out"], F.array(total)).alias("out"))

        return F.aggregate(values, start, add, lambda acc: acc["out"])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def joined(strides: Column) -> Column:
        bases = F.concat(F.array(F.lit(0)), sums(F.transform(strides, total)))
        bases = F.slice(bases, F.lit(1), F.size(strides))
        return F.flatten(F.zip_with(strides, bases, lambda s, b: F.transform(sums(s), lambda x: x + b)))

    starts = F.sequence(F.lit(1), F.size(lengths), F.lit(STRIDE))
    return _let(F.transform(starts, lambda i: F.slice(lengths, i, F.lit(STRIDE))), joined)


def rule_spans(text: Column, rule: Rule, no: int, wanted: Column) -> Column:
    """Array of spans (start, no, end, kind) of a rule, in code points. Matches and the pieces
    between them follow each other, so running sums of their lengths are the matches' places."""

    def lengths(group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), F.length)

    def matches(m: Column) -> Column:
        pieces = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), F.lit(1), F.size(m))
        group = m if rule.group == 0 else lengths(rule.group)
        return F.zip_with(F.zip_with(pieces, m, lambda p, x: F.struct(p.alias("p"), x.alias("m"))), group, lambda a, g: F.struct(a["p"].alias("p"), a["m"].alias("m"), g.alias("g")))

    def spans(found: Column) -> Column:
        ends = _running(F.transform(found, lambda z: z["p"] + z["m"]))
        each = F.zip_with(found, ends, lambda z, e: F.when(
            z["g"] >= rule.least,
            F.struct((e - z["m"]).alias("start"), F.lit(no).alias("no"), e.alias("end"), F.lit(rule.kind).alias("kind")),
        ))
        return F.array_compact(each)

    empty = F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")
    found = _let(_let(lengths(0), matches), spans)
    return F.when(wanted & F.coalesce(text.rlike(rule.pattern), F.lit(False)), F.coalesce(found, empty)).otherwise(empty)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, spans (array of start, no, end, kind by start and then the
    rule's place; code points, end exclusive), and the columns of ``docs`` named in ``keep``.

    A null text counts as empty. Rows that share an id are scanned each for itself; rows with a
    null id are kept and scanned. Empty tables give empty results. Whole texts of any length
    are scanned. No other column is looked at.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in keep if c != text_col], F.lit(0).alias("_")).alias("_kept"),
    )
    found = candidates(id_text(rows, text_col="_text"), rules).withColumnRenamed("doc_id", "_id")
    joined = rows.join(found, F.coalesce(rows["doc_id"], F.lit(0)) == found["_id"], "left")

    def wanted(rule: Rule) -> Column:
        return F.coalesce(F.array_contains("kinds", F.lit(rule.kind)), F.lit(False)) if rule.query else F.lit(True)

    each = [rule_spans(F.col("_text"), rule, no, wanted(rule)) for no, rule in enumerate(rules)]
    spans = F.array_sort(F.concat(*each))
    kept = [F.col("_text" if c == text_col else f"_kept.`{c}`").alias(c) for c in keep]
    return joined.select("doc_id", spans.alias("spans"), *kept)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every secret replaced by <kind>. Overlapping spans are taken as one, named
    after the first."""
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        more = F.when(fresh, F.array(before, F.concat(F.lit("<"), s["kind"], F.lit(">")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    def joined(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, step, add, joined)).otherwise(text)
