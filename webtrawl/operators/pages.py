"""Responses and page records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtrawl.functions.html import META_CHARSET, first_text
from webtrawl.functions.urls import _col, with_resolved_url
from webtrawl.plans.staging import stage
from webtrawl.settings import DOC_ID_LIMIT, MAX_BODY_BYTES, MAX_REDIRECTS


def read_pages(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Final URL and HTML text of fetched pages."""
    return df.select(F.col(url).alias("url"), F.col(html).alias("html"))


def classify_response(status, content_type, location) -> Column:
    """``redirect``, ``error:HTTP n``, ``error:not HTML`` or ``page`` (4xx HTML included)."""
    status, location = _col(status), _col(location)
    kind = F.lower(F.coalesce(_col(content_type), F.lit("")))
    return (
        F.when(
            status.between(300, 399) & (F.coalesce(location, F.lit("")) != ""), "redirect"
        )
        .when(status >= 500, F.concat(F.lit("error:HTTP "), status.cast("string")))
        .when(~kind.contains("text/html") & ~kind.contains("xhtml"), "error:not HTML")
        .otherwise("page")
    )


def header_charset(content_type) -> Column:
    kind = F.lower(F.coalesce(_col(content_type), F.lit("")))
    found = F.regexp_replace(F.regexp_extract(kind, r"charset=([^\s;]+)", 1), "[\"']", "")
    return F.when(found == "", "utf-8").otherwise(found)


# Labels that web clients decode with the Windows variant of the charset.
_WINDOWS_LABELS = {"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252",
                   "us-ascii": "cp1252", "iso-8859-9": "cp1254", "gb2312": "gbk"}


@F.pandas_udf(T.StringType())
def _decode(body, charset):
    """Text of each body; null without a body or for a charset that is not known."""
    import codecs

    import pandas as pd

    def one(data, label):
        if data is None:
            return None
        name = _WINDOWS_LABELS.get(label.lower(), label)
        try:
            codecs.lookup(name)
        except LookupError:
            return None
        return bytes(data).decode(name, errors="replace")

    return pd.Series([one(*row) for row in zip(body, charset)], dtype=object)


def decode_body(
    df: DataFrame, body: str, content_type: str, out: str = "html", max_bytes: int | None = MAX_BODY_BYTES
) -> DataFrame:
    """Add ``out``: the body text, decoded by header charset, then by the ``<meta>`` charset.

    UTF-8 bodies, nearly all, are decoded in the JVM; Python gets a body only when another
    charset is named. An unknown charset falls back to UTF-8 (header) or to the header's text
    (meta). One pass over the table.
    """
    utf8_names = ["utf-8", "utf8"]
    data, label = F.col("_data_"), F.col("_label_")
    prepared = (
        df.withColumn("_data_", F.col(body) if max_bytes is None else F.substring(body, 1, max_bytes))
        .withColumn("_label_", header_charset(content_type))
        .withColumn("_utf8_", F.make_valid_utf8(data.cast("string")))
    )
    by_header = _decode(F.when(~label.isin(utf8_names), data), label)
    first = prepared.withColumn("_first_", F.coalesce(by_header, "_utf8_")).withColumn(
        "_meta_", F.regexp_extract("_first_", META_CHARSET, 1)
    )
    meta = F.col("_meta_")
    differs = (meta != "") & (meta != label)
    meta_utf8 = F.lower(meta).isin(utf8_names)
    by_meta = _decode(F.when(differs & ~meta_utf8, data), meta)
    text = F.when(differs & meta_utf8, F.col("_utf8_")).otherwise(F.coalesce(by_meta, "_first_"))
    return first.withColumn(out, text).drop("_data_", "_label_", "_utf8_", "_first_", "_meta_")


def follow_redirects(responses: DataFrame, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """Final response for every URL: ``origUrl``, ``finalUrl``, ``hops``, ``outcome``.

    ``responses`` has one row per url with status, content_type and location. A missing
    target is ``error:not fetched``; a redirect after ``max_hops`` hops is ``error:redirects``.
    Each hop joins only the rows that still move; they are staged per hop.
    """
    base = responses.withColumn("_kind_", classify_response("status", "content_type", "location"))
    absolute = F.startswith("location", F.lit("http"))
    resolved = with_resolved_url(
        base.filter(F.col("_kind_") == "redirect"), "url", "location", "_resolved_"
    ).withColumn("_target_", F.when(absolute, F.col("location")).otherwise(F.col("_resolved_")))
    table = base.filter(F.col("_kind_") != "redirect").select(
        "url", F.col("_kind_").alias("kind"), F.lit(None).cast("string").alias("target")
    ).unionByName(
        resolved.select("url", F.col("_kind_").alias("kind"), F.col("_target_").alias("target"))
    )
    table = stage(table, "responses")
    lookup = table.select(
        F.col("url").alias("_key_"), F.col("kind").alias("_next_kind_"),
        F.col("target").alias("_next_target_"),
    )
    done = None
    moving = table.select(
        F.col("url").alias("origUrl"), F.col("url").alias("finalUrl"), "kind", "target",
        F.lit(0).alias("hops"),
    )
    for hop in range(max_hops + 1):
        settled = moving.filter(F.col("kind") != "redirect").select(
            "origUrl", "finalUrl", "hops", F.col("kind").alias("outcome")
        )
        done = settled if done is None else done.unionByName(settled)
        moving = moving.filter(F.col("kind") == "redirect")
        if hop == max_hops or moving.isEmpty():
            break
        moving = stage(
            moving.join(lookup, moving["target"] == lookup["_key_"], "left").select(
                "origUrl",
                F.coalesce("target", "finalUrl").alias("finalUrl"),
                F.coalesce("_next_kind_", F.lit("error:not fetched")).alias("kind"),
                F.col("_next_target_").alias("target"),
                F.lit(hop + 1).alias("hops"),
            ),
            "redirects",
        )
    stuck = moving.select("origUrl", "finalUrl", "hops", F.lit("error:redirects").alias("outcome"))
    return done.unionByName(stuck)


def to_index_docs(page_data: DataFrame, now_ms) -> DataFrame:
    """Search-index documents from page records; absent values become '', 0 or ``now_ms``."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    encoded = F.regexp_replace(F.base64(F.encode("url", "UTF-8")), "[\r\n]", "")
    content = blank("content") if "content" in page_data.columns else F.lit("")
    return page_data.select(
        F.substring(encoded, 1, DOC_ID_LIMIT).alias("_id"),
        "url",
        blank("title").alias("title"),
        first_text("description", "metaDescription").alias("metaDescription"),
        blank("ogTitle").alias("ogTitle"),
        blank("ogDescription").alias("ogDescription"),
        blank("domain").alias("domain"),
        content.alias("content"),
        blank("lang").alias("lang"),
        F.coalesce(F.col("https") == 1, F.lit(False)).alias("https"),
        F.coalesce(F.col("popularity"), F.lit(0)).alias("popularity"),
        F.coalesce(F.col("depth"), F.lit(0)).alias("depth"),
        F.coalesce(F.nullif(F.col("crawled_at"), F.lit(0).cast("long")), F.lit(now_ms)).alias(
            "timestamp"
        ),
    )


def result_view(hits: DataFrame, words=None) -> DataFrame:
    """Display title and snippet of each hit, highlighted when ``words`` is given."""
    from webtrawl.functions.text import highlight
    from webtrawl.settings import SNIPPET_LIMIT

    title = first_text("title", "ogTitle", "url")
    snippet = F.substring(first_text("metaDescription", "ogDescription"), 1, SNIPPET_LIMIT)
    if words is not None:
        title, snippet = highlight(title, words), highlight(snippet, words)
    return hits.withColumn("view_title", title).withColumn("snippet", snippet)


def filter_sites(nodes: DataFrame, text: str) -> DataFrame:
    """Rows whose domain or title contains ``text``, whatever the case; '' keeps all."""
    wanted = text.lower()
    if not wanted:
        return nodes
    return nodes.filter(
        F.contains(F.lower("domain"), F.lit(wanted))
        | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(wanted))
    )
