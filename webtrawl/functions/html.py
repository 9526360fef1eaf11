"""Field extraction from HTML text as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.functions.urls import _col, get_domain, is_https, with_resolved_url
from webtrawl.settings import META_TEXT_LIMIT

# The patterns that decide what counts as a title, description, language or link.
TITLE = r"(?i)<title[^>]*>([^<]*)</title>"
DESCRIPTION = (
    r"""(?i)<meta\s+[^>]*name=["']description["'][^>]*content=["']([^"']*)["']"""
)
DESCRIPTION_REVERSED = (
    r"""(?i)<meta\s+[^>]*content=["']([^"']*)["'][^>]*name=["']description["']"""
)
OG_TITLE = r"""(?i)<meta\s+[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']"""
OG_DESCRIPTION = (
    r"""(?i)<meta\s+[^>]*property=["']og:description["'][^>]*content=["']([^"']*)["']"""
)
LANG = r"""(?i)<html[^>]*\slang=["']([a-z]{2,3})["']"""
HREF = r"""(?i)href=["']([^"'#]+)"""
META_CHARSET = r"""(?i)<meta[^>]+charset=["']?([^"'\s;>]+)"""
# White space as a browser script sees it: ASCII blanks, NBSP, the Unicode spaces and the BOM.
BLANKS = (
    r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
)


def first_text(*values) -> Column:
    """The first value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(_col(v), F.lit("")) for v in values], F.lit(""))


def extract_title(html) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(_col(html), TITLE, 1), BLANKS, " "))


def extract_meta_description(html, limit: int | None = META_TEXT_LIMIT) -> Column:
    html = _col(html)
    # The first pattern wins whenever it matches, even when its content is empty.
    text = F.when(html.rlike(DESCRIPTION), F.regexp_extract(html, DESCRIPTION, 1)).otherwise(
        F.regexp_extract(html, DESCRIPTION_REVERSED, 1)
    )
    return text if limit is None else F.substring(text, 1, limit)


def extract_og_title(html) -> Column:
    return F.regexp_extract(_col(html), OG_TITLE, 1)


def extract_og_description(html, limit: int | None = META_TEXT_LIMIT) -> Column:
    text = F.regexp_extract(_col(html), OG_DESCRIPTION, 1)
    return text if limit is None else F.substring(text, 1, limit)


def extract_lang(html) -> Column:
    return F.regexp_extract(_col(html), LANG, 1)


def content_length(html) -> Column:
    """Length in UTF-16 code units; pure ASCII text needs no re-encoding."""
    html = _col(html)
    units = F.octet_length(F.encode(html, "UTF-16BE")) / 2
    return F.when(F.octet_length(html) == F.length(html), F.length(html)).otherwise(
        units.cast("int")
    )


def raw_links(html) -> Column:
    """Every ``href`` value of any tag, up to the quote or ``#``, in document order."""
    return F.regexp_extract_all(_col(html), F.lit(HREF), 1)


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per resolved http(s) link: the page's other columns, ``pos`` and ``link``.

    Duplicates and order are kept; ``pos`` counts every href, dropped ones included.
    """
    keep = [F.col(c) for c in pages.columns if c != html]
    hrefs = pages.select(*keep, F.posexplode(raw_links(html)).alias("pos", "href"))
    return (
        with_resolved_url(hrefs, url, "href", "link")
        .filter(F.col("link").isNotNull())
        .drop("href")
    )


def parse_page(
    pages: DataFrame, url: str = "url", html: str = "html", text_limit: int | None = META_TEXT_LIMIT
) -> DataFrame:
    """Page columns from the final URL and its HTML; other input columns pass through. The
    descriptions are cut to ``text_limit`` characters (None: whole)."""
    fields = (
        pages.withColumn("title", extract_title(html))
        .withColumn("metaDescription", extract_meta_description(html, text_limit))
        .withColumn("ogTitle", extract_og_title(html))
        .withColumn("ogDescription", extract_og_description(html, text_limit))
        .withColumn("lang", extract_lang(html))
        .withColumn("contentLength", content_length(html))
        .withColumn("domain", get_domain(url))
        .withColumn("https", is_https(url))
    )
    return fields.withColumn(
        "description", first_text("metaDescription", "ogDescription")
    ).drop(html)
