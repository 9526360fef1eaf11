"""URL rules as column expressions: hosts, origins, reference resolution, hashing.

A URL is taken apart as the public URL standard does it: blanks around it and line breaks in it
are dropped, backslashes count as slashes and missing slashes are made up for in the schemes of
the web, hosts are decoded and lower-cased, IPv4 hosts may be written in
octal, hexadecimal or fewer parts, IPv6 hosts are shortened, and ports must fit 16 bits. Plain
lower-case URLs take a short way. All of it stays inside the JVM; a malformed URL gives null or
an empty host, never an error. URLs are given as names of columns.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.functions.resolve import resolve_refs

# The schemes of the web and their default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

_PLAIN = r"^(https?)://([a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z][a-z0-9-]*)(?=[/?#]|$)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_WEB = r"(?s)^(?:https?|wss?|ftp):[/\\]*([^/\\?#]*)(.*)$"
_FILE = r"(?s)^file:[/\\]{2}([^/\\?#]*)(.*)$"
_OTHER = r"(?s)^[a-z][a-z0-9+.-]*://([^/?#]*)(.*)$"
_HOST_PORT = r"(?s)^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
_FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|]"
_FORBIDDEN_IN_NAMES = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"
_NUMBER = r"^([0-9]+|0[xX][0-9a-fA-F]*)$"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _named(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ipv4(name: str) -> str:
    """The dotted form of a name whose last label is a number; null if it is no address."""
    value = (
        "CAST(CASE WHEN p RLIKE '^0[xX][0-9a-fA-F]{1,15}$' THEN conv(substring(p, 3), 16, 10) WHEN p RLIKE '^0[xX]$' THEN '0'"
        " WHEN p RLIKE '^0[0-7]{1,20}$' THEN conv(p, 8, 10) WHEN p RLIKE '^(0|[1-9][0-9]{0,17})$' THEN p END AS BIGINT)"
    )
    total = "aggregate(transform(slice(v, 1, size(v) - 1), (p, i) -> p * element_at(array(16777216L, 65536L, 256L), i + 1)), element_at(v, -1), (a, p) -> a + p)"
    octets = ", ".join(f"CAST(shiftright(n, {k}) & 255 AS STRING)" for k in (24, 16, 8, 0))
    good = (
        "size(v) <= 4 AND forall(v, p -> p IS NOT NULL) AND forall(slice(v, 1, size(v) - 1), p -> p <= 255)"
        " AND element_at(v, -1) < element_at(array(4294967296L, 16777216L, 65536L, 256L), least(size(v), 4))"
    )
    shown = _named(total, "n", f"concat_ws('.', {octets})")
    labels = rf"split(regexp_replace({name}, r'\.$', ''), r'\.')"
    return _named(f"transform({labels}, p -> {value})", "v", f"CASE WHEN {good} THEN {shown} END")


def _ipv6(text: str) -> str:
    """The shortest form, in brackets, of an address without them; null if it is none."""
    dotted = r"r'(?<=:)((?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2}))$'"
    pair = lambda i: f"lower(hex(element_at(o, {i}) * 256 + element_at(o, {i + 1})))"
    octets = rf"transform(split(tail, r'\.'), x -> CAST(x AS INT))"
    in_hex = _named(octets, "o", f"CASE WHEN forall(o, x -> x <= 255) THEN concat({pair(1)}, ':', {pair(3)}) END")
    plain = _named(
        f"regexp_extract(t, {dotted}, 1)", "tail",
        f"CASE WHEN tail = '' THEN t ELSE concat(substring(t, 1, length(t) - length(tail)), {in_hex}) END",
    )
    side = lambda pattern: f"filter(split(regexp_extract(g, '{pattern}', 1), ':'), x -> x <> '')"
    # One gap at most, which stands for one group of zeros or more, and no other empty group.
    gapped = _named(
        f"named_struct('l', {side('^(.*?)::')}, 'r', {side('::(.*)$')})", "s",
        "CASE WHEN NOT g RLIKE ':::|::.*::|^:[^:]|[^:]:$' AND size(s.l) + size(s.r) < 8"
        " THEN concat(s.l, array_repeat('0', 8 - size(s.l) - size(s.r)), s.r) END",
    )
    groups = _named(plain, "g", f"CASE WHEN contains(g, '::') THEN {gapped} ELSE split(g, ':') END")
    runs = [rf"(?:^|(?<=[0-9a-f]):|^:)0(?::0){{{n - 1}}}(?::|$)" for n in range(8, 1, -1)]
    cuts = " ".join(f"WHEN j RLIKE '{run}' THEN regexp_replace(j, '^(.*?){run}(.*)$', '$1::$2')" for run in runs)
    joined = "array_join(transform(v, x -> regexp_replace(x, '^0+(?=.)', '')), ':')"
    short = _named(joined, "j", f"CASE {cuts} ELSE j END")
    good = "size(v) = 8 AND forall(v, x -> x RLIKE '^[0-9a-f]{1,4}$')"
    return _named(_named(f"lower({text})", "t", groups), "v", f"CASE WHEN {good} THEN concat('[', {short}, ']') END")


def _name(host: str) -> str:
    """A host name of the web in lower case, or its IPv4 address; null if it is neither."""
    decoded = f"CASE WHEN contains({host}, '%') THEN try_url_decode(replace({host}, '+', '%2B')) ELSE {host} END"
    last = r"element_at(split(regexp_replace(n, r'\.$', ''), r'\.'), -1)"
    return _named(
        f"lower({decoded})", "n",
        f"CASE WHEN n = '' OR n RLIKE r'{_FORBIDDEN_IN_NAMES}' THEN NULL WHEN {last} RLIKE '{_NUMBER}' THEN {_ipv4('n')} ELSE n END",
    )


def _parts_sql() -> str:
    """The parts of the URL ``{0}`` as one SQL expression. It is written as text, which the session
    reads in one go, because it is long."""
    raw = r"regexp_replace(regexp_replace({0}, r'^[\x00-\x20]+|[\x00-\x20]+$', ''), r'[\t\n\r]', '')"
    web = f"u.s IN ({', '.join(repr(x) for x in DEFAULT_PORTS)})"
    pattern = lambda group: (
        f"CASE WHEN {web} THEN regexp_extract(u.t, r'{_WEB}', {group}) WHEN u.s = 'file' THEN regexp_extract(u.t, r'{_FILE}', {group})"
        f" ELSE regexp_extract(u.t, r'{_OTHER}', {group}) END"
    )
    own_port = f"map({', '.join(f'{k!r}, {v!r}' for k, v in DEFAULT_PORTS.items())})"
    inside = r"regexp_extract(a.h, r'^\[(.*)\]$', 1)"
    host = (
        f"CASE WHEN NOT a.auth THEN '' WHEN startswith(a.h, '[') THEN {_ipv6(inside)}"
        f" WHEN a.h = '' AND NOT {web} THEN '' WHEN {web} OR u.s = 'file' THEN {_name('a.h')} WHEN NOT a.h RLIKE r'{_FORBIDDEN}' THEN a.h END"
    )
    local = "CASE WHEN u.s = 'file' AND q = 'localhost' THEN '' ELSE q END"
    port = f"CASE WHEN a.p <> '' AND a.p <> coalesce({own_port}[u.s], '') THEN a.p END"
    made = _named(
        host, "q",
        f"CASE WHEN q IS NOT NULL THEN named_struct('scheme', u.s, 'host', {local}, 'port', {port}, 'rest', a.rest) END",
    )
    good = "u.s <> '' AND a.good AND length(a.p) <= 5 AND (a.p = '' OR CAST(a.p AS INT) <= 65535) AND NOT (u.s = 'file' AND a.p <> '')"
    port_of = f"regexp_replace(regexp_extract(after, r'{_HOST_PORT}', 2), '^0+(?=.)', '')"
    has_authority = f"{web} OR (u.s = 'file' AND u.t RLIKE r'{_FILE}') OR u.t RLIKE r'{_OTHER}'"
    rest = f"CASE WHEN {has_authority} THEN {pattern(2)} ELSE substring(u.t, length(u.s) + 2) END"
    cut = _named(
        f"regexp_replace({pattern(1)}, '(?s)^.*@', '')", "after",
        f"named_struct('h', regexp_extract(after, r'{_HOST_PORT}', 1), 'p', {port_of}, 'good', after RLIKE r'{_HOST_PORT}', 'auth', {has_authority}, 'rest', {rest})",
    )
    scheme = f"lower(regexp_extract(r, '{_SCHEME}', 1))"
    split = _named(scheme, "s", "named_struct('s', s, 't', concat(s, substring(r, length(s) + 1)))")
    return _named(_named(raw, "r", split), "u", _named(cut, "a", f"CASE WHEN {good} THEN {made} END"))


_PARTS = _parts_sql()


def _sql(text: str, url: str) -> Column:
    """The expression ``text`` with ``{0}`` for the column named ``url``."""
    return F.expr(text.replace("{0}", url if re.fullmatch(r"\w+(\.\w+)*", url) else f"`{url}`"))


def url_parts(url: str) -> Column:
    """``scheme, host, port, rest`` of a URL, null if it is not valid. ``host`` is empty where the
    scheme has none; ``port`` is null if it is the scheme's own; ``rest`` starts after the port.

    Names with letters beyond ASCII are only lower-cased here; ``with_resolved_url`` of a URL on
    itself gives it the ASCII form. Names that are given as ``xn--`` are not checked.
    """
    plain = (
        f"named_struct('scheme', regexp_extract({{0}}, r'{_PLAIN}', 1), 'host', regexp_extract({{0}}, r'{_PLAIN}', 2),"
        " 'port', CAST(NULL AS STRING), 'rest', regexp_replace({0}, '^[a-z]+://[^/?#]*', ''))"
    )
    return _sql(rf"CASE WHEN {{0}} RLIKE r'{_PLAIN}[^\x00-\x20\\]*$' THEN {plain} ELSE {_PARTS} END", url)


def url_host(url: str) -> Column:
    """The host without port or user info; null when the URL is not valid, '' if it has none."""
    return _sql(f"CASE WHEN {{0}} RLIKE r'{_PLAIN}' THEN regexp_extract({{0}}, r'{_PLAIN}', 2) ELSE ({_PARTS}).host END", url)


def get_host(url: str) -> Column:
    """Host without port or user info; '' when the URL is not valid."""
    return F.coalesce(url_host(url), F.lit(""))


def strip_www(host) -> Column:
    """Remove the first ``www.`` wherever it stands."""
    return F.regexp_replace(_col(host), r"^(.*?)www\.", "$1")


def get_domain(url) -> Column:
    return strip_www(get_host(url))


def get_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), _SCHEME, 1))


def get_origin(url: str) -> Column:
    """Scheme, host and any non-default port; '' when the URL is not valid or its scheme is none
    of the web's."""
    web = ", ".join(repr(x) for x in DEFAULT_PORTS)
    origin = _named(_PARTS, "o", f"CASE WHEN o.scheme IN ({web}) THEN concat(o.scheme, '://', o.host, coalesce(concat(':', o.port), '')) END")
    return _sql(f"coalesce(CASE WHEN {{0}} RLIKE r'{_PLAIN}' THEN regexp_extract({{0}}, r'{_PLAIN}', 0) ELSE {origin} END, '')", url)


def get_path(url: str) -> Column:
    """The path of a URL of the web, with slashes for backslashes; '/' when it is empty or the URL
    is not valid. Dot segments stay."""
    path = F.translate(F.regexp_extract(url_parts(url)["rest"], r"^([^?#]*)", 1), "\\", "/")
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))


def standard_places(url: str) -> tuple[Column, Column, Column]:
    """Domain, origin and path of http and https URLs that are in the standard's form already, as
    resolved links are; patterns are enough for these."""
    host = r"\[[0-9a-f:]+\]|[^/:?#]*"
    start = r"^(https?://)(?:[^/?#@]*@)?"
    origin = F.concat(F.regexp_extract(url, start, 1), F.regexp_extract(url, rf"{start}((?:{host})(?::[0-9]+)?)", 2))
    return strip_www(F.regexp_extract(url, rf"{start}({host})", 2)), origin, F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)


def is_https(url) -> Column:
    return F.coalesce(F.startswith(_col(url), F.lit("https")), F.lit(False)).cast("int")


def host_suffixes(host) -> Column:
    """``a.b.c`` gives ``[a.b.c, b.c, c]``."""
    labels = F.split(_col(host), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )


def is_blacklisted(url, blocklist) -> Column:
    """True when the host or one of its parent domains is listed, or the URL is not valid.

    ``blocklist`` is a short Python list; use ``drop_blacklisted`` for a list held in a table.
    """
    listed = F.exists(host_suffixes(strip_www(url_host(url))), lambda s: s.isin(list(blocklist)))
    return F.coalesce(listed, F.lit(True))


def domain_partition(url, partitions: int = 6) -> Column:
    """Partition number from the 31-multiplier int32 hash of the raw host; 0 if invalid."""
    span, half = 1 << 32, 1 << 31
    code = F.aggregate(
        F.split(get_host(url), ""),
        F.lit(0).cast("long"),
        lambda acc, c: F.pmod(acc * 31 + F.ascii(c), F.lit(span)),
    )
    signed = F.when(code >= half, code - span).otherwise(code)
    return (F.abs(signed) % partitions).cast("int")


# ---------------------------------------------------------------- reference resolution

# References that need no rewriting: a clean path from the root, or a clean absolute URL
# with a path, both without dot segments.
_CLEAN = r"(?!.*/(\.|%2[eE]))[A-Za-z0-9_~!$&()*+,;=:@%/.-]*(\?[A-Za-z0-9_~!$&()*+,;=:@%/.?-]*)?$"
_CLEAN_ROOTED = rf"^/(?!/){_CLEAN}"
_CLEAN_ABSOLUTE = rf"^https?://[a-z0-9._-]+(?=/){_CLEAN}"


def with_resolved_url(df: DataFrame, base: str, ref: str, out: str = "link") -> DataFrame:
    """Add ``out``: the absolute http(s) URL that ``ref`` names on the page ``base``.

    Null when the reference is not valid or leads to another scheme. Clean references, the
    common case, are put together in the JVM; only the others are handed to Python, in Arrow
    batches.
    """
    origin = F.regexp_extract(base, _PLAIN, 0)
    rooted = F.col(ref).rlike(_CLEAN_ROOTED) & (origin != "")
    absolute = F.col(ref).rlike(_CLEAN_ABSOLUTE)
    simple = F.when(rooted, F.concat(origin, F.col(ref))).when(absolute, F.col(ref))
    staged = df.withColumn("_simple_", simple)
    hard = F.col("_simple_").isNull()
    slow = resolve_refs(F.when(hard, F.col(base)), F.when(hard, F.col(ref)))
    resolved = F.coalesce("_simple_", slow)
    return staged.withColumn(out, resolved).drop("_simple_")
