"""URL rules, HTML fields and responses on literal rows."""

import urllib.parse

from pyspark.sql import functions as F

from webtrawl.functions import urls as u
from webtrawl.functions.html import extract_links, parse_page
from webtrawl.functions.resolve import resolve
from webtrawl.operators.pages import (
    classify_response,
    decode_body,
    filter_sites,
    follow_redirects,
    result_view,
    to_index_docs,
)
from webtrawl.settings import BLOCKLIST, SEED_LANGS, SEED_TOPICS


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_domains(spark):
    cases = {
        "https://www.example.com/page": "example.com",
        "https://en.wikipedia.org/wiki/Test": "en.wikipedia.org",
        "not-a-url": "",
        "https://foo.www.awww.b.com/": "foo.awww.b.com",
        "HTTPS://User:p@WWW.Ex.COM:8080/a": "ex.com",
        "http://a b.com/": "",
        "mailto:x@y.z": "",
        "http://under_score.com/x|y z": "under_score.com",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "url string")
    got = dict(values(df, "url", u.get_domain("url")))
    assert got == {**cases, None: ""}


def test_origin_path_https(spark):
    rows = [("https://A.com:443/x/y?q#f",), ("http://a.com:8080",), ("http://a.com:80/",), ("bad",)]
    df = spark.createDataFrame(rows, "url string")
    assert values(df, u.get_origin("url"), u.get_path("url"), u.is_https("url")) == [
        ("https://a.com", "/x/y", 1), ("http://a.com:8080", "/", 0), ("http://a.com", "/", 0),
        ("", "/", 0),
    ]


def test_blacklist(spark):
    listed = ["https://facebook.com/a", "https://www.instagram.com", "http://twitter.com/x",
              "https://ad.doubleclick.net/", "not-a-url", "https://a.x.com"]
    free = ["https://example.com", "https://github.com/x", "https://netflix.com"]
    df = spark.createDataFrame([(x,) for x in listed + free], "url string")
    got = dict(values(df, "url", u.is_blacklisted("url", BLOCKLIST)))
    assert all(got[x] for x in listed) and not any(got[x] for x in free)
    assert len(BLOCKLIST) == 42 and len(SEED_LANGS) == 28 and len(SEED_TOPICS) == 106


def test_hosts_of_the_url_standard(spark):
    cases = {
        "http://[2001:db8::1]/a": "[2001:db8::1]", "https:\\\\a.com\\b": "a.com", "http:/a.com/x": "a.com",
        "  http://a.com": "a.com", "http:a.com": "a.com", "http://a.com:abc/": None, "http://a.com:99999": None,
        "http://a.com:65535": "a.com", "http://a.com:/": "a.com", "http://a.com:00080/": "a.com", "http://": None,
        "http:///a": "a", "http://a b/": None, "http://a%20b/": None, "http://%41.com": "a.com", "http://a%zz/": None,
        "http://user@pw@A.b:1/": "a.b", "http://[::1": None, "http://[::1]x/": None, "http://[1:2]": None,
        "http://[0:0:1:0:0:0:0:2]": "[0:0:1::2]", "http://[1:0:0:2:0:0:3:4]:8": "[1::2:0:0:3:4]",
        "http://[::ffff:1.2.3.4]": "[::ffff:102:304]", "http://[::1.2.3.400]": None, "http://[::01.2.3.4]": None,
        "http://[1:2:3:4:5:6:7::]": "[1:2:3:4:5:6:7:0]", "http://[1::2::3]": None, "http://[:1::2]": None, "http://[::]": "[::]",
        "http://[1:2:3:4:5:6:7:8:9]": None, "http://[ABCD::00F]": "[abcd::f]", "http://[12345::]": None, "http://[1:2:3:4:5:6:7:]": None,
        "http://0x7f.1": "127.0.0.1", "http://2130706433/": "127.0.0.1", "http://017700000001": "127.0.0.1",
        "http://1.2.3.4.": "1.2.3.4", "http://256.1": None, "http://1.256": "1.0.1.0", "http://1.2.3.08": None, "http://1.2.3.4.5": None,
        "http://4294967296": None, "http://a.0x": None, "http://a.1b": "a.1b", "http://1.2.3.4a": "1.2.3.4a", "http://0x.0x": "0.0.0.0",
        "http://99999999999999999999999": None, "http://M\u00dcnchen.de/": "m\u00fcnchen.de", "ht\ntp://a.com": "a.com",
        "file:///etc": "", "file://localhost/x": "", "file://Srv/x": "srv", "mailto:x@y": "", "foo://Ab:5/": "Ab", "foo://a b/": None,
        "//a.com": None, "a.com": None, "": None, "1http://a.com": None, "wss://A.com:443": "a.com", "http://a<b": None, "foo://": "",
        "http://a.com\\@b.com": "a.com", "http://a..b": "a..b", "http://.": ".", "http://a^b": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    got = dict(values(df, "url", u.url_host("url")))
    assert {k: (v, got[k]) for k, v in cases.items() if got[k] != v} == {}
    listed = dict(values(df, "url", u.is_blacklisted("url", ["a.com", "1]"])))
    assert all(listed[k] == (v is None or v == "a.com") for k, v in cases.items())


def test_resolved_hosts_are_in_the_standard_form(spark):
    cases = {
        "http://M\u00dcNCHEN.de/": "http://xn--mnchen-3ya.de/", "http://fa\u00df.de": "http://xn--fa-hia.de/", "http://\u2168.com": "http://ix.com/",
        "http://a\u3002b": "http://a.b/", "http://\uff45x.com": "http://ex.com/", "http://\u0301a.com": None, "http://b\u00fccher\u00ad.de/x": "http://xn--bcher-kva.de/x",
        "http://\U0001f600.la": "http://xn--e28h.la/", "http://[2001:DB8::0:1]:80/a": "http://[2001:db8::1]/a", "http://[::ffff:1.2.3.4]": "http://[::ffff:102:304]/",
        "http://[1:0:0:2:0:0:3:4]:8": "http://[1::2:0:0:3:4]:8/", "http://[::1%25e]": None, "http://[::g]": None, "http://0x7f.1:080": "http://127.0.0.1/",
        "https://2130706433": "https://127.0.0.1/", "http://256.1": None, "http://1.2.3.08": None, "http://%41.com": "http://a.com/", "http://a%zz": None,
        "http:/a.com/x": "http://a.com/x", "https:\\\\a.com\\b": "https://a.com/b", "http://a b/": None, "http://a:99999": None, "http://a.com:/": "http://a.com/",
    }
    df = spark.createDataFrame([(k, "ftp://x") for k in cases], "ref string, base string")
    got = dict(values(u.with_resolved_url(df, "base", "ref", "link"), "ref", "link"))
    assert {k: (v, got[k]) for k, v in cases.items() if got[k] != v} == {}


def test_places_of_resolved_links(spark):
    links = ["http://a.com/", "https://www.a.com:8080/x/y?q#f", "http://u:p@[2001:db8::1]:81/z", "https://b.org/?a@b", "http://10.0.0.1/p"]
    df = spark.createDataFrame([(x,) for x in links], "url string")
    full = df.select(u.get_domain("url"), u.get_origin("url"), u.get_path("url")).collect()
    assert df.select(*u.standard_places("url")).collect() == full


def test_url_parts_can_be_grouped_and_counted(spark):
    df = spark.createDataFrame([("http://a.com/1",), ("http:/A.com",), ("bad",)], "url string")
    assert df.agg(F.count_distinct(u.get_origin("url")), F.count_distinct(u.url_host("url"))).first() == (2, 1)


def test_origins_of_the_url_standard(spark):
    cases = {
        "http:\\\\A.com:80\\x": "http://a.com", "ws://a.com:81/": "ws://a.com:81", "ftp://u@a.com:21": "ftp://a.com",
        "https://[::1]:0443": "https://[::1]", "file:///x": "", "foo://a": "", "http://a.com:66000": "", "https://a:000": "https://a:0",
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert dict(values(df, "url", u.get_origin("url"))) == cases
    paths = {"http:/a.com\\b\\c?d": "/b/c", "http://a.com?x": "/", "http://[::1]/p#q": "/p", "bad": "/"}
    df = spark.createDataFrame([(k,) for k in paths], "url string")
    assert dict(values(df, "url", u.get_path("url"))) == paths


def test_domain_partition(spark):
    df = spark.createDataFrame([("https://en.wikipedia.org/x",), ("nope",)], "url string")
    assert values(df, u.domain_partition("url")) == [(2,), (0,)]


def test_resolve_against_standard_library():
    base = "https://e.com/d/e/"
    expected = {
        "../a?x=1#f": "https://e.com/d/a?x=1#f", "//h.com/b": "https://h.com/b",
        "?q=2": "https://e.com/d/e/?q=2", "mailto:x@y.z": None, "http://H.com:80": "http://h.com/",
        "/a b|c": "https://e.com/a%20b|c", "x/../../y": "https://e.com/d/y", ".": "https://e.com/d/e/",
        "https:z": "https://e.com/d/e/z", "http://a_b.com:99/": "http://a_b.com:99/",
        "http://bad host/": None, "javascript:void(0)": None, "\\\\w.com\\p": "https://w.com/p",
        "http://x.com:70000/": None, "/%2e%2e/k": "https://e.com/k", "é": "https://e.com/d/e/%C3%A9",
        "http://bücher.de/": "http://xn--bcher-kva.de/",
    }
    assert {r: resolve(base, r) for r in expected} == expected
    for ref in ["a", "a/b", "../x", "../../x/y", "/r", "?k", "b/./c/../d", "a;b=1"]:
        joined = urllib.parse.urljoin(base, ref)
        assert resolve(base, ref) == joined


def test_links(spark):
    html = (
        '<a href="../a?x=1#f"><link HREF=\'//h.com/b\'><a href="?q=2"><a href="mailto:x@y.z">'
        '<a href="#top"><a href="/page1"><a href="https://other.com/page2"><a href="/page1">'
    )
    df = spark.createDataFrame([("https://e.com/d/e/", html)], "url string, html string")
    assert [r.link for r in extract_links(df).orderBy("pos").collect()] == [
        "https://e.com/d/a?x=1", "https://h.com/b", "https://e.com/d/e/?q=2",
        "https://e.com/page1", "https://other.com/page2", "https://e.com/page1",
    ]


def test_fast_and_slow_resolution_agree(spark):
    refs = ["/a", "/a.b/c.html?x=/..", "/a/./b", "/a/../b", "//x.y/z", "https://x.com/a-b_c",
            "https://X.com/a", "http://x.com", "http://x.com:80/a", "/ü", "/a?b c", "/.hidden"]
    df = spark.createDataFrame([("https://e.com:444/p", r) for r in refs], "b string, r string")
    for row in u.with_resolved_url(df, "b", "r", "link").collect():
        assert row.link == resolve(row.b, row.r), row


def test_parse_page(spark):
    nbsp, astral = chr(0xA0), chr(0x1F600)
    pages = {
        "<title>Test Page</title>": {"title": "Test Page"},
        "<p>": {"title": "", "lang": "", "description": ""},
        f"<TITLE a=b> a{nbsp}\n b </title>": {"title": "a b"},
        '<meta name="description" content="A test page">': {"metaDescription": "A test page"},
        "<meta content='A test page' name='description'>": {"metaDescription": "A test page"},
        '<meta property="og:title" content="OG Title">': {"ogTitle": "OG Title"},
        '<meta content="OG Title" property="og:title">': {"ogTitle": ""},
        '<meta property="og:description" content="od">': {"description": "od", "metaDescription": ""},
        '<meta name="description" content=""><meta content="z" name="description">': {
            "metaDescription": ""},
        '<html lang="ru">': {"lang": "ru"},
        '<html lang="en-US">': {"lang": ""},
        f"x{astral}": {"contentLength": 3},
        f'<meta name="description" content="{"k" * 1500}">': {"metaDescription": "k" * 1000},
    }
    df = spark.createDataFrame(
        [("https://www.e.com/", h, h) for h in pages], "url string, html string, src string"
    )
    for row in parse_page(df).collect():
        assert row.domain == "e.com" and row.https == 1
        for name, value in pages[row.src].items():
            assert row[name] == value, (row.src, name)


def test_classify(spark):
    rows = [(302, "", "/x", "redirect"), (302, "text/html", None, "page"),
            (503, "text/html", None, "error:HTTP 503"), (404, "Text/HTML", None, "page"),
            (200, "application/json", None, "error:not HTML"), (200, None, None, "error:not HTML"),
            (200, "application/xhtml+xml", None, "page")]
    df = spark.createDataFrame(rows, "s int, c string, l string, want string")
    assert all(a == b for a, b in values(df, classify_response("s", "c", "l"), "want"))


def test_redirects(spark):
    chain = [(f"http://a/{i}", 301, None, f"/{i + 1}") for i in range(7)]
    rows = chain + [("http://a/7", 200, "text/html", None), ("http://b/", 301, None, "http://gone/")]
    df = spark.createDataFrame(rows, "url string, status int, content_type string, location string")
    got = {r.origUrl: (r.finalUrl, r.outcome) for r in follow_redirects(df).collect()}
    assert got["http://a/2"] == ("http://a/7", "page")
    assert got["http://a/1"][1] == "error:redirects" and got["http://a/7"] == ("http://a/7", "page")
    assert got["http://b/"] == ("http://gone/", "error:not fetched") and len(got) == 9


def test_decode(spark):
    text = "<meta charset=windows-1251>Привет"
    rows = [
        (1, text.encode("cp1251"), "text/html"), (2, "é".encode(), "text/html; charset=UTF-8"),
        (3, b"\x80 \xe9", 'text/html; charset="iso-8859-1"'), (4, b"ok\xff", "text/html"),
        (5, "é".encode(), "text/html; charset=nonsense"), (6, b"abcdef", "text/html"),
    ]
    df = spark.createDataFrame(rows, "id int, body binary, ct string")
    got = {r.id: r.html for r in decode_body(df, "body", "ct", max_bytes=4 << 10).collect()}
    replaced = chr(0xFFFD)
    assert got == {1: text, 2: "é", 3: "€ é", 4: f"ok{replaced}", 5: "é", 6: "abcdef"}
    short = decode_body(df.filter("id = 6"), "body", "ct", max_bytes=3).first().html
    assert short == "abc"


def test_index_docs_and_views(spark):
    import base64

    url = "https://e.com/" + "x" * 600
    df = spark.createDataFrame(
        [(url, None, "", "meta", None, "og", "e.com", None, 1, None, None, None)],
        "url string, title string, description string, metaDescription string, ogTitle string, "
        "ogDescription string, domain string, lang string, https int, popularity int, depth int, "
        "crawled_at long",
    )
    row = to_index_docs(df, 5).first()
    assert row["_id"] == base64.b64encode(url.encode()).decode()[:512]
    assert (row.metaDescription, row.https, row.popularity, row.timestamp) == ("meta", True, 0, 5)
    view = result_view(df).first()
    assert view.view_title == url and view.snippet == "meta"
    assert filter_sites(df, "E.CO").count() == 1 and filter_sites(df, "zzz").count() == 0
    assert filter_sites(df, "").count() == 1
