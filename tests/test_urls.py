"""URL features against the case tables and against Python's own URL parser."""

import ipaddress
from urllib.parse import parse_qs, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from lureline import fixed_values as V
from lureline.functions import urls as U
from lureline.operators import pages as P

BRAND = {
    0: ["google.com", "www.google.com", "accounts.google.com", "mail.google.com", "drive.google.com", "amazon.com",
        "www.amazon.com", "aws.amazon.com", "smile.amazon.com", "paypal.com", "www.paypal.com", "business.paypal.com",
        "example.com", "test.org", "mywebsite.net", "random-domain.co.uk"],
    1: ["paypal-verify.com", "secure-paypal.com", "paypal-login.tk", "google-login.net", "amazon-account.com",
        "verify-amazon.org", "facebook-security.info", "apple-support-center.com", "paypa1.com", "g00gle.com",
        "amaz0n.com", "micros0ft.com", "paypai.com", "gooogle.com"],
}
AWKWARD = [
    "http://u@a.com:80/x;p?a=1&a=2&b=", "http://a/b;c/d;e;f", "http://x.com", "http://x.com?", "http://x.com#f?g",
    "HTTPS://X.com/A", "//h/p", "mailto:a@b", "a:b", "http:///p", "http://x/?a=b?c=d", "http://a b/c d", "x/y;z?q",
    "http://x.com/%zz?%41=1&b=%20&+c=+&d", "http://x.com/?a&=1&b=2&b=3&c==", "javascript:void(0)", "http://x;y.com/z",
    "http://ä.de/ü", "1http://x", "http://x.com/a//b/", "http://a.b.c.d.e/", "http://-/_~",
]


def rows(spark, values, **columns):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return df.select("v", *[c(F.col("v")).alias(n) for n, c in columns.items()]).collect()


def test_brand_rule(spark):
    for expected, hosts in BRAND.items():
        for r in rows(spark, hosts, b=U.embedded_brand):
            assert r.b == expected, r.v


@pytest.mark.parametrize("function,cases", [
    (U.count_dots, {"http://example.com": 1, "http://www.example.com": 2, "http://sub.domain.example.com": 3,
                    "http://a.b.c.d.com": 4}),
    (U.subdomain_level, {"example.com": 0, "www.example.com": 1, "mail.google.com": 1, "sub1.sub2.example.com": 2,
                         "a.b.c.example.com": 3}),
    (U.path_level, {"/": 0, "/login": 1, "/account/settings": 2, "/users/profile/edit": 3, "": 0}),
    (U.is_ip, {"192.168.1.1": 1, "127.0.0.1": 1, "10.0.0.1": 1, "example.com": 0, "www.google.com": 0, "invalid.ip": 0}),
    (lambda u: U.url_length_rt(F.length(u)), {
        "http://short.com": -1, "http://medium-length-url-that-is-somewhat-longish.org": 0,
        "http://very-long-url-that-exceeds-the-threshold-and-keeps-going-on-and-on.com": 1}),
    (lambda h: U.subdomain_level_rt(U.subdomain_level(h)), {
        "example.com": -1, "www.example.com": -1, "a.b.example.com": 0, "a.b.c.example.com": 0, "a.b.c.d.example.com": 1}),
])
def test_case_tables(spark, function, cases):
    assert {r.v: r.x for r in rows(spark, cases, x=function)} == cases


def test_parts_equal_python(spark):
    for r in rows(spark, AWKWARD, host=U.netloc, path=U.path, query=U.query, scheme=U.scheme):
        p = urlparse(r.v)
        assert (r.scheme, r.host, r.path, r.query) == (p.scheme, p.netloc, p.path, p.query), r.v


def test_query_components_equal_python(spark):
    queries = ["a=1&a=2&b=", "a", "", "a=b=c&d=", "%41=1&A=2", "a+b=1&a%20b=2", "&&x=1", "x=1;y=2", "=1&=2",
               "a%41%zz=1&aA%zz=2", "%=1&%25=2", "%4=1&%4%34=2", "%%41=1&%A=2", "%c3%a9=1&\u00e9=2"]
    for r in rows(spark, queries, n=U.query_components):
        assert r.n == len(parse_qs(r.v)), r.v


def test_authorities_that_cannot_be_parsed_equal_python(spark):
    hosts = ["a.com", "[bad]", "[::1]", "[::1]:80", "u@[::1]:80", "[::1]x", "x[::1]", "[v1.a]", "[v1.]", "[vx.a]", "[1.2.3.4]", "[", "]", "][",
             "[::1", "u[]@a.com", "a\u2100b.com", "a\uff0fb.com", "\u00e9.com", "a\uff1ab", "\uff20", "b\u00fccher.de", "[fe80::1%25eth0]", ""]

    def fine(h):
        try:
            urlparse(f"http://{h}/x")
            return True
        except ValueError:
            return False

    assert {r.v: r.x for r in rows(spark, hosts, x=U.parses)} == {h: fine(h) for h in hosts}


def test_ip_literals_equal_python(spark):
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
             "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4",
             "fe80::1%eth0", "fe80::1%", "12345::", ":::", "1:2:3:4:5:6:7:8:9", "g::1", "1::5:1.2.3.4", "::1.2.3.400"]

    def known(t):
        try:
            ipaddress.ip_address(t)
            return 1
        except ValueError:
            return 0

    assert {r.v: r.x for r in rows(spark, texts, x=U.is_ip)} == {t: known(t) for t in texts}


def test_whole_vector(spark):
    cases = ["https://www.google.com", "http://paypa1-verify.suspicious.com/login", "", "not-a-url", "://invalid",
             "ht tp://broken.com", "http://[bad", "HTTPS://x.com", "http://[bad]/x", "http://a\u2100b.com/x"]
    df = spark.createDataFrame([(c,) for c in cases], "url string")
    got = {r.url: r.features for r in P.feature_vector(df, "url", None).collect()}
    assert all(len(v) == 48 for v in got.values())
    assert got[cases[0]][14] == 0 and got[cases[0]][25] == 0
    assert got[cases[1]][14] == 1 and got[cases[1]][25] == 1 and got[cases[1]][1] > 0
    assert all(got[u] == [0.0] * 48 for u in ("http://[bad", "http://[bad]/x", "http://a\u2100b.com/x"))
    assert got["HTTPS://x.com"][14] == 1
    assert len(V.FEATURE_NAMES) == len(set(V.FEATURE_NAMES)) == 48


def test_tagger_edges(spark):
    cases = ["http://192.168.1.1:8080/", "https://microsoft.com", "http://localhost/a.info.html", "google.com//x"]
    df = spark.createDataFrame([(c,) for c in cases], "url string")
    got = {r.url: r.f for r in df.select("url", U.tagger_url_features(F.col("url")).alias("f")).collect()}
    assert got[cases[0]].has_ip == 1 and got[cases[0]].port_in_url == 1
    assert got[cases[1]].shortening_service == 1
    assert got[cases[2]].subdomain_count == -1 and got[cases[2]].suspicious_tld == 1
    assert got[cases[3]].double_slash_redirect == 1 and got[cases[3]].subdomain_count == 0
    strict = df.select(U.tagger_url_features(F.col("url"), host_only=True).alias("f")).collect()
    assert [r.f.shortening_service for r in strict] == [0, 0, 0, 0]
    assert [r.f.suspicious_tld for r in strict] == [0, 0, 0, 0]


def test_absolute_links_equal_python(spark):
    links = ["/a", "b/c", "../x", "./y", "?q=1", "#f", "//h.com/p", "http://z.com", "mailto:a@b", "a/../b", "/a/./b/..", "x y"]
    bases = ["http://h.com/d/e?k=v", "https://h.com", "http://h.com/d/"]
    df = spark.createDataFrame([(b, t) for b in bases for t in links], "b string, t string")
    for r in df.select("b", "t", P.absolute_url(F.col("t"), F.col("b")).alias("x")).collect():
        expected = urljoin(r.b, r.t)
        assert r.x.replace("h.com/?", "h.com?") == expected.replace("h.com/?", "h.com?"), (r.b, r.t)
