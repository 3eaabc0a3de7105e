"""Page features on the case pages, and against Python's HTML parser on mixed markup."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from lureline.functions import urls as U
from lureline.operators import pages as P

FORMS = [("https://x.com", '<form action="">', "relative", 1), ("https://x.com", '<form action="mailto:a@b.c">', "abnormal", 1),
         ("https://x.com", '<form action="http://other.com/p">', "insecure", 1), ("http://x.com", "<form action=/p>", "insecure", 1)]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "id int, url string, html string")


def test_forms(spark):
    got = P.summarise(pages(spark, [(u, h) for u, h, _, _ in FORMS])).orderBy("id").select("forms.*").collect()
    for row, (_, html, name, n) in zip(got, FORMS):
        assert row[name] == n, html
    assert got[2].external == 1 and got[1].submit_to_email == 1


def test_links(spark):
    html = '<a href="#"></a><a href=" javascript:; "></a><a href="/a"></a><a href="//x.com/b"></a><a href="http://y.com"></a>'
    r = P.summarise(pages(spark, [("http://x.com", html)])).select("links.*").first()
    assert (r.total, r.null, r.internal, r.external) == (5, 2, 2, 1)
    assert (r.pct_external, r.pct_null) == (0.2, 0.4)
    assert r.external_list == ["http://y.com"] and r.internal_list == ["http://x.com/a", "http://x.com/b"]


def test_empty_page_and_missing_page(spark):
    f = P.feature_columns(pages(spark, [("http://x.com", ""), ("http://x.com", None)])).orderBy("id").collect()
    assert f[0].MissingTitle == 1 and f[0].PctExtResourceUrlsRT == -1 and f[0].PctExtNullSelfRedirectHyperlinksRT == -1
    assert f[1].MissingTitle == 0 and f[1].PctExtResourceUrlsRT == 0 and f[1].SubdomainLevelRT == -1


def test_unparsable_link_zeroes_the_vector(spark):
    r = P.feature_vector(pages(spark, [("http://x.com", '<a href="http://[bad">x</a>')])).first()
    assert r.features == [0.0] * 48


def test_attributes_against_html_parser(spark):
    html = (
        '<A HREF="one">1</a><a class="k" data-x=\'href="no"\' href=two>2</a><a title="> href=no" href=\'three\'>3</a>'
        '<a>none</a><abbr href="no"></abbr><a\nhref = "four" >4</a><a href="five?a=1&amp;b=2&copy;">5</a><a href="&#x2F;six">6</a>'
        '<!-- <a href="hidden"> --><script>var s = \'<a href="script">\';</script><a href="">7</a><a href>8</a>'
        '<a HREF="nine" href="ten">9</a>'
    )
    found = []

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            hrefs = [v or "" for k, v in attrs if k == "href"]
            if tag == "a" and hrefs:
                found.append(hrefs[0])

    parser = Links()
    parser.feed(html)
    got = P.with_page_elements(pages(spark, [("http://x.com", html)])).select("_hrefs").first()[0]
    assert got == found


def test_hostile_page_does_not_end_the_job(spark):
    wide = "<a " + " ".join(f'x{i}="{i}"' for i in range(20_000)) + ' href="http://y.com">z</a>'
    deep = "<form>" * 2000 + "<div " + "a" * 300_000 + ">"
    rows = [("http://x.com", wide), ("http://x.com", deep), ("http://x.com", "<" * 50_000), ("http://x.com", "<!--" * 20_000)]
    assert P.feature_vector(pages(spark, rows)).filter(F.size("features") == 48).count() == 4
    got = P.summarise(pages(spark, rows)).orderBy("id").select("links.total", "forms.total").collect()
    assert [tuple(r) for r in got] == [(1, 0), (0, 2000), (0, 0), (0, 0)]


def test_comment_marks_in_scripts_and_attributes(spark):
    cases = [('<script>var a="<!--";</script><a href="/a">x</a>', ["/a"]), ('<a title="<!--" href="/a">x</a><a href="/b">y</a>', ["/a", "/b"]),
             ('<!-- <script> --><a href="/a">x</a><!-- </script> -->', ["/a"]), ('<a/href="/a">x</a>', ["/a"]),
             ('<a class="y"href="/a">x</a>', ["/a"]), ("<a href = '/a' HREF=/b>x</a>", ["/a"]), ('<a data-x="q href=/no">x</a>', []),
             ('<a href="&#' + "0" * 45 + '47;a">x</a>', ["/a"])]
    got = P.with_page_elements(pages(spark, [("http://x.com", h) for h, _ in cases])).orderBy("id").select("_hrefs").collect()
    assert [r[0] for r in got] == [e for _, e in cases]


def test_mixed_content_reads_pages_of_urls_only(spark):
    page = '<form action="http://evil.com/p"></form><a href="http://other.com">x</a>'
    rows = [("http://x.com", "url", page), ("see http://x.com now", "mail", page), ("no link here", "mail", page), (None, "url", page),
            ("http://x.com", "url", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, c string, kind string, html string")
    got = [r.features for r in P.content_vector(df, "c", "kind", html="html").orderBy("id").collect()]
    plain = [r.features for r in P.content_vector(df, "c", "kind").orderBy("id").collect()]
    assert got[0] == P.feature_vector(pages(spark, [("http://x.com", page)])).first().features != plain[0]
    assert got[1:] == plain[1:] and got[3] is None


def planned(spark, df) -> str:
    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", kept)


def test_hosts_and_attributes_are_judged_once(spark):
    df = pages(spark, [("http://x.com", '<a href="x">x</a>')])
    plan = planned(spark, P.feature_vector(df))
    assert plan.count(U.LOOK_ALIKES) <= 8  # the page's URL, then one for each kind of target, not for each feature
    assert plan.count(r"(?i)^[\s/]*href") <= 2  # links and linked files, not each use of the value


def test_values_of_attributes(spark):
    html = """<a href="it's'">a</a><a href='"a"'>b</a><a href="">c</a><a href>d</a><a href=>e</a><a HREF=\n"q\n">f</a>
              <a href=a=b>g</a><a title="href=" href="k">h</a><a name=n>i</a>"""
    got = P.with_page_elements(pages(spark, [("http://x.com", html)])).first()["_hrefs"]
    assert got == ["it's'", '"a"', "", "", "", "q\n", "a=b", "k"]
