"""Inputs of the registered queries.

The driver tables hold invented prose, so most rules never fire on them. Each input below keeps
every row of a driver table and appends (or wraps around) one of a few case texts chosen by the
row's id; row counts grow with the tables. A handful of edge rows with negative ids follow. The
same literals are written into the Spark columns and into the check SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.shared import spread


def quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def pick(values: list[str], row_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (row_id % len(values) + 1).cast("int"))


def sql_pick(values: list[str], row_id: str) -> str:
    return f"({sql_list(values)})[({row_id}) % {len(values)} + 1]"


def with_edges(df: DataFrame, edges: list[tuple], schema: str) -> DataFrame:
    rows = [(-1 - i, *edge) for i, edge in enumerate(edges)]
    return df.union(df.sparkSession.createDataFrame(rows, schema).coalesce(1))


def sql_edges(edges: list[tuple]) -> str:
    rows = [f"({-1 - i}, " + ", ".join(quote(v) for v in e) + ")" for i, e in enumerate(edges)]
    return "VALUES " + ", ".join(rows)


# ---- mails: documents + case text --------------------------------------------------------------

MAIL_CASES = [
    "",
    " Subject: URGENT! Act now, your account will expire. Suspend? Hurry, limited time!",
    " Please verify your payment: http://192.168.1.1/verify-account.html?id=7 or mail a.b@c.org",
    " &lt;b&gt;Dear&nbsp;Customer&lt;/b&gt; your bank &amp; credit invoice: refund, money, dollar!!",
    " We will terminate, close, block, lock and delete the ACCOUNT of bob@example.com <br> now.",
    " See https://bit.ly/x%20y, www.example.com and HTTP://Upper.case/ ... 100% #1 @home foo@ @bar x@@y",
    " &#169; &#x41;&copy;&amp;lt; R&D AT&T &notit; &unknown; a&b; fish & chips",
    " payment invoice refund credit prize lottery important fast quick asap deadline",
]
MAIL_EDGES = [("",), ("   ",), (None,), ("@",), ("subject:",), ("<p>only tags</p>",), ("!?!?",), ("ÀÉ 42",)]


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    body = docs.select("doc_id", F.concat("text", pick(MAIL_CASES, F.col("doc_id"))).alias("text"))
    return with_edges(body, MAIL_EDGES, "doc_id bigint, text string")


MAILS = (
    f"mails AS (SELECT doc_id, text || {sql_pick(MAIL_CASES, 'doc_id')} AS text FROM documents "
    f"UNION ALL {sql_edges(MAIL_EDGES)})"
)

# ---- urls: page URLs wrapped by cases; {u} the URL, {r} the URL without protocol ------------------

URL_CASES = [
    "{u}", "{r}", "http://paypa1-verify.suspicious.com/{r}", "https://accounts.google.com/{r}",
    "http://secure-paypal.tk/a/{r}", "http://u@a.com:80/x;p?a=1&a=2&b=&c=%41&{r}",
    "http://192.168.1.1:8080/{r}", "http://192.168.1.1/verify//{r}", "HTTPS://{r}",
    "http://[bad/{r}", "ht tp://{r}", "http://a.b.c.d.example.com/account/update;v=1/{r};x",
    "http://https-amaz0n.net/~home/{r}?q=100%25&Q=a+b&q=c", "https://bit.ly/{r}#f?x=1",
    "http://xkcdfghjklmn.com/{r}?a&=1&b=2", "http://[::1]:80/{r}", "https://www.PayPal.com/{r}",
    "http://localhost/a.info.html?{r}", "http://microsoft.com.evil-site.co.uk/{r}",
    "http://::1/{r}", "http://01.2.3.4/{r}", "http://x.googel.io:443/{r}",
]
URL_EDGES = [
    ("",), ("not-a-url",), ("://invalid",), ("http://",), ("https://www.google.com",),
    ("http://mill-stream-mill-stream-mill-stream-mill-s.net",), ("http://garden-gate-garden-gate-garden-gate-garden-gate-garden-gate-garden.net",), ("http://oak.net",), ("http://a.ebay.com.paypal.com/",), ("http://1.2.3.4",),
    ("http://256.1.1.1/",), ("//x.com/y",), ("a.b.c/d",), ("http://user:pw@h.com:8/",),
]


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    case = pick(URL_CASES, F.col("page_id"))
    rest = F.regexp_replace("url", "^https?://", "")
    made = F.replace(F.replace(case, F.lit("{u}"), F.col("url")), F.lit("{r}"), rest)
    return with_edges(pages.select("page_id", made.alias("url")), URL_EDGES,
                      "page_id bigint, url string")


URLS = (
    f"urls AS (SELECT page_id, replace(replace({sql_pick(URL_CASES, 'page_id')}, '{{u}}', url), "
    f"'{{r}}', regexp_replace(url, '^https?://', '')) AS url FROM pages "
    f"UNION ALL {sql_edges(URL_EDGES)})"
)

# ---- mails with one URL each, made from the case list ------------------------------------------------

def linked_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    rest = F.concat(F.col("lang"), F.lit(".example.com/"), F.col("source"), F.lit("/"),
                    F.col("doc_id").cast("string"))
    case = pick(URL_CASES, F.col("doc_id"))
    link = F.replace(F.replace(case, F.lit("{u}"), F.concat(F.lit("https://"), rest)),
                     F.lit("{r}"), rest)
    body = docs.select("doc_id", F.concat("text", pick(MAIL_CASES, F.col("doc_id"))).alias("text"),
                       link.alias("url"))
    edges = [(text, url) for (text,), (url,) in zip(MAIL_EDGES, URL_EDGES)]
    return with_edges(body, edges + [("plain text", None), (None, "http://1.2.3.4")],
                      "doc_id bigint, text string, url string")


LINKED_MAILS = (
    f"linked_mails AS (SELECT doc_id, text || {sql_pick(MAIL_CASES, 'doc_id')} AS text, "
    f"replace(replace({sql_pick(URL_CASES, 'doc_id')}, '{{u}}', 'https://' || lang || '.example.com/' "
    "|| source || '/' || doc_id), '{r}', lang || '.example.com/' || source || '/' || doc_id) AS url "
    "FROM documents UNION ALL "
    + sql_edges([(t, u) for (t,), (u,) in zip(MAIL_EDGES, URL_EDGES)]
                + [("plain text", None), (None, "http://1.2.3.4")]) + ")"
)

# ---- captured pages: page HTML + case fragment; {h} is the page's own authority -------------------

PAGE_CASES = [
    "",
    '<form action=""><input name="q"></form><a href="#">x</a><a href=" javascript:; ">y</a>',
    '<form action="mailto:a@b.c"></form><link rel="icon" href="http://cdn.other.com/f.ico">',
    '<form method=post action="http://other.com/p"><img src="//cdn.x.org/i.png"></form>',
    '<FORM ACTION="http://{h}/p"><select></select></FORM><A HREF="http://{h}/in">in</A>',
    '<iframe src="x.html"></iframe><script src="https://cdn.x.org/a.js"></script>'
    '<script>window.open("a"); window.status="b";</script>',
    '<link rel="Shortcut ICON" href="/f.ico"><link rel="stylesheet preload" href="//c.x.org/s.css">'
    '<link rel=stylesheet href=/s.css>',
    '<body oncontextmenu="return false"><a href=\'http://a.com/?x=">"\'>q</a><a name="n">none</a>'
    '<a href="http://b.com">b</a><a href="https://c.com">c</a><a href>bare</a>',
    '<!-- <a href="http://hidden.com">h</a> <form></form> --><img src=""><img src="i.png" alt="a > b">',
    '<a title="href=x" href="mailto:a@b.c">m</a><a href="tel:1">t</a><a href="http:&#47;&#47;e.com/">e</a>'
    '<a href="?q=1&amp;r=2">q</a>',
    '<a href="http://[bad">broken</a>',
    "".join(f'<a href="http://out{i}.net/">o</a>' for i in range(60)),
    "".join('<a href="javascript:void(0)">v</a>' for _ in range(60)),
    '<form action="/x"><img src="a.png"><textarea></textarea></form>'
    '<form action="#"><img src="b.png"></form>',
    '<frame src="f.html"><abbr href="http://no.com"></abbr><formx action="http://no.com">',
    "<a " + " ".join(f'd{i}="{i}"' for i in range(300)) + ' href="http://many.com/">m</a>',
    '<script>var a="<!--";</script><a href="http://after.com/">a</a><a title="<!--" href="/b">b</a>',
    '<style>a{content:"<!--"}</style><a/href="http://slash.com/x">s</a><img/src="http://slash.com/i.png">',
]
PAGE_EDGES = [
    ("http://x.com/", ""),
    ("https://x.com", "<title> &nbsp; </title>"),
    ("http://x.com", '<a href="#"></a><a href=" javascript:; "></a><a href="/a"></a>'
                     '<a href="//x.com/b"></a><a href="http://y.com"></a>'),
    ("https://x.com", '<form action=""></form>'),
    ("http://[bad", "<a href='/x'>x</a>"),
]


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    extra = F.replace(pick(PAGE_CASES, F.col("page_id")), F.lit("{h}"), host)
    body = pages.select("page_id", "url", F.concat("html", extra).alias("html"))
    return with_edges(body, PAGE_EDGES, "page_id bigint, url string, html string")


CAPTURED = (
    f"captured AS (SELECT page_id, url, html || replace({sql_pick(PAGE_CASES, 'page_id')}, '{{h}}', "
    f"regexp_extract(url, '^https?://([^/?#]*)', 1)) AS html FROM pages "
    f"UNION ALL {sql_edges(PAGE_EDGES)})"
)

# ---- messages: conversation turns with case texts in front ---------------------------------------

MESSAGE_CASES = [
    "", "Subject: your invoice. Dear user, click here www.pay-pal.com/login and regards. ",
    "check bit.ly/account-verify or example.org ", "google.com", "http://a.com/x ", "Hey! ",
    "Can you help me? ", "urgent: confirm your order number. ",
    "Dear Bob, thanks: https://a.com/b>c and www.x.co.uk/y?z. ", "  www.Example.com/path ",
]
MESSAGE_EDGES = [
    ("google.com",), ("www.google.com/a/b",), ("hi",), ("",), ("   ",), ("see",), ("a.b",),
    ("May I open this one: bit.ly/garden-tools",), ("https://x.com/a b",),
    ("dear sincerely https://q.org",), ("x@y.com and z.net/a, z.net/a",), ("urgent receipt",),
    ("cde.fg/h http://cde.fg/h www.cde.fg/h",), ("dear thanks",),
]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations"))
    msg_id = F.col("conv_id") * 1000 + F.col("turn")
    case = pick(MESSAGE_CASES, F.col("conv_id") + F.col("turn"))
    body = turns.select(msg_id.alias("msg_id"), F.concat(case, "text").alias("message"))
    return with_edges(body, MESSAGE_EDGES, "msg_id bigint, message string")


MESSAGES = (
    f"messages AS (SELECT conv_id * 1000 + turn AS msg_id, "
    f"{sql_pick(MESSAGE_CASES, 'conv_id + turn')} || text AS message FROM conversations "
    f"UNION ALL {sql_edges(MESSAGE_EDGES)})"
)

# ---- probabilities: one per order line, on a grid of exact thousandths -----------------------------

def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    n = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber")) % 1001
    return lines.select("l_orderkey", "l_linenumber", "l_partkey",
                        (n.cast("double") / F.lit(1000.0)).alias("probability"))


PROBABILITIES = (
    "probabilities AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_orderkey * 7919 + "
    "l_partkey * 104729 + l_linenumber) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS probability "
    "FROM lineitem)"
)

# ---- predictions: three pseudo models over documents, with a true label ------------------------------

MODELS = ["alpha", "beta", "gamma"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label and three probabilities that lean towards the label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    i = F.col("doc_id")
    label = F.when((i * 31 + F.col("n_chars")) % 5 < 2, 1).otherwise(0)
    docs = docs.select("doc_id", "n_chars", label.alias("label"))

    def prob(a: int, m: int, lean: int) -> Column:
        noise = ((i * a + F.col("n_chars")) % m).cast("double") / F.lit(float(m))
        return (noise * (10 - lean) + F.col("label") * lean) / F.lit(10.0)

    return docs.select("doc_id", "label", prob(7919, 97, 4).alias("p_alpha"),
                       prob(104729, 101, 3).alias("p_beta"), prob(1299709, 89, 1).alias("p_gamma"))


def _prob_sql(a: int, m: int, lean: int, name: str) -> str:
    return (f"(CAST((doc_id * {a} + n_chars) % {m} AS DOUBLE) / CAST({m} AS DOUBLE) * {10 - lean} "
            f"+ label * {lean}) / CAST(10 AS DOUBLE) AS {name}")


PREDICTIONS = (
    "labelled AS (SELECT doc_id, n_chars, CASE WHEN (doc_id * 31 + n_chars) % 5 < 2 THEN 1 ELSE 0 "
    "END AS label FROM documents), predictions AS (SELECT doc_id, label, "
    f"{_prob_sql(7919, 97, 4, 'p_alpha')}, {_prob_sql(104729, 101, 3, 'p_beta')}, "
    f"{_prob_sql(1299709, 89, 1, 'p_gamma')} FROM labelled)"
)

LONG_PREDICTIONS = (
    PREDICTIONS + ", scored AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{m}' AS model, label, p_{m} AS probability, "
        f"CASE WHEN p_{m} > 0.5 THEN 1 ELSE 0 END AS prediction FROM predictions" for m in MODELS)
    + ")"
)


def long_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = predictions(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("probability"))
                      for m in MODELS])
    rows = wide.select("doc_id", "label", F.explode(pairs).alias("s"))
    return rows.select("doc_id", "s.model", "label", "s.probability",
                       F.when(F.col("s.probability") > 0.5, 1).otherwise(0).alias("prediction"))


# 1 row per document and model in a k-fold, fold by hash rank; used by the fold queries
FOLDS = 5
