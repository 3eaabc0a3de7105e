"""Text functions against plain Python on awkward inputs."""

import html
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lureline import fixed_values as V
from lureline.functions import messages as M
from lureline.functions import risk as R
from lureline.functions import tagging
from lureline.functions import text as T

TEXTS = [
    "", " ", "<b>Hi</b> there", "a@b c@ @d e@@f x@y@z", "see http://a.b/c?d=[e] now", "&lt;p&gt;x&amp;lt;y", "&notit; &copy &ampx",
    "&#65;&#x42;&#0;&#xD800;&#1114112;", "a b@c d", "ÉTÉ Ⅰ ǅ", "100² ٣", "x" * 5000, "tab\tnew\nline\r\x0b\x0c\x1c",
    "URGENT!!! click here?", "&hellip;&nbsp;&eacute;", "http://", "https://x", "<unclosed", "a < b > c", "fish & chips &",
]


def python_clean(text):
    t = html.unescape(text)
    t = re.sub(r"<[^>]+>", " ", t)
    t = re.sub(r"https?://[a-zA-Z!$-_]+", " URL ", t)
    t = re.sub(r"\S+@\S+", " EMAIL ", t)
    t = re.sub(r"[^a-zA-Z0-9\s]", " ", t)
    return " ".join(t.split()).lower()


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    assert column(spark, TEXTS, T.clean_text) == [python_clean(t) for t in TEXTS]
    assert column(spark, [None], T.clean_text) == [""]


def test_unescape(spark):
    values = TEXTS + ["x&#" + "0" * 45 + "65;y", "a&#1;b", "&#128;&#x9f;&#129;&#0;&#13;", "&#99999999999999999999;", "&#xD800;&#xFFFF;&#xfdd0;",
               "&#x" + "0" * 60 + "1F600;", "&#00;", "&#x0;"]
    assert column(spark, values, T.unescape_entities) == [html.unescape(t) for t in values]


ALPHABET = st.text(alphabet="ab@<>&;#x1 ./:hptg é!", max_size=40)


@settings(max_examples=5, deadline=None)
@given(st.lists(ALPHABET, min_size=40, max_size=40))
def test_clean_text_random(spark, values):
    values = [v for v in values if "&#" not in v]
    assert column(spark, values, T.clean_text) == [python_clean(v) for v in values]


def test_character_statistics(spark):
    def caps(t):
        return sum(c.isupper() for c in t) / max(len(t), 1)

    def special(t):
        return sum(not c.isalnum() and not c.isspace() for c in t) / max(len(t), 1)

    assert column(spark, TEXTS, T.caps_ratio) == [caps(t) for t in TEXTS]
    assert column(spark, TEXTS, T.special_char_ratio) == [special(t) for t in TEXTS]
    assert column(spark, TEXTS, T.digit_count) == [sum(c.isdigit() for c in t) for t in TEXTS]


def test_sensitive_words(spark):
    cases = {"Please verify your account": 1, "Update your password now": 1, "Click here to confirm": 2,
             "Urgent: Your account will expire": 2, "Normal text with no triggers": 0}
    assert column(spark, list(cases), T.sensitive_words) == list(cases.values())


def test_risk_levels(spark):
    levels = {0.05: "low", 0.25: "low", 0.3: "low", 0.5: "medium", 0.65: "medium", 0.7: "medium", 0.85: "high", 0.95: "high"}
    df = spark.createDataFrame([(p,) for p in levels] + [(0.29,)], "probability double")
    got = {r.probability: r for r in R.detailed(df).collect()}
    assert {p: got[p].level for p in levels} == levels
    assert got[0.29].score == 28 and got[0.85].action_items == V.TIERS["high"]["action_items"]
    assert got[0.5].risk_breakdown.user_friendly_score == "50/100"


def test_tag_thresholds(spark):
    four = " ".join(V.URGENCY_KEYWORDS[:4])
    three = "urgent immediate hurry"
    df = spark.createDataFrame([(four, None), (three, None), (None, "https://bit.ly/x"), (None, None)], "t string, u string")
    got = [r.automated_tags for r in tagging.tag_table(df, "t", "u").collect()]
    assert "high_urgency" in got[0] and "high_urgency" not in got[1]
    assert got[2] == ["shortened_url"] and got[3] == []


def test_one_decimal_like_python(spark):
    values = [72.25, 72.35, 0.05, 0.15, 0.25, 99.95, 33.333, 0.0, 100.0, 66.65, 66.75, 12.45, 97.85]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.x for r in df.select(M.one_decimal(F.col("v")).alias("x")).collect()] == [f"{v:.1f}" for v in values]


def test_message_routing(spark):
    cases = {"Is this link safe: bit.ly/account-verify": "greeting", "google.com": "url", "check a": "unclear",
             "urgent: confirm your order number": "mail"}
    assert column(spark, list(cases), lambda c: M.route(c)["route"]) == list(cases.values())
    assert column(spark, ["is this bit.ly/a"], lambda c: M.route(c, True)["route"]) == ["url"]


def test_hosts_have_any_number_of_labels(spark):
    """Against Python's matcher, which takes the rule as it is written."""
    label = V.HOST_LABEL
    rule = re.compile(rf"{label}(?:\.{label})*\.{V.TOP_LEVEL}(?:/[^ ]*)?")
    rng = random.Random(3)
    pieces = ["a", "b7", "1", "-", "com", "museum", "community", ".", ".", "..", "/", " ", "é", "x" * 62, "y" * 63, "z" * 64, ".-"]
    cases = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    cases += ["a." * 20_000 + "com", "1." * 2_000 + "1", "a.com" + ".1" * 2_000 + "-", "-" * 9_000, ("q" * 63 + ".") * 400 + "org/x"]
    for prefix, got in (("", column(spark, cases, M.hosts)), ("www.", column(spark, ["www." + c for c in cases], lambda c: M.hosts(c, r"www\.")))):
        own = re.compile(prefix.replace(".", r"\.") + rule.pattern)
        for case, found in zip(cases, got):
            assert found == own.findall(prefix + case), case[:200]
    long = "see " + "a." * 20_000 + "com now"
    hostile = ["1." * 400_000, "1www." * 200_000, "a1." * 200_000 + "-", "com." * 200_000]
    got = column(spark, [long, *hostile], M.extract_urls)
    assert got[:4] == [["http://" + "a." * 20_000 + "com"], [], [], []] and len(got[4]) == 1


def test_tagged_texts_are_lowered_once(spark):
    df = spark.createDataFrame([(1, "URGENT: verify your bank account", "http://bit.ly/x")], "id int, t string, u string")
    tagged = tagging.tag_table(df, "t", "u")
    plan = tagged.select("automated_tags", "risk_level")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(t#") == 1 and tagged.columns[:3] == df.columns and "_low" not in tagged.columns


def test_a_message_is_lowered_and_stripped_once(spark):
    df = spark.createDataFrame([(1, "Dear a.bc\u0085"), (2, " see www.q.io "), (3, None), (4, "no dot ://")], "i int, t string")
    routed = df.select("i", M.route(F.col("t")).alias("r"), M.extract_urls(F.col("t")).alias("u"), T.strip(F.col("t")).alias("s"))
    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", kept)
    assert plan.count("lower(") <= 4  # not once for each phrase that is looked for
    got = {r.i: r for r in routed.collect()}
    assert [got[i].s for i in (1, 2, 3, 4)] == ["Dear a.bc", "see www.q.io", None, "no dot ://"]
    assert got[1].u == ["http://a.bc"] and got[2].u == ["http://www.q.io"] and got[3].u is None and got[4].u == []
    assert [got[i].r.route for i in (1, 2, 3, 4)] == ["url", "url", "unclear", "unclear"]
