"""Text, URL and rule-tag queries over mails, page URLs and their case variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import inputs as I
from lureline import fixed_values as V
from lureline.functions import tagging, text as T, urls as U

# ---- SQL pieces ----------------------------------------------------------------------------------


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def count_sql(c: str, needle: str) -> str:
    return f"((length({c}) - length(replace({c}, {I.quote(needle)}, ''))) // {len(needle)})"


def any_sql(c: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {I.quote(n)})" for n in needles) + ")"


def hits_sql(c: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, {I.quote(n)}) AS INT)" for n in needles) + ")"


def score_sql(c: str, words: list[str]) -> str:
    return f"least({hits_sql(c, words)} / {dbl(float(len(words)))}, {dbl(1.0)})"


def chars_sql(c: str, body: str) -> str:
    return f"length(regexp_replace({c}, '[^{body}]+', '', 'g'))"


DIGITS = r"0-9"
SPACE = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}"
)
TEXT_URL = rf"https?://[^{SPACE}<>\"{{}}|\\^`\[\]]+"
SENSITIVE = "(" + " + ".join(count_sql("lower({c})", t) for t in V.SENSITIVE_TERMS) + ")"


def entities_sql(c: str) -> str:
    for ref, char in [("&#169;", "©"), ("&#x41;", "A"), ("&copy;", "©"), ("&notit;", "¬it;"),
                      ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]:
        c = f"replace({c}, '{ref}', '{char}')"
    return c


def clean_sql(c: str) -> str:
    t = entities_sql(f"coalesce({c}, '')")
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = f"regexp_replace({t}, 'https?://[a-zA-Z!$-_]+', ' URL ', 'g')"
    t = f"regexp_replace({t}, '[^{SPACE}]+@[^{SPACE}]+', ' EMAIL ', 'g')"
    return f"lower(trim(regexp_replace({t}, '[^a-zA-Z0-9]+', ' ', 'g')))"


CLEANED = f"cleaned AS (SELECT doc_id, text, {clean_sql('text')} AS c FROM mails)"

# ---- TXT: text functions ---------------------------------------------------------------------------


def txt1_clean_text(spark, sf_dir) -> DataFrame:
    return I.mails(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def txt2_has_subject(spark, sf_dir) -> DataFrame:
    return I.mails(spark, sf_dir).select("doc_id", T.has_subject(F.col("text")).alias("has_subject"))


def txt3_4_mail_components(spark, sf_dir) -> DataFrame:
    m = I.mails(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("c"))
    c = F.col("c")
    return m.select(
        "doc_id", T.first_line(c).alias("first_line"), F.length(c).alias("text_length"),
        F.size(T.words(c)).alias("word_count"),
        F.round(T.average_word_length(c), 6).alias("avg_word_length"))


def txt5_keyword_scores(spark, sf_dir) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    return I.mails(spark, sf_dir).select(
        "doc_id",
        T.keyword_score(low, V.URGENCY_KEYWORDS).alias("urgency"),
        T.keyword_score(low, V.AUTHORITY_KEYWORDS).alias("authority"),
        T.keyword_score(low, V.FINANCIAL_KEYWORDS).alias("financial"),
        T.keyword_score(low, V.ACTION_KEYWORDS).alias("action"),
        T.keyword_score(low, V.THREAT_KEYWORDS).alias("threat"))


def txt6_8_char_statistics(spark, sf_dir) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return I.mails(spark, sf_dir).select(
        "doc_id", T.occurrences(t, "!").alias("exclamations"), T.occurrences(t, "?").alias("questions"),
        T.caps_ratio(t).alias("caps_ratio"), T.special_char_ratio(t).alias("special_ratio"))


def txt9_text_features(spark, sf_dir) -> DataFrame:
    m = I.mails(spark, sf_dir).select("doc_id", T.text_features(F.col("text")).alias("f"))
    return m.select("doc_id", *[f"f.{n}" for n in T.TEXT_FEATURES])


def txt10_sensitive_words(spark, sf_dir) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return I.mails(spark, sf_dir).select("doc_id", T.sensitive_words(t).alias("n"))


def txt11_text_vector(spark, sf_dir) -> DataFrame:
    return I.mails(spark, sf_dir).select("doc_id", T.text_vector(F.col("text")).alias("vector"))


def txt14_urls_in_text(spark, sf_dir) -> DataFrame:
    return I.mails(spark, sf_dir).select("doc_id", T.urls_in_text(F.col("text")).alias("links"))


TEXT_FEATURE_SQL = ", ".join([
    *[f"{score_sql('low', kw)} AS {n}_score" for n, kw in [
        ("urgency", V.URGENCY_KEYWORDS), ("authority", V.AUTHORITY_KEYWORDS),
        ("financial", V.FINANCIAL_KEYWORDS), ("action", V.ACTION_KEYWORDS),
        ("threat", V.THREAT_KEYWORDS)]],
    "CAST(0 AS DOUBLE) AS sentiment_compound", "CAST(0 AS DOUBLE) AS sentiment_negative",
    "CAST(0 AS DOUBLE) AS sentiment_positive",
    f"{count_sql('t', '!')} AS exclamation_count", f"{count_sql('t', '?')} AS question_count",
    f"{chars_sql('t', chr(92) + 'p{Lu}')} / greatest(length(t), 1) AS caps_ratio",
    f"(length(t) - {chars_sql('t', chr(92) + 'p{L}' + chr(92) + 'p{N}' + SPACE)}) "
    "/ greatest(length(t), 1) AS special_char_ratio",
    "0 AS misspelling_score",
])
LOWERED = "lowered AS (SELECT doc_id, text, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM mails)"
TEXT_FEATURES_CTE = f"feats AS (SELECT doc_id, text, {TEXT_FEATURE_SQL} FROM lowered)"

# ---- URL features ---------------------------------------------------------------------------------------


def url_0_25_42_43_features(spark, sf_dir) -> DataFrame:
    parts = U.with_url_parts(I.urls(spark, sf_dir), "url")
    return parts.select("page_id", *[c.alias(n) for n, c in U.url_features().items()])


def ut1_9_tagger_url_features(spark, sf_dir) -> DataFrame:
    f = I.urls(spark, sf_dir).select("page_id", U.tagger_url_features(F.col("url")).alias("f"))
    return f.select("page_id", "f.*")


def clean_url_sql(u: str) -> str:
    return f"regexp_replace(regexp_replace({u}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]+', '', 'g')"


PARTS_RE = "(?s)" + U.URL_PARTS
BALANCED = "(contains(host, '[') = contains(host, ']'))"


def url_parts_sql(source: str, u: str, name: str) -> str:
    c = clean_url_sql(u)
    return (
        f"{name} AS (SELECT *, regexp_extract({c}, '{PARTS_RE}', 2) AS host, regexp_replace("
        f"regexp_extract({c}, '{PARTS_RE}', 3), ';[^/]*$', '') AS path, "
        f"regexp_extract({c}, '{PARTS_RE}', 4) AS query FROM {source})"
    )


FULL_URL = (
    "full_url AS (SELECT page_id, CASE WHEN starts_with(url, 'http://') OR starts_with(url, "
    "'https://') THEN url ELSE 'http://' || url END AS u FROM urls)"
)


def brand_sql(h: str) -> str:
    cases = "".join(
        f" WHEN contains({h}, '{b}') THEN CASE WHEN {h} IN ('{b}.com', 'www.{b}.com') OR "
        f"ends_with({h}, '.{b}.com') THEN 0 ELSE 1 END" for b in V.BRANDS)
    return f"CASE{cases} ELSE CAST({any_sql(h, V.BRAND_TYPOS)} AS INT) END"


LEVEL = f"greatest({count_sql('host', '.')} - 1, 0)"
URL_SQL = {
    "NumDots": count_sql("u", "."),
    "SubdomainLevel": LEVEL,
    "PathLevel": f"CASE WHEN path IN ('', '/') THEN 0 ELSE {count_sql('path', '/')} END",
    "UrlLength": "length(u)",
    "NumDash": count_sql("u", "-"),
    "NumDashInHostname": count_sql("host", "-"),
    "AtSymbol": "CAST(contains(u, '@') AS INT)",
    "TildeSymbol": "CAST(contains(u, '~') AS INT)",
    "NumUnderscore": count_sql("u", "_"),
    "NumPercent": count_sql("u", "%"),
    "NumQueryComponents": (
        "len(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda x: "
        "regexp_matches(x, '(?s)^[^=]*=.')), lambda x: url_decode(replace(regexp_extract(x, "
        "'(?s)^([^=]*)=', 1), '+', ' ')))))"),
    "NumAmpersand": count_sql("u", "&"),
    "NumHash": count_sql("u", "#"),
    "NumNumericChars": chars_sql("u", DIGITS),
    "NoHttps": "CAST(NOT starts_with(u, 'https://') AS INT)",
    "RandomString": (
        "CASE WHEN length(host) = 0 THEN 0 WHEN "
        + chars_sql("lower(host)", "bcdfghjklmnpqrstvwxyz")
        + f" / length(host) > {dbl(0.8)} THEN 1 ELSE 0 END"),
    "IpAddress": f"CAST(regexp_matches(host, '{U.IP_LITERAL}') AS INT)",
    "DomainInSubdomains": "CAST(" + any_sql(
        "array_to_string(string_split(lower(host), '.')[:-3], '.')", V.SUSPICIOUS_HOST_WORDS) + " AS INT)",
    "DomainInPaths": f"CAST({any_sql('lower(path)', V.SUSPICIOUS_HOST_WORDS)} AS INT)",
    "HttpsInHostname": "CAST(contains(host, 'https') AS INT)",
    "HostnameLength": "length(host)",
    "PathLength": "length(path)",
    "QueryLength": "length(query)",
    "DoubleSlashInPath": "CAST(contains(path, '//') AS INT)",
    "NumSensitiveWords": SENSITIVE.replace("{c}", "u"),
    "EmbeddedBrandName": brand_sql("lower(host)"),
    "SubdomainLevelRT": f"CASE WHEN {LEVEL} > 3 THEN 1 WHEN {LEVEL} > 1 THEN 0 ELSE -1 END",
    "UrlLengthRT": "CASE WHEN length(u) > 75 THEN 1 WHEN length(u) > 50 THEN 0 ELSE -1 END",
}
URL_FEATURES_SQL = ", ".join(
    f"CASE WHEN {BALANCED} THEN {e} ELSE 0 END AS {n}" for n, e in URL_SQL.items())

TAIL_HOST = "regexp_replace(host, '(?s)^.*@', '')"
HOSTNAME_SQL = (
    f"CASE WHEN NOT {BALANCED} THEN '' WHEN contains({TAIL_HOST}, '[') THEN lower(regexp_extract("
    f"{TAIL_HOST}, '\\[([^\\]]*)', 1)) ELSE lower(string_split({TAIL_HOST}, ':')[1]) END"
)
TAGGER_PARTS = (
    url_parts_sql("urls", "url", "tparts")
    + f", hosts AS (SELECT page_id, url, lower(url) AS low, {HOSTNAME_SQL} AS hostname FROM tparts)"
)
TAGGER_SQL = {
    "has_ip": f"CAST(regexp_matches(hostname, '{U.IP_LITERAL}') AS INT)",
    "url_length": "length(url)",
    "has_at_symbol": "CAST(contains(url, '@') AS INT)",
    "double_slash_redirect": "CAST(contains(url[9:], '//') AS INT)",
    "has_hyphen": "CAST(contains(url, '-') AS INT)",
    "subdomain_count": f"CASE WHEN hostname <> '' THEN {count_sql('hostname', '.')} - 1 ELSE 0 END",
    "suspicious_tld": f"CAST({any_sql('low', V.SUSPICIOUS_TLDS)} AS INT)",
    "has_https": "CAST(starts_with(url, 'https://') AS INT)",
    "port_in_url": "CAST(regexp_matches(url, ':[0-9]+') AS INT)",
    "shortening_service": f"CAST({any_sql('low', V.URL_SHORTENERS)} AS INT)",
}
TAGGER_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in TAGGER_SQL.items())

# ---- tagging ------------------------------------------------------------------------------------------------


def _tagged(spark, sf_dir) -> DataFrame:
    return tagging.tag_table(I.linked_mails(spark, sf_dir), "text", "url")


def tag1_confidence(spark, sf_dir) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", F.round("confidence_score", 9).alias("confidence"))


def tag2_tags(spark, sf_dir) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", "automated_tags")


def tag3_agg12_risk_distribution(spark, sf_dir) -> DataFrame:
    """Tagger tiers with counts and shares of all rows."""
    return tagging.risk_distribution(_tagged(spark, sf_dir))


def tag4_tag_table(spark, sf_dir) -> DataFrame:
    t = _tagged(spark, sf_dir)
    return t.select(
        "doc_id", "risk_level", F.size("automated_tags").alias("n_tags"),
        F.col("text_features.urgency_score").alias("urgency_score"),
        F.col("text_features.threat_score").alias("threat_score"),
        F.col("url_features.suspicious_tld").alias("suspicious_tld"),
        F.col("url_features.subdomain_count").alias("subdomain_count"))


TAGGED = (
    f"{I.LINKED_MAILS}, mails AS (SELECT doc_id, text FROM linked_mails), "
    "urls AS (SELECT doc_id AS page_id, url FROM linked_mails), "
    f"{TAGGER_PARTS}, {LOWERED}, {TEXT_FEATURES_CTE}, "
    f"links AS (SELECT page_id, url, {TAGGER_COLUMNS} FROM hosts), "
    "both_sides AS (SELECT f.*, l.* EXCLUDE (page_id), coalesce(length(f.text) > 0, false) AS has_text, "
    "coalesce(length(l.url) > 0, false) AS has_url FROM feats f JOIN links l ON f.doc_id = l.page_id), "
    "weighted AS (SELECT *, least(greatest("
    + " + ".join(
        [dbl(0.0)] + [f"CASE WHEN {'has_url' if n in TAGGER_SQL else 'has_text'} THEN {n} ELSE 0 END * {dbl(w)}"
                      for n, w in V.CONFIDENCE_WEIGHTS.items()])
    + f", {dbl(0.0)}), {dbl(1.0)}) AS confidence FROM both_sides), "
    f"tagged AS (SELECT *, CASE WHEN confidence >= {dbl(0.7)} THEN 'high' WHEN confidence >= {dbl(0.4)} "
    "THEN 'medium' ELSE 'low' END AS risk_level, list_filter(["
    + ", ".join(f"CASE WHEN {cond} THEN '{tag}' END" for tag, cond in [
        ("high_urgency", f"has_text AND urgency_score > {dbl(0.3)}"),
        ("contains_threats", f"has_text AND threat_score > {dbl(0.3)}"),
        ("financial_content", f"has_text AND financial_score > {dbl(0.3)}"),
        ("ip_address_url", "has_url AND has_ip = 1"),
        ("suspicious_domain", "has_url AND suspicious_tld = 1"),
        ("shortened_url", "has_url AND shortening_service = 1")])
    + "], lambda x: x IS NOT NULL) AS automated_tags FROM weighted)"
)

QUERIES = {
    "txt1_clean_text": txt1_clean_text,
    "txt2_has_subject": txt2_has_subject,
    "txt3_4_mail_components": txt3_4_mail_components,
    "txt5_keyword_scores": txt5_keyword_scores,
    "txt6_8_char_statistics": txt6_8_char_statistics,
    "txt9_text_features": txt9_text_features,
    "txt10_sensitive_words": txt10_sensitive_words,
    "txt11_text_vector": txt11_text_vector,
    "txt14_urls_in_text": txt14_urls_in_text,
    "url_0_25_42_43_features": url_0_25_42_43_features,
    "ut1_9_tagger_url_features": ut1_9_tagger_url_features,
    "tag1_confidence": tag1_confidence,
    "tag2_tags": tag2_tags,
    "tag3_agg12_risk_distribution": tag3_agg12_risk_distribution,
    "tag4_tag_table": tag4_tag_table,
}

SQL = {
    "txt1_clean_text": f"WITH {I.MAILS}, {CLEANED} SELECT doc_id, c AS cleaned FROM cleaned",
    "txt2_has_subject": (
        f"WITH {I.MAILS} SELECT doc_id, coalesce(CAST(contains(lower(text), 'subject:') AS INT), 0) "
        "AS has_subject FROM mails"),
    "txt3_4_mail_components": (
        f"WITH {I.MAILS}, {CLEANED} SELECT doc_id, c[1:100] AS first_line, length(c) AS text_length, "
        "len(list_filter(string_split(c, ' '), lambda x: x <> '')) AS word_count, coalesce(round(list_avg("
        "list_transform(list_filter(string_split(c, ' '), lambda x: x <> ''), lambda x: length(x))), 6), 0) "
        "AS avg_word_length FROM cleaned"),
    "txt5_keyword_scores": f"WITH {I.MAILS}, {LOWERED} SELECT doc_id, " + ", ".join(
        f"{score_sql('low', kw)} AS {n}" for n, kw in [
            ("urgency", V.URGENCY_KEYWORDS), ("authority", V.AUTHORITY_KEYWORDS),
            ("financial", V.FINANCIAL_KEYWORDS), ("action", V.ACTION_KEYWORDS),
            ("threat", V.THREAT_KEYWORDS)]) + " FROM lowered",
    "txt6_8_char_statistics": (
        f"WITH {I.MAILS}, {LOWERED}, {TEXT_FEATURES_CTE} SELECT doc_id, exclamation_count AS exclamations, "
        "question_count AS questions, caps_ratio, special_char_ratio AS special_ratio FROM feats"),
    "txt9_text_features": (
        f"WITH {I.MAILS}, {LOWERED}, {TEXT_FEATURES_CTE} SELECT * EXCLUDE (text) FROM feats"),
    "txt10_sensitive_words": (
        f"WITH {I.MAILS}, {LOWERED} SELECT doc_id, {SENSITIVE.replace('{c}', 't')} AS n FROM lowered"),
    "txt11_text_vector": (
        f"WITH {I.MAILS}, {LOWERED} SELECT doc_id, CAST(list_concat([0, 0, 0, least(length(t), 1000), "
        f"0, 0, 0, 0, 0, {count_sql('t', '%')}, 0, 0, 0, {chars_sql('t', DIGITS)}, 0, 0, 0, 0, 0, 0, 0, "
        f"0, 0, 0, 0, {SENSITIVE.replace('{c}', 't')}], list_transform(range(22), lambda x: 0)) AS FLOAT[]) "
        "AS vector FROM lowered"),
    "txt14_urls_in_text": (
        f"WITH {I.MAILS} SELECT doc_id, regexp_extract_all(text, "
        + I.quote(TEXT_URL) + ") AS links FROM mails"),
    "url_0_25_42_43_features": (
        f"WITH {I.URLS}, {FULL_URL}, {url_parts_sql('full_url', 'u', 'parts')} "
        f"SELECT page_id, {URL_FEATURES_SQL} FROM parts"),
    "ut1_9_tagger_url_features": (
        f"WITH {I.URLS}, {TAGGER_PARTS} SELECT page_id, {TAGGER_COLUMNS} FROM hosts"),
    "tag1_confidence": f"WITH {TAGGED} SELECT doc_id, round(confidence, 9) AS confidence FROM tagged",
    "tag2_tags": f"WITH {TAGGED} SELECT doc_id, automated_tags FROM tagged",
    "tag3_agg12_risk_distribution": (
        f"WITH {TAGGED} SELECT risk_level, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) "
        "AS pct FROM tagged GROUP BY risk_level"),
    "tag4_tag_table": (
        f"WITH {TAGGED} SELECT doc_id, risk_level, len(automated_tags) AS n_tags, "
        "CASE WHEN has_text THEN urgency_score END AS urgency_score, CASE WHEN has_text THEN threat_score "
        "END AS threat_score, CASE WHEN has_url THEN suspicious_tld END AS suspicious_tld, CASE WHEN "
        "has_url THEN subdomain_count END AS subdomain_count FROM tagged"),
}
