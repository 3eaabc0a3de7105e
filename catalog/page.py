"""Page queries: links, resources, forms, page flags and the 48-slot vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import inputs as I
from catalog import text_url as TU
from lureline import fixed_values as V
from lureline.functions import risk, tagging
from lureline.functions import urls as U
from lureline.operators import pages as P
from lureline.sources.captures import accepted_pages

# ---- SQL pieces: the same markup rules over lists ---------------------------------------------------

Q = """[^>"'']*(?:"[^"]*"[^>"'']*|''[^'']*''[^>"'']*)*"""
ATTR = r"""[^\s"''>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?"""
PART = TU.PARTS_RE


def tag_re(names: str) -> str:
    return rf"(?i)<(?:{names})(?:[\s/]{Q})?>"


def attr_re(name: str) -> str:
    return (rf"""(?i)^<[a-z]+(?:[\s/]+{ATTR})*?[\s/]+{name}"""
            r"""(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]*)|[\s/>])""")


def attr_sql(t: str, name: str) -> str:
    raw = f"regexp_extract({t}, '{attr_re(name)}', 1)"
    value = (f"CASE WHEN starts_with({raw}, '\"') OR starts_with({raw}, '''') THEN "
             f"{raw}[2:length({raw}) - 1] ELSE {raw} END")
    return f"replace(replace({value}, '&#47;', '/'), '&amp;', '&')"


def tags_sql(names: str) -> str:
    return f"regexp_extract_all(markup, '{tag_re(names)}')"


def values_sql(tags: str, name: str) -> str:
    return (f"list_transform(list_filter({tags}, lambda t: regexp_matches(t, '{attr_re(name)}')), "
            f"lambda t: {attr_sql('t', name)})")


def url_part(u: str, group: int) -> str:
    return f"regexp_extract({TU.clean_url_sql(u)}, '{PART}', {group})"


def host_sql(u: str) -> str:
    return (f"CASE WHEN {url_part(u, 2)} <> '' OR {url_part(u, 1)} <> '' THEN {url_part(u, 2)} "
            "ELSE base END")


STYLES = (f"list_filter({tags_sql('link')}, lambda t: list_contains(string_split_regex("
          f"{attr_sql('t', 'rel')}, '\\s+'), 'stylesheet'))")
ICON = (f"(list_filter({tags_sql('link')}, lambda t: contains(lower({attr_sql('t', 'rel')}), 'icon')))[1]")
NULLS = "('#', '', 'javascript:void(0)', 'javascript:;')"
BAD = "(contains({h}, '[') <> contains({h}, ']'))"


def bad(h: str) -> str:
    return BAD.replace("{h}", h)


ELEMENTS = (
    f"marked AS (SELECT page_id, url, html, lower(html) AS low, {url_part('url', 2)} AS base, "
    f"lower({url_part('url', 1)}) AS base_scheme, "
    "regexp_replace(html, '(?is)<!--(?:.*?-->|.*\\z)|"
    f"(<(?:script|style)(?:[\\s/]{Q})?>)(?:.*?</(?:script|style)\\s*>|.*\\z)|(<[a-z/]{Q}>)', '\\1\\2', 'g') AS markup "
    "FROM captured), "
    f"elements AS (SELECT *, {values_sql(tags_sql('a'), 'href')} AS hrefs, "
    f"list_concat({values_sql(tags_sql('img|script'), 'src')}, {values_sql(STYLES, 'href')}) AS srcs, "
    f"list_transform({tags_sql('form')}, lambda t: trim({attr_sql('t', 'action')})) AS actions, "
    f"coalesce({attr_sql(ICON, 'href')}, '') AS icon FROM marked), "
    f"targets AS (SELECT *, list_filter(list_transform(hrefs, lambda h: trim(h)), lambda h: h NOT IN {NULLS}) "
    "AS links, list_filter(srcs, lambda s: s <> '') AS resources, list_filter(actions, lambda a: a NOT IN "
    "('', '#') AND NOT starts_with(a, 'mailto:')) AS posts FROM elements), "
    f"resolved AS (SELECT *, list_transform(links, lambda h: {host_sql('h')}) AS link_hosts, "
    f"list_transform(resources, lambda h: {host_sql('h')}) AS resource_hosts, "
    f"list_transform(posts, lambda h: {host_sql('h')}) AS post_hosts, {host_sql('icon')} AS icon_host, "
    f"list_transform(posts, lambda h: CASE WHEN {url_part('h', 1)} <> '' THEN lower({url_part('h', 1)}) "
    "ELSE base_scheme END) AS post_schemes FROM targets)"
)


def away_sql(hosts: str) -> str:
    return f"len(list_filter({hosts}, lambda h: h <> '' AND h <> base))"


N_NULL = f"len(list_filter(hrefs, lambda h: trim(h) IN {NULLS}))"


def ratio_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE CAST(0 AS DOUBLE) END"


PCT_EXT = ratio_sql(away_sql("link_hosts"), "len(hrefs)")
PCT_NULL = ratio_sql(N_NULL, "len(hrefs)")
PCT_RES = ratio_sql(away_sql("resource_hosts"), "len(resources)")
N_EMAIL = "len(list_filter(actions, lambda a: starts_with(a, 'mailto:')))"
N_REL = "len(list_filter(actions, lambda a: a IN ('', '#')))"
N_INSECURE = "len(list_filter(post_schemes, lambda s: s = 'http'))"
N_ABNORMAL = f"({away_sql('post_hosts')} + {N_EMAIL})"
MISMATCH = (f"len(list_filter(hrefs, lambda h: starts_with(h, 'http') AND {url_part('h', 2)} <> '' AND "
            f"{url_part('h', 2)} <> base))")


def flag_sql(cond: str) -> str:
    return f"CAST(({cond}) AS INT)"


def rt_sql(ratio: str) -> str:
    return (f"CASE WHEN {ratio} > CAST(0.6 AS DOUBLE) THEN 1 WHEN {ratio} > CAST(0.2 AS DOUBLE) "
            "THEN 0 ELSE -1 END")


ICON_SQL = flag_sql("icon <> '' AND icon_host <> '' AND icon_host <> base")
FRAME_SQL = flag_sql(r"regexp_matches(markup, '(?i)<i?frame[\s/>]')")
TITLE_SQL = flag_sql(
    rf"trim(replace(regexp_extract(markup, '(?is)<title(?:[\s/]{Q})?>(.*?)(?:</title|\z)', 1), '&nbsp;', ' ')) = ''")
RIGHT_SQL = flag_sql(TU.any_sql("low", V.RIGHT_CLICK_MARKERS))
POPUP_SQL = flag_sql("contains(low, 'window.open')")
STATUS_SQL = flag_sql("contains(low, 'window.status')")
IMAGES_SQL = flag_sql(
    rf"len(list_filter(regexp_extract_all(markup, '(?is)<form(?:[\s/]{Q})?>(?:.*?</form\s*>|.*\z)'), lambda f: "
    r"regexp_matches(f, '(?i)<img[\s/>]') AND NOT regexp_matches(f, "
    r"'(?i)<(?:input|textarea|select)[\s/>]'))) > 0")
MISMATCH_SQL = flag_sql(f"len(hrefs) > 0 AND {MISMATCH} / len(hrefs) > CAST(0.6 AS DOUBLE)")
ERROR_SQL = (
    f"({bad('base')} OR len(list_filter(list_concat(list_concat(link_hosts, resource_hosts), post_hosts), "
    f"lambda h: {bad('h')})) > 0 OR len(list_filter(hrefs, lambda h: starts_with(h, 'http') AND "
    f"{bad(url_part('h', 2))})) > 0 OR {bad(url_part('icon', 2))})")

PAGE_SQL = {
    "PctExtHyperlinks": PCT_EXT, "PctExtResourceUrls": PCT_RES, "ExtFavicon": ICON_SQL,
    "InsecureForms": flag_sql(f"{N_INSECURE} > 0"), "RelativeFormAction": flag_sql(f"{N_REL} > 0"),
    "ExtFormAction": flag_sql(f"{away_sql('post_hosts')} > 0"),
    "AbnormalFormAction": flag_sql(f"{N_ABNORMAL} > 0"),
    "PctNullSelfRedirectHyperlinks": PCT_NULL, "FrequentDomainNameMismatch": MISMATCH_SQL,
    "FakeLinkInStatusBar": STATUS_SQL, "RightClickDisabled": RIGHT_SQL, "PopUpWindow": POPUP_SQL,
    "SubmitInfoToEmail": N_EMAIL, "IframeOrFrame": FRAME_SQL, "MissingTitle": TITLE_SQL,
    "ImagesOnlyInForm": IMAGES_SQL, "PctExtResourceUrlsRT": rt_sql(PCT_RES),
    "AbnormalExtFormActionR": flag_sql(f"{N_ABNORMAL} > 0"), "ExtMetaScriptLinkRT": "0",
    "PctExtNullSelfRedirectHyperlinksRT": rt_sql(PCT_NULL),
}

ABSOLUTE_SQL = (
    f"CASE WHEN {url_part('h', 1)} <> '' THEN h WHEN starts_with(h, '//') THEN base_scheme || ':' || h "
    f"WHEN starts_with(h, '/') THEN base_scheme || '://' || base || h ELSE base_scheme || '://' || base "
    f"|| {url_part('url', 3)} || h END")
AWAY = f"({host_sql('h')}) <> '' AND ({host_sql('h')}) <> base"

# ---- queries ---------------------------------------------------------------------------------------------


def _summaries(spark, sf_dir) -> DataFrame:
    return P.summarise(I.captured(spark, sf_dir))


def ht1_links(spark, sf_dir) -> DataFrame:
    return _summaries(spark, sf_dir).select("page_id", "links.*")


def ht2_resources(spark, sf_dir) -> DataFrame:
    return _summaries(spark, sf_dir).select("page_id", "resources.*")


def ht3_forms(spark, sf_dir) -> DataFrame:
    return _summaries(spark, sf_dir).select("page_id", "forms.*")


def ht4_14_page_flags(spark, sf_dir) -> DataFrame:
    f = P.page_features(I.captured(spark, sf_dir))
    return f.select("page_id", "_page_error", *PAGE_SQL).withColumnRenamed("_page_error", "page_error")


def ht15_vec48_uncaptured(spark, sf_dir) -> DataFrame:
    return P.feature_columns(I.urls(spark, sf_dir), "url", None).drop("url")


def vec48_page_features(spark, sf_dir) -> DataFrame:
    return P.feature_vector(I.captured(spark, sf_dir)).select("page_id", "features")


def vec48_mail_content(spark, sf_dir) -> DataFrame:
    """Vectors of mails: by their first link, else by their text."""
    m = I.mails(spark, sf_dir).withColumn("kind", F.lit("email"))
    return P.content_vector(m, "text", "kind").select("doc_id", "features")


def _responses(spark, sf_dir) -> DataFrame:
    c = I.captured(spark, sf_dir)
    n = F.col("page_id")
    raw = F.encode("html", "UTF-8")
    return c.select(
        "page_id", "url", F.when(n % 5 == 0, F.concat("url", F.lit("#moved"))).alias("final_url"),
        F.when(n % 7 == 3, 404).otherwise(200).alias("status"),
        F.when(n % 11 == 4, "application/pdf").when(n % 11 == 5, None)
        .otherwise("Text/HTML; charset=utf-8").alias("content_type"),
        F.when(n % 6 == 1, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw).alias("body"))


def src6_captured_responses(spark, sf_dir) -> DataFrame:
    pages = accepted_pages(_responses(spark, sf_dir))
    return pages.select("page_id", "url", "final_url", F.md5("html").alias("html_md5"),
                        F.length("html").alias("n_chars"))


def flagship_risk_by_tier(spark, sf_dir) -> DataFrame:
    """Pages to URL, page and tagger features, rule confidence, and counts per tier."""
    vectors = P.feature_columns(I.captured(spark, sf_dir))
    tagged = tagging.tag_table(vectors.withColumn("text", F.lit(None).cast("string")), "text", "url")
    n_ext = F.col("PctExtHyperlinks").cast("double")
    score = F.least(F.lit(1.0), F.col("confidence_score") + F.round(n_ext, 6) * 0.5
                    + F.col("EmbeddedBrandName") * 0.25 + F.col("FrequentDomainNameMismatch") * 0.25)
    leveled = tagged.withColumn("p", F.round(score, 6)).withColumn("level", risk.risk_level(F.col("p")))
    return leveled.groupBy("level").agg(
        F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"),
        F.sum("UrlLength").cast("bigint").alias("url_chars"),
        F.sum("NumNumericChars").cast("bigint").alias("digits"))


ALL_PAGE = f"{I.CAPTURED}, {ELEMENTS}"
FULL_SQL = ", ".join(
    f"CAST(CASE WHEN {TU.BALANCED} AND NOT page_error THEN " + (
        f"({TU.URL_SQL[n]})" if n in TU.URL_SQL else n) + f" ELSE 0 END AS FLOAT) AS {n}"
    for n in V.FEATURE_NAMES)
PAGE_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in PAGE_SQL.items())
VECTORS = (
    f"{ALL_PAGE}, page_side AS (SELECT page_id, {ERROR_SQL} AS page_error, {PAGE_COLUMNS} FROM resolved), "
    "urls AS (SELECT page_id, url FROM captured), "
    f"{TU.FULL_URL}, {TU.url_parts_sql('full_url', 'u', 'parts')}, "
    f"vectors AS (SELECT parts.page_id, {FULL_SQL} FROM parts JOIN page_side ON parts.page_id = page_side.page_id)"
)
FIRST_LINK = f"regexp_extract(text, {I.quote(TU.TEXT_URL)})"
ZERO_PAGE = ", ".join(f"0 AS {n}" for n in PAGE_SQL)

QUERIES = {
    "ht1_links": ht1_links,
    "ht2_resources": ht2_resources,
    "ht3_forms": ht3_forms,
    "ht4_14_page_flags": ht4_14_page_flags,
    "ht15_vec48_uncaptured": ht15_vec48_uncaptured,
    "vec48_page_features": vec48_page_features,
    "vec48_mail_content": vec48_mail_content,
    "src6_captured_responses": src6_captured_responses,
    "flagship_risk_by_tier": flagship_risk_by_tier,
}

SQL = {
    "ht1_links": (
        f"WITH {ALL_PAGE} SELECT page_id, len(hrefs) AS total, len(links) - {away_sql('link_hosts')} AS internal, "
        f"{away_sql('link_hosts')} AS external, {N_NULL} AS \"null\", {PCT_EXT} AS pct_external, "
        f"{PCT_NULL} AS pct_null, list_transform(list_filter(links, lambda h: NOT ({AWAY})), lambda h: "
        f"{ABSOLUTE_SQL}) AS internal_list, list_transform(list_filter(links, lambda h: {AWAY}), lambda h: "
        f"{ABSOLUTE_SQL}) AS external_list FROM resolved"),
    "ht2_resources": (
        f"WITH {ALL_PAGE} SELECT page_id, len(resources) AS total, len(resources) - "
        f"{away_sql('resource_hosts')} AS internal, {away_sql('resource_hosts')} AS external, "
        f"{PCT_RES} AS pct_external FROM resolved"),
    "ht3_forms": (
        f"WITH {ALL_PAGE} SELECT page_id, len(actions) AS total, {N_INSECURE} AS insecure, "
        f"{away_sql('post_hosts')} AS external, {N_REL} AS relative, {N_ABNORMAL} AS abnormal, "
        f"{N_EMAIL} AS submit_to_email, {flag_sql(N_INSECURE + ' > 0')} AS has_insecure, "
        f"{flag_sql(away_sql('post_hosts') + ' > 0')} AS has_external, {flag_sql(N_REL + ' > 0')} AS "
        f"has_relative, {flag_sql(N_ABNORMAL + ' > 0')} AS has_abnormal FROM resolved"),
    "ht4_14_page_flags": f"WITH {ALL_PAGE} SELECT page_id, {ERROR_SQL} AS page_error, {PAGE_COLUMNS} FROM resolved",
    "ht15_vec48_uncaptured": (
        f"WITH {I.URLS}, {TU.FULL_URL}, {TU.url_parts_sql('full_url', 'u', 'parts0')}, "
        f"parts AS (SELECT *, false AS page_error, {ZERO_PAGE} FROM parts0) SELECT page_id, {FULL_SQL} FROM parts"),
    "vec48_page_features": (
        f"WITH {VECTORS} SELECT page_id, [{', '.join(V.FEATURE_NAMES)}] AS features FROM vectors"),
    "vec48_mail_content": (
        f"WITH {I.MAILS}, {TU.LOWERED}, urls AS (SELECT doc_id AS page_id, {FIRST_LINK} AS url FROM mails), "
        f"{TU.FULL_URL}, {TU.url_parts_sql('full_url', 'u', 'parts0')}, "
        f"parts AS (SELECT *, false AS page_error, {ZERO_PAGE} FROM parts0), "
        f"url_side AS (SELECT page_id, {FULL_SQL} FROM parts) SELECT l.doc_id, CASE WHEN l.text IS NULL THEN "
        f"NULL WHEN u.url <> '' THEN [{', '.join('s.' + n for n in V.FEATURE_NAMES)}] ELSE CAST(list_concat([0, "
        f"0, 0, least(length(t), 1000), 0, 0, 0, 0, 0, {TU.count_sql('t', '%')}, 0, 0, 0, "
        f"{TU.chars_sql('t', TU.DIGITS)}, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, {TU.SENSITIVE.replace('{c}', 't')}], "
        "list_transform(range(22), lambda x: 0)) AS FLOAT[]) END AS features FROM lowered l JOIN urls u ON "
        "l.doc_id = u.page_id JOIN url_side s ON l.doc_id = s.page_id"),
    "src6_captured_responses": (
        f"WITH {I.CAPTURED} SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN url || '#moved' ELSE url END AS "
        "final_url, md5(html) AS html_md5, length(html) AS n_chars FROM captured WHERE page_id % 7 <> 3 "
        "AND page_id % 11 NOT IN (4, 5) AND octet_length(encode(html)) + CASE WHEN page_id % 6 = 1 THEN 1 "
        f"ELSE 0 END <= 5242880 AND {url_part('url', 1)} <> '' AND {url_part('url', 2)} <> '' AND NOT "
        + bad(url_part("url", 2))),
    "flagship_risk_by_tier": (
        f"WITH {VECTORS}, {TU.TAGGER_PARTS}, tagged AS (SELECT v.*, least({TU.dbl(1.0)}, least(greatest("
        + " + ".join([TU.dbl(0.0)] + [f"CASE WHEN h.url <> '' THEN {TU.TAGGER_SQL[n]} ELSE 0 END * {TU.dbl(w)}"
                                      for n, w in V.CONFIDENCE_WEIGHTS.items() if n in TU.TAGGER_SQL])
        + f", {TU.dbl(0.0)}), {TU.dbl(1.0)}) + round(CAST(PctExtHyperlinks AS DOUBLE), 6) * {TU.dbl(0.5)} + "
        f"EmbeddedBrandName * {TU.dbl(0.25)} + FrequentDomainNameMismatch * {TU.dbl(0.25)}) AS score FROM vectors v "
        "JOIN hosts h ON v.page_id = h.page_id), leveled AS (SELECT *, round(score, 6) AS p FROM tagged), "
        f"named AS (SELECT *, CASE WHEN p <= {TU.dbl(0.3)} THEN 'low' WHEN p <= {TU.dbl(0.7)} THEN 'medium' "
        "ELSE 'high' END AS level FROM leveled) SELECT level, count(*) AS n, round(avg(p), 6) AS mean_p, "
        "CAST(sum(UrlLength) AS BIGINT) AS url_chars, CAST(sum(NumNumericChars) AS BIGINT) AS digits "
        "FROM named GROUP BY level"),
}
