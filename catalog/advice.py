"""Risk tier and chat message queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.text_url import SPACE, TEXT_URL, any_sql, dbl, hits_sql
from lureline import fixed_values as V
from lureline.functions import messages as M
from lureline.functions import risk as R
from lureline.functions import text as T

LEVEL_SQL = (f"CASE WHEN probability <= {dbl(0.3)} THEN 'low' WHEN probability <= {dbl(0.7)} THEN 'medium' "
             "ELSE 'high' END")
SCORE_SQL = "least(100, CAST(trunc(probability * CAST(100 AS DOUBLE)) AS INT))"
CONF_SQL = (f"CASE WHEN greatest(probability, 1 - probability) >= {dbl(0.8)} THEN 'high' WHEN "
            f"greatest(probability, 1 - probability) >= {dbl(0.6)} THEN 'medium' ELSE 'low' END")
THREAT_SQL = "CASE " + " ".join(
    f"WHEN probability <= {dbl(limit)} THEN '{name}'" for limit, name in V.THREAT_STEPS[:-1]
) + f" ELSE '{V.THREAT_STEPS[-1][1]}' END"
ASSESSED = f"{I.PROBABILITIES}, assessed AS (SELECT *, {LEVEL_SQL} AS level FROM probabilities)"
TIER_SQL = "tiers AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{lvl}', " + ", ".join(I.quote(t[n]) for n in
                              ("color", "icon", "urgency", "recommendation", "description", "why_risky"))
    + ", " + ", ".join(I.sql_list(t[n]) for n in ("action_items", "warning_signs", "tactics", "immediate"))
    + ")" for lvl, t in V.TIERS.items()
) + (") AS t(level, color, icon, urgency, recommendation, description, why_risky, action_items, "
     "warning_signs, tactics, immediate))")


def rsk1_2_4_5_levels(spark, sf_dir) -> DataFrame:
    p = F.col("probability")
    return I.probabilities(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", R.risk_level(p).alias("level"), R.risk_score(p).alias("score"),
        R.confidence_level(p).alias("confidence_level"), R.threat_level(p).alias("threat_level"))


def rsk3_6_jn2_tier_texts(spark, sf_dir) -> DataFrame:
    """Every probability joined with its tier's texts, summed up per order line part."""
    full = R.assess(I.probabilities(spark, sf_dir))
    return full.groupBy("level", "color", "icon", "urgency", "recommendation", "description",
                        "why_risky", "action_items", "warning_signs", "tactics", "immediate").agg(
        F.count("*").alias("n"), F.sum("score").alias("score_sum"))


def rsk7_detailed_analysis(spark, sf_dir) -> DataFrame:
    d = R.detailed(I.probabilities(spark, sf_dir))
    return d.select(
        "l_orderkey", "l_linenumber", F.col("risk_breakdown.user_friendly_score").alias("shown_score"),
        F.col("risk_breakdown.risk_category").alias("category"),
        F.col("risk_breakdown.threat_level").alias("threat"),
        F.col("severity_indicators.confidence").alias("confidence"),
        F.size("explanation.what_to_look_for").alias("n_signs"),
        F.size("next_steps.prevention").alias("n_tips"),
        F.col("next_steps.resources.reporting").alias("reporting"))


def msg1_route(spark, sf_dir) -> DataFrame:
    r = I.messages(spark, sf_dir).select("msg_id", M.route(F.col("message")).alias("r"))
    return r.select("msg_id", "r.*")


def msg2_win3_extract_urls(spark, sf_dir) -> DataFrame:
    return I.messages(spark, sf_dir).select("msg_id", M.extract_urls(F.col("message")).alias("urls"))


def msg3_mail_detection(spark, sf_dir) -> DataFrame:
    return I.messages(spark, sf_dir).select("msg_id", M.is_mail(F.col("message")).alias("is_mail"))


def _indicator_names(row_id):
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.element_at(
        F.array(*[F.lit(n) for n in V.FEATURE_NAMES]), ((row_id * 5 + j * 7) % 48 + 1).cast("int")))


def msg4_reply(spark, sf_dir) -> DataFrame:
    """Reply text of every probability with three indicators."""
    a = R.assess(I.probabilities(spark, sf_dir))
    p = F.col("probability")
    return a.select("l_orderkey", "l_linenumber", M.reply(
        F.col("level"), p > 0.5, F.greatest(p, 1 - p), F.col("recommendation"),
        _indicator_names(F.col("l_partkey"))).alias("reply"))


def msg5_display_names(spark, sf_dir) -> DataFrame:
    lines = I.probabilities(spark, sf_dir)
    names = lines.select(F.explode(_indicator_names(F.col("l_partkey"))).alias("feature"))
    return names.groupBy("feature").agg(F.count("*").alias("n")).select(
        "feature", M.display_name(F.col("feature")).alias("shown"), "n")


LABEL = "[a-zA-Z0-9][-a-zA-Z0-9]{0,62}"
DOMAIN_SQL = rf"{LABEL}(?:\.{LABEL})*\.[a-zA-Z]{{2,6}}(?:/[^{SPACE}]*)?"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


URLS_SQL = (
    "CASE WHEN starts_with(m, 'http://') OR starts_with(m, 'https://') THEN [m] "
    f"WHEN regexp_matches(m, '^{DOMAIN_SQL}$') THEN ['http://' || m] ELSE (SELECT coalesce(list(u ORDER BY first), "
    "[]) FROM (SELECT u, min(i) AS first FROM (SELECT CASE WHEN starts_with(x, 'http://') OR starts_with(x, "
    "'https://') THEN x ELSE 'http://' || x END AS u, i FROM (SELECT unnest(found) AS x, "
    "generate_subscripts(found, 1) AS i)) GROUP BY u)) END"
)
FOUND = (
    f"stripped AS (SELECT msg_id, message, {strip_sql('message')} AS m FROM messages), found AS (SELECT *, "
    f"list_concat(list_concat(regexp_extract_all(m, {I.quote(TEXT_URL)}), regexp_extract_all(m, "
    f"'www\\.{DOMAIN_SQL}')), regexp_extract_all(m, '{DOMAIN_SQL}')) AS found FROM stripped), "
    f"linked AS (SELECT *, {URLS_SQL} AS urls FROM found)"
)
MAIL_SQL = (
    f"({hits_sql('lower(message)', V.MAIL_INDICATORS)} >= 2 OR (length(message) > 150 AND "
    f"({any_sql('lower(message)', V.MAIL_OPENINGS)} OR {any_sql('lower(message)', V.MAIL_CLOSINGS)})) OR "
    f"({any_sql('lower(message)', V.MAIL_OPENINGS)} AND {any_sql('lower(message)', V.MAIL_CLOSINGS)} AND "
    "regexp_matches(message, 'https?://|www\\.')))"
)
ROUTED = (
    f"{I.MESSAGES}, {FOUND}, routed AS (SELECT *, CASE WHEN {any_sql('lower(m)', V.GREETINGS)} THEN 'greeting' "
    f"WHEN {any_sql('lower(m)', V.HELP_WORDS)} THEN 'help' WHEN {MAIL_SQL} THEN CASE WHEN len(urls) > 0 THEN "
    "'mail_url' ELSE 'mail' END WHEN len(urls) > 0 THEN 'url' ELSE 'unclear' END AS route FROM linked)"
)
NAMES_SQL = (f"list_transform([0, 1, 2, 3], lambda j: ({I.sql_list(V.FEATURE_NAMES)})"
             "[(l_partkey * 5 + j * 7) % 48 + 1])")


def display_sql(c: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {c} = '{k}' THEN {I.quote(v)}" for k, v in V.FEATURE_DISPLAY.items()) + f" ELSE {c} END"


REPLY_SQL = (
    "t.icon || ' **' || upper(level) || ' RISK**' || chr(10) || chr(10) || 'This appears to be ' || CASE WHEN "
    "probability > 0.5::DOUBLE THEN 'a **phishing attempt' ELSE '**legitimate' END || '** with ' || printf('%.1f', "
    "greatest(probability, 1 - probability) * 100) || '% confidence.' || chr(10) || chr(10) || "
    "'**Key Indicators:**' || chr(10) || array_to_string(list_transform(names[1:3], lambda n: '• ' || "
    + display_sql("n") + " || chr(10)), '') || chr(10) || '**Recommendation:** ' || t.recommendation || chr(10) || "
    "CASE level " + " ".join(f"WHEN '{k}' THEN {I.quote(v)}" for k, v in V.REPLY_TIPS.items()) + " END"
)

QUERIES = {
    "rsk1_2_4_5_levels": rsk1_2_4_5_levels,
    "rsk3_6_jn2_tier_texts": rsk3_6_jn2_tier_texts,
    "rsk7_detailed_analysis": rsk7_detailed_analysis,
    "msg1_route": msg1_route,
    "msg2_win3_extract_urls": msg2_win3_extract_urls,
    "msg3_mail_detection": msg3_mail_detection,
    "msg4_reply": msg4_reply,
    "msg5_display_names": msg5_display_names,
}

SQL = {
    "rsk1_2_4_5_levels": (
        f"WITH {I.PROBABILITIES} SELECT l_orderkey, l_linenumber, {LEVEL_SQL} AS level, {SCORE_SQL} AS score, "
        f"{CONF_SQL} AS confidence_level, {THREAT_SQL} AS threat_level FROM probabilities"),
    "rsk3_6_jn2_tier_texts": (
        f"WITH {ASSESSED}, {TIER_SQL} SELECT t.*, count(*) AS n, CAST(sum({SCORE_SQL}) AS BIGINT) AS score_sum "
        "FROM assessed a JOIN tiers t ON a.level = t.level GROUP BY ALL"),
    "rsk7_detailed_analysis": (
        f"WITH {ASSESSED}, {TIER_SQL} SELECT l_orderkey, l_linenumber, CAST(CAST(trunc(probability * "
        "CAST(100 AS DOUBLE)) AS INT) AS VARCHAR) || '/100' AS shown_score, upper(a.level[1]) || a.level[2:] AS "
        f"category, {THREAT_SQL} AS threat, {CONF_SQL} AS confidence, len(warning_signs) AS n_signs, "
        f"{len(V.PREVENTION_TIPS)} AS n_tips, {I.quote(V.HELPFUL_RESOURCES['reporting'])} AS reporting "
        "FROM assessed a JOIN tiers t ON a.level = t.level"),
    "msg1_route": (
        f"WITH {ROUTED} SELECT msg_id, route, route IN ('mail_url', 'mail', 'url') AS requires_analysis, "
        "CASE WHEN route IN ('mail_url', 'url') THEN urls[1] WHEN route = 'mail' THEN message END AS "
        "extracted_content, CASE WHEN route IN ('mail_url', 'url') THEN 'url' WHEN route = 'mail' THEN 'email' "
        "END AS content_type, CASE route "
        + " ".join(f"WHEN '{k}' THEN {I.quote(v)}" for k, v in V.ROUTE_TEXT.items())
        + " END AS message FROM routed"),
    "msg2_win3_extract_urls": f"WITH {I.MESSAGES}, {FOUND} SELECT msg_id, urls FROM linked",
    "msg3_mail_detection": f"WITH {I.MESSAGES} SELECT msg_id, {MAIL_SQL} AS is_mail FROM messages",
    "msg4_reply": (
        f"WITH {ASSESSED}, {TIER_SQL}, named AS (SELECT *, {NAMES_SQL} AS names FROM assessed) SELECT "
        f"l_orderkey, l_linenumber, {REPLY_SQL} AS reply FROM named a JOIN tiers t USING (level)"),
    "msg5_display_names": (
        f"WITH {I.PROBABILITIES}, names AS (SELECT unnest({NAMES_SQL}) AS feature FROM probabilities) SELECT "
        f"feature, {display_sql('feature')} AS shown, count(*) AS n FROM names GROUP BY feature"),
}
