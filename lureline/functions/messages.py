"""Chat messages: routing, link extraction and reply texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lureline import fixed_values as V
from lureline.functions import text as T
from lureline.shared import let

# A host by its characters: one label, then characters that continue it, back to the last dot that letters follow.
# No dot without a letter or digit after it, no 64th character of a label. Java steps over single characters in a
# loop, over whole labels by recursion, so that a host of any number of labels is found in this form only.
_NEXT = r"(?!\.(?![a-zA-Z0-9]))(?!(?<=\.[-a-zA-Z0-9]{63})[-a-zA-Z0-9])[-a-zA-Z0-9.]"
_RUN = rf"{V.HOST_LABEL}+(?=\.)(?:{_NEXT})*\."
DOMAIN = rf"{_RUN}{V.TOP_LEVEL}(?:/[^{T.SPACE}]*)?"  # with (?U)


def hosts(message: Column, prefix: str = "") -> Column:
    """Hosts with their paths, in order, each after the prefix.

    Where none begins, labels that lead to no top level are passed over up to their last dot, as none can begin
    among them; so the time grows with the text, not with its square.
    """
    found = F.regexp_extract_all(message, F.lit(f"(?U){prefix}(?:{DOMAIN}|{_RUN})"), F.lit(0))
    return F.filter(found, lambda h: ~h.endswith(".") | F.contains(h, F.lit("/")))


def extract_urls(message: Column) -> Column:
    """Links of a message, completed with http://, first appearance kept."""
    none = F.array().cast("array<string>")

    def complete(u: Column) -> Column:
        known = u.startswith("http://") | u.startswith("https://")
        return F.when(known, u).otherwise(F.concat(F.lit("http://"), u))

    def links(v: Column) -> Column:
        m = v["stripped"]
        # the searches are passed over where what they must hold is missing
        dotted = m.rlike(rf"\.{V.TOP_LEVEL}")
        found = F.concat(
            F.when(~F.contains(m, F.lit("://")), none).otherwise(F.regexp_extract_all(m, F.lit(T.TEXT_URL), F.lit(0))),
            F.when(~F.contains(m, F.lit("www.")) | ~dotted, none).otherwise(hosts(m, r"www\.")),
            F.when(~dotted, none).otherwise(hosts(m)))
        return (
            F.when(m.startswith("http://") | m.startswith("https://"), F.array(m))
            .when(m.rlike(f"(?U)^{DOMAIN}$"), F.array(F.concat(F.lit("http://"), m)))
            .otherwise(F.array_distinct(F.transform(F.transform(found, T.strip), complete)))
        )

    return let({"stripped": T.strip(message)}, links)


def is_mail(message: Column) -> Column:
    def rule(v: Column) -> Column:
        hits = T.distinct_hits(v["low"], V.MAIL_INDICATORS)
        opening = T.contains_any(v["low"], V.MAIL_OPENINGS)
        closing = T.contains_any(v["low"], V.MAIL_CLOSINGS)
        linked = v["message"].rlike(r"https?://|www\.")
        return (hits >= 2) | ((F.length(v["message"]) > 150) & (opening | closing)) | (
            opening & closing & linked)

    return let({"message": message, "low": F.lower(message)}, rule)


def _mentions(low: Column, phrases: list[str], word_boundary: bool) -> Column:
    if not word_boundary:
        return T.contains_any(low, phrases)
    return low.rlike(r"\b(?:" + "|".join(phrases) + r")\b")


def route_name(message: Column, urls: Column, word_boundary: bool = False) -> Column:
    """First rule that fits: greeting, help, mail_url, mail, url, unclear.

    ``word_boundary`` asks for whole words, so that "this" is no greeting.
    """
    linked = F.size(urls) > 0
    return let({"low": T.strip(F.lower(message))}, lambda v: (
        F.when(_mentions(v["low"], V.GREETINGS, word_boundary), "greeting")
        .when(_mentions(v["low"], V.HELP_WORDS, word_boundary), "help")
        .when(is_mail(message), F.when(linked, "mail_url").otherwise("mail"))
        .when(linked, "url")
        .otherwise("unclear")
    ))


def route(message: Column, word_boundary: bool = False) -> Column:
    """Routing record: rule, whether to analyse, what to analyse, reply text."""
    texts = F.create_map(*[F.lit(x) for pair in V.ROUTE_TEXT.items() for x in pair])

    def record(v: Column) -> Column:
        name = v["name"]
        link = name.isin("mail_url", "url")
        return F.struct(
            name.alias("route"),
            name.isin("mail_url", "mail", "url").alias("requires_analysis"),
            F.when(link, v["first"]).when(name == "mail", message)
            .alias("extracted_content"),
            F.when(link, "url").when(name == "mail", "email").alias("content_type"),
            F.element_at(texts, name).alias("message"),
        )

    return let({"urls": extract_urls(message)}, lambda u: let({
        "name": route_name(message, u["urls"], word_boundary), "first": F.try_element_at(u["urls"], F.lit(1))}, record))


def display_name(feature: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.FEATURE_DISPLAY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, feature), feature)


def one_decimal(x: Column) -> Column:
    """Text with one decimal, ties judged on the exact binary value and then to even.

    ``x * 16 - k + x * 4`` is an exact comparison of ``20 x`` with its nearest integer ``k``.
    """
    k = F.round(x * 20)
    above = (x * 16 - k) + x * 4
    tie = (k % 2 == 1) & (F.abs(above) < 1e-6)
    low = F.floor(k / 2)
    picked = F.when(above > 0, low + 1).when(above < 0, low).otherwise(low + low % 2)
    return F.format_string("%.1f", F.when(tie, picked / 10).otherwise(x))


def reply(
    level: Column, is_phishing: Column, confidence: Column, recommendation: Column,
    feature_names: Column | None = None,
) -> Column:
    """Reply text from risk level, verdict, confidence and up to three indicators."""
    def by_level(values: dict[str, str], default: str) -> Column:
        chain = F
        for key, value in values.items():
            chain = chain.when(level == key, F.lit(value))
        return chain.otherwise(F.lit(default))

    icons = by_level({k: t["icon"] for k, t in V.TIERS.items()}, "❓")
    verdict = F.when(is_phishing, "phishing attempt").otherwise("legitimate")
    article = F.when(is_phishing, "a **").otherwise("**")
    parts = [
        icons, F.lit(" **"), F.upper(level), F.lit(" RISK**\n\nThis appears to be "), article,
        verdict, F.lit("** with "), one_decimal(confidence * 100),
        F.lit("% confidence.\n\n"),
    ]
    if feature_names is not None:
        lines = F.transform(F.slice(feature_names, 1, 3),
                            lambda n: F.concat(F.lit("• "), display_name(n), F.lit("\n")))
        parts.append(F.when(
            F.size(feature_names) > 0,
            F.concat(F.lit("**Key Indicators:**\n"), F.array_join(lines, ""), F.lit("\n")),
        ).otherwise(""))
    parts += [F.lit("**Recommendation:** "), recommendation, F.lit("\n"),
              by_level(V.REPLY_TIPS, "")]
    return F.concat(*parts)
