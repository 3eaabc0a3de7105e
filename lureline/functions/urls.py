"""URL features as Column -> Column functions. The URL is parsed once by one pattern."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureline import fixed_values as V
from lureline.functions import text as T
from lureline.shared import let, once

# groups: scheme, authority, path, query
URL_PARTS = (
    r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
)

LEADING = "".join(map(chr, range(0x21)))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6() -> str:
    """IPv6 text forms built by rule: full, or shortened once by ``::``, or with a v4 tail."""
    h = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{IPV4}", f"(?:{h}:){{1,7}}:", f":(?::{h}){{1,7}}", "::",
             f"::(?:{h}:){{0,5}}{IPV4}"]
    for left in range(1, 7):
        forms.append(f"(?:{h}:){{{left}}}(?::{h}){{1,{7 - left}}}")
        if left <= 5:
            forms.append(f"(?:{h}:){{{left}}}:(?:{h}:){{0,{5 - left}}}{IPV4}")
    return "(?:" + "|".join(forms) + ")(?:%[^%]+)?"


IP_LITERAL = f"^(?:{IPV4}|{_ipv6()})$"


def normalise_for_parsing(u: Column) -> Column:
    """Leading blanks and controls go, tabs and line breaks go everywhere."""
    out = F.ltrim(u, F.lit(LEADING))
    for c in "\t\r\n":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def part(u: Column, group: int) -> Column:
    return F.regexp_extract(normalise_for_parsing(u), f"(?s){URL_PARTS}", group)


def scheme(u: Column) -> Column:
    return F.lower(part(u, 1))


def netloc(u: Column) -> Column:
    """Whole authority, user info and port included."""
    return part(u, 2)


def path(u: Column) -> Column:
    return F.regexp_replace(part(u, 3), r";[^/]*$", "")


def query(u: Column) -> Column:
    return part(u, 4)


def _delimiter_look_alikes() -> str:
    """Characters whose compatibility form holds a delimiter of the authority."""
    found = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)])
             if set("/?#@:") & set(unicodedata.normalize("NFKC", c))]
    return "[" + "".join(found) + "]"


LOOK_ALIKES = _delimiter_look_alikes()
BRACKETED = rf"^[^\[]*\[(?:v[0-9A-Fa-f]+\.[^\]]+|{_ipv6()})(?:\].*)?$"


def parses(host: Column) -> Column:
    """False for an authority that cannot be parsed.

    Brackets come as a pair and hold an IP literal, and no character may stand for a delimiter.
    """
    opened, closed = F.contains(host, F.lit("[")), F.contains(host, F.lit("]"))
    plain = ~host.rlike(r"[^\x00-\x7f]")  # the cheap test goes first, as all look-alikes are beyond ASCII
    return (opened == closed) & (~opened | host.rlike(BRACKETED)) & (plain | ~host.rlike(LOOK_ALIKES))


def hostname(host: Column) -> Column:
    """Lower-case host of an authority without user info, port and brackets."""
    tail = F.regexp_replace(host, r"(?s)^.*@", "")
    inside = F.regexp_extract(tail, r"\[([^\]]*)", 1)
    return F.lower(F.when(F.contains(tail, F.lit("[")), inside)
                   .otherwise(F.regexp_extract(tail, r"^([^:]*)", 1)))


def with_protocol(u: Column) -> Column:
    known = u.startswith("http://") | u.startswith("https://")
    return F.when(known, u).otherwise(F.concat(F.lit("http://"), u))


def flag(condition: Column) -> Column:
    return condition.cast("int")


# ---- single features -------------------------------------------------------------------------

def count_dots(u: Column) -> Column:
    return T.occurrences(u, ".")


def subdomain_level(host: Column) -> Column:
    return F.greatest(T.occurrences(host, ".") - 1, F.lit(0))


def path_level(p: Column) -> Column:
    return F.when(p.isin("", "/"), 0).otherwise(T.occurrences(p, "/"))


def query_components(q: Column) -> Column:
    """Distinct decoded names that carry a non-empty value."""
    pairs = F.filter(F.split(q, "&"), lambda p: p.rlike(r"(?s)^[^=]*=."))

    def name(p: Column) -> Column:
        raw = F.regexp_extract(p, r"(?s)^([^=]*)=", 1)
        return F.try_url_decode(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"))  # what is no escape stays

    return F.size(F.array_distinct(F.transform(pairs, name)))


def random_string(host: Column) -> Column:
    consonants = T.matched_chars(host, r"b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z\x{212a}")
    return flag((F.length(host) > 0) & (consonants > F.length(host) * F.lit(0.8)))


def is_ip(host: Column) -> Column:
    return flag(host.rlike(IP_LITERAL))


def words_in_subdomains(host: Column) -> Column:
    sub = F.regexp_extract(F.lower(host), r"(?s)^(.*)\.[^.]*\.[^.]*$", 1)
    return flag(let({"sub": sub}, lambda v: T.contains_any(v["sub"], V.SUSPICIOUS_HOST_WORDS)))


def words_in_path(p: Column) -> Column:
    return flag(let({"low": F.lower(p)}, lambda v: T.contains_any(v["low"], V.SUSPICIOUS_HOST_WORDS)))


def embedded_brand(host: Column) -> Column:
    """The first brand of the list found in the host decides; typo variants only without one."""
    def rule(v: Column) -> Column:
        h, chain = v["low"], F
        for brand in V.BRANDS:
            own = h.isin(f"{brand}.com", f"www.{brand}.com") | h.endswith(f".{brand}.com")
            chain = chain.when(F.contains(h, F.lit(brand)), F.when(own, 0).otherwise(1))
        return chain.otherwise(flag(T.contains_any(h, V.BRAND_TYPOS)))

    return let({"low": F.lower(host)}, rule)


def subdomain_level_rt(level: Column) -> Column:
    return F.when(level > 3, 1).when(level > 1, 0).otherwise(-1)


def url_length_rt(length: Column) -> Column:
    return F.when(length > 75, 1).when(length > 50, 0).otherwise(-1)


# ---- feature sets ------------------------------------------------------------------------------

def with_url_parts(df: DataFrame, url: str, prefix: str = "_u_") -> DataFrame:
    """Adds the completed URL and its parsed parts once; the features below read them."""
    full = df.withColumn(f"{prefix}full", with_protocol(F.col(url)))
    u = F.col(f"{prefix}full")
    parsed = once(full, {
        f"{prefix}host": netloc(u), f"{prefix}path": path(u), f"{prefix}query": query(u),
    })
    return once(parsed, {f"{prefix}fine": parses(F.col(f"{prefix}host"))})


def url_features(prefix: str = "_u_") -> dict[str, Column]:
    """Features that need the URL only, by name; all 0 where the URL cannot be parsed."""
    u, host, p, q = (F.col(f"{prefix}{n}") for n in ("full", "host", "path", "query"))
    level = subdomain_level(host)
    raw = {
        "NumDots": count_dots(u),
        "SubdomainLevel": level,
        "PathLevel": path_level(p),
        "UrlLength": F.length(u),
        "NumDash": T.occurrences(u, "-"),
        "NumDashInHostname": T.occurrences(host, "-"),
        "AtSymbol": flag(F.contains(u, F.lit("@"))),
        "TildeSymbol": flag(F.contains(u, F.lit("~"))),
        "NumUnderscore": T.occurrences(u, "_"),
        "NumPercent": T.occurrences(u, "%"),
        "NumQueryComponents": query_components(q),
        "NumAmpersand": T.occurrences(u, "&"),
        "NumHash": T.occurrences(u, "#"),
        "NumNumericChars": T.digit_count(u),
        "NoHttps": flag(~u.startswith("https://")),
        "RandomString": random_string(host),
        "IpAddress": is_ip(host),
        "DomainInSubdomains": words_in_subdomains(host),
        "DomainInPaths": words_in_path(p),
        "HttpsInHostname": flag(F.contains(host, F.lit("https"))),
        "HostnameLength": F.length(host),
        "PathLength": F.length(p),
        "QueryLength": F.length(q),
        "DoubleSlashInPath": flag(F.contains(p, F.lit("//"))),
        "NumSensitiveWords": T.sensitive_words(u),
        "EmbeddedBrandName": embedded_brand(host),
        "SubdomainLevelRT": subdomain_level_rt(level),
        "UrlLengthRT": url_length_rt(F.length(u)),
    }
    return {n: F.when(F.col(f"{prefix}fine"), c).otherwise(0) for n, c in raw.items()}


def tagger_url_features(u: Column, host_only: bool = False) -> Column:
    """The 10 URL features of the mail tagger as a struct; here the URL is taken as it is.

    ``host_only`` looks for suspicious endings and shorteners in the host alone, which avoids
    hits such as ``t.co`` inside ``microsoft.com``.
    """
    authority = netloc(u)
    host = F.when(parses(authority), hostname(authority)).otherwise("")
    low = F.lower(u)
    if host_only:
        bad_tld = reduce(lambda a, b: a | b, [host.endswith(t) for t in V.SUSPICIOUS_TLDS])
        short = reduce(lambda a, b: a | b, [
            (host == s) | host.endswith(f".{s}") | host.startswith(f"{s}.")
            for s in V.URL_SHORTENERS])
    else:
        bad_tld = T.contains_any(low, V.SUSPICIOUS_TLDS)
        short = T.contains_any(low, V.URL_SHORTENERS)
    return F.struct(
        is_ip(host).alias("has_ip"),
        F.length(u).alias("url_length"),
        flag(F.contains(u, F.lit("@"))).alias("has_at_symbol"),
        flag(F.contains(F.substring(u, 9, 1 << 30), F.lit("//"))).alias("double_slash_redirect"),
        flag(F.contains(u, F.lit("-"))).alias("has_hyphen"),
        F.when(host != "", T.occurrences(host, ".") - 1).otherwise(0).alias("subdomain_count"),
        flag(bad_tld).alias("suspicious_tld"),
        flag(u.startswith("https://")).alias("has_https"),
        flag(u.rlike(r":\p{Nd}")).alias("port_in_url"),
        flag(short).alias("shortening_service"),
    )


def resolved_netloc(link: Column, base_netloc: Column) -> Column:
    """Authority of a link resolved against a page: its own, none for ``mailto:`` and the
    like, or the page's."""
    own_scheme = part(link, 1) != ""
    authority = netloc(link)
    return F.when((authority != "") | own_scheme, authority).otherwise(base_netloc)
