"""Page features from captured HTML, row local: tags become arrays, no explode and no shuffle.

What is never closed (comment, script, form, title) runs to the end of the page, as in a browser;
this also keeps the patterns linear on hostile pages. Loops over attributes are possessive: they
take any number of them without recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureline import fixed_values as V
from lureline.functions import text as T
from lureline.functions import urls as U
from lureline.shared import once

_QUOTED = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
# one attribute after blanks, slashes or the quote that ends the one before; values come as written
_ATTRIBUTE = r"""(?:[\s/]++|(?<=["']))[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+))?+"""
# comments go, scripts and styles lose their bodies, other tags are stepped over as they are
_HIDDEN = (rf"(?is)<!--(?:.*?-->|.*\z)|(<(script|style)(?:[\s/]{_QUOTED})?+>)(?:.*?</(?:script|style)\s*>|.*\z)"
           rf"|(<[a-z/]{_QUOTED}>)")


def tag_pattern(names: str) -> str:
    # an unfinished tag runs to the end of the page in one step; `tags` drops it
    return rf"(?i)<(?:{names})(?:[\s/]{_QUOTED}(?:>|\z)|>)"


def tags(html: Column, names: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(tag_pattern(names)), F.lit(0))
    return F.filter(found, lambda t: t.endswith(">"))


def attributes(tag: Column) -> Column:
    """The attributes of a tag in order, each as written."""
    return F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))


def named(items: Column, name: str) -> Column:
    """Value of the first attribute of that name, without quotes; null when absent, '' when it has no value."""
    item = F.get(F.filter(items, lambda i: i.rlike(rf"(?i)^[\s/]*{name}(?:[\s=]|\z)")), F.lit(0))
    # a value that begins with a quote ends with it, see `_ATTRIBUTE`; without quotes it holds none
    return F.regexp_extract(item, r"""(?s)^[^=]*=\s*["']?(.*?)["']?\z""", 1)


def decoded(arrays: list[Column]) -> Column:
    """All values with character references decoded, by one expression: the table of references is
    large and should be in a plan once."""
    def decode(v: Column) -> Column:
        return F.when(F.contains(v, F.lit("&")), T.unescape_entities(v)).otherwise(v)

    return F.transform(F.concat(*arrays), decode)


def visible_markup(html: Column) -> Column:
    """HTML without comments and without the bodies of scripts and styles, whichever begins first."""
    return F.regexp_replace(html, _HIDDEN, "$1$3")


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _targets(elements: Column, name: str) -> Column:
    """Values of one attribute over the elements that carry it."""
    return _present(F.transform(elements, lambda t: named(attributes(t), name)))


def _resolved(targets: Column, base: Column) -> Column:
    """Each target with its scheme and the authority it leads to, parsed once."""
    parsed = F.transform(targets, lambda t: F.struct(
        t.alias("target"), U.scheme(t).alias("scheme"), U.netloc(t).alias("own")))
    return F.transform(parsed, lambda p: F.struct(
        p["target"].alias("target"), p["scheme"].alias("scheme"),
        F.when((p["own"] != "") | (p["scheme"] != ""), p["own"]).otherwise(base).alias("host")))


def _is_external(host: Column, base: Column) -> Column:
    return (host != "") & (host != base)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _size(array: Column, keep: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(array, keep))


def with_page_elements(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds the tag arrays that the feature operators share, each extracted once per page.

    ``_base`` is the page's own authority, after redirects. Every step keeps its results (`once`), so
    no page, tag or target is parsed again for each feature that reads it.
    """
    base = F.col("_base")
    markup = F.col("_markup")
    out = once(df, {"_markup": visible_markup(F.col(html)), "_base": U.netloc(F.col(url)),
                    "_base_scheme": U.scheme(F.col(url)), "_lower": F.lower(html)})
    title = F.regexp_extract("_markup", rf"(?is)<title(?:[\s/]{_QUOTED})?+>(.*?)(?:</title|\z)", 1)
    link = F.transform(tags(markup, "link"), attributes)
    out = once(out, {
        "_hrefs": _targets(tags(markup, "a"), "href"),
        "_srcs": _targets(tags(markup, "img|script"), "src"),
        "_linked": F.transform(link, lambda i: F.struct(
            F.coalesce(named(i, "rel"), F.lit("")).alias("rel"), named(i, "href").alias("href"))),
        "_actions": F.transform(tags(markup, "form"), lambda t: F.coalesce(named(attributes(t), "action"), F.lit(""))),
        "_titles": F.array(title),
    })
    styles = F.filter("_linked", lambda x: F.array_contains(F.split(x["rel"], r"\s+"), "stylesheet"))
    icons = F.filter("_linked", lambda x: F.contains(F.lower(x["rel"]), F.lit("icon")))
    raw = {
        "_hrefs": F.col("_hrefs"),
        "_srcs": F.concat("_srcs", _present(F.transform(styles, lambda x: x["href"]))),
        "_actions": F.col("_actions"),
        "_icons": F.transform(F.slice(icons, 1, 1), lambda x: F.coalesce(x["href"], F.lit(""))),
        "_titles": F.col("_titles"),
    }
    out = once(out, {"_decoded": decoded(list(raw.values())), "_sizes": F.array(*[F.size(c) for c in raw.values()])})
    out = out.drop(*raw, "_linked")
    start, pieces = F.lit(1), {}
    for k, name in enumerate(raw):
        size = F.get("_sizes", F.lit(k))
        pieces[name] = F.slice("_decoded", start, size)
        start = start + size
    pieces["_actions"] = F.transform(pieces["_actions"], T.strip)
    pieces["_stripped"] = F.transform(pieces["_hrefs"], T.strip)
    out = once(out, pieces).drop("_decoded", "_sizes")
    null_href = V.NULL_HREFS
    return once(out, {
        "_nulls": _size(F.col("_stripped"), lambda h: h.isin(null_href)),
        "_links": _resolved(F.filter("_stripped", lambda h: ~h.isin(null_href)), base),
        "_http_hosts": F.transform(F.filter("_hrefs", lambda h: h.startswith("http")), U.netloc),
        "_resources": _resolved(F.filter("_srcs", lambda s: s != ""), base),
        "_posts": _resolved(F.filter("_actions", lambda a: ~a.isin("", "#")
                                     & ~a.startswith("mailto:")), base),
        "_icon_href": F.coalesce(F.get("_icons", F.lit(0)), F.lit("")),
    }).drop("_stripped")


def absolute_url(target: Column, base_url: Column) -> Column:
    """Link resolved against the page URL, for the link lists of the summary."""
    scheme, host, path = U.scheme(base_url), U.netloc(base_url), U.part(base_url, 3)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*/)", 1)
                    ).otherwise("/")
    query = F.regexp_extract(base_url, r"^[^?#]*(\?[^#]*)", 1)
    joined = F.concat(folder, target)
    return (
        F.when(U.scheme(target) != "", target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, _no_dots(target)))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.startswith("#"), F.concat(root, path, query, target))
        .otherwise(F.concat(root, _no_dots(joined)))
    )


def _no_dots(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved; the query and fragment stay."""
    head = F.regexp_extract(path, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(path, r"(?s)^[^?#]*(.*)$", 1)
    folders = F.split(head, "/")
    kept = F.aggregate(
        F.slice(folders, 2, F.greatest(F.size(folders) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)))
    last_dot = F.element_at(folders, -1).isin(".", "..")
    out = F.concat(F.lit("/"), F.array_join(kept, "/"),
                   F.when(last_dot & (F.size(kept) > 0), "/").otherwise(""))
    dotted = F.contains(head, F.lit("/."))
    return F.concat(F.when(dotted, out).otherwise(head), rest)


def link_summary(url: str = "url") -> Column:
    base, links = F.col("_base"), F.col("_links")
    total = F.size("_hrefs")
    external = _size(links, lambda l: _is_external(l["host"], base))
    internal = F.size(links) - external

    def listed(keep: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(links, keep), lambda l: absolute_url(l["target"], F.col(url)))

    return F.struct(
        total.alias("total"), internal.alias("internal"), external.alias("external"),
        F.col("_nulls").alias("null"), _ratio(external, total).alias("pct_external"),
        _ratio(F.col("_nulls"), total).alias("pct_null"),
        listed(lambda l: ~_is_external(l["host"], base)).alias("internal_list"),
        listed(lambda l: _is_external(l["host"], base)).alias("external_list"))


def resource_summary() -> Column:
    base, total = F.col("_base"), F.size("_resources")
    external = _size(F.col("_resources"), lambda r: _is_external(r["host"], base))
    return F.struct(total.alias("total"), (total - external).alias("internal"),
                    external.alias("external"), _ratio(external, total).alias("pct_external"))


def form_summary() -> Column:
    base, posts = F.col("_base"), F.col("_posts")
    external = _size(posts, lambda p: _is_external(p["host"], base))
    # a target without its own scheme takes the page's
    own = F.col("_base_scheme")
    insecure = _size(posts, lambda p: F.when(p["scheme"] != "", p["scheme"]).otherwise(own) == "http")
    email = _size(F.col("_actions"), lambda a: a.startswith("mailto:"))
    relative = _size(F.col("_actions"), lambda a: a.isin("", "#"))
    counts = {"total": F.size("_actions"), "insecure": insecure, "external": external,
              "relative": relative, "abnormal": external + email, "submit_to_email": email}
    flags = {f"has_{n}": U.flag(counts[n] > 0)
             for n in ("insecure", "external", "relative", "abnormal")}
    return F.struct(*[c.alias(n) for n, c in {**counts, **flags}.items()])


def external_favicon() -> Column:
    href = F.col("_icon_href")
    host = U.resolved_netloc(href, F.col("_base"))
    return U.flag((href != "") & _is_external(host, F.col("_base")))


def has_frame() -> Column:
    return U.flag(F.col("_markup").rlike(r"(?i)<i?frame[\s/>]"))


def missing_title() -> Column:
    title = F.get("_titles", F.lit(0))
    return U.flag(T.strip(title) == "")


def right_click_disabled() -> Column:
    return U.flag(T.contains_any(F.col("_lower"), V.RIGHT_CLICK_MARKERS))


def opens_popup() -> Column:
    return U.flag(F.contains("_lower", F.lit("window.open")))


def fakes_status_bar() -> Column:
    return U.flag(F.contains("_lower", F.lit("window.status")))


def image_only_form() -> Column:
    forms = F.regexp_extract_all(
        F.col("_markup"), F.lit(rf"(?is)<form(?:[\s/]{_QUOTED})?+>(?:.*?</form\s*>|.*\z)"), F.lit(0))
    return U.flag(F.exists(forms, lambda f: f.rlike(r"(?i)<img[\s/>]")
                           & ~f.rlike(r"(?i)<(?:input|textarea|select)[\s/>]")))


def domain_mismatch() -> Column:
    """More than 60 % of all links start with http and lead elsewhere."""
    base, total = F.col("_base"), F.size("_hrefs")
    away = _size(F.col("_http_hosts"), lambda h: _is_external(h, base))
    return U.flag((total > 0) & (away > total * 0.6))


def unparsable_target() -> Column:
    """True where the page or one of its targets has an authority that cannot be parsed."""
    def bad(h: Column) -> Column:
        return ~U.parses(h)

    return (bad(F.col("_base"))
            | F.exists("_links", lambda l: bad(l["host"]))
            | F.exists("_resources", lambda l: bad(l["host"]))
            | F.exists("_posts", lambda l: bad(l["host"]))
            | F.exists("_http_hosts", bad)
            | bad(U.netloc(F.col("_icon_href"))))


def ratio_rt(ratio: Column) -> Column:
    return F.when(ratio > 0.6, 1).when(ratio > 0.2, 0).otherwise(-1)


def summarise(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds the link, resource and form summaries."""
    return once(with_page_elements(df, html, url), {
        "links": link_summary(url), "resources": resource_summary(), "forms": form_summary()})


def page_features(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds the HTML features by name plus ``_page_error``; null HTML means not captured."""
    out = summarise(df, html, url)
    links, resources, forms = F.col("links"), F.col("resources"), F.col("forms")
    raw = {
        "PctExtHyperlinks": links["pct_external"],
        "PctExtResourceUrls": resources["pct_external"],
        "ExtFavicon": external_favicon(),
        "InsecureForms": forms["has_insecure"],
        "RelativeFormAction": forms["has_relative"],
        "ExtFormAction": forms["has_external"],
        "AbnormalFormAction": forms["has_abnormal"],
        "PctNullSelfRedirectHyperlinks": links["pct_null"],
        "FrequentDomainNameMismatch": domain_mismatch(),
        "FakeLinkInStatusBar": fakes_status_bar(),
        "RightClickDisabled": right_click_disabled(),
        "PopUpWindow": opens_popup(),
        "SubmitInfoToEmail": forms["submit_to_email"],
        "IframeOrFrame": has_frame(),
        "MissingTitle": missing_title(),
        "ImagesOnlyInForm": image_only_form(),
        "PctExtResourceUrlsRT": ratio_rt(resources["pct_external"]),
        "AbnormalExtFormActionR": forms["has_abnormal"],
        "ExtMetaScriptLinkRT": F.lit(0),
        "PctExtNullSelfRedirectHyperlinksRT": ratio_rt(links["pct_null"]),
    }
    captured = F.col(html).isNotNull()
    columns = {n: F.when(captured, c).otherwise(0) for n, c in raw.items()}
    return out.withColumns({**columns, "_page_error": captured & unparsable_target()})


def feature_columns(df: DataFrame, url: str = "url", html: str | None = "html",
                    final_url: str | None = None) -> DataFrame:
    """Adds all 48 named features. Without HTML the page features are 0 (URL only).

    A page or link that cannot be parsed makes the whole vector 0.
    """
    keep = df.columns
    parts = U.with_url_parts(df, url)
    if html is None:
        parts = parts.withColumn("_page_error", F.lit(False)).withColumns(
            {n: F.lit(0) for n in V.FEATURE_NAMES[26:42] + V.FEATURE_NAMES[44:]})
    else:
        target = final_url or "_u_full"
        parts = page_features(parts, html, target)
    url_side = U.url_features()
    values = {n: F.when(F.col("_page_error"), 0).otherwise(url_side.get(n, F.col(n)))
              for n in V.FEATURE_NAMES}
    return parts.select(*keep, *[c.cast("float").alias(n) for n, c in values.items()])


def feature_vector(df: DataFrame, url: str = "url", html: str | None = "html",
                   final_url: str | None = None, out: str = "features") -> DataFrame:
    """Adds the 48 features as one ``array<float>`` column in the fixed order."""
    keep = df.columns
    wide = feature_columns(df, url, html, final_url)
    return wide.select(*keep, F.array(*[F.col(n) for n in V.FEATURE_NAMES]).alias(out))


def content_vector(df: DataFrame, content: str, content_type: str, out: str = "features",
                   html: str | None = None) -> DataFrame:
    """48-slot vector of mixed content: URLs as they are, mails by their first link, mails
    without a link by their text. Null content gives a null vector.

    ``html`` holds the captured page of rows that are URLs, null where there is none; it is not read for mails.
    """
    keep = df.columns
    c = F.col(content)
    is_url = F.col(content_type) == "url"
    first = F.try_element_at(T.urls_in_text(c), F.lit(1))
    target = F.coalesce(F.when(is_url, c).otherwise(first), F.lit(""))
    rows = df.withColumn("_target", target)
    if html is not None:
        rows = rows.withColumn("_html", F.when(is_url, F.col(html)))
    wide = feature_vector(rows, "_target", "_html" if html is not None else None)
    value = F.when(c.isNull(), None).when(is_url | first.isNotNull(), F.col("features")).otherwise(T.text_vector(c))
    return wide.select(*keep, value.alias(out))
