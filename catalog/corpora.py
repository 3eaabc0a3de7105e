"""Corpus queries: four corpora, one per language, each with columns of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.text_url import SPACE
from lureline.operators import corpus as C
from lureline.shared import new_path
from lureline.sources import corpora as R
from lureline.sources import sinks as K

LABEL = "CASE WHEN n_chars % 17 = 0 THEN NULL WHEN (doc_id * 31 + n_chars) % 5 < 2 THEN 1 ELSE 0 END"
TEXT = "CASE WHEN n_chars % 23 = 0 THEN '  ' WHEN n_chars % 29 = 0 THEN NULL ELSE text END"


def _docs(spark, sf_dir) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.expr(TEXT).alias("text"), F.expr(LABEL).alias("label"))


def corpora(spark, sf_dir) -> list[tuple[str, DataFrame]]:
    """Per language: a ready text; subject and body; a text column; other columns only."""
    d = _docs(spark, sf_dir)
    subject, body = F.substring("text", 1, 20).alias("subject"), F.substring("text", 21, 1 << 30).alias("body")
    return [
        ("en", d.filter("lang = 'en'").select("doc_id", F.col("text").alias("text_combined"), "label")),
        ("fr", d.filter("lang = 'fr'").select("doc_id", "source", subject, body, "label")),
        ("de", d.filter("lang = 'de'").select("doc_id", "text", "source", "label")),
        ("es", d.filter("lang NOT IN ('en', 'fr', 'de')").select(
            "doc_id", "source", F.col("source").alias("urls"), F.col("text").alias("content"), "label")),
    ]


def _unified(spark, sf_dir) -> DataFrame:
    parts = [C.unify(df, name, i, "doc_id") for i, (name, df) in enumerate(corpora(spark, sf_dir))]
    return C.union(parts)


CORPUS = (
    f"docs AS (SELECT doc_id, lang, source, {TEXT} AS text, {LABEL} AS label FROM documents), unified AS (SELECT "
    "CASE lang WHEN 'en' THEN text WHEN 'fr' THEN coalesce(text[1:20], '') || ' ' || coalesce(text[21:], '') WHEN "
    "'de' THEN text ELSE source || ' ' || coalesce(text, '') END AS text_combined, label, CASE WHEN lang IN ('en', "
    "'fr', 'de') THEN lang ELSE 'es' END AS source, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 "
    "ELSE 3 END AS source_no, doc_id AS row_no FROM docs), combined AS (SELECT * FROM unified QUALIFY row_number() "
    "OVER (PARTITION BY text_combined ORDER BY source_no, row_no) = 1), cleaned AS (SELECT * FROM combined WHERE "
    f"label IS NOT NULL AND (text_combined IS NULL OR NOT regexp_full_match(text_combined, '[{SPACE}]*')))"
)
SHOWN = "md5(coalesce(text_combined, 'none')) AS text_md5, label, source, source_no, row_no"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.md5(F.coalesce("text_combined", F.lit("none"))).alias("text_md5"), "label", "source",
                     "source_no", "row_no")


def src1_csv_round_trip(spark, sf_dir) -> DataFrame:
    """Documents written as quoted multi-line CSV and read back with a declared schema."""
    path = new_path(spark, "corpus-csv")
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    K.write_csv(docs, path)
    back = R.read_csv(spark, path, docs.schema.simpleString()[7:-1].replace(":", " "))
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


def src2_capped_read(spark, sf_dir) -> DataFrame:
    return _shown(R.first_rows(_unified(spark, sf_dir), 100, ["source_no", "row_no"]))


def src3_feature_table(spark, sf_dir) -> DataFrame:
    """Feature table of order lines split into feature vector and label."""
    li = I.table(spark, sf_dir, "lineitem")
    wide = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount",
                     "l_tax", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("CLASS_LABEL"))
    t = R.feature_table(wide, ["l_quantity", "l_discount", "l_tax"])
    return t.select("id", "features", "label")


def src4_prj3_optional_sources(spark, sf_dir) -> DataFrame:
    """A missing file and a corpus without labels are skipped; the rest is combined."""
    named = {name: df for name, df in corpora(spark, sf_dir)}
    plan = [("en", lambda: named["en"], False), ("fr", lambda: named["fr"], False),
            ("gone", lambda: R.read_csv(spark, new_path(spark, "no-such-file")), True),
            ("de", lambda: named["de"].drop("label"), True), ("es", lambda: named["es"], True)]
    usable, skipped = R.load_sources(plan, row_no="doc_id")
    out = C.union(usable).groupBy("source", "source_no").agg(F.count("*").alias("n"))
    return out.withColumn("skipped", F.lit(",".join(sorted(skipped))))


def src5_create_if_missing(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "combined")
    R.create_if_missing(spark, path, lambda: C.combine([_unified(spark, sf_dir)]))
    again = R.create_if_missing(spark, path, lambda: C.combine([_unified(spark, sf_dir)]))
    return _shown(again)


def prj1_2_set1_union(spark, sf_dir) -> DataFrame:
    return _shown(_unified(spark, sf_dir))


def set2_win1_keep_first(spark, sf_dir) -> DataFrame:
    return _shown(C.keep_first(_unified(spark, sf_dir)))


def flt1_2_snk1_clean(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "clean")
    K.write_table(C.clean(C.keep_first(_unified(spark, sf_dir))), path)
    return _shown(spark.read.parquet(path))


def snk2_sample(spark, sf_dir) -> DataFrame:
    return _shown(C.sample(C.clean(C.keep_first(_unified(spark, sf_dir)))))


def agg10_corpus_profile(spark, sf_dir) -> DataFrame:
    p = C.profile(C.keep_first(_unified(spark, sf_dir)))
    return p.withColumns({c: F.round(c, 6) for c in ("mean_length", "empty_pct", "missing_pct")})


def agg11_class_totals(spark, sf_dir) -> DataFrame:
    t = C.class_totals(C.clean(C.keep_first(_unified(spark, sf_dir))))
    return t.withColumn("ratio", F.round("ratio", 6))


def snk6_feedback_agreement(spark, sf_dir) -> DataFrame:
    """Feedback rows of all messages appended to a log, then agreement counts from the log."""
    from lureline.operators.metrics import feedback_agreement

    rows = I.messages(spark, sf_dir).select(
        F.col("message").alias("content"),
        F.when(F.length("message") % 3 == 0, "phishing").otherwise("legitimate").alias("predicted"),
        F.when(F.length("message") % 2 == 0, "phishing").otherwise("legitimate").alias("actual"),
        F.lit(None).cast("string").alias("user_comment"))
    path = new_path(spark, "feedback")
    K.append_feedback(rows, path)
    return feedback_agreement(spark.read.parquet(path))


EMPTY = f"(text_combined IS NULL OR regexp_full_match(text_combined, '[{SPACE}]*'))"

QUERIES = {f.__name__: f for f in (
    src1_csv_round_trip, src2_capped_read, src3_feature_table, src4_prj3_optional_sources, src5_create_if_missing,
    prj1_2_set1_union, set2_win1_keep_first, flt1_2_snk1_clean, snk2_sample, agg10_corpus_profile,
    agg11_class_totals, snk6_feedback_agreement)}

SQL = {
    "src1_csv_round_trip": "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents",
    "src2_capped_read": f"WITH {CORPUS} SELECT {SHOWN} FROM unified ORDER BY source_no, row_no LIMIT 100",
    "src3_feature_table": (
        "SELECT l_orderkey * 10 + l_linenumber AS id, [l_quantity, l_discount, l_tax] AS features, CASE WHEN "
        "l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem"),
    "src4_prj3_optional_sources": (
        f"WITH {CORPUS} SELECT source, CASE source WHEN 'es' THEN 4 ELSE source_no END AS source_no, count(*) AS n, "
        "'de,gone' AS skipped FROM unified WHERE source <> 'de' GROUP BY ALL"),
    "src5_create_if_missing": f"WITH {CORPUS} SELECT {SHOWN} FROM combined",
    "prj1_2_set1_union": f"WITH {CORPUS} SELECT {SHOWN} FROM unified",
    "set2_win1_keep_first": f"WITH {CORPUS} SELECT {SHOWN} FROM combined",
    "flt1_2_snk1_clean": f"WITH {CORPUS} SELECT {SHOWN} FROM cleaned",
    "snk2_sample": (
        f"WITH {CORPUS} SELECT {SHOWN} FROM cleaned ORDER BY md5('42|' || row_no), row_no LIMIT 1000"),
    "agg10_corpus_profile": (
        f"WITH {CORPUS} SELECT count(*) AS rows, round(avg(length(text_combined)), 6) AS mean_length, "
        "median(length(text_combined)) AS median_length, min(length(text_combined)) AS min_length, "
        f"max(length(text_combined)) AS max_length, count(*) FILTER ({EMPTY}) AS empty_texts, round(count(*) FILTER "
        f"({EMPTY}) * 100.0 / count(*), 6) AS empty_pct, count(*) FILTER (label IS NULL) AS missing_labels, "
        "round(count(*) FILTER (label IS NULL) * 100.0 / count(*), 6) AS missing_pct FROM combined"),
    "agg11_class_totals": (
        f"WITH {CORPUS} SELECT count(*) AS rows, count(*) FILTER (label = 1) AS phishing, count(*) FILTER (label = 0) "
        "AS legitimate, round(count(*) FILTER (label = 1) / count(*) FILTER (label = 0), 6) AS ratio FROM cleaned"),
    "snk6_feedback_agreement": (
        f"WITH {I.MESSAGES} SELECT CASE WHEN length(message) % 3 = 0 THEN 'phishing' ELSE 'legitimate' END AS predicted, "
        "CASE WHEN length(message) % 2 = 0 THEN 'phishing' ELSE 'legitimate' END AS actual, count(*) AS n FROM messages "
        "GROUP BY ALL"),
}
