"""Preparation queries: TF-IDF, token ids, splits, scaling, weights, neighbours, oversampling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.text_url import CLEANED, clean_sql
from lureline import fixed_values as V
from lureline.functions import text as T
from lureline.operators import lexicon as L
from lureline.operators import neighbors as N
from lureline.operators import pages as PG
from lureline.operators import prep as P
from lureline.sources.corpora import available

STOP_WORDS = ["the", "and", "of", "to", "in", "de", "la", "et", "que", "der", "und", "el", "is", "by"]
TFIDF = {"max_features": 5000, "min_df": 5, "max_df": 0.95}
SEGMENTS = "c_mktsegment"


def _cleaned(spark, sf_dir) -> DataFrame:
    return I.mails(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("c"))


def pre1_tfidf_vocabulary(spark, sf_dir) -> DataFrame:
    v = P.tfidf_vocabulary(_cleaned(spark, sf_dir), "c", STOP_WORDS, **TFIDF)
    return v.withColumn("idf", F.round("idf", 9))


def pre1_tfidf_transform(spark, sf_dir) -> DataFrame:
    """Vocabulary fitted on all mails, then each mail's sparse weights summed up."""
    docs = _cleaned(spark, sf_dir)
    w = P.fit_tfidf(docs, "c", STOP_WORDS, **TFIDF).transform(docs, "c")
    a = w.select("doc_id", vector_to_array("tfidf").alias("a"))
    used = F.filter("a", lambda x: x > 0)
    return a.select("doc_id", F.size(used).alias("terms"),
                    F.round(F.aggregate(used, F.lit(0.0), lambda s, x: s + x), 6).alias("weight_sum"),
                    F.round(F.coalesce(F.array_max(used), F.lit(0.0)), 6).alias("weight_max"))


def pre3_mail_metadata(spark, sf_dir) -> DataFrame:
    m = P.mail_components(I.mails(spark, sf_dir), "text").select("doc_id", *P.METADATA)
    return m.withColumn("avg_word_length", F.round("avg_word_length", 6))


def pre4_label_encoding(spark, sf_dir) -> DataFrame:
    c = I.table(spark, sf_dir, "customer").select("c_custkey", SEGMENTS)
    return P.encode_labels(c, SEGMENTS)


def _labelled(spark, sf_dir) -> DataFrame:
    return I.table(spark, sf_dir, "labels")


def pre5_split_70_15_15(spark, sf_dir) -> DataFrame:
    return P.stratified_split(_labelled(spark, sf_dir), "doc_id", "quality").select("doc_id", "quality", "split")


def pre5_split_60_20_20(spark, sf_dir) -> DataFrame:
    s = P.stratified_split(I.table(spark, sf_dir, "customer"), "c_custkey", SEGMENTS, 0.2, None, 0.25)
    return s.select("c_custkey", "split")


def pre5_split_counts(spark, sf_dir) -> DataFrame:
    s = P.stratified_split(_labelled(spark, sf_dir), "doc_id", "quality", 0.15, None, 0.176)
    return P.split_counts(s, "quality")


def _vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as (id, features, label) with two classes of unequal size."""
    return I.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
        F.when(F.col("label") < 3, 1).otherwise(0).alias("label"), F.col("label").alias("topic"))


def pre6_smote_counts(spark, sf_dir) -> DataFrame:
    s = P.smote(_vectors(spark, sf_dir).drop("topic"))
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.col("synthetic"), 1)).alias("made"))


def pre6_smote_rows(spark, sf_dir) -> DataFrame:
    s = P.smote(_vectors(spark, sf_dir).drop("topic")).filter("synthetic")
    return s.select("id", "label", F.round(F.get("features", F.lit(0)), 6).alias("first"))


def pre7_standardise(spark, sf_dir) -> DataFrame:
    """Scaled on the training rows only; each vector summed up."""
    rows = P.stratified_split(_vectors(spark, sf_dir), "id", "topic")
    s = P.standardise(rows, "features", F.col("split") == "train")
    return s.select("id", "split", F.round(F.get("scaled", F.lit(0)), 6).alias("first"),
                    F.round(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def pre7_standardise_columns(spark, sf_dir) -> DataFrame:
    li = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    s = P.standardise_columns(li, ["l_quantity", "l_extendedprice"])
    return s.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


def pre9_uniform_sample(spark, sf_dir) -> DataFrame:
    return P.uniform_sample(I.table(spark, sf_dir, "orders"), "o_orderkey", 1000).select("o_orderkey")


def pre10_class_weights(spark, sf_dir) -> DataFrame:
    w = P.balanced_weights(_labelled(spark, sf_dir), "quality")
    return w.select("doc_id", F.round("weight", 9).alias("weight"))


def pre11_absolute(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("features", array_to_vector("features"))
    a = P.absolute(v).select("id", vector_to_array("features").alias("a"))
    return a.select("id", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def prj4_url_columns(spark, sf_dir) -> DataFrame:
    """The URL columns a table has out of the 24 wanted ones."""
    wide = PG.feature_columns(I.urls(spark, sf_dir), "url", None).drop("NumDash", "QueryLength")
    return wide.select("page_id", *available(wide, V.URL_TABLE_FEATURES))


def ml7_knn_classify(spark, sf_dir) -> DataFrame:
    """Topic of held-out vectors by their five nearest training vectors."""
    rows = P.stratified_split(_vectors(spark, sf_dir), "id", "topic")
    return N.knn_classify(rows.filter("split <> 'train'"), rows.filter("split = 'train'"), 5, label="topic")


def jn3_win4_nearest(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return N.nearest(v, v, 5, same_table=True).withColumn("distance", F.round("distance", 6))


def jn3_win4_nearest_hashed(spark, sf_dir) -> DataFrame:
    """The ten nearest of every fiftieth vector among all, by hash tables."""
    v = _vectors(spark, sf_dir)
    return N.nearest_hashed(v.where("id % 50 = 0"), v, 10, same_table=True).withColumn("distance", F.round("distance", 6))


def _lexicon(spark, sf_dir) -> DataFrame:
    """Valence -3..3 of each brand word of the part names; grows with the parts."""
    words = I.table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token"))
    extra = I.table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(L.WORD), F.lit(0)))).alias("token"))
    return words.union(extra).distinct().select("token", (F.length("token") % 7 - 3).cast("double").alias("valence"))


def txt12_sentiment(spark, sf_dir) -> DataFrame:
    return L.sentiment(I.mails(spark, sf_dir), "doc_id", "text", _lexicon(spark, sf_dir))


def txt13_misspelled(spark, sf_dir) -> DataFrame:
    """Dictionary: the words of all English documents."""
    english = I.table(spark, sf_dir, "documents").filter("lang = 'en'")
    words = english.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("token"))
    return L.misspelled(I.mails(spark, sf_dir), "doc_id", "text", words)


def txt15_token_vocabulary(spark, sf_dir) -> DataFrame:
    return P.token_vocabulary(I.mails(spark, sf_dir), "doc_id", "text", 10000)


def txt15_token_ids(spark, sf_dir) -> DataFrame:
    m = I.mails(spark, sf_dir)
    return P.encode_tokens(m, "doc_id", "text", P.token_vocabulary(m, "doc_id", "text", 10000), 500)


# ---- SQL ----------------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
GRAMS = (
    f"{I.MAILS}, {CLEANED}, words AS (SELECT doc_id, list_filter(string_split(c, ' '), lambda w: length(w) >= 2 AND w NOT "
    f"IN ({STOP})) AS w FROM cleaned), grams AS (SELECT doc_id, unnest(list_concat(list_concat(w, list_transform(range(1, "
    "len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] "
    "|| ' ' || w[i + 2]))) AS term FROM words), doc_terms AS (SELECT doc_id, term, count(*) AS n FROM grams GROUP BY ALL), "
    "stats AS (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM doc_terms GROUP BY term), docs AS (SELECT "
    f"count(*) AS n_docs FROM mails), vocabulary AS (SELECT term, tf, df, ln((n_docs + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM "
    f"stats, docs WHERE df >= {TFIDF['min_df']} AND df <= {TFIDF['max_df']}::DOUBLE * n_docs ORDER BY tf DESC, term LIMIT "
    f"{TFIDF['max_features']})"
)


def split_sql(table: str, key: str, label: str, test: str, rest: str) -> str:
    return (
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('42|' || {key}), {key}) AS rk, count(*) "
        f"OVER (PARTITION BY {label}) AS n FROM {table}), sized AS (SELECT *, round(n * {test}::DOUBLE) AS n_test FROM "
        f"ranked), split AS (SELECT *, CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + round((n - n_test) * "
        f"({rest})::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM sized)")


VECTORS = ("vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, CASE WHEN label < 3 THEN 1 ELSE 0 END "
           "AS label, label AS topic FROM embeddings)")
SPLIT_VECTORS = f"{VECTORS}, {split_sql('vectors', 'id', 'topic', '0.15', '0.15::DOUBLE / 0.85::DOUBLE')}"
CELLS = "unnest(features) AS x, generate_subscripts(features, 1) AS i"
NEAREST = (
    "near AS (SELECT q.id, r.id AS neighbour, list_distance(q.features, r.features) AS distance, row_number() OVER "
    "(PARTITION BY q.id ORDER BY list_distance(q.features, r.features), r.id) AS rank FROM {q} q JOIN {r} r ON {on} QUALIFY "
    "rank <= 5)"
)
LEXICON = (
    "lexicon AS (SELECT DISTINCT token, CAST(length(token) % 7 - 3 AS DOUBLE) AS valence FROM (SELECT "
    f"unnest(string_split(lower(p_name), ' ')) AS token FROM part UNION ALL SELECT unnest(regexp_extract_all(lower(text), "
    "'[a-z'']+')) AS token FROM documents))"
)
TOKENS_RE = r"[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n ]+".replace('\\"', '"')
TOKEN_SQL = (
    f"{I.MAILS}, listed AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{TOKENS_RE}'), lambda "
    "w: w <> '') AS w FROM mails), placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM "
    "listed), freq AS (SELECT word, count(*) AS n, min((doc_id, pos)) AS first FROM placed GROUP BY word ORDER BY n DESC, "
    "first LIMIT 9998), vocabulary AS (SELECT word, row_number() OVER (ORDER BY n DESC, first) + 1 AS word_id FROM freq)"
)

QUERIES = {f.__name__: f for f in (
    pre1_tfidf_vocabulary, pre1_tfidf_transform, pre3_mail_metadata, pre4_label_encoding, pre5_split_70_15_15,
    pre5_split_60_20_20, pre5_split_counts, pre6_smote_counts, pre6_smote_rows, pre7_standardise,
    pre7_standardise_columns, pre9_uniform_sample, pre10_class_weights, pre11_absolute, prj4_url_columns,
    ml7_knn_classify, jn3_win4_nearest, jn3_win4_nearest_hashed, txt12_sentiment, txt13_misspelled, txt15_token_vocabulary, txt15_token_ids)}

from catalog import page as _page  # noqa: E402  (the URL vector SQL)

SQL = {
    "pre1_tfidf_vocabulary": f"WITH {GRAMS} SELECT term, tf, df, round(idf, 9) AS idf FROM vocabulary",
    "pre1_tfidf_transform": (
        f"WITH {GRAMS}, weights AS (SELECT doc_id, n * idf AS w FROM doc_terms JOIN vocabulary USING (term)), norms AS (SELECT "
        "doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM weights) SELECT m.doc_id, count(w) AS terms, "
        "round(coalesce(sum(w), 0), 6) AS weight_sum, round(coalesce(max(w), 0), 6) AS weight_max FROM mails m LEFT JOIN "
        "norms USING (doc_id) GROUP BY m.doc_id"),
    "pre3_mail_metadata": (
        f"WITH {I.MAILS}, {CLEANED} SELECT doc_id, length(c) AS text_length, len(list_filter(string_split(c, ' '), lambda x: "
        "x <> '')) AS word_count, coalesce(round(list_avg(list_transform(list_filter(string_split(c, ' '), lambda x: x <> "
        "''), lambda x: length(x))), 6), 0) AS avg_word_length, coalesce(CAST(contains(lower(text), 'subject:') AS INT), 0) "
        "AS has_subject FROM cleaned"),
    "pre4_label_encoding": (
        f"SELECT c_custkey, {SEGMENTS}, dense_rank() OVER (ORDER BY {SEGMENTS}) - 1 AS label_index FROM customer"),
    "pre5_split_70_15_15": (
        f"WITH {split_sql('labels', 'doc_id', 'quality', '0.15', '0.15::DOUBLE / 0.85::DOUBLE')} SELECT doc_id, quality, "
        "split FROM split"),
    "pre5_split_60_20_20": (
        f"WITH {split_sql('customer', 'c_custkey', SEGMENTS, '0.2', '0.25')} SELECT c_custkey, split FROM split"),
    "pre5_split_counts": (
        f"WITH {split_sql('labels', 'doc_id', 'quality', '0.15', '0.176')} SELECT split, quality, count(*) AS n FROM split "
        "GROUP BY ALL"),
    "pre6_smote_counts": (
        f"WITH {VECTORS}, c AS (SELECT label, count(*) AS n FROM vectors GROUP BY label) SELECT label, (SELECT max(n) FROM c) "
        "AS n, (SELECT max(n) FROM c) - n AS made FROM c"),
    "pre7_standardise": (
        f"WITH {SPLIT_VECTORS}, cells AS (SELECT id, split, {CELLS} FROM split), m AS (SELECT i, avg(x) AS mean, "
        "stddev_pop(x) AS s FROM cells WHERE split = 'train' GROUP BY i) SELECT id, split, round(max((x - mean) / s) FILTER "
        "(i = 1), 6) AS first, round(sum((x - mean) / s), 5) AS total FROM cells JOIN m USING (i) GROUP BY id, split"),
    "pre7_standardise_columns": (
        "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT "
        "stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity, round((l_extendedprice - (SELECT avg(l_extendedprice) FROM "
        "lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS l_extendedprice FROM lineitem"),
    "pre9_uniform_sample": "SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1000",
    "pre10_class_weights": (
        "SELECT doc_id, round((count(*) OVER ())::DOUBLE / ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER "
        "(PARTITION BY quality)), 9) AS weight FROM labels"),
    "pre11_absolute": (
        f"WITH {VECTORS} SELECT id, round(list_sum(list_transform(features, lambda x: abs(x))), 6) AS total FROM vectors"),
    "prj4_url_columns": (
        _page.SQL["ht15_vec48_uncaptured"].rsplit(" SELECT ", 1)[0] + ", wide AS (SELECT page_id, " + _page.FULL_SQL
        + " FROM parts) SELECT page_id, "
        + ", ".join(n for n in V.URL_TABLE_FEATURES if n not in ("NumDash", "QueryLength")) + " FROM wide"),
    "ml7_knn_classify": (
        f"WITH {SPLIT_VECTORS}, q AS (SELECT * FROM split WHERE split <> 'train'), r AS (SELECT * FROM split WHERE split = "
        f"'train'), {NEAREST.format(q='q', r='r', on='true')}, votes AS (SELECT n.id, r.topic AS prediction, count(*) AS "
        "votes FROM near n JOIN r ON n.neighbour = r.id GROUP BY ALL) SELECT * FROM votes QUALIFY row_number() OVER "
        "(PARTITION BY id ORDER BY votes DESC, prediction) = 1"),
    "jn3_win4_nearest": (
        f"WITH {VECTORS}, {NEAREST.format(q='vectors', r='vectors', on='q.id <> r.id')} SELECT id, neighbour, "
        "round(distance, 6) AS distance, rank FROM near"),
    "txt12_sentiment": (
        f"WITH {I.MAILS}, {LEXICON}, found AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), "
        "'[a-z'']+')) AS token FROM mails), counted AS (SELECT doc_id, token, count(*) AS n FROM found GROUP BY ALL), sums AS "
        "(SELECT doc_id, sum(coalesce(valence, 0) * n) AS s, sum(CASE WHEN valence > 0 THEN (valence + 1) * n ELSE 0 END) AS "
        "pos, sum(CASE WHEN valence < 0 THEN (1 - valence) * n ELSE 0 END) AS neg, sum(CASE WHEN coalesce(valence, 0) = 0 "
        "THEN n ELSE 0 END) AS neu FROM counted LEFT JOIN lexicon USING (token) GROUP BY doc_id) SELECT m.doc_id, "
        "round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 4) AS compound, round(coalesce(neg / nullif(pos + "
        "neg + neu, 0), 0), 3) AS negative, round(coalesce(pos / nullif(pos + neg + neu, 0), 0), 3) AS positive FROM mails m "
        "LEFT JOIN sums USING (doc_id)"),
    "txt13_misspelled": (
        f"WITH {I.MAILS}, dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM documents "
        "WHERE lang = 'en'), found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')[1:1000]), "
        "'\\p{L}+')) AS token FROM mails), wrong AS (SELECT DISTINCT doc_id FROM found ANTI JOIN dict USING (token)) SELECT "
        "doc_id, CAST(doc_id IN (SELECT doc_id FROM wrong) AS INT) AS misspelling_score FROM mails"),
    "txt15_token_vocabulary": f"WITH {TOKEN_SQL} SELECT word, word_id FROM vocabulary",
    "txt15_token_ids": (
        f"WITH {TOKEN_SQL}, coded AS (SELECT doc_id, list(coalesce(word_id, 1) ORDER BY pos) AS ids FROM placed LEFT JOIN "
        "vocabulary USING (word) WHERE pos <= 500 GROUP BY doc_id) SELECT m.doc_id, list_concat(coalesce(ids, []), "
        "list_transform(range(500 - coalesce(len(ids), 0)), lambda x: 0)) AS tokens FROM mails m LEFT JOIN coded USING (doc_id)"),
}
