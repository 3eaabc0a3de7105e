"""Corpus, quality, metric, ranking and preparation operators on small tables."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lureline.functions import inference
from lureline.operators import corpus as C
from lureline.operators import ensemble as E
from lureline.operators import lexicon as L
from lureline.operators import metrics as M
from lureline.operators import neighbors as N
from lureline.operators import prep as P
from lureline.operators import quality as Q
from lureline.operators import ranking as R
from lureline.shared import lookup_join
from lureline.sources import captures, corpora, sinks


def test_keep_first_with_a_hot_text(spark):
    rows = [("hot", i % 2, "s", i % 3, i) for i in range(300)] + [(None, 1, "s", 2, 7), (None, 0, "s", 1, 9), ("b", None, "s", 0, 5)]
    df = spark.createDataFrame(rows, "text_combined string, label int, source string, source_no int, row_no bigint")
    got = {r.text_combined: (r.label, r.source_no, r.row_no) for r in C.keep_first(df.repartition(5)).collect()}
    assert got == {"hot": (0, 0, 0), None: (0, 1, 9), "b": (None, 0, 5)}
    # default row numbers over a shuffled corpus: each text once, whatever the numbers are
    shuffled = spark.range(2000).select(F.concat(F.lit("t"), F.col("id") % 700).alias("text"), F.lit(1).alias("label")).repartition(7)
    kept = C.keep_first(C.union([C.unify(shuffled, "x", 0), C.unify(shuffled, "y", 1)]))
    assert sorted(r.text_combined for r in kept.collect()) == sorted(f"t{i}" for i in range(700))
    assert {r.source for r in kept.collect()} == {"x"}
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_clean_keeps_null_text_unless_asked(spark):
    df = spark.createDataFrame([("a", 1), ("  ", 1), (None, 0), ("b", None)], "text_combined string, label int")
    assert {r[0] for r in C.clean(df).collect()} == {"a", None}
    assert {r[0] for r in C.clean(df, drop_null_text=True).collect()} == {"a"}


def test_source_without_label_and_nothing_usable(spark):
    assert C.unify(spark.createDataFrame([("a",)], "text string"), "x", 0) is None
    with pytest.raises(ValueError):
        C.union([None])
    other = C.unify(spark.createDataFrame([("a", None, 1, "d")], "p string, q string, label int, date string"), "x", 0)
    assert other.first().text_combined == "a "


def test_quality_with_nan_and_constants(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 2.0, 5.0, 11.0, 3.0], "c": [4.0] * 6})
    df = spark.createDataFrame(pdf)
    s = {r.column: r for r in Q.feature_statistics(df).collect()}
    assert s["x"]["skew"] == pytest.approx(pdf.x.skew()) and s["x"].kurtosis == pytest.approx(pdf.x.kurtosis())
    assert s["x"].median == 2.5 and s["c"].kurtosis == 0 and Q.outliers(df, ["c"]).count() == 0
    gaps = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    assert {r.column: r.missing for r in Q.missing_values(gaps).collect()} == {"x": 2, "s": 1}


def test_label_distribution_ratio_only_for_two(spark):
    two = spark.createDataFrame([(1,), (1,), (1,), (1,), (0,), (None,)], "label int")
    assert {r.imbalance_ratio for r in Q.label_distribution(two).collect()} == {4.0}
    three = spark.createDataFrame([(1,), (2,), (3,)], "label int")
    assert {r.imbalance_ratio for r in Q.label_distribution(three).collect()} == {None}


def test_duplicates_of_nested_columns(spark):
    df = spark.createDataFrame([(1, ["a"]), (1, ["a"]), (1, ["b"])], "k int, v array<string>")
    assert Q.duplicates(df).first().duplicates == 1


def test_hash_rank_with_null_group_and_medians(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(500)], "id int, g int")
    got = R.hash_rank(df, "id", ["g"]).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1)) and set(part.group_rows) == {len(part)}
    rng = random.Random(1)
    values = {"near": [1.7e9 + rng.random() for _ in range(301)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 12) for _ in range(200)],
              "ties": [0.0] * 150 + [1.0] * 3}
    long = spark.createDataFrame([(n, float(v)) for n, vs in values.items() for v in vs], "column string, value double")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("rows"))
    for r in [*R.medians(long).collect(), *R.medians(counted, count="rows").collect()]:
        assert r["median"] == pytest.approx(float(np.median(values[r["column"]])), rel=1e-12), r["column"]


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [("m", rng.randint(0, 1), rng.randint(0, 20) / 7 - 1) for _ in range(200)]
    df = spark.createDataFrame(rows, "model string, label int, probability double")
    pos = [p for _, y, p in rows if y]
    neg = [p for _, y, p in rows if not y]
    expected = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df, ["model"]).first().roc_auc == pytest.approx(expected)
    points = M.roc_points(df, ["model"]).orderBy("fpr", "tpr").toPandas()
    assert points.iloc[-1].fpr == 1 and points.iloc[-1].tpr == 1
    area = np.trapezoid([0, *points.tpr], [0, *points.fpr])
    assert area == pytest.approx(expected)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    m = M.binary_metrics(df).first()
    assert (m.precision, m.f1, m.accuracy) == (0.0, 0.0, 0.5)
    empty = M.prediction_counters(spark.createDataFrame([], "is_phishing boolean")).first()
    assert empty.total_predictions == 0 and empty.phishing_rate == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(0, 0.01, (120, 6))  # a third of all rows in one dense cell
    pts = np.vstack([hot, rng.normal(0, 3, (240, 6)), hot[:3]])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id bigint, features array<double>")
    got = N.nearest(df, df, 4, same_table=True, block_rows=16).toPandas()
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(pts)):
        expected = sorted(range(len(pts)), key=lambda j: (d[i, j], j))[:4]
        mine = got[got.id == i].sort_values("rank")
        assert list(mine.neighbour) == expected
    two = N.nearest(df.limit(3), df, 400, block_rows=64)
    assert two.groupBy("id").count().filter("count <> 363").count() == 0


def test_a_query_is_sent_out_once_a_cell(spark, monkeypatch):
    """Vectors without clusters: every cell is visited, whose rows go to one task at a time, not to one per 1,024 rows."""
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(np.random.default_rng(4).normal(size=(6000, 16)))], "id bigint, features array<double>")
    sent, chunked = [], N._chunked

    def counted(refs, visits, rows):
        out = chunked(refs, visits, rows)
        sent.append(out[1].count())
        return out

    monkeypatch.setattr(N, "_chunked", counted)
    got = N.nearest(v.where("id % 10 = 0"), v, 3, same_table=True)
    assert got.count() == 1800 and sum(sent) <= 600 * 5  # 6,000 rows make five cells


def test_sparse_neighbours_are_those_of_arrays(spark):
    rng = np.random.default_rng(8)
    points = [[float(x) if rng.random() < 0.2 else 0.0 for x in rng.normal(0, 2, 30)] + [float(rng.integers(0, 40))] for _ in range(300)]
    points[7], points[9], points[11] = points[5], [0.0] * 31, [1.0] * 31
    rows = [(i, p, Vectors.dense(p) if i % 5 == 0 else Vectors.sparse(31, {j: x for j, x in enumerate(p) if x})) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, ["id", "a", "v"])
    dense, sparse = (N.nearest(df, df, 4, features=c, same_table=True, block_rows=16).collect() for c in ("a", "v"))
    assert sorted(map(tuple, dense)) == sorted(map(tuple, sparse)) and len(dense) == 1200
    some = df.withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    made = [P.smote(some, features=c).filter("synthetic").collect() for c in ("a", "v")]
    key = lambda r: (r.id, r.features)
    assert [key(r) for r in sorted(made[0], key=key)] == [key(r) for r in sorted(made[1], key=key)] and len(made[0]) == 100


def test_hashed_neighbours_reach_the_recall(spark):
    """0.9 at 10 in 32 buckets a table; what is found has exact distances, and copies do not push each other out."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    q = v.where("id % 50 = 0")
    exact = {(r.id, r.neighbour): r.distance for r in N.nearest(q, v, 10, same_table=True).collect()}
    found = {(r.id, r.neighbour): r.distance for r in N.nearest_hashed(q, v, 10, same_table=True, bucket_rows=64, block_rows=16).collect()}
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(found[p] == exact[p] for p in found.keys() & exact.keys())
    whole = N.nearest_hashed(q, v, 10, same_table=True, bucket_rows=10**9)  # a single bucket is the exact way
    assert {(r.id, r.neighbour): r.distance for r in whole.collect()} == exact
    same = spark.range(1, 1001).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("features"))
    got = N.nearest_hashed(same, same, 3, same_table=True, bucket_rows=10)
    for r in got.groupBy("id").agg(F.sort_array(F.collect_list("neighbour")).alias("n")).collect():
        assert r.n == [i for i in (1, 2, 3, 4) if i != r.id][:3]
    assert N.nearest_hashed(q, v.limit(0), 3).count() == N.nearest(q, v.limit(0), 3).count() == 0


def test_split_is_disjoint_and_exact(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "id int, label int")
    s = P.stratified_split(df, "id", "label").toPandas()
    assert len(s) == 1000 == s.id.nunique()
    assert s[s.label == 1].split.value_counts().to_dict() == {"train": 70, "test": 15, "val": 15}
    big = spark.range(10_000).select("id", (F.col("id") % 2).alias("label"))
    sizes = P.stratified_split(big, "id", "label", 0.15, None, 0.176).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in sizes} == {"train": 7004, "val": 1496, "test": 1500}
    with pytest.raises(ValueError):
        P.assign_folds(df, "id", "label", strategy="time_series")


def test_smote_lies_between_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 3)], int(i < 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label int")
    out = P.smote(df, chunk=3).toPandas()
    assert out.groupby("label").size().to_dict() == {0: 53, 1: 53}
    small = np.array([r[1] for r in rows if r[2]])
    for v in out[out.synthetic].features:
        v = np.array(v)
        assert any(np.linalg.norm(a - v) + np.linalg.norm(b - v) < np.linalg.norm(a - b) + 1e-9 for a in small for b in small)


def test_tfidf_unfitted_and_names(spark):
    df = spark.createDataFrame([(i, "red fox " * (i % 3 + 1) + f"word{i}") for i in range(20)], "id int, c string")
    model = P.fit_tfidf(df, "c", ["fox"], min_df=2, max_df=1.0)
    assert model.terms == ["red", "red red", "red red red", "red red word2", "red word0"][:3] or "red" in model.terms
    norm = model.transform(df, "c").first().tfidf.norm(2)
    assert norm == pytest.approx(1.0)
    with pytest.raises(ValueError):
        P.TfidfModel([], [], [], (1, 1)).transform(df, "c")
    with pytest.raises(ValueError):
        P.combine_features(df, [], [])


def test_class_weights_of_any_number_of_classes(spark):
    """More classes than one plan could name, null labels, a hot class; both ways of the join agree."""
    df = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(
        F.concat(F.lit("c"), F.col("id") % 15_000)).alias("label"), F.create_map("id", "id").alias("m"))
    sizes = df.groupBy("label").count().toPandas().dropna().set_index("label")["count"]
    assert len(sizes) > 9_000
    for max_rows in (200_000, 10):
        got = P.balanced_weights(df, "label", max_rows=max_rows)
        assert got.columns == [*df.columns, "weight"]
        rows = got.select("label", "weight").collect()
        assert len(rows) == 40_000
        for r in rows:
            assert (r.weight is None) == (r.label is None)
            assert r.label is None or abs(r.weight - sizes.sum() / (len(sizes) * sizes[r.label])) < 1e-9
    assert P.balanced_weights(df.limit(0), "label").count() == 0


def test_lookup_join_is_the_same_with_and_without_broadcast(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(100)], "id int, key string")
    small = spark.createDataFrame([("hot", 1), ("k3", 2)], "key string, v int")
    a = lookup_join(big, small, "key", "id").select("id", "v").orderBy("id").collect()
    b = lookup_join(big, small, "key", "id", max_rows=1, salts=4).select("id", "v").orderBy("id").collect()
    assert a == lookup_join(big, small, "key", "id", max_bytes=1, salts=4).select("id", "v").orderBy("id").collect()
    assert a == b and len(a) == 100


def test_sentiment_by_a_large_lexicon(spark, monkeypatch):
    """Frequent words meet their entries by broadcast, rare ones by a join without repeated lexicon rows; the sums agree."""
    rng = random.Random(3)
    texts = [(i, None if i == 5 else "" if i == 6 else " ".join(rng.choice(["good", "bad", "so", f"w{chr(97 + i % 26)}{'x' * (i % 9)}"]) for _ in range(i % 40)))
             for i in range(300)]
    df = spark.createDataFrame(texts, "id int, t string")
    entries = [("good", 2.0), ("bad", -1.5)] + [(f"w{chr(97 + i)}{'x' * j}", float(i % 5 - 2)) for i in range(26) for j in range(9)]
    lexicon = spark.createDataFrame(entries, "token string, valence double")
    small = sorted(map(tuple, L.sentiment(df, "id", "t", lexicon).collect()))
    monkeypatch.setattr(L, "is_small", lambda *_: False)
    for frequent in (0, 2, 1000):
        monkeypatch.setattr(L, "FREQUENT", frequent)
        large = L.sentiment(df, "id", "t", lexicon)
        assert sorted(map(tuple, large.collect())) == small and len(small) == 300
        assert "_salt" not in large._jdf.queryExecution().optimizedPlan().toString()


def test_sentiment_of_plain_words(spark):
    df = spark.createDataFrame([(1, "good good bad thing"), (2, None)], "id int, t string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0)], "token string, valence double")
    got = {r.id: r for r in L.sentiment(df, "id", "t", lexicon).collect()}
    assert got[1].compound == round(3 / math.sqrt(9 + 15), 4) and got[1].positive == round(6 / 9, 3)
    assert (got[2].compound, got[2].negative, got[2].positive) == (0.0, 0.0, 0.0)


def test_votes_and_weight_search(spark):
    df = spark.createDataFrame([(0.9, 0.2, 1), (0.1, 0.3, 0), (0.6, 0.1, 1)], "p_a double, p_b double, label int")
    best = E.best_weights(df, ["p_a", "p_b"], "label").first()
    assert best.f1 == 1.0 and sum(best.weights) == pytest.approx(1)
    none = E.best_weights(df.withColumn("label", F.lit(0)), ["p_a", "p_b"], "label").first()
    assert none.trial is None and none.weights == [0.5, 0.5]
    with pytest.raises(ValueError):
        E.vote(df, ["p_a", "p_b"], weights=[1.0])
    with pytest.raises(ValueError):
        E.vote(df, [])


def test_paired_tests_with_few_folds(spark):
    a = spark.createDataFrame([(i, 0.8 + i / 100) for i in range(10)], "fold int, value double")
    b = a.withColumn("value", F.col("value") - 0.05 - F.col("fold") / 1000)
    t = M.paired_tests(a, b).first()
    assert t.t_significant and t.wilcoxon_statistic == 0 and t.wilcoxon_significant


def test_intervals_and_tests_have_no_end(spark):
    """Values of published tables: t with 30, 39 and 100 degrees of freedom, signed ranks of 10, 20 and 50."""
    for confidence, df, expected in ((0.95, 30, 2.0423), (0.95, 39, 2.0227), (0.99, 100, 2.6259), (0.9, 1, 6.3138)):
        assert abs(inference.t_quantile(confidence, df) - expected) < 1e-4
    assert abs(inference.t_p_value(2.262157, 9) - 0.05) < 1e-6 and inference.t_p_value(None, 9) is None
    for w, n in ((8, 10), (52, 20), (434, 50)):
        assert inference.signed_rank_p_value(w, n, 0) <= 0.05 < inference.signed_rank_p_value(w + 1, n, 0)
    a = spark.createDataFrame([(i, 0.9 + i / 1000) for i in range(40)], "fold int, value double")
    b = a.withColumn("value", F.col("value") - 0.4 - F.col("fold") / 100000)
    t = M.paired_tests(a, b).first()
    assert t.t_significant and t.wilcoxon_significant and t.t_p_value < 1e-6
    low, high = M.confidence_intervals(a.withColumn("m", F.lit("x")), ["m"], confidence=0.99).select("low", "high").first()
    assert low < 0.9195 < high
    one = M.paired_tests(a.filter("fold = 0"), b.filter("fold = 0")).first()
    assert one.t_significant is None and one.t_p_value is None


def test_captured_pages_rules(spark):
    ok = (200, "text/html", bytearray(b"caf\xc3\xa9 \xff!"))
    rows = [("http://a.b", None, *ok), ("a.b", None, *ok), ("http://a.b", None, 404, "text/html", bytearray(b"x")),
            ("http://a.b", None, 200, "image/png", bytearray(b"x")), ("http://[x", None, *ok)]
    df = spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, body binary")
    got = captures.accepted_pages(df).collect()
    assert [(r.url, r.final_url, r.html) for r in got] == [("http://a.b", "http://a.b", "café !")]


def test_correlations_of_wide_tables_with_gaps(spark):
    rng = np.random.default_rng(6)
    for width, block in ((3, 128), (70, 16), (300, 128)):
        x = rng.normal(size=(60, width)) * 10.0 ** rng.integers(-3, 4, width) + 10.0 ** rng.integers(0, 7, width)
        x[:, 1] = x[:, 0] * 2 + 5
        x[:, 2] = 7.1
        x[rng.random(x.shape) < 0.1] = np.nan
        names = [f"c{k}" for k in range(width)]
        frame = pd.DataFrame(x, columns=names)
        df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(3)
        got = {(r.feature1, r.feature2): r.correlation for r in Q.correlations(df, block=block).collect()}
        expected = frame.drop(columns="c2").corr()
        assert list(got) and len(got) == width * (width - 1) // 2
        assert all(v is None for p, v in got.items() if "c2" in p)
        assert all(abs(v - expected.loc[p]) < 1e-6 for p, v in got.items() if "c2" not in p)
    assert Q.correlations(df.limit(0), names[:3]).count() == 0


def test_report_equals_the_single_checks(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 90, float("nan") if i % 11 == 0 else float(rng.normal()) ** 3, None if i % 7 == 0 else f"t{i % 90}", [1, 0, None][(i % 90) % 3],
             float(i % 90) * 2, [i % 90]) for i in range(300)] + [(5, 1e9, None, 1, None, None)] * 3
    df = spark.createDataFrame(rows, "word_count int, x double, t string, label int, my_score double, l array<int>").repartition(4)
    got = {(r.check, r.column, r.metric): r.value for r in Q.full_report(df).collect()}
    assert len(got) == Q.full_report(df).count()

    def near(check, column, metric, value):
        mine = got.pop((check, column, metric))
        assert mine == value or abs(mine - value) <= 1e-9 * abs(value), (check, column, metric, mine, value)

    for r in Q.missing_values(df).collect():
        near("missing_values", r.column, "missing", r.missing)
        near("missing_values", r.column, "pct", r.pct)
    for r in Q.feature_statistics(df).collect():
        for m in ("mean", "std", "min", "max", "median", "skew", "kurtosis"):
            near("feature_statistics", r.column, m, r[m])
    for r in Q.outliers(df).collect():
        near("outliers", r.column, "outliers", r.outliers)
        near("outliers", r.column, "pct", r.pct)
    for r in Q.label_distribution(df).collect():
        near("label_distribution", str(r.label), "n", r.n)
        near("label_distribution", str(r.label), "pct", r.pct)
    for r in Q.consistency(df).collect():
        near("consistency", r.column, "n", r.n)
    for r in Q.high_correlations(df).collect():
        near("correlation", f"{r.feature1}|{r.feature2}", "correlation", r.correlation)
    d = Q.duplicates(df).first()
    near("duplicates", None, "duplicates", d.duplicates)
    near("duplicates", None, "pct", d.pct)
    assert d.duplicates == 303 - len({str(r) for r in rows})
    near("quality", None, "quality_score", Q.quality_report(df).first().quality_score)
    assert {k[0] for k in got} == {"dataset_info"} and len(got) == 4
    assert Q.full_report(df.limit(0)).count() > 0 and Q.full_report(df.select("t")).count() == 4 + 2 + 2 + 1


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("a \"q\", b\nc", 1), ("", 0), (" x ", None)], "text string, label int")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = corpora.read_csv(spark, str(tmp_path / "c"), "text string, label int")
    # an empty cell reads as missing, as it does in spreadsheet tools
    assert {tuple(r) for r in back.collect()} == {("a \"q\", b\nc", 1), (None, 0), (" x ", None)}


def test_neighbours_far_from_the_origin_and_on_ties(spark):
    far = spark.createDataFrame([(i, [1e8 + i * 0.001, 1e8]) for i in range(60)], "id long, features array<double>")
    query = spark.createDataFrame([(0, [1e8 + 0.0301, 1e8])], "id long, features array<double>")
    assert [r.neighbour for r in N.nearest(query, far, 3).orderBy("rank").collect()] == [30, 31, 29]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1, 1001)], "id long, features array<double>")
    got = N.nearest(query.withColumn("features", F.array(F.lit(1.0), F.lit(2.0))), same, 5, block_rows=100).orderBy("rank")
    assert [(r.neighbour, r.distance) for r in got.collect()] == [(i, 0.0) for i in range(1, 6)]


def test_terms_are_counted_as_plain_python_counts_them(spark, monkeypatch):
    from collections import Counter

    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["red", "fox", "the", "a", "ox", "élan", "x9"], rng.integers(0, 30))) for _ in range(250)]
    texts += ["", None, "fox", "the a", "red fox", "fox  ox "]
    df = spark.createDataFrame([(t,) for t in texts], "c string").repartition(3)
    for chunk in (5, 1 << 20):
        monkeypatch.setattr(P, "CHUNK_WORDS", chunk)
        for low, high in ((1, 3), (2, 2), (1, 1), (3, 5)):
            tf, dfs = Counter(), Counter()
            for t in texts:
                w = [x for x in (t or "").split(" ") if len(x) >= 2 and x != "the"]
                grams = [" ".join(w[i:i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]
                tf.update(grams)
                dfs.update(set(grams))
            got = {r.term: (r.tf, r.df) for r in P.term_statistics(df, "c", ["the"], low, high).collect()}
            assert got == {t: (tf[t], dfs[t]) for t in tf}
            listed = P.with_ngrams(df.where("c is not null"), "c", ["the"], low, high).select("_grams").collect()
            assert Counter(g for r in listed for g in r[0]) == tf


def test_a_text_is_cleaned_once_for_its_grams(spark):
    df = spark.createDataFrame([("a Big Fox & ox",)], "t string").select(F.regexp_replace("t", "&", "-").alias("c"))
    plan = P.with_ngrams(df, "c", ["the"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_vocabulary_of_frequent_ends_is_that_of_all_terms(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, rng.integers(0, 40), p=share / share.sum())) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "c string").repartition(3)
    every = P.term_statistics(df, "c", ["w3"]).collect()
    known, count, handed = [], P.term_statistics, []

    def counted(*args):
        known.append({n: len(t) for n, t in args[5].items()})
        out = count(*args)
        handed.append(out.count())
        return out

    monkeypatch.setattr(P, "term_statistics", counted)
    for size, least, most in ((50, 5, 0.95), (200, 2, 0.2), (5000, 3, 1.0)):
        best = sorted(((-r.tf, r.term, r.df) for r in every if least <= r.df <= most * 300))[:size]
        got = P.tfidf_vocabulary(df, "c", ["w3"], size, (1, 3), least, most).collect()
        assert sorted((-r.tf, r.term, r.df) for r in got) == best
    assert sum(handed[:3]) < len(every) / 3  # most longer grams are never counted
    assert known[2].keys() == {1, 2}
    monkeypatch.setattr(P, "MOST_KNOWN", 3)
    assert P.tfidf_vocabulary(df, "c", ["w3"], 50).count() == 50
    assert known[-1] == {}


def test_smote_asks_only_for_neighbours_of_copied_rows(spark, monkeypatch):
    from lureline.operators import prep as P

    asked, nearest = [], P.nearest
    monkeypatch.setattr(P, "nearest", lambda q, r, *a, **o: asked.append((q.count(), r.count())) or nearest(q, r, *a, **o))
    df = spark.range(70).selectExpr("id", "array(cast(id * id % 31 as double), cast(id as double)) AS features", "cast(id < 30 as int) AS label")
    got = P.smote(df)
    assert got.where("label = 1").count() == 40 and got.where("synthetic").count() == 10
    assert asked == [(10, 30)]


def test_blocks_beyond_the_limit_are_passed_over(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lureline.operators import neighbors as N

    n = 2000
    place = np.random.default_rng(5).permutation(n)
    values = pa.array([[float(v), 1.0] for v in place], pa.list_(pa.float64()))
    chunk = N._Chunk([np.arange(n)], [values], [pa.array([[0, 2]] * n, pa.list_(pa.int32()))], 3)
    made, block = [], chunk._block
    monkeypatch.setattr(chunk, "_block", lambda start: made.append(start) or block(start))
    at, near, away = chunk.best(np.array([[10.2, 0.0, 1.0]]), None, np.array([5.0]), 3)
    assert [place[i] for i in near] == [10, 11, 9] and np.allclose(away, [0.2, 0.8, 1.2])
    assert len(made) == 1
