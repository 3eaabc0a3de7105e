"""Mixing sources to target weights by entropy balancing.

Every document starts with rate one. The rates nearest to that in relative entropy under one token
constraint per source, with rates of at most two, are exponentially tilted: min(2, exp(lambda * size)).
The multipliers maximise a concave dual; each Newton iteration is one aggregation over counted
(source, size) classes, for all sources at once. Rates become whole copies by systematic rounding in the
order of size, so that errors of neighbours cancel. Everything is DataFrame functions on narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm.common import documents, join_on, materialise, narrow
from lureline.operators.ranking import hash_rank

WEIGHTS = (5, 2, 1)
SHARE = 1.5          # of all words that the mix takes
MAX_RATE = 2
TOLERANCE = 1e-10    # of the constraints, relative
MAX_ITERATIONS = 80
CORRECTIONS = 4
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS       # rates are whole multiples of 1/UNIT before they are rounded, so sums are exact


def word_count(text: Column) -> Column:
    """Runs of characters other than blank and the five ASCII control characters of white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            max_rate: float = MAX_RATE) -> DataFrame:
    """Adds ``sid`` (order by code points, null last), ``target`` to source, source_size.

    Weights repeat over the ordered sources. A target stops at ``max_rate`` times its source's size and
    the excess goes to the others by weight; in the end all others stand at one common level per weight,
    which is found at once from sums over the sources ordered by cap per weight. One row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("sid", F.row_number().over(order)).withColumn("_w", w)
    rows = rows.withColumn("_cap", F.col("source_size") * float(max_rate))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "sid").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    rows = rows.withColumn("_total", F.sum("source_size").over(whole) * float(share))
    rows = rows.withColumn("_capped", F.sum("_cap").over(by_ratio) - F.col("_cap"))
    rows = rows.withColumn("_open", F.sum("_w").over(whole) - F.sum("_w").over(by_ratio) + F.col("_w"))
    level = (F.col("_total") - F.col("_capped")) / F.col("_open")
    fits = level * F.col("_w") <= F.col("_cap")
    rows = rows.withColumn("_level", F.min(F.when(fits, F.struct(F.col("_cap") / F.col("_w"), F.col("sid"), level.alias("at"))))
                           .over(whole)["at"])
    return rows.withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))) \
        .drop("_w", "_cap", "_total", "_capped", "_open", "_level")


def _tilt() -> Column:
    return F.least(F.lit(float(MAX_RATE)), F.exp(F.col("lam") * F.col("size") / F.col("mean")))


def multipliers(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """sid, lam, mean for each source with words: Newton steps on the logarithm of the taken words.

    A bracket that provably holds the solution guards each step; a step out of it is replaced by the
    bracket's middle. The state has one row per source and is written once per iteration.
    """
    used = classes.where("size > 0")
    span = used.groupBy("sid").agg(F.min("size").alias("least"), F.sum("n").alias("rows"))
    state = join_on(sources.select("sid", "source_size", "target"), span, ["sid"])
    state = state.withColumn("mean", F.col("source_size") / F.col("rows"))
    # every size is at least `least`, so the tilt of `least` bounds the multiplier on one side and 0 on the other
    edge = F.log(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("least")
    state = state.select("sid", "target", "mean", F.least(edge, F.lit(0.0)).alias("low"), F.greatest(edge, F.lit(0.0)).alias("high"))
    full = F.col("target") >= F.col("source_total") * MAX_RATE * (1 - 1e-12)
    state = join_on(state, sources.select("sid", F.col("source_size").alias("source_total")), ["sid"])
    state = state.withColumn("done", full).withColumn("lam", F.when(full, F.col("high")).otherwise(F.lit(0.0)))
    state = materialise(state.drop("source_total"), "mix-state")
    for _ in range(MAX_ITERATIONS):
        if state.where("NOT done").isEmpty():
            break
        at = join_on(used, state.where("NOT done").select("sid", "lam", "mean"), ["sid"])
        words = F.col("n") * F.col("size") * _tilt()
        slope = F.when(_tilt() < MAX_RATE, words * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        sums = at.groupBy("sid").agg(F.sum(words).alias("got"), F.sum(slope).alias("slope"))
        new = join_on(state, sums, ["sid"], "left")
        over = F.col("got") > F.col("target")
        new = new.withColumn("low", F.when(~F.col("done") & ~over, F.col("lam")).otherwise(F.col("low")))
        new = new.withColumn("high", F.when(~F.col("done") & over, F.col("lam")).otherwise(F.col("high")))
        newton = F.col("lam") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        met = (F.abs(F.col("got") / F.col("target") - 1) < TOLERANCE) | (F.col("high") - F.col("low") < 1e-14)
        done = F.col("done") | met
        new = new.select("sid", "target", "mean", "low", "high", done.alias("done"),
                         F.when(done, F.col("lam")).otherwise(step).alias("lam"))
        state = materialise(new, "mix-state")
    return state.select("sid", F.round("lam", 11).alias("lam"), "mean")


def _corrected(classes: DataFrame) -> DataFrame:
    """One pass that brings the taken words nearer to the targets.

    The rest that is missing (or too much) is made up by copies of documents that are no larger than it,
    larger ones first; what then still differs is less than half of the rest, if there is such a document.
    """
    whole = Window.partitionBy("sid")
    rest = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)
    rows = classes.withColumn("_rest", rest)
    room = F.when(F.col("_rest") > 0, MAX_RATE * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    small = (F.col("size") > 0) & (F.col("size") <= F.abs("_rest"))
    rows = rows.withColumn("_room", F.when(small, room).otherwise(F.lit(0)))
    down = Window.partitionBy("sid").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(F.col("_room") * F.col("size")).over(down) - F.col("_room") * F.col("size")
    fill = F.floor((F.abs("_rest") - before) / F.greatest(F.col("size"), F.lit(1)))
    moved = F.least(F.col("_room"), F.greatest(fill, F.lit(0)))
    return rows.withColumn("copies", (F.col("copies") + F.when(F.col("_rest") > 0, moved).otherwise(-moved)).cast("bigint")) \
        .drop("_rest", "_room")


def class_copies(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """Whole copies of every (source, size) class: systematic rounding along the sizes of a source, then correction."""
    lam = multipliers(classes, sources)
    rows = join_on(join_on(classes, sources, ["sid"]), lam, ["sid"], "left")
    rate = F.when(F.col("size") > 0, _tilt()).otherwise(F.lit(1.0))
    rows = rows.withColumn("rate", rate).withColumn("_units", F.round(F.col("rate") * UNIT).cast("bigint") * F.col("n"))
    up = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("_units").over(up) + UNIT // 2)
    whole = lambda x: F.shiftright(x, UNIT_BITS)
    rows = rows.withColumn("copies", whole(F.col("_end")) - whole(F.col("_end") - F.col("_units"))).drop("_end", "_units")
    for _ in range(CORRECTIONS):
        rows = _corrected(rows)
    return rows


def plan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies of every row of ``df``.

    ``copies`` is 0, 1 or 2. A null text has size 0 and so has an empty one; such rows keep rate one.
    A null source is a source of its own. Repeated rows are rows like others. Rows of one size in a
    source are told apart by a hash of the id, so reruns agree. An empty table gives no rows.
    """
    sized = narrow(df, doc_id=id_column, source=source_column, text=text_column)
    sized = materialise(sized.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    counted = materialise(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-classes")
    sources = counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = materialise(targets(sources), "mix-sources")
    classes = materialise(join_on(counted, sources.select("source", "sid"), ["source"]), "mix-numbered")
    done = materialise(class_copies(classes.select("sid", "size", "n"), sources), "mix-copies")
    ranked = hash_rank(sized, "doc_id", by=["source", "size"])
    out = join_on(ranked, done.drop("n", "sid", "mean", "lam"), ["source", "size"])
    each = F.floor(F.col("copies") / F.col("group_rows")).cast("bigint")
    copies = each + (F.col("rank") <= F.col("copies") - each * F.col("group_rows")).cast("bigint")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the plan takes it; columns as they were.

    Rows with one id, source and size share their copies.
    """
    def key(row_id: str, source: str, size: Column) -> Column:
        return F.to_json(F.struct(F.col(row_id).alias("i"), F.col(source).alias("s"), size.alias("n"))).alias("_m_key")

    shared = plan(df, id_column, text_column, source_column)
    shared = shared.groupBy(key("doc_id", "source", F.col("size")).alias("_m_at")).agg(
        F.sum("copies").alias("_m_copies"), F.count(F.lit(1)).alias("_m_rows"))
    keyed = df.withColumn("_m_key", key(id_column, source_column, word_count(F.col(text_column))))
    rows = keyed.join(shared, F.col("_m_key") == F.col("_m_at"))
    rows = rows.withColumn("_m_no", F.row_number().over(Window.partitionBy("_m_key").orderBy(F.xxhash64(text_column))))
    each = F.floor(F.col("_m_copies") / F.col("_m_rows"))
    own = each + (F.col("_m_no") <= F.col("_m_copies") - each * F.col("_m_rows")).cast("bigint")
    return rows.withColumn("_m_each", F.explode(F.array_repeat(F.lit(0), own.cast("int")))).select(*df.columns)


def op7_entropy_mix(spark, sf_dir):
    rows = plan(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                       "source", "rate", "copies")


QUERIES = {"op7_entropy_mix": op7_entropy_mix}
SQL: dict[str, str] = {}
