"""Profiles, quality and privacy reports, evaluation scores: plain aggregations and joins over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shieldframe.functions.recognizers import SPANS, Detector, detectors
from shieldframe.operators import resolve
from shieldframe.policy import Blocked, Policy

MOST_CATEGORIES = 50


def missing(c: Column) -> Column:
    """Null, or a text without characters: both count as missing everywhere."""
    return c.isNull() | (c.cast("string") == "")


def shown(c: Column) -> Column:
    """A cell as text, null spelled out, so that equal cells are equal texts."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def scalar_kind(value: Column) -> Column:
    """What a text cell holds, in this order: null, boolean, email, date, phone, integer, float, text."""
    v = value.cast("string")
    day = v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{8}$") & F.coalesce(F.try_to_timestamp(v, F.when(F.length(v) == 8, "yyyyMMdd").otherwise("yyyy-MM-dd")), F.lit(None)).isNotNull()
    return (
        F.when(missing(v), "null")
        .when(F.lower(v).isin("true", "false"), "boolean")
        .when(v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email")
        .when(day, "date")
        .when(v.rlike(r"^\+?[0-9][0-9 .()-]{6,20}$"), "phone")
        .when(v.rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), "integer")
        .when(v.rlike(r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|nan|inf(?:inity)?)$"), "float")
        .otherwise("text")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct) of the cells that aren't missing: a cell per row and column, each (column, cell) kept once."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in columns))).alias("x")).select("x.*")
    return cells.where(~missing(F.col("cell"))).distinct().groupBy("column").agg(F.count("*").alias("n_distinct"))


def kind_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kind, n): how many cells of each kind a column has."""
    kinds = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), scalar_kind(F.col(f"`{c}`")).alias("kind")) for c in columns))).alias("x")).select("x.*")
    return kinds.groupBy("column", "kind").agg(F.count("*").alias("n"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: rows, null rate, distinct values, and for numbers minimum, maximum, mean, population deviation.

    All columns are aggregated side by side in one pass, and their distinct cells are counted in another.
    """
    kinds = dict(df.dtypes)
    numeric = {c: kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal") for c in columns}
    null = F.lit(None).cast("double")
    aggs = []
    for c in columns:
        x = F.col(c)
        number = x.cast("double") if numeric[c] else null
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count("*").alias("n"),
                F.round(F.avg(missing(x).cast("int")), 6).alias("null_rate"),
                F.round(F.min(number), 6).alias("minimum"),
                F.round(F.max(number), 6).alias("maximum"),
                F.round(F.avg(number), 6).alias("mean"),
                F.round(F.stddev_pop(number), 6).alias("deviation"),
            ).alias(f"_{c}")
        )
    rows = df.agg(*aggs).select(F.explode(F.array(*(F.col(f"_{c}") for c in columns))).alias("p")).select("p.*")
    both = rows.join(F.broadcast(distinct_counts(df, columns)), "column", "left")  # a row per column
    return both.select("column", "n", "null_rate", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "minimum", "maximum", "mean", "deviation")


def is_category(n_distinct: Column, n: Column) -> Column:
    """Whether a text column counts as a category: few distinct values for its number of non-missing rows."""
    return n_distinct <= F.least(F.lit(MOST_CATEGORIES), F.greatest(F.lit(4), F.ceil(n * 0.2)))


def weights(df: DataFrame, column: str) -> DataFrame:
    """(category, n, weight): each value's share of the column's non-missing rows."""
    counts = df.where(~missing(F.col(column))).groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("total")).alias("weight"))


def total_variation(real: DataFrame, made: DataFrame, column: str) -> DataFrame:
    """One row: half the sum of the absolute differences of the two tables' category weights."""
    p, q = weights(real, column).select("category", F.col("weight").alias("p")), weights(made, column).select("category", F.col("weight").alias("q"))
    gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return p.join(q, "category", "full_outer").agg(F.round(F.sum(gap) / 2, 6).alias("total_variation"))


def category_coverage(real: DataFrame, made: DataFrame, column: str) -> DataFrame:
    """One row: the part of the real table's categories that the made one has."""
    seen = lambda d: d.where(~missing(F.col(column))).select(F.col(column).cast("string").alias("category")).distinct()
    both = seen(real).join(seen(made).withColumn("hit", F.lit(1)), "category", "left")
    return both.agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("category_coverage"))


def mean_delta(real: DataFrame, made: DataFrame, column: str) -> DataFrame:
    """One row: the difference of the means over the real range, or over one where the range is smaller."""
    a = real.agg(F.avg(column).alias("m1"), (F.max(column) - F.min(column)).alias("r"))
    return a.join(F.broadcast(made.agg(F.avg(column).alias("m2")))).select(F.round(F.abs(F.col("m1") - F.col("m2")) / F.greatest(F.col("r"), F.lit(1.0)), 6).alias("normalized_mean_delta"))


def null_rates(real: DataFrame, made: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: both tables' null rates and their difference."""
    rate = lambda d, n: d.agg(*(F.avg(missing(F.col(c)).cast("int")).alias(c) for c in columns)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias(n)) for c in columns))).alias("x")).select("x.*")
    both = rate(real, "source").join(rate(made, "synthetic"), "column")
    return both.select("column", F.round("source", 6).alias("source_null_rate"), F.round("synthetic", 6).alias("synthetic_null_rate"), F.round(F.abs(F.col("source") - F.col("synthetic")), 6).alias("null_rate_delta"))


def exact_match_rate(real: DataFrame, made: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the part of made rows that equal some real row on all `columns`, compared as text."""
    cells = lambda d: d.select(*(shown(F.col(c)).alias(c) for c in columns))
    hits = cells(made).groupBy(*columns).agg(F.count("*").alias("n")).join(cells(real).distinct().withColumn("hit", F.lit(1)), list(columns), "left")
    return hits.agg(F.round(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("exact_row_match_rate"))


def cell_copy_rate(real: DataFrame, made: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the part of made cells whose value some real cell of any of the columns has. Equal cells are counted once
    and weighed, so a value that most rows share is one row of the join."""
    cells = lambda d: d.select(F.explode(F.array(*(shown(F.col(c)) for c in columns))).alias("cell"))
    counted = cells(made).groupBy("cell").agg(F.count("*").alias("n")).join(cells(real).distinct().withColumn("hit", F.lit(1)), "cell", "left")
    return counted.agg(F.round(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("non_key_cell_copy_rate"))


def k_anonymity(made: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """One row: the size of the smallest group of equal quasi-identifiers."""
    return made.groupBy(*(shown(F.col(c)).alias(c) for c in quasi)).agg(F.count("*").alias("n")).agg(F.min("n").alias("k_anonymity"))


def l_diversity(made: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame:
    """One row: the least number of distinct sensitive values (null is one) in such a group."""
    return made.groupBy(*(shown(F.col(c)).alias(c) for c in quasi)).agg(F.count_distinct(shown(F.col(sensitive))).alias("n")).agg(F.min("n").alias("l_diversity"))


def privacy_report(real: DataFrame, made: DataFrame, quasi: Sequence[str], sensitive: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """One row: status, the two copy rates, k, l by sensitive column, and warnings. Not evaluable without rows, quasi-
    identifiers, or columns that both tables have; the reason then says so."""
    spark = made.sparkSession
    schema = "status string, reason string, exact_row_match_rate double, non_key_cell_copy_rate double, k_anonymity long, l_diversity map<string,long>, warnings array<string>"
    bad = lambda why: spark.createDataFrame([("not_evaluable", why, None, None, None, None, None)], schema)
    both = sorted(set(real.columns) & set(made.columns))
    columns = [c for c in both if c not in keys]
    if not quasi or real.isEmpty() or made.isEmpty():
        return bad("non-empty tables and quasi-identifiers are required")
    if not set(quasi) <= set(both):
        return bad("a quasi-identifier column is missing")
    if not set(sensitive) <= set(both):
        return bad("a sensitive column is missing")
    if not columns:
        return bad("no columns besides keys")
    row = exact_match_rate(real, made, columns).join(F.broadcast(cell_copy_rate(real, made, columns))).join(F.broadcast(k_anonymity(made, quasi)))
    pairs = []
    for s in sensitive:
        row = row.join(F.broadcast(l_diversity(made, quasi, s).withColumnRenamed("l_diversity", f"_l_{s}")))
        pairs += [F.lit(s), F.col(f"_l_{s}")]
    few = [F.when(F.col(f"_l_{s}") < 2, F.lit("a group has one sensitive value")) for s in sensitive][:1]
    warnings = F.array_compact(
        F.array(
            F.when(F.col("exact_row_match_rate") > 0, "rows equal source rows"),
            F.when(F.col("non_key_cell_copy_rate") > 0.2, "over 20% of cells copy a source value"),
            F.when(F.col("k_anonymity") < 3, "a group has under 3 rows"),
            *([F.when(F.least(*(F.col(f"_l_{s}") for s in sensitive), F.lit(1 << 40)) < 2, few and "a group has one sensitive value")] if sensitive else []),
        )
    )
    diversity = F.create_map(*pairs).cast("map<string,long>") if pairs else F.create_map().cast("map<string,long>")
    return row.select(F.lit("evaluated").alias("status"), F.lit(None).cast("string").alias("reason"), "exact_row_match_rate", "non_key_cell_copy_rate", "k_anonymity", diversity.alias("l_diversity"), warnings.alias("warnings"))


def span_scores(expected: DataFrame, found: DataFrame, by: Sequence[str] = ("entity",), keys: Sequence[str] = ("case_id", "entity", "start", "end")) -> DataFrame:
    """Per group: true and false positives, false negatives, precision, recall and F1 (null on empty denominators) of
    exactly equal spans."""
    e = expected.select(*keys).distinct().withColumn("is_expected", F.lit(1))
    f = found.select(*keys).distinct().withColumn("is_found", F.lit(1))
    both = e.join(f, list(keys), "full_outer")
    hit = lambda a, b: F.sum(F.when(a & b, 1).otherwise(0))
    x, y = F.col("is_expected").isNotNull(), F.col("is_found").isNotNull()
    out = both.groupBy(*by).agg(hit(x, y).alias("tp"), hit(~x, y).alias("fp"), hit(x, ~y).alias("fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return out.select(*by, "tp", "fp", "fn", F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def span_accuracy(cases: DataFrame, policy: Policy, found: Sequence[Detector] | None = None) -> DataFrame:
    """cases (case_id, text, expected, allow_terms) to rows by entity, and one for ALL: true and false positives, false negatives,
    precision, recall, F1 (null on empty denominators), and the blocked cases of the whole run.

    A detector that the policy requires and that isn't there blocks every case: then nothing is found.
    """
    own = detectors() if found is None else list(found)
    try:
        policy.gate([d.name for d in own], has_key=True)
        blocked = False
    except Blocked:
        blocked = True
    spans = resolve.resolve(resolve.candidates(F.coalesce("text", F.lit("")), policy, own), policy, allow=F.col("allow_terms"))
    rows = cases.select("case_id", "expected", F.when(F.lit(not blocked), spans).otherwise(F.array().cast(SPANS)).alias("s"))
    keys = ["case_id", "entity", "start", "end"]
    flat = lambda name: rows.select("case_id", F.explode(name).alias("x")).select("case_id", "x.entity", "x.start", "x.end")
    expected, got = flat("expected"), flat("s")
    every = span_scores(expected, got, keys=keys).unionByName(span_scores(expected, got, by=(), keys=keys).withColumn("entity", F.lit("ALL")))
    n_blocked = cases.agg(F.count(F.when(F.lit(blocked), 1)).alias("blocked"))
    return every.join(F.broadcast(n_blocked))


def stability(outcomes: DataFrame, case: str, outcome: str) -> DataFrame:
    """(case, n, stable): whether every repetition of a case had the same outcome."""
    return outcomes.groupBy(case).agg(F.count("*").alias("n"), F.min(F.col(outcome)).eqNullSafe(F.max(F.col(outcome))).alias("stable"))


def default_quasi(columns: Sequence[str], keys: Sequence[str] = ()) -> list[str]:
    """The first three columns that are no keys, for reports whose quasi-identifiers aren't named."""
    return [c for c in columns if c not in keys][:3]


def timing(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group: samples, median, nearest-rank 95th percentile and minimum; null without samples.

    Equal values of a group are counted first, then dealt to ranges of group and value. Ranks are prefix sums over the
    ranges' totals and windows within a range, so a large group is spread over many tasks.
    """
    groups = [f"_g{i}" for i in range(len(by))]
    named = samples.select(*(F.col(c).alias(g) for c, g in zip(by, groups)), F.col(value).alias("_v"))
    counts = named.where("_v is not null").groupBy(*groups, "_v").agg(F.count("*").alias("_times"))
    counts = counts.repartitionByRange(*groups, "_v").withColumn("_range", F.spark_partition_id()).checkpoint()  # the ranges are drawn once
    sums = counts.groupBy(*groups, "_range").agg(F.sum("_times").alias("_times"))
    before = F.sum("_times").over(W.partitionBy(*groups).orderBy("_range")) - F.col("_times")
    sums = sums.select(*groups, "_range", before.alias("_before"), F.sum("_times").over(W.partitionBy(*groups)).alias("_n"))
    within = counts.withColumn("_upto", F.sum("_times").over(W.partitionBy(*groups, "_range").orderBy("_v")))
    same = lambda a, b, names: reduce(lambda x, c: x & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), names, F.lit(True))
    placed = within.alias("a").join(sums.alias("b"), same("a", "b", [*groups, "_range"]))
    placed = placed.select(*(F.col(f"a.{g}").alias(g) for g in groups), "_v", "_times", "_n", (F.col("_before") + F.col("_upto")).alias("_upto"))
    ranks = {"_low": F.expr("(_n + 1) div 2"), "_high": F.expr("_n div 2 + 1"), "_p95": F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.95))}
    held = {k: (F.col("_upto") - F.col("_times") < r) & (r <= F.col("_upto")) for k, r in ranks.items()}
    chosen = placed.where(reduce(lambda x, y: x | y, held.values()))
    chosen = chosen.groupBy(*groups).agg(*(F.max(F.when(h, F.col("_v"))).alias(k) for k, h in held.items()))
    whole = named.groupBy(*groups).agg(F.count("_v").alias("n"), F.round(F.min("_v"), 6).alias("least"))
    out = whole.alias("a").join(chosen.alias("b"), same("a", "b", groups), "left")
    return out.select(*(F.col(f"a.{g}").alias(c) for c, g in zip(by, groups)), "n", F.round(F.col("_low") * 0.5 + F.col("_high") * 0.5, 6).alias("median"), F.round("_p95", 6).alias("p95"), "least")
