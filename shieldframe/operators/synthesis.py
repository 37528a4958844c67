"""Seeded synthetic tables: every cell is a function of seed, table, column and row, so any part can be made anywhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shieldframe.operators import reports

KINDS = ("null", "boolean", "integer", "float", "date", "email", "phone", "category", "text")
#: First names by locale; other locales take the first.
NAMES = {
    "en-US": ("Alex", "Jordan", "Morgan", "Riley", "Taylor", "Casey"),
    "es-ES": ("Alex", "Carmen", "Dani", "Lucia", "Mar", "Sofia"),
    "fr-FR": ("Alex", "Camille", "Lou", "Manon", "Noa", "Sacha"),
}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    nullable: bool = False
    categories: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None
    primary_key: bool = False
    locale: str = "en-US"
    null_rate: float = 0.0
    weights: Mapping[str, float] = field(default_factory=dict)
    mean: float | None = None
    deviation: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent_table: str
    parent_column: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    diagnostics: tuple[str, ...] = ()


def infer(df: DataFrame, name: str) -> TableSpec:
    """A table's specification from its rows, in one aggregation and one count of distinct cells: kinds, ranges, categories.

    Cells of several kinds make a text column (integers and floats a float one) with a diagnostic that holds no values.
    """
    cols = df.columns
    typed = {"boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "float", "date": "date"}
    kind_of = {c: F.when(reports.missing(F.col(c)), "null").otherwise(typed[t]) if t in typed else reports.scalar_kind(F.col(c)) for c, t in df.dtypes}
    number = {c: F.expr(f"try_cast(`{c}` as double)") for c in cols}
    row = df.agg(
        F.count("*").alias("n"),
        *(F.collect_set(kind_of[c]).alias(f"k_{i}") for i, c in enumerate(cols)),
        *(F.sum(reports.missing(F.col(c)).cast("long")).alias(f"m_{i}") for i, c in enumerate(cols)),
        *(f(number[c]).alias(f"{p}_{i}") for i, c in enumerate(cols) for p, f in (("lo", F.min), ("hi", F.max), ("avg", F.avg), ("sd", F.stddev_pop))),
    ).first()
    different = {r["column"]: r["n_distinct"] for r in reports.distinct_counts(df, cols).collect()}  # a row per column
    specs, notes = [], []
    for i, c in enumerate(cols):
        kinds = set(row[f"k_{i}"]) - {"null"}
        if not kinds:
            kind = "null"
        elif kinds <= {"integer", "float"}:
            kind = "float" if "float" in kinds else "integer"
        elif len(kinds) == 1:
            kind = kinds.pop()
        else:
            kind = "text"
            notes.append(f"{c}: mixed kinds {', '.join(sorted(kinds))}")
        filled, distinct = row["n"] - row[f"m_{i}"], different.get(c, 0)
        categories, shares = (), {}
        if kind == "text" and len(set(row[f"k_{i}"]) - {"null"}) == 1 and distinct <= min(reports.MOST_CATEGORIES, max(4, -(-filled // 5))):
            kind = "category"
            found = sorted((r["category"], r["weight"]) for r in reports.weights(df, c).collect())  # at most 50 rows
            categories, shares = tuple(k for k, _ in found), dict(found)
        key = c.lower() in ("id", f"{name.lower()}_id") and filled > 0 and distinct == filled
        numeric = kind in ("integer", "float")
        specs.append(
            ColumnSpec(
                c, kind, nullable=filled < row["n"], categories=categories, primary_key=key, null_rate=(row["n"] - filled) / row["n"] if row["n"] else 0.0, weights=shares,
                minimum=row[f"lo_{i}"] if numeric else None, maximum=row[f"hi_{i}"] if numeric and not key else None, mean=row[f"avg_{i}"] if numeric else None, deviation=row[f"sd_{i}"] if numeric else None,
            )
        )
    return TableSpec(name, tuple(specs), diagnostics=tuple(notes))


def spec_table(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """A specification as a table of its own, a row per column: what a schema file holds."""
    rows = [(c.name, c.kind, c.nullable, list(c.categories), c.minimum, c.maximum, c.primary_key, round(c.null_rate, 6), c.mean, c.deviation) for c in spec.columns]
    rows = [tuple(float(v) if i in (4, 5, 8, 9) and v is not None else v for i, v in enumerate(r)) for r in rows]
    return spark.createDataFrame(rows, "name string, kind string, nullable boolean, categories array<string>, minimum double, maximum double, primary_key boolean, null_rate double, mean double, deviation double")


def valid(spec: ColumnSpec, value: Column) -> Column:
    """Whether a cell fits a column: missing where that is allowed, one of its categories, or of its kind (whole numbers are
    numbers too)."""
    if spec.kind == "category":
        fits = value.cast("string").isin(*spec.categories) if spec.categories else F.lit(False)
    else:
        fits = reports.scalar_kind(value).isin(*({spec.kind, "integer"} if spec.kind == "float" else {spec.kind}))
    return F.when(reports.missing(value), F.lit(spec.nullable)).otherwise(fits)


def quality_report(real: DataFrame, made: DataFrame, spec: TableSpec) -> DataFrame:
    """A row per column of the specification: null rates and their difference, the part of made cells that are valid, for
    categories coverage and total variation from the specification's weights, for numbers the difference of the means over
    the real range. One row says so where nothing can be evaluated. Columns that a table lacks count as null.

    Both tables are aggregated once; categories are counted once per table.
    """
    spark = made.sparkSession
    schema = "status string, reason string, source_rows long, synthetic_rows long, column string, kind string, source_null_rate double, synthetic_null_rate double, null_rate_delta double, synthetic_type_valid_rate double, category_coverage double, category_total_variation double, normalized_mean_delta double"
    if not spec.columns or real.isEmpty() or made.isEmpty():
        return spark.createDataFrame([("not_evaluable", "both tables need a row", *[None] * 11)], schema)

    def aggregated(df: DataFrame) -> dict:
        cells = {c.name: F.col(f"`{c.name}`") if c.name in df.columns else F.lit(None).cast("string") for c in spec.columns}
        number = {n: F.when(~reports.missing(x) & reports.scalar_kind(x).isin("integer", "float"), x.cast("string").try_cast("double")) for n, x in cells.items()}
        parts = []
        for i, c in enumerate(spec.columns):
            x = cells[c.name]
            parts += [F.avg(reports.missing(x).cast("int")).alias(f"m_{i}"), F.avg(F.coalesce(valid(c, x), F.lit(False)).cast("int")).alias(f"v_{i}")]
            if c.kind in ("integer", "float"):
                parts += [f(number[c.name]).alias(f"{p}_{i}") for p, f in (("lo", F.min), ("hi", F.max), ("avg", F.avg))]
        return df.agg(F.count("*").alias("n"), *parts).first().asDict()

    a, b = aggregated(real), aggregated(made)
    rows = []
    for i, c in enumerate(spec.columns):
        coverage = variation = delta = None
        if c.kind == "category" and c.name in made.columns:
            counts = {r["category"]: r["n"] for r in reports.weights(made, c.name).where(F.col("category").isin(*c.categories)).collect()} if c.categories else {}
            filled = round(b["n"] * (1 - b[f"m_{i}"]))
            coverage = round(len(counts) / len(set(c.categories)), 6) if c.categories else None
            if c.weights and filled:
                other = (filled - sum(counts.values())) / filled  # cells that are no category at all
                variation = round((sum(abs(w - counts.get(k, 0) / filled) for k, w in c.weights.items()) + other) / 2, 6)
        if c.kind in ("integer", "float") and a[f"avg_{i}"] is not None and b[f"avg_{i}"] is not None:
            delta = round(abs(a[f"avg_{i}"] - b[f"avg_{i}"]) / max(a[f"hi_{i}"] - a[f"lo_{i}"], 1.0), 6)
        rows.append(("evaluated", None, a["n"], b["n"], c.name, c.kind, round(a[f"m_{i}"], 6), round(b[f"m_{i}"], 6), round(abs(a[f"m_{i}"] - b[f"m_{i}"]), 6), round(b[f"v_{i}"], 6), coverage, variation, delta))
    return spark.createDataFrame(rows, schema)


def uniform(seed: str, table: str, column: str, row: Column, draw: int = 0) -> Column:
    """A number in [0, 1) from 52 bits of a SHA-256 of where it is drawn."""
    text = F.concat_ws("\x00", F.lit("shieldframe"), F.lit(seed), F.lit(table), F.lit(column), row.cast("string"), F.lit(str(draw)))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _between(u: Column, low: int, n: int) -> Column:
    return (F.lit(low) + F.floor(u * n)).cast("long")


def cell(spec: ColumnSpec, row: Column, seed: str, table: str, rows: int) -> Column:
    """A column's generator. Raises where a key can't have so many values or a range is empty."""
    u = lambda k: uniform(seed, table, spec.name, row, k)
    lo, hi = spec.minimum, spec.maximum
    if spec.primary_key:
        limit = {"null": 0, "boolean": 2, "category": len(spec.categories), "phone": 10_000_000}.get(spec.kind)
        if spec.kind == "integer" and hi is not None:
            limit = int(hi // 1) - _ceil(1 if lo is None else lo) + 1
        if spec.kind == "float" and hi is not None and rows > 1 and hi <= (1.0 if lo is None else lo):
            limit = 1
        if limit is not None and rows > limit:
            raise ValueError(f"{spec.name}: {rows} rows, but only {max(limit, 0)} keys")
        if spec.kind == "integer":
            return (row + F.lit(_ceil(1 if lo is None else lo))).cast("long")
        if spec.kind == "float":
            start = 1.0 if lo is None else float(lo)
            return (F.lit(start) + row * ((hi - start) / (rows - 1) if hi is not None and rows > 1 else 0.0 if hi is not None else 1.0)).cast("double")
        made = {
            "email": F.concat(F.lit("pk"), (row + 1).cast("string"), F.lit("@example.test")),
            "phone": F.concat(F.lit("+1-202-"), F.lpad((row + 1).cast("string"), 7, "0")),
            "date": F.date_add(F.lit("2000-01-01").cast("date"), row.cast("int")).cast("string"),
            "boolean": row == 1,
            "category": F.element_at(F.array(*map(F.lit, spec.categories or ("",))), (row + 1).cast("int")),
            "text": F.concat(F.lit(f"{table}-"), F.lpad((row + 1).cast("string"), F.greatest(F.lit(6), F.length((row + 1).cast("string"))), F.lit("0"))),
        }
        return made[spec.kind]
    if spec.kind == "null":
        return F.lit(None).cast("string")
    low = 0 if lo is None else lo
    high = low + 100 if hi is None else hi
    if spec.kind in ("integer", "float") and (high < low or spec.kind == "integer" and _ceil(low) > high // 1):
        raise ValueError(f"{spec.name}: its range is empty")
    if spec.kind == "boolean":
        value = u(1) < 0.5
    elif spec.kind == "integer":
        value = _between(u(1), _ceil(low), int(high // 1) - _ceil(low) + 1)
    elif spec.kind == "float":
        if spec.mean is not None and spec.deviation is not None:
            normal = F.sqrt(-2 * F.log(1 - u(1))) * F.cos(2 * F.pi() * u(2))
            value = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.lit(spec.mean) + normal * spec.deviation))
        else:
            value = F.lit(float(low)) + u(1) * float(high - low)
        value = F.round(value, 4)
    elif spec.kind == "date":
        value = F.date_add(F.lit("2020-01-01").cast("date"), _between(u(1), 0, 3653).cast("int")).cast("string")
    elif spec.kind == "email":
        value = F.concat(F.lit("person"), _between(u(1), 100_000, 899_999).cast("string"), F.lit("@example.test"))
    elif spec.kind == "phone":
        value = F.concat(F.lit("+1-202-555-"), F.lpad(_between(u(1), 0, 10_000).cast("string"), 4, "0"))
    elif spec.kind == "category":
        if not spec.categories:
            raise ValueError(f"{spec.name}: no categories")
        shares = [spec.weights.get(c, 1.0) for c in spec.categories]
        value, upto = F.lit(spec.categories[-1]), sum(shares)
        for c, w in reversed(list(zip(spec.categories, shares, strict=True))):
            upto -= w
            value = F.when(u(1) * sum(shares) < upto + w, F.lit(c)).otherwise(value)
    else:
        names = NAMES.get(spec.locale, NAMES["en-US"])
        value = F.concat(F.element_at(F.array(*map(F.lit, names)), (F.floor(u(1) * len(names)) + 1).cast("int")), F.lit(f" {spec.name.replace('_', ' ')} "), (row + 1).cast("string"))
    return F.when(u(0) >= spec.null_rate, value) if spec.nullable else value


def _ceil(x: float) -> int:
    return int(-(-x // 1))


def table(spark: SparkSession, spec: TableSpec, rows: int, seed: str, partitions: int | None = None) -> DataFrame:
    """`rows` rows of a table, made in parallel without a shuffle."""
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return base.select(*(cell(c, F.col("id"), seed, spec.name, rows).alias(c.name) for c in spec.columns))


def order_of(specs: Sequence[TableSpec]) -> list[TableSpec]:
    """Parents before children, names in order among those that are free; a table may refer to itself. Raises on cycles."""
    by_name = {s.name: s for s in specs}
    for s in specs:
        columns = [k.column for k in s.foreign_keys]
        if len(set(columns)) != len(columns):
            raise ValueError(f"{s.name}: a column has two foreign keys")
        for k in s.foreign_keys:
            parent = by_name.get(k.parent_table)
            if parent is None or k.parent_column not in {c.name for c in parent.columns}:
                raise ValueError(f"{s.name}.{k.column}: unknown parent")
            kinds = [next(c.kind for c in t.columns if c.name == n) for t, n in ((s, k.column), (parent, k.parent_column))]
            if kinds[0] != kinds[1] and kinds != ["float", "integer"]:
                raise ValueError(f"{s.name}.{k.column}: {kinds[0]} can't refer to {kinds[1]}")
    done: list[TableSpec] = []
    left = dict(by_name)
    while left:
        free = sorted(n for n, s in left.items() if not any(k.parent_table in left and k.parent_table != n for k in s.foreign_keys))
        if not free:
            raise ValueError("foreign keys form a cycle")
        done.append(left.pop(free[0]))
    return done


def sample_parents(children: DataFrame, row: str, parents: DataFrame, parent_column: str, seed: str, name: str, unique: bool = False) -> DataFrame:
    """`children` with a column `name` of parent values: drawn by a hash of the row, or, if unique, each parent once.

    Parents are numbered in order of a SHA-256 and joined by number: a distinct parent's rank within its hash bucket plus
    the bucket's offset, so numbering is spread over the buckets.
    """
    h = F.sha2(F.concat_ws("\x00", F.lit(seed), F.lit(name), F.col("parent").cast("string")), 256)
    distinct = parents.select(F.col(parent_column).alias("parent")).where("parent is not null").distinct().withColumn("h", h).withColumn("b", F.substring("h", 1, 2))
    sizes = distinct.groupBy("b").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("offset", F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))  # 256 rows
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not total:
        raise ValueError(f"{name}: no parents")
    if unique and children.count() > total:
        raise ValueError(f"{name}: fewer parents than rows")
    ranked = distinct.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy("h", "parent"))).join(F.broadcast(offsets), "b")
    ranked = ranked.select((F.col("offset") + F.col("r") - 1).alias("_i"), F.col("parent").alias(name))
    index = F.col(row) if unique else F.floor(uniform(seed, "parents", name, F.col(row)) * F.lit(total))
    return children.withColumn("_i", index.cast("long")).join(ranked, "_i").drop("_i")


def tables(spark: SparkSession, specs: Sequence[TableSpec], rows: Mapping[str, int], seed: str) -> dict[str, DataFrame]:
    """All tables with their foreign keys; keys of unique columns take each parent at most once."""
    made: dict[str, DataFrame] = {}
    for spec in order_of(specs):
        n, own = rows[spec.name], {k.column: k for k in spec.foreign_keys}
        out = spark.range(n).select(F.col("id").alias("_row"), *(cell(c, F.col("id"), seed, spec.name, n).alias(c.name) for c in spec.columns if c.name not in own))
        for k in spec.foreign_keys:
            parents = out if k.parent_table == spec.name else made[k.parent_table]
            out = sample_parents(out, "_row", parents, k.parent_column, f"{seed}/{spec.name}", k.column, unique=next(c.primary_key for c in spec.columns if c.name == k.column))
        made[spec.name] = out.select(*(c.name for c in spec.columns))
    return made


def orphans(children: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose foreign key has no parent; null keys don't count."""
    keys = parents.select(F.col(parent_column).alias("_k")).distinct()
    return children.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_k"), "left_anti")
