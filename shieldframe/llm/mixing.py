"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

The mix is a sequence of slots of about `BLOCK_WORDS` words. Slot i's point, the fractional part of i times the golden ratio,
falls into one source's part of [0, 1) (parts are as wide as the sources' shares), so every stretch of the mix has its
sources near their weights. Slots are ranked per source, and a source's target, in whole words, is dealt to its slots in
equal blocks (up to one word). A source's documents, in a shuffled order, are one sequence of words that starts again
at its end, of which each slot takes the next block; so a source takes its target to the word, however small it is.

All ranks and offsets are prefix sums over (source, bucket) totals and windows within a bucket, so that a source with a
third of all rows is spread over `16 ** BUCKET_DIGITS` buckets. Only tables with a row per source go through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shieldframe.llm.scratch import checkpoint, stored, unused

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
MOST_REPEATS = 3
SLOT_CHUNK = 4096
CELLS = 1024
#: Hexadecimal digits of a document's place in the shuffled order that make its bucket.
BUCKET_DIGITS = 3
#: The golden ratio's fraction in units of 2 ** -POINT_BITS: points are whole numbers, so slots of any number have points of their own.
POINT_BITS = 48
GOLDEN = 173961102589771
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """totals (source, source_size): adds weight, target, and the part [lo, hi) of the slots' points.

    Sources in order of code points, null last, weigh `weights` in turn. Targets share the sum of all sizes by weight;
    one that passes `most` times its source's size stops there and the excess goes to the others by weight, until none
    is above. That is the water level: in order of cap per weight, a source is capped while its cap per weight is at
    most what remains per remaining weight.
    """
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    named = totals.withColumn("place", F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))).withColumn("weight", pick)
    named = named.withColumn("cap", F.col("source_size") * most)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest_size = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))
    rest_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))
    level = named.withColumn("level", rest_size / rest_weight).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)  # the first that isn't capped has the true level
    done = level.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * free))
    total = F.sum("source_size").over(whole)
    upto = F.sum("target").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    done = done.withColumn("words", total).withColumn("hi", upto / total)
    return done.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("place")), F.lit(0.0))).select(
        "source", "source_size", "weight", "target", "words", "lo", "hi"
    )


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2 ** POINT_BITS, from products of halves that a long holds (slots under 2 ** 48)."""
    half = 1 << (POINT_BITS // 2)
    high, low = GOLDEN // half, GOLDEN % half
    a, b = F.floor(slot / half), slot % half
    return (((a * low + b * high) % half) * half + b * low) % (1 << POINT_BITS)


def _earlier(counts: DataFrame, keys: list[str], by: str, n: str, into: str, width: int = CELLS) -> DataFrame:
    """counts (keys, by, n; one row each) with the sum of `n` over smaller `by` of the same keys, in two levels, so that
    one key's rows are spread."""
    wide = counts.withColumn("_span", F.floor(F.col(by) / width))
    spans = wide.groupBy(*keys, "_span").agg(F.sum(n).alias("_n"))
    spans = spans.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_span")) - F.col("_n"))
    inner = wide.withColumn("_inner", F.sum(n).over(W.partitionBy(*keys, "_span").orderBy(by)) - F.col(n)).alias("a")
    same = F.col("a._span") == F.col("b._span")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return inner.join(spans.alias("b"), same).select(*(f"a.{c}" for c in counts.columns), (F.col("b._before") + F.col("a._inner")).alias(into))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (slot, source, rank): the mix's slots in order, each with its source and rank in it.

    A source with a target whose part no point falls into gets one slot, after all others.
    """
    spark = targets.sparkSession
    words = targets.agg(F.max("words")).first()[0] or 0
    n_slots = -(-int(words) // block_words)
    n_tasks = max(1, min(n_slots // 65536, 4096))
    slots = spark.range(0, n_slots, 1, n_tasks).select(F.col("id").alias("slot")).withColumn("point", point(F.col("slot")) / float(1 << POINT_BITS))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    cells = F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))
    parts = targets.where("hi > lo").select("source", "lo", "hi", F.explode(cells).alias("cell"))
    last = F.max("hi").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    parts = parts.withColumn("hi", F.when(F.col("hi") == last, F.lit(2.0)).otherwise(F.col("hi")))  # rounding leaves no gap at 1
    placed = slots.join(parts, "cell").where("point >= lo and point < hi").select("slot", "source")
    placed = placed.withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    counts = checkpoint(placed.groupBy("source", "chunk").agg(F.count("*").alias("n")))
    ranked = placed.withColumn("in_chunk", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot"))).alias("a")
    at = ranked.join(_earlier(counts, ["source"], "chunk", "n", "before").alias("b"), _same_source("a", "b") & (F.col("a.chunk") == F.col("b.chunk")))
    at = at.select("a.slot", "a.source", (F.col("b.before") + F.col("a.in_chunk") - 1).alias("rank"))
    left = targets.where(F.round("target") > 0).alias("a").join(counts.alias("b"), _same_source("a", "b"), "left_anti")
    more = left.select((F.lit(n_slots - 1) + F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))).alias("slot"), "source", F.lit(0).cast("long").alias("rank"))
    return at.unionByName(more)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rid: Column | None = None) -> DataFrame:
    """(rid, doc_id, source, size, key, bucket): one row per row of `docs`; `key` is the shuffled order within a source.

    `rid` is a number that each row has for itself; one is made where none is given."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    number = F.monotonically_increasing_id() if rid is None else rid
    rows = docs.select(number.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), key.alias("key"))
    return checkpoint(rows.select("*", F.substring("key", 1, BUCKET_DIGITS).alias("bucket")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` of which the mix takes words, with size, source_size, target and taken (see `mix`).

    Ids may be repeated or null: rows are numbered and written before they are mixed, so each has a taken of its own.
    Columns of `docs` with the added names are replaced.
    """
    rid = unused("mix_rid", docs.columns)
    rows = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-rows")
    numbers = _mixed(sized(rows, id_col, text_col, source_col, F.col(rid)), BLOCK_WORDS).where("taken > 0").drop("doc_id").withColumnRenamed("rid", rid)
    kept = rows.select(*(c for c in rows.columns if c.lower() not in ("size", "source_size", "target", "taken")))
    return kept.join(numbers, rid).drop(rid)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target (its source's), taken (words the mix takes of it).

    Null and empty texts have size 0 and take 0; rows of a null source form a source of their own, last in order.
    Ties in the shuffled order fall only between equal rows. Repeated rows count each by itself, and reruns agree.
    """
    return _mixed(sized(docs, id_col, text_col, source_col), block_words).drop("rid")


def _mixed(rows: DataFrame, block_words: int) -> DataFrame:
    """The rows of `mix` with their rid, from those of `sized`."""
    sums = checkpoint(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    targets = checkpoint(source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size"))))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).select("source", "bucket", "before")
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "rid")
    placed = rows.where("size > 0").withColumn("upto", F.sum("size").over(within)).alias("a")
    placed = placed.join(before.alias("b"), _same_source("a", "b") & (F.col("a.bucket") == F.col("b.bucket")))
    start = F.col("b.before") + F.col("a.upto") - F.col("a.size")
    placed = placed.select("a.rid", "a.source", start.alias("start"), (start + F.col("a.size")).alias("stop"))
    slots = schedule(targets, block_words)
    per = slots.groupBy("source").agg(F.count("*").alias("slots")).alias("p").join(targets.alias("t"), _same_source("p", "t"))
    per = per.select("t.source", "t.source_size", F.round("t.target").cast("long").alias("take"), "p.slots").where("take > 0")
    # the first `longer` slots take one word more than the others
    per = checkpoint(per.select("*", F.expr("take div slots").alias("each"), (F.col("take") % F.col("slots")).alias("longer")))
    slot_of = lambda x: f"case when {x} < longer * (each + 1) then {x} div (each + 1) else longer + ({x} - longer * (each + 1)) div greatest(each, 1) end"
    begins = lambda r: r * F.col("each") + F.least(r, F.col("longer"))
    mine = placed.alias("d").join(per.alias("s"), _same_source("d", "s")).where("start < take").select("d.rid", "d.source", "start", "stop", "source_size", "take", "each", "longer")
    passes = mine.withColumn("pass", F.explode(F.expr("sequence(0L, (take - 1 - start) div source_size)")))
    passes = passes.withColumns({"lo": F.col("pass") * F.col("source_size") + F.col("start"), "hi": F.least(F.col("pass") * F.col("source_size") + F.col("stop"), "take")})
    pieces = passes.withColumn("rank", F.explode(F.expr(f"sequence({slot_of('lo')}, {slot_of('(hi - 1)')})")))
    overlap = F.least("hi", begins(F.col("rank") + 1)) - F.greatest("lo", begins(F.col("rank")))
    took = pieces.select("rid", "source", "rank", overlap.alias("overlap")).alias("p").join(slots.alias("t"), _same_source("p", "t") & (F.col("p.rank") == F.col("t.rank")))
    took = took.groupBy("p.rid").agg(F.sum("p.overlap").alias("taken"))
    out = rows.join(took, "rid", "left").alias("r").join(targets.alias("s"), _same_source("r", "s"))
    return out.select("r.rid", "r.doc_id", "r.size", "s.source_size", F.round("s.target", 6).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
