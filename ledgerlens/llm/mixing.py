"""Mixing sources to target weights by weighted fair queueing.

Within its source each document, in a shuffled order fixed by a hash, has a
virtual finish time: the source's words up to and with it, divided by the
source's target. All documents sorted by that time are cut where their words
reach the total budget. A source whose target exceeds its size goes round a
second time, in the same order.

Running sums are made in two steps, sums of hash ranges and then sums within a
range, so no source is summed by one task; the cut is found likewise. Since a
source's finish times follow its hash order, the cut is a hash position per
source, and applying it moves no text.

Null text has size 0 and null is a source of its own, the last. The order goes
by a hash of id and text, so rows without an id, or of one id with unlike texts,
are spread like others; rows that are equal in both are numbered, and spread by
their numbers too: which of them has which number makes no difference. Empty
tables give empty results. Whole documents are taken, never parts. Columns that
begin with two underscores are for the operator's own use; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, sized_broadcast, word_array

#: Fixed: weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST_TIMES = 1.5, 2
#: Documents in a hash range of a source, and in a slice of finish times, that a task sorts.
RANGE_ROWS = 20_000


def size_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.size(word_array(text)).cast("long")


def order_hash(id_col: str, seed: int, text_col: str = "text") -> Column:
    """The place of a row in the shuffled order: a hash of id and text, and of the row's number among those that are equal in both."""
    own = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    return F.when(F.col("__copy") == 0, own).otherwise(F.xxhash64(own, F.col("__copy")))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __copy: 0, or the number of a row among rows of its id and text. Only repeated rows move, in pieces as they lie."""
    scratch = Scratch(docs.sparkSession, "copies")
    same = F.xxhash64(F.col(id_col), F.col(text_col))
    again = scratch.keep(docs.groupBy(same.alias("__same2")).agg(F.count(F.lit(1)).alias("__n2")).where("__n2 > 1").select("__same2"), "again")
    n = again.count()
    if not n:
        return docs.withColumn("__copy", F.lit(0).cast("long"))
    rows = docs.withColumn("__same", same)
    on = F.col("__same") == F.col("__same2")
    repeated = rows.join(sized_broadcast(again, n), on).drop("__same2").withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    repeated = scratch.keep(repeated, "repeated")
    counts = repeated.groupBy(F.col("__same").alias("__same2"), F.col("__p").alias("__p2")).agg(F.count(F.lit(1)).alias("__n2"))
    before = F.coalesce(F.sum("__n2").over(W.partitionBy("__same2").orderBy("__p2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    counts = counts.withColumn("__before", before)
    rank = F.row_number().over(W.partitionBy("__same", "__p").orderBy("__m")) - 1 + F.col("__before")
    numbered = repeated.join(counts, on & (F.col("__p") == F.col("__p2"))).withColumn("__copy", rank.cast("long"))
    columns = [*[F.col(f"`{c}`") for c in docs.columns], F.col("__copy")]
    alone = rows.join(sized_broadcast(again, n), on, "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    return alone.select(*columns).unionByName(numbered.select(*columns))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """Per source: source, source_size, docs, rank, weight and target, from its documents' sizes.

    Sources filled to their limit are those of the least limit per weight, as
    many as it takes until an even rate for the rest stays below theirs.
    """
    one = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by = by.withColumn("rank", F.row_number().over(one))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double")).withColumn("limit", most * F.col("source_size"))
    total = W.partitionBy(F.lit(0))
    below = W.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    budget = F.sum("source_size").over(total) * share
    rate = (budget - F.coalesce(F.sum("limit").over(below), F.lit(0))) / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    by = by.withColumn("rate", rate).withColumn("open", F.col("rate") * F.col("weight") <= F.col("limit"))
    by = by.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "rank", "rate"))).over(total)["rate"])
    return by.select("source", "source_size", "docs", "rank", "weight", F.when(F.col("level").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def _bits(rows: int) -> int:
    """Bits of a hash that part so many rows into ranges of about RANGE_ROWS."""
    return min(20, max(8, (max(1, rows) // RANGE_ROWS).bit_length() + 1))


def _range(h: Column, bits: int) -> Column:
    """The place of a hash, as a signed number, among 2**bits even ranges."""
    return F.shiftright(h, 64 - bits)


def cuts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """Per source: its row of targets() with last1 and last2, the (hash, id) of the last document taken in each round."""
    docs = docs if "__copy" in docs.columns else with_copies(docs, id_col)
    scratch = Scratch(spark, "mixing")
    rows = scratch.keep(docs.select(F.col(id_col).alias("id"), F.col("source"), order_hash(id_col, seed).alias("h"), size_of(F.col("text")).alias("size")), "sizes")
    by = scratch.keep(targets(rows), "targets")
    known = by.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    n_sources, n_docs, budget = known
    bits = _bits(n_docs)
    rows = rows.join(sized_broadcast(by.select(F.col("source").alias("s"), "rank", "source_size", "target"), n_sources), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source").where("size > 0").withColumn("r", _range(F.col("h"), bits))
    # Words of a source before each hash range, and then before each document.
    ranges = rows.groupBy("rank", "r").agg(F.sum("size").alias("n"))
    start = ranges.select("rank", "r", F.coalesce(F.sum("n").over(W.partitionBy("rank").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = W.partitionBy("rank", "r").orderBy("h", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.withColumn("cum", F.sum("size").over(inside)).join(start, ["rank", "r"])
    first = F.col("start") + F.col("cum")
    again = F.col("target") > F.col("source_size")
    events = F.array_compact(F.array(F.struct(F.lit(1).alias("round"), (first / F.col("target")).alias("time")), F.when(again, F.struct(F.lit(2).alias("round"), ((first + F.col("source_size")) / F.col("target")).alias("time")))))
    timed = scratch.keep(summed.select("rank", "h", "id", "size", F.inline(events)), "timed")
    # Words before each slice of time, and the slice where they reach the budget.
    slices = 1 << _bits(2 * n_docs)
    slice_ = F.floor(F.least(F.col("time"), F.lit(4.0)) * slices).cast("long")
    sums = timed.groupBy(slice_.alias("slice")).agg(F.sum("size").alias("n"))
    running = W.orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = sums.withColumn("upto", F.sum("n").over(running)).where(F.col("upto") > budget).agg(F.min(F.struct("slice", "upto", "n"))).first()[0]
    if edge is None:
        taken = timed
    else:
        order = ("time", "rank", "h", "id", "round")
        within = timed.where(slice_ == edge.slice).withColumn("upto", F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) + F.lit(edge.upto - edge.n)).where(F.col("upto") <= budget)
        taken = timed.where(slice_ < edge.slice).unionByName(within.drop("upto"))
    last = taken.groupBy("rank").agg(*[F.max(F.when(F.col("round") == k, F.struct("h", "id"))).alias(f"last{k}") for k in (1, 2)])
    return scratch.keep(by.join(last, "rank", "left"), "cuts")


def with_taken(docs: DataFrame, cut: DataFrame, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """docs with __size, __cut (the source's row) and __times, how often the mix takes the document."""
    docs = docs if "__copy" in docs.columns else with_copies(docs, id_col)
    side = cut.select(F.col("source").alias("__source"), F.struct("source_size", "target", "last1", "last2").alias("__cut"))
    rows = docs.join(sized_broadcast(side, cut.count()), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    own = F.struct(order_hash(id_col, seed).alias("h"), F.col(id_col).alias("id"))
    within = lambda k: F.coalesce(own <= F.col(f"__cut.last{k}"), F.lit(False)).cast("long")
    size = size_of(F.col("text"))
    return rows.withColumn("__size", size).withColumn("__times", F.when(F.col("__size") > 0, within(1) + within(2)).otherwise(0))
