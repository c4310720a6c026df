"""Shards by extendible hashing, natively.

A directory is indexed by the leading bits of a 64-bit hash of the row. It
starts as one bucket; only buckets over the byte limit split on another bit,
until each fits. Splitting is decided on byte sums of hash prefixes, never on
rows, so a step's work is one map-side-combined sum.

A single row over the limit gets a bucket of its own (oversize true). Rows that
are the same in every hashed column share all 64 bits; if such copies exceed a
limit together, their bucket continues in chained shards, as in the classic
scheme; they alone are numbered, by counts of the partitions they are written
in. Null text has no bytes, null ids are ids like others. An empty table gives
an empty directory. Columns of the names that shard() gives are replaced, those
that begin with two underscores are for its own use, others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, sized_broadcast, whole

BYTE_LIMIT = 16 << 20
#: Bits beyond those an even split needs, looked at in one step; further steps look at STEP_BITS more where they must.
SLACK_BITS, STEP_BITS = 4, 8


def text_bytes(text: Column) -> Column:
    return F.octet_length(whole(text)).cast("long")


def row_hash(*columns: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def _prefix(h: Column, bits: int) -> Column:
    """The leading bits of a hash; 0 for none."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")



def directory(spark: SparkSession, sizes: DataFrame, limit: int, scratch: Scratch) -> list[tuple[int, DataFrame, int]]:
    """The buckets of sizes (h long, bytes long).

    Returns a list of (bits, cells, number of cells): cells has a row for each
    prefix of that many bits in use, with its bucket's depth, shard_bytes,
    shard_docs and oversize, or a null depth if a later entry looks at more bits.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = min(32, max(1, math.ceil(math.log2(max(1, total / limit)))) + SLACK_BITS)
    low, pending, out = 0, sizes, []
    while True:
        hist = scratch.keep(pending.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), f"hist{bits}")
        levels = hist.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth")).withColumn("top", F.expr(f"shiftrightunsigned(cell, {bits} - depth)"))
        sums = levels.groupBy("depth", "top").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)
        last = bits == 64
        fit = sums.where(fits | (F.col("depth") == 64) if last else fits)
        leaf = levels.select("cell", "depth", "top").join(fit, ["depth", "top"]).groupBy("cell").agg(F.min_by(F.struct("depth", "shard_bytes", "shard_docs"), "depth").alias("leaf"))
        cells = scratch.keep(hist.select("cell").join(leaf, "cell", "left").select("cell", "leaf.*").withColumn("oversize", F.col("shard_bytes") > limit), f"cells{bits}")
        counted = cells.agg(F.count(F.lit(1)), F.count(F.when(F.col("depth").isNull(), 1))).first()
        out.append((bits, cells, counted[0]))
        if not counted[1]:
            return out
        over = cells.where(F.col("depth").isNull()).select(F.col("cell").alias("__cell"))
        pending = pending.join(over, _prefix(F.col("h"), bits) == F.col("__cell"), "left_semi")
        low, bits = bits, min(64, bits + STEP_BITS)


def place(rows: DataFrame, found: list[tuple[int, DataFrame, int]], h: str = "__h") -> DataFrame:
    """rows with __leaf: depth, shard_bytes, shard_docs and oversize of the bucket of each row's hash."""
    leaf = F.lit(None)
    for bits, cells, n in found:
        name = f"__leaf{bits}"
        side = cells.where(F.col("depth").isNotNull()).select(F.col("cell").alias(f"__cell{bits}"), F.struct("depth", "shard_bytes", "shard_docs", "oversize").alias(name))
        rows = rows.join(sized_broadcast(side, n), _prefix(F.col(h), bits) == F.col(f"__cell{bits}"), "left").drop(f"__cell{bits}")
    leaf = F.coalesce(*[F.col(f"__leaf{bits}") for bits, _, _ in found])
    return rows.withColumn("__leaf", leaf).drop(*[f"__leaf{bits}" for bits, _, _ in found])


def shard(docs: DataFrame, limit: int = BYTE_LIMIT, text_col: str = "text", keys: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs with shard (string), depth, n_bytes, shard_bytes, shard_docs, oversize, in place of columns of those names.

    Hashing the key and the text leaves only whole copies of a row together.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    h, n = row_hash(*keys), text_bytes(F.col(text_col))
    sizes = scratch.keep(docs.select(h.alias("h"), n.alias("bytes")), "sizes")
    found = directory(spark, sizes, limit, scratch)
    rows = place(docs.drop("shard", "depth", "n_bytes", "shard_bytes", "shard_docs", "oversize").withColumns({"__h": h, "__n": n}), found)
    bits = F.concat(F.lit("s"), F.substring(F.lpad(F.bin("__h"), 64, "0"), F.lit(1), F.col("__leaf.depth")))
    rows = rows.withColumn("__own", F.struct(bits.alias("shard"), F.col("__leaf.shard_bytes").alias("bytes"), F.col("__leaf.shard_docs").alias("docs"), F.col("__leaf.oversize").alias("oversize")))
    if found[-1][0] == 64:
        copies = (F.col("__leaf.depth") == 64) & F.col("__leaf.oversize") & (F.col("__leaf.shard_docs") > 1)
        rows = rows.where(~copies).unionByName(_chained(rows.where(copies), limit, scratch))
    own = {"shard": F.col("__own.shard"), "depth": F.col("__leaf.depth").cast("long"), "n_bytes": F.col("__n"), "shard_bytes": F.col("__own.bytes"), "shard_docs": F.col("__own.docs"), "oversize": F.col("__own.oversize")}
    return rows.withColumns(own).drop("__h", "__n", "__leaf", "__own")


def _chained(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Rows that exceed the limit only together, dealt to chained shards: numbered within the partitions they are written in, and these by their counts."""
    written = scratch.keep(rows.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}), "copies")
    counts = written.groupBy("__h", "__p").agg(F.count(F.lit(1)).alias("k"), F.max("__n").alias("n"))
    w = W.partitionBy("__h")  # a row per partition
    before = counts.select(F.col("__h").alias("__h1"), F.col("__p").alias("__p1"), (F.sum("k").over(w.orderBy("__p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("k")).alias("__before"), F.max("n").over(w).alias("__most"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("__most"), F.lit(1))))
    rank = F.col("__before") + F.row_number().over(W.partitionBy("__h", "__p").orderBy("__m")) - 1
    dealt = written.join(before, (F.col("__h") == F.col("__h1")) & (F.col("__p") == F.col("__p1"))).withColumn("__chain", F.floor(rank / each))
    sums = dealt.groupBy(F.col("__h").alias("__h2"), F.col("__chain").alias("__c2")).agg(F.sum("__n").alias("__bytes"), F.count(F.lit(1)).alias("__docs"))
    dealt = dealt.join(sums, (F.col("__h") == F.col("__h2")) & (F.col("__chain") == F.col("__c2")))
    name = F.concat(F.col("__own.shard"), F.lit("."), F.col("__chain").cast("string"))
    own = F.struct(name.alias("shard"), F.col("__bytes").alias("bytes"), F.col("__docs").alias("docs"), (F.col("__bytes") > limit).alias("oversize"))
    return dealt.withColumn("__own2", own).select(*[F.col(f"`{c}`") for c in rows.columns if c != "__own"], F.col("__own2").alias("__own"))
