"""Running sums over any number of ordered rows, without a task for all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.sources.scratch import Scratch


def running(rows: DataFrame, keys: list[str], order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """rows with, for each of sums, name_upto (the sum of its key up to and with the row) and name_all (of all its key's rows).

    Rows are written in ranges of keys and order, so a key's rows are in as
    many ranges as their number asks for; a key has one sum per range, and
    windows run over these sums, and over rows within a range. Values of order
    should be distinct within a key.
    """
    by = F.desc(order) if descending else F.asc(order)
    ranged = rows.repartitionByRange(*keys, by).withColumn("__range", F.spark_partition_id())
    ranged = Scratch(rows.sparkSession, "ranges").keep(ranged, "rows")  # written, as ranges are sampled anew each time
    key = [F.col(c) for c in keys]
    parts = ranged.groupBy(*keys, "__range").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    whole = W.partitionBy(*key) if keys else W.partitionBy(F.lit(0))
    before = whole.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"__key_{c}") for c in keys], F.col("__range").alias("__of"), *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__before_{s}") for s in sums], *[F.sum(f"__{s}").over(whole).alias(f"{s}_all") for s in sums])
    same = F.col("__range") == F.col("__of")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    inside = W.partitionBy(*key, "__range").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    done = ranged.join(parts, same).withColumns({f"{s}_upto": F.sum(s).over(inside) + F.col(f"__before_{s}") for s in sums})
    return done.drop("__range", "__of", *[f"__key_{c}" for c in keys], *[f"__before_{s}" for s in sums])
