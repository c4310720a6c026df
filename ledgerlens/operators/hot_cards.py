"""Features of cards with any number of rows: a hot card's rows lie in ranges of time, and ranges hand on what later ones need.

The last row of a range is what the first row of the next one follows; counts
and sums by merchant and day are running sums over ranges and then within one;
a card's statistics are aggregates, its median comes from counts by amount. So
the most that a task holds is a range. Results equal those of the windows by
card, but for the rounding of a day's running amounts, which are added range by range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.columns import mean_of, stddev_of
from ledgerlens.functions.ranges import running
from ledgerlens.operators import features as X
from ledgerlens.sources.scratch import Scratch

RANGE_ROWS, MANY_CARDS = 1_000_000, 200_000


def by_card_in_ranges(df: DataFrame, hot_rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """features.by_card(), with cards of more than hot_rows rows in ranges of about range_rows."""
    scratch = Scratch(df.sparkSession, "cards")
    counts = df.groupBy(X.CARD).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > hot_rows) & F.col(X.CARD).isNotNull())
    hot = scratch.keep(counts.select(F.col(X.CARD).alias("__hot"), "__n"), "hot")
    known = hot.agg(F.count(F.lit(1)), F.sum("__n")).first()
    if not known[0]:
        return X.by_card(df)
    side = F.broadcast(hot.select("__hot")) if known[0] <= MANY_CARDS else hot.select("__hot")
    on = F.col(X.CARD) == F.col("__hot")
    cold = X.by_card(df.join(side, on, "left_anti"))
    parts = max(2, -(-known[1] // range_rows))
    ranged = df.join(side, on, "left_semi").withColumn("date", F.to_date(X.TIME)).repartitionByRange(parts, X.CARD, *X.ORDER).withColumn("__range", F.spark_partition_id())
    return cold.unionByName(_in_ranges(scratch.keep(ranged, "ranged"), scratch).select(*cold.columns))


def _joined(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """df with what side has for its keys; nulls are equal."""
    renamed = side.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(renamed, on, "left").drop(*[f"__k_{k}" for k in keys])


def _before(df: DataFrame, keys: list[str], n: str, amount: str | None = None) -> DataFrame:
    """df with the number of rows of the same keys in earlier ranges (n), and their amounts."""
    sums = df.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__rows"), F.sum("amt").alias("__amt"))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    side = sums.select(*keys, "__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias(n), *([F.sum("__amt").over(earlier).alias(amount)] if amount else []))
    return _joined(df, side, [*keys, "__range"])


def _in_ranges(df: DataFrame, scratch: Scratch) -> DataFrame:
    card, inside = X.CARD, W.partitionBy(X.CARD, "__range").orderBy(*X.ORDER)
    last = F.struct(F.col(X.TIME).alias("time"), "amt", "merch_lat", "merch_long")
    ends = df.groupBy(card, "__range").agg(F.max_by(last, F.struct(*X.ORDER)).alias("__end"))
    ends = ends.select(card, "__range", F.lag("__end").over(W.partitionBy(card).orderBy("__range")).alias("__carried"))
    own = df
    df = _joined(df, ends, [card, "__range"]).withColumn("__prev", F.coalesce(F.lag(last).over(inside), F.col("__carried"))).drop("__carried")
    df = _before(df, [card, "merchant"], "__used")
    df = df.withColumn("merchant_use_count", (F.col("__used") + F.row_number().over(W.partitionBy(card, "merchant", "__range").orderBy(*X.ORDER)) - 1).cast("long"))
    df = _before(df, [card, "date"], "__today", "__spent")
    day = W.partitionBy(card, "date", "__range").orderBy(*X.ORDER)
    now = F.sum("amt").over(day.rowsBetween(W.unboundedPreceding, W.currentRow))
    pairs = lambda *keys: own.where(F.col(keys[-1]).isNotNull()).select(*keys).distinct().groupBy(*keys[:-1]).agg(F.count(F.lit(1)).alias("__k"))
    df = _joined(df, pairs(card, "date", "merchant").withColumnRenamed("__k", "__merchants"), [card, "date"])
    df = df.withColumns({
        "daily_trans_count": (F.col("__today") + F.row_number().over(day)).cast("long"),
        "daily_amount_sum": F.coalesce(F.col("__spent") + now, now, F.col("__spent")),
        "daily_merchant_count": F.coalesce("__merchants", F.lit(0)).cast("long"),
    })
    c = F.round(F.col("amt") * 100).cast("decimal(19,0)")
    stats = own.groupBy(card).agg(F.count("amt").alias("__n"), F.sum(c).alias("__s"), F.sum((c * c).cast("decimal(38,0)")).alias("__q"), F.min("amt").alias("customer_amt_min"), F.max("amt").alias("customer_amt_max"))
    # The middle of a card's amounts, from running counts by amount.
    amounts = own.where("amt is not null").groupBy(card, F.round(F.col("amt") * 100).cast("long").alias("cents")).agg(F.count(F.lit(1)).alias("n"))
    run, place = running(amounts, [card], "cents", ["n"]), (F.col("n_all") - 1) / 2
    at = lambda p: F.max(F.when((F.col("n_upto") - F.col("n") <= p) & (p < F.col("n_upto")), F.col("cents")))
    middle = run.groupBy(card).agg(((at(F.floor(place)) + at(F.ceil(place))) / 2 / 100).alias("customer_amt_median"))
    for side in (pairs(card, "merchant").withColumnRenamed("__k", "customer_merchant_nunique"), pairs(card, "category").withColumnRenamed("__k", "customer_category_nunique"), middle):
        stats = _joined(stats, side, [card])
    stats = stats.withColumns({"customer_amt_mean": mean_of(F.col("__n"), F.col("__s")), "customer_amt_std": stddev_of(F.col("__n"), F.col("__s"), F.col("__q")), **{f"customer_{k}_nunique": F.coalesce(f"customer_{k}_nunique", F.lit(0)).cast("long") for k in ("merchant", "category")}})
    df = _joined(df, scratch.keep(stats.drop("__n", "__s", "__q"), "stats"), [card])
    df = X.against_profile(X.first_merchant(X.velocity(df, F.col("__prev.time"))))
    df = X.geo_velocity(X.amount_patterns(df, F.col("__prev.amt")), (F.col("__prev.merch_lat"), F.col("__prev.merch_long")))
    return X.time_features(df)
