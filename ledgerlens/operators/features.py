"""Feature engineering: every operator is DataFrame -> DataFrame.

Order within a card is by time and transaction number. All windows of a card
begin with cc_num, so one exchange by cc_num serves them all; distinct counts
come from first-occurrence flags on the same sort, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.columns import PI, clean, flag, mean_of, moments, stddev_of

CARD, TIME, ORDER = "cc_num", "trans_date_trans_time", ("trans_date_trans_time", "trans_num")
DAY_SECONDS, RAPID_SECONDS = 86400, 60
EXCLUDED = {
    "trans_num", "trans_date_trans_time", "cc_num", "merchant", "category", "first", "last", "gender", "street", "city", "state", "zip", "job", "dob", "date", "is_fraud", "unix_time", "index",
}


def _card(*more: str):
    return W.partitionBy(CARD, *more).orderBy(*ORDER)


def join_labels(df: DataFrame, labels: DataFrame | None, fallback: str = "zero", seed: int = 42) -> DataFrame:
    """Labels by transaction, 0 where missing. Without labels: zero, random_5 (5 %) or random_1 (1 %)."""
    if labels is None:
        rate = {"zero": 0.0, "random_5": 0.05, "random_1": 0.01}[fallback]
        return df.withColumn("is_fraud", (F.rand(seed) < rate).cast("int"))
    return df.drop("is_fraud").join(labels.select("trans_num", "is_fraud"), "trans_num", "left").withColumn("is_fraud", F.coalesce("is_fraud", F.lit(0)).cast("int"))


def join_customers(df: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers by card, left; columns that transactions have already are theirs. Spark broadcasts customers if they are few."""
    extra = [c for c in customers.columns if c == CARD or c not in df.columns]
    return df.join(customers.select(*extra), CARD, "left")


def velocity(df: DataFrame, before: Column | None = None) -> DataFrame:
    """Seconds since the card's last transaction; before: its time, by default that of the row before."""
    before = F.lag(TIME).over(_card()) if before is None else before
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    seconds = F.coalesce((micros(F.col(TIME)) - micros(before)) / 1e6, F.lit(float(DAY_SECONDS)))
    return df.withColumn("seconds_since_last_trans", seconds).withColumn("is_rapid_trans", flag(F.col("seconds_since_last_trans") < RAPID_SECONDS))


def daily_velocity(df: DataFrame) -> DataFrame:
    """Running count and sum of a card's day, and its merchants over the whole day."""
    df = df.withColumn("date", F.to_date(TIME))
    day = _card("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    new = (F.row_number().over(_card("date", "merchant")) == 1) & F.col("merchant").isNotNull()
    df = df.withColumn("__new", flag(new))
    return df.withColumns({
        "daily_trans_count": F.row_number().over(_card("date")).cast("long"),
        "daily_amount_sum": F.sum("amt").over(day),
        "daily_merchant_count": F.sum("__new").over(W.partitionBy(CARD, "date")).cast("long"),
    }).drop("__new")


def first_merchant(df: DataFrame) -> DataFrame:
    if "merchant_use_count" not in df.columns:
        df = df.withColumn("merchant_use_count", (F.row_number().over(_card("merchant")) - 1).cast("long"))
    return df.withColumn("is_first_merchant_use", flag(F.col("merchant_use_count") == 0))


def customer_profile(df: DataFrame) -> DataFrame:
    """A card's statistics on each of its rows, and the row's amount against them."""
    w = W.partitionBy(CARD)
    n, s, q = moments(F.col("amt"), w)
    df = df.withColumns({"__m": flag((F.row_number().over(_card("merchant")) == 1) & F.col("merchant").isNotNull()), "__c": flag((F.row_number().over(_card("category")) == 1) & F.col("category").isNotNull()), "__n": n, "__s": s, "__q": q})
    df = df.withColumns({
        "customer_amt_mean": mean_of(F.col("__n"), F.col("__s")),
        "customer_amt_median": F.median(F.round(F.col("amt") * 100).cast("long")).over(w) / 100,
        "customer_amt_std": stddev_of(F.col("__n"), F.col("__s"), F.col("__q")),
        "customer_amt_min": F.min("amt").over(w), "customer_amt_max": F.max("amt").over(w),
        "customer_merchant_nunique": F.sum("__m").over(w).cast("long"), "customer_category_nunique": F.sum("__c").over(w).cast("long"),
    }).drop("__m", "__c", "__n", "__s", "__q")
    return against_profile(df)


def against_profile(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "amt_vs_customer_median": F.col("amt") / (F.col("customer_amt_median") + 1),
        "amt_vs_customer_max": F.col("amt") / (F.col("customer_amt_max") + 1),
        "amt_zscore": (F.col("amt") - F.col("customer_amt_mean")) / (F.col("customer_amt_std") + 1),
    })


def merchant_stats(df: DataFrame) -> DataFrame:
    """Per merchant: fraud rate and count, amounts, and cards; cards are counted on distinct pairs, summed first per pair."""
    c = F.round(F.col("amt") * 100).cast("decimal(19,0)")
    pairs = df.where("merchant is not null").groupBy("merchant", CARD).agg(F.sum("is_fraud").alias("f"), F.count("is_fraud").alias("fn"), F.count("amt").alias("n"), F.sum(c).alias("s"), F.sum((c * c).cast("decimal(38,0)")).alias("q"))
    by = pairs.groupBy("merchant").agg(F.sum("f").alias("f"), F.sum("fn").alias("fn"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(CARD).alias("merchant_unique_cards"))
    return by.select(
        "merchant", F.try_divide(F.col("f").cast("double"), F.col("fn")).alias("merchant_fraud_rate"), F.col("f").cast("long").alias("merchant_fraud_count"),
        mean_of(F.col("n"), F.col("s")).alias("merchant_amt_mean"), stddev_of(F.col("n"), F.col("s"), F.col("q")).alias("merchant_amt_std"), "merchant_unique_cards",
    )


def merchant_risk(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Merchant statistics on each row; from other rows (before) where a label must not see itself."""
    df = df.join(merchant_stats(before if before is not None else df), "merchant", "left")
    return df.withColumns({"is_rare_merchant": flag(F.col("merchant_unique_cards") < 10), "amt_vs_merchant_mean": F.col("amt") / (F.col("merchant_amt_mean") + 1)})


def category_risk(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    rates = (before if before is not None else df).where("category is not null").groupBy("category").agg(F.try_divide(F.sum("is_fraud").cast("double"), F.count("is_fraud")).alias("category_fraud_rate"))
    return df.join(rates, "category", "left")


def time_features(df: DataFrame) -> DataFrame:
    t = F.col(TIME)
    df = df.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "day_of_month": F.dayofmonth(t), "month": F.month(t)})
    angle = 2 * PI * F.col("hour") / 24
    return df.withColumns({
        "is_weekend": flag(F.col("day_of_week").isin(5, 6)), "is_night": flag(F.col("hour").between(0, 6)), "is_high_risk_hour": flag(F.col("hour").between(2, 5)),
        "hour_sin": F.sin(angle), "hour_cos": F.cos(angle),
    })


def amount_patterns(df: DataFrame, before: Column | None = None) -> DataFrame:
    amt = F.col("amt")
    df = df.withColumn("prev_amt", F.lag("amt").over(_card()) if before is None else before)
    return df.withColumns({
        "is_round_amount": flag(F.pmod(amt, F.lit(10.0)) == 0), "is_whole_dollar": flag(amt == amt.cast("long")), "amt_log": F.log1p(amt),
        "amt_change_ratio": F.try_divide(amt, F.col("prev_amt") + 1), "is_increasing_amounts": flag(amt > F.col("prev_amt")),
        "is_high_risk_category": flag(F.lower("category").rlike("net|gas|transport")),
    })


def geo_velocity(df: DataFrame, before: tuple[Column, Column] | None = None) -> DataFrame:
    """Planar distance and speed from the card's last transaction; needs velocity()."""
    w = _card()
    lat, long = before or (F.lag("merch_lat").over(w), F.lag("merch_long").over(w))
    df = df.withColumns({"prev_lat": lat, "prev_long": long})
    a, b = F.col("merch_lat") - F.col("prev_lat"), F.col("merch_long") - F.col("prev_long")
    df = df.withColumn("distance_from_prev", F.coalesce(F.sqrt(a * a + b * b) * 111, F.lit(0.0)))
    df = df.withColumn("speed_kmh", F.try_divide(F.col("distance_from_prev"), F.col("seconds_since_last_trans") / 3600 + 0.001))
    return df.withColumn("impossible_speed", flag(F.col("speed_kmh") > 500))


def risk_scores(df: DataFrame) -> DataFrame:
    c = F.col
    df = df.withColumns({
        "velocity_risk": flag(c("daily_trans_count") > 5) + flag(c("daily_amount_sum") > 1000) + c("is_rapid_trans"),
        "merchant_risk": c("is_first_merchant_use") + c("is_rare_merchant") + flag(c("merchant_fraud_rate") > 0.01),
        "time_risk": c("is_night") + c("is_high_risk_hour") + c("is_weekend"),
        "amount_risk": flag(c("amt_zscore") > 3) + c("is_round_amount") + flag(c("amt_change_ratio") > 10),
    })
    return df.withColumn("total_risk_score", c("velocity_risk") + c("merchant_risk") + c("time_risk") + c("amount_risk") + c("is_high_risk_category"))


def by_card(df: DataFrame) -> DataFrame:
    """The features that follow from a card's other rows, and those of a row's own."""
    for step in (velocity, daily_velocity, first_merchant, customer_profile, amount_patterns, geo_velocity, time_features):
        df = step(df)
    return df


def engineered(df: DataFrame, stats_from: DataFrame | None = None, fill_text: bool = False, hot_rows: int | None = None) -> DataFrame:
    """All features, nulls filled with 0 last. stats_from: rows that merchant and category rates are learned from (all by default).

    hot_rows: cards with more rows are worked out in ranges of time (`hot_cards`), so that no task holds one; cards are counted first.
    """
    df = df.withColumn("amt", clean(F.col("amt").cast("double")))
    if hot_rows is None:
        df = by_card(df)
    else:
        from ledgerlens.operators.hot_cards import by_card_in_ranges

        df = by_card_in_ranges(df, hot_rows)
    df = risk_scores(category_risk(merchant_risk(df, stats_from), stats_from)).na.fill(0)
    return df.na.fill("0") if fill_text else df


def feature_columns(df: DataFrame, exclude: set[str] = EXCLUDED) -> list[str]:
    """Numeric columns that are not identifiers or the label."""
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
    return [c for c, kind in df.dtypes if c not in exclude and (kind in numeric or kind.startswith("decimal"))]


def dataset_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum("is_fraud").cast("long").alias("frauds"), F.try_divide(F.sum("is_fraud").cast("double"), F.count(F.lit(1))).alias("fraud_ratio")).withColumn("columns", F.lit(len(df.columns)).cast("long"))
