"""Features against a hand-computed table in which every awkward comparison occurs, and against themselves in another order."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import features as X
from ledgerlens.sources import tables as S

INF = float("inf")
ROWS = [
    ("T1", 1, "2024-01-05 23:59:30", "m1", "grocery_pos", 20.0, 40.0, -74.0, 0.0), ("T2", 1, "2024-01-06 00:00:00", "m1", "gas_transport", 7.25, 40.0, -74.0, None),
    ("T3", 1, "2024-01-06 00:00:59", "m2", "shopping_net", 1200.0, 43.0, -70.0, 1.0), ("T4", 1, "2024-01-06 03:00:59", "m2", "shopping_net", 30.5, 43.0, -70.0, INF),
    ("T5", 2, "2024-01-07 12:00:00", "m2", "food_dining", 50.0, 30.0, -90.0, 0.5), ("T6", 3, "2024-01-08 12:00:00", "m3", "food_dining", 10.0, 30.0, -90.0, 0.51), ("T7", 3, "2024-01-08 12:00:00", "m3", "misc_net", 200.0, 30.0, -90.0, -2.0),
]
GOLD = {
    "is_fraud": [0, 0, 1, 0, 0, 1, 0], "seconds_since_last_trans": [86400, 30, 59, 10800, 86400, 86400, 0], "is_rapid_trans": [0, 1, 1, 0, 0, 0, 1], "daily_trans_count": [1, 1, 2, 3, 1, 1, 2],
    "daily_amount_sum": [20, 7.25, 1207.25, 1237.75, 50, 10, 210], "daily_merchant_count": [1, 2, 2, 2, 1, 1, 1], "customer_amt_mean": [314.438] * 4 + [50, 105, 105], "customer_amt_median": [25.25] * 4 + [50, 105, 105],
    "customer_amt_std": [590.452] * 4 + [0, 134.35, 134.35], "amt_zscore": [-0.497822, -0.519379, 1.49727, -0.480069, 0, -0.701883, 0.701883], "is_first_merchant_use": [1, 0, 1, 0, 1, 1, 0],
    "merchant_fraud_rate": [0, 0, 0.333333, 0.333333, 0.333333, 0.5, 0.5], "category_fraud_rate": [0, 0, 0.5, 0.5, 0.5, 0.5, 0], "is_rare_merchant": [1] * 7, "is_weekend": [0, 1, 1, 1, 1, 0, 0], "is_night": [0, 1, 1, 1, 0, 0, 0],
    "is_high_risk_hour": [0, 0, 0, 1, 0, 0, 0], "is_round_amount": [1, 0, 1, 0, 1, 1, 1], "is_whole_dollar": [1, 0, 1, 0, 1, 1, 1], "prev_amt": [0, 20, 7.25, 1200, 0, 0, 10], "amt_change_ratio": [0, 0.345238, 145.455, 0.0253955, 0, 0, 18.1818],
    "is_increasing_amounts": [0, 0, 1, 0, 0, 0, 1], "is_high_risk_category": [0, 1, 1, 1, 0, 0, 1], "distance_from_prev": [0, 0, 555, 0, 0, 0, 0], "speed_kmh": [0, 0, 31916.9, 0, 0, 0, 0], "impossible_speed": [0, 0, 1, 0, 0, 0, 0],
    "velocity_risk": [0, 1, 2, 1, 0, 0, 1], "merchant_risk": [2, 1, 3, 2, 3, 3, 2], "time_risk": [0, 2, 2, 3, 1, 0, 0], "amount_risk": [1, 0, 2, 0, 1, 1, 2], "total_risk_score": [3, 5, 10, 7, 5, 4, 6],
}


@pytest.fixture(scope="module")
def raw(spark):
    kinds = "trans_num string, cc_num long, t string, merchant string, category string, amt double, merch_lat double, merch_long double, raw double"
    df = spark.createDataFrame(ROWS, kinds).withColumn("trans_date_trans_time", F.col("t").cast("timestamp_ntz"))
    return df.withColumn("is_fraud", S.clean_label(F.col("raw"))).drop("t", "raw")


def test_every_feature_of_the_hand_computed_table(spark, raw):
    want = {r[0]: i for i, r in enumerate(ROWS)}
    for df in (raw, raw.orderBy(F.desc("trans_num")).repartition(3)):  # the order of input rows doesn't matter
        for r in X.engineered(df).collect():
            for c, values in GOLD.items():
                assert r[c] == pytest.approx(values[want[r.trans_num]], rel=1e-5, abs=1e-9), (r.trans_num, c)


def test_nulls_and_nan_raise_no_flags(spark, raw):
    odd = raw.limit(1).withColumn("amt", F.lit(float("nan"))).withColumn("merchant", F.lit(None).cast("string")).withColumn("category", F.lit(None).cast("string"))
    r = X.engineered(odd).first()
    assert (r.is_round_amount, r.is_increasing_amounts, r.merchant_fraud_rate, r.customer_merchant_nunique, r.is_high_risk_category, r.daily_merchant_count) == (0, 0, 0, 0, 0, 0)


def test_statistics_can_come_from_other_rows(spark, raw):
    done = {r.trans_num: r for r in X.engineered(raw, stats_from=raw.where("trans_num <> 'T3'")).collect()}
    assert done["T4"].merchant_fraud_rate == 0 and done["T3"].category_fraud_rate == 0


def test_joins_and_fallbacks(spark, raw):
    labels = spark.createDataFrame([("T1", 1)], "trans_num string, is_fraud int")
    assert {r.trans_num: r.is_fraud for r in X.join_labels(raw, labels).collect()} == {f"T{i}": int(i == 1) for i in range(1, 8)}
    assert X.join_labels(raw, None).agg(F.sum("is_fraud")).first()[0] == 0
    assert 300 < X.join_labels(spark.range(10_000).withColumnRenamed("id", "trans_num"), None, "random_5").agg(F.sum("is_fraud")).first()[0] < 700
    people = spark.createDataFrame([(1, "a", "zzz"), (1, "b", "zzz")], "cc_num long, first string, category string")
    done = X.join_customers(raw, people)
    assert done.count() == 11 and done.columns.count("category") == 1  # as many rows as keys match; a transaction's own column stays
    assert "amt" in X.feature_columns(X.engineered(raw)) and "cc_num" not in X.feature_columns(X.engineered(raw))
    assert X.dataset_summary(raw).first().frauds == 2


def test_cards_are_shuffled_once(spark, raw):
    plan = X.geo_velocity(X.amount_patterns(X.customer_profile(X.first_merchant(X.daily_velocity(X.velocity(raw))))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cc_num") == 1 and "Python" not in plan


def test_sources(spark, tmp_path, raw):
    assert S.load_transactions(spark, f"{tmp_path}/none.parquet").count() == 0 and S.load_customers(spark, f"{tmp_path}/none.csv").count() == 0 and S.load_labels(spark, f"{tmp_path}/none.json").count() == 0
    raw.drop("merch_lat", "merch_long").write.parquet(f"{tmp_path}/my_transactions.parquet")
    found = S.find_source(spark, str(tmp_path), "transaction", (".parquet", ".csv"))
    df = S.load_transactions(spark, found)
    assert {r.merch_lat for r in df.collect()} == {40.7128} and df.where("trans_num = 'T1'").first().unix_time == int(datetime(2024, 1, 5, 23, 59, 30).timestamp() - datetime(1970, 1, 1).timestamp())
    (tmp_path / "customers.csv").write_text("credit_card_number,city\n5,Rome\n")
    r = S.load_customers(spark, f"{tmp_path}/customers.csv").first()
    assert (r.cc_num, r.city, r.zip, r.city_pop) == (5, "Rome", "00000", 100000)
    (tmp_path / "fraud.json").write_text('{"a": 1, "b": 0.5, "c": 1.5, "d": NaN, "e": Infinity, "f": null, "g": -3, "h": 7}')
    assert {r.trans_num: r.is_fraud for r in S.load_labels(spark, f"{tmp_path}/fraud.json").collect()} == {"a": 1, "b": 0, "c": 1, "d": 0, "e": 0, "f": 0, "g": 0, "h": 1}
    files = S.dataset_paths(spark, f"{tmp_path}/*.csv")
    assert files.count() == 1 and S.newest_and_oldest(files).first().newest.endswith("customers.csv")
    assert S.request_row(spark, '{"amt": 3.5, "cc_num": "9"}', "array<struct<amt:double,cc_num:string>>".removeprefix("array<").removesuffix(">")).first().amt == 3.5


def test_made_up_tables(spark):
    people = S.sample_customers(spark)
    trades = S.sample_transactions(people).cache()
    assert people.count() == 100 and trades.count() == 1000 and trades.join(people, "cc_num", "left_anti").count() == 0
    assert 10 < S.sample_labels(trades).agg(F.sum("is_fraud")).first()[0] < 110
    f = S.synthetic_features(spark, 500)
    assert f.count() == 500 and len([c for c in f.columns if c.startswith("feature_")]) == 57
