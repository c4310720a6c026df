"""Registered queries over the bundled tables, and the same results in DuckDB SQL.

events are read as card transactions and as logs. Doubles agree to the last
bit where sums are exact (cents); results of transcendental functions and of
plain double sums are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import boosting as B
from ledgerlens.operators import drift as D
from ledgerlens.operators import evaluation as E
from ledgerlens.operators import features as X
from ledgerlens.operators import learning as M
from ledgerlens.operators import logs as L
from ledgerlens.sources import tables as S
from ledgerlens.sources.scratch import Scratch, shared_folder
from ledgerlens.streaming import monitor

AS_OF, DAY, SPLIT = "2024-01-29 12:00:00", "2024-01-15", "2024-01-16"
THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
NUMERIC, CATEGORICAL = ["amt", "merchant", "merch_lat", "merch_long", "hour"], ["category", "daypart"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# -- SQL views that the oracles share ----------------------------------------------------------
TX = """tx AS (
  SELECT *, 25 + ((merchant * 7) % 100) / 4.0::DOUBLE AS merch_lat, -125 + ((merchant * 13) % 100) / 2.0::DOUBLE AS merch_long,
         CASE WHEN amt >= 100 AND merchant % 4 = 0 THEN 1 ELSE 0 END AS is_fraud, CAST(round(amt * 100) AS BIGINT) AS c
  FROM (SELECT event_id AS trans_num, ts, user_id AS cc_num, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS merchant, value AS amt,
               CASE event_type WHEN 'purchase' THEN 'shopping_net' WHEN 'view' THEN 'gas_transport' WHEN 'click' THEN 'grocery_pos' WHEN 'signup' THEN 'food_dining' ELSE 'entertainment' END AS category
        FROM events))"""
FEATURES = f"""{TX},
v AS (
  SELECT *, CAST(ts AS DATE) AS date, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER card)) / 1e6::DOUBLE, 86400.0::DOUBLE) AS seconds_since_last_trans,
         lag(amt) OVER card AS prev_amt, lag(merch_lat) OVER card AS prev_lat, lag(merch_long) OVER card AS prev_long,
         row_number() OVER (PARTITION BY cc_num, merchant ORDER BY ts, trans_num) - 1 AS merchant_use_count,
         row_number() OVER (PARTITION BY cc_num, CAST(ts AS DATE) ORDER BY ts, trans_num) AS daily_trans_count,
         sum(amt) OVER (PARTITION BY cc_num, CAST(ts AS DATE) ORDER BY ts, trans_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS daily_amount_sum
  FROM tx WINDOW card AS (PARTITION BY cc_num ORDER BY ts, trans_num)),
dm AS (SELECT cc_num, date, count(DISTINCT merchant) AS daily_merchant_count FROM v GROUP BY 1, 2),
cs AS (
  SELECT cc_num, sum(c)::DOUBLE / count(c)::DOUBLE / 100 AS customer_amt_mean, median(c) / 100 AS customer_amt_median,
         CASE WHEN count(c) > 1 THEN sqrt((count(c)::HUGEINT * sum(c::HUGEINT * c) - sum(c)::HUGEINT * sum(c))::DOUBLE / (count(c)::DOUBLE * (count(c) - 1))) END / 100 AS customer_amt_std,
         min(amt) AS customer_amt_min, max(amt) AS customer_amt_max, count(DISTINCT merchant) AS customer_merchant_nunique, count(DISTINCT category) AS customer_category_nunique
  FROM tx GROUP BY 1),
ms AS (
  SELECT merchant, sum(is_fraud)::DOUBLE / count(is_fraud) AS merchant_fraud_rate, sum(is_fraud)::BIGINT AS merchant_fraud_count, sum(c)::DOUBLE / count(c)::DOUBLE / 100 AS merchant_amt_mean,
         CASE WHEN count(c) > 1 THEN sqrt((count(c)::HUGEINT * sum(c::HUGEINT * c) - sum(c)::HUGEINT * sum(c))::DOUBLE / (count(c)::DOUBLE * (count(c) - 1))) END / 100 AS merchant_amt_std,
         count(DISTINCT cc_num) AS merchant_unique_cards
  FROM tx GROUP BY 1),
gs AS (SELECT category, sum(is_fraud)::DOUBLE / count(is_fraud) AS category_fraud_rate FROM tx GROUP BY 1),
f0 AS (
  SELECT *, amt / (customer_amt_median + 1) AS amt_vs_customer_median, amt / (customer_amt_max + 1) AS amt_vs_customer_max, (amt - customer_amt_mean) / (customer_amt_std + 1) AS amt_zscore,
         CASE WHEN merchant_use_count = 0 THEN 1 ELSE 0 END AS is_first_merchant_use, CASE WHEN merchant_unique_cards < 10 THEN 1 ELSE 0 END AS is_rare_merchant, amt / (merchant_amt_mean + 1) AS amt_vs_merchant_mean,
         CASE WHEN seconds_since_last_trans < 60 THEN 1 ELSE 0 END AS is_rapid_trans,
         hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week, day(ts)::INT AS day_of_month, month(ts)::INT AS month,
         CASE WHEN amt % 10 = 0 THEN 1 ELSE 0 END AS is_round_amount, CASE WHEN amt = trunc(amt) THEN 1 ELSE 0 END AS is_whole_dollar, ln(1 + amt) AS amt_log,
         amt / (prev_amt + 1) AS amt_change_ratio, CASE WHEN amt > prev_amt THEN 1 ELSE 0 END AS is_increasing_amounts,
         CASE WHEN regexp_matches(lower(category), 'net|gas|transport') THEN 1 ELSE 0 END AS is_high_risk_category,
         coalesce(sqrt((merch_lat - prev_lat) * (merch_lat - prev_lat) + (merch_long - prev_long) * (merch_long - prev_long)) * 111, 0.0::DOUBLE) AS distance_from_prev
  FROM v LEFT JOIN dm USING (cc_num, date) LEFT JOIN cs USING (cc_num) LEFT JOIN ms USING (merchant) LEFT JOIN gs USING (category)),
f1 AS (
  SELECT *, CASE WHEN day_of_week IN (5, 6) THEN 1 ELSE 0 END AS is_weekend, CASE WHEN hour BETWEEN 0 AND 6 THEN 1 ELSE 0 END AS is_night, CASE WHEN hour BETWEEN 2 AND 5 THEN 1 ELSE 0 END AS is_high_risk_hour,
         sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos, distance_from_prev / (seconds_since_last_trans / 3600 + 0.001::DOUBLE) AS speed_kmh
  FROM f0),
f2 AS (
  SELECT *, CASE WHEN speed_kmh > 500 THEN 1 ELSE 0 END AS impossible_speed,
         CASE WHEN daily_trans_count > 5 THEN 1 ELSE 0 END + CASE WHEN daily_amount_sum > 1000 THEN 1 ELSE 0 END + is_rapid_trans AS velocity_risk,
         is_first_merchant_use + is_rare_merchant + CASE WHEN merchant_fraud_rate > 0.01 THEN 1 ELSE 0 END AS merchant_risk,
         is_night + is_high_risk_hour + is_weekend AS time_risk,
         CASE WHEN amt_zscore > 3 THEN 1 ELSE 0 END + is_round_amount + CASE WHEN amt_change_ratio > 10 THEN 1 ELSE 0 END AS amount_risk
  FROM f1),
feat AS (SELECT *, velocity_risk + merchant_risk + time_risk + amount_risk + is_high_risk_category AS total_risk_score FROM f2),
scored AS (SELECT trans_num, is_fraud, amt, total_risk_score / 13.0::DOUBLE AS score FROM feat)"""
LOGS = """logs AS (
  SELECT event_id AS id, ts, CASE WHEN event_type = 'error' THEN 'system_error' WHEN event_type IN ('purchase', 'view') THEN 'prediction_request' WHEN event_type = 'click' THEN 'dataset_creation' ELSE 'model_training' END AS event_type,
         CASE WHEN event_type = 'error' THEN NULL WHEN event_type IN ('purchase', 'view') THEN '/predict' WHEN event_type = 'click' THEN '/create_dataset' ELSE '/train_model' END AS endpoint,
         CASE WHEN event_type IN ('purchase', 'view', 'click') THEN value END AS t, CASE event_type WHEN 'purchase' THEN 'fraudulent' WHEN 'view' THEN 'legitimate' END AS prediction,
         CASE WHEN event_type = 'signup' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 100.0::DOUBLE END AS "precision", CASE WHEN event_type = 'signup' THEN value / 500 END AS recall
  FROM events)"""
METRICS = """count(*) AS total_events, coalesce(sum(CAST(round(t * 1000) AS BIGINT))::DOUBLE / count(t) / 1000, 0) AS avg_seconds, coalesce(max(t), 0) AS max_seconds, coalesce(min(t), 0) AS min_seconds, count(t) AS timed,
  count(*) FILTER (event_type = 'system_error') AS errors, count(*) FILTER (event_type = 'system_error') * 100.0::DOUBLE / count(*) AS error_rate,
  count(*) FILTER (prediction = 'fraudulent') AS fraudulent, count(*) FILTER (prediction = 'legitimate') AS legitimate,
  coalesce(count(*) FILTER (prediction = 'fraudulent') * 100.0::DOUBLE / nullif(count(*) FILTER (prediction IN ('fraudulent', 'legitimate')), 0), 0) AS fraud_rate"""
SIDES = f"""{TX},
h AS (SELECT *, hour(ts) AS hour, CASE WHEN hour(ts) < 12 THEN 'am' WHEN ts >= '2024-01-25' THEN 'late' ELSE 'pm' END AS daypart FROM tx),
num AS (SELECT feature, value, (ts < '{SPLIT}')::INT AS a, (ts >= '{SPLIT}')::INT AS b FROM
  (SELECT ts, unnest(['amt', 'merchant', 'merch_lat', 'merch_long', 'hour']) AS feature, unnest([amt, merchant::DOUBLE, merch_lat, merch_long, hour::DOUBLE]) AS value FROM h)),
cat AS (SELECT feature, value, (ts < '{SPLIT}')::INT AS a, (ts >= '{SPLIT}')::INT AS b FROM (SELECT ts, unnest(['category', 'daypart']) AS feature, unnest([category, daypart]) AS value FROM h)),
nv AS (SELECT feature, value, sum(a) AS a, sum(b) AS b FROM num GROUP BY 1, 2),
ks AS (SELECT feature, max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS statistic, any_value(na) AS n_base, any_value(nb) AS n_other FROM
  (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb FROM nv WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1),
ksp AS (SELECT *, CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0::DOUBLE * k * k * lam * lam))))) END AS p_value
  FROM (SELECT *, statistic * sqrt(n_base::DOUBLE * n_other / (n_base + n_other)) AS lam FROM ks)),
cv AS (SELECT feature, value, sum(a) AS a, sum(b) AS b FROM cat GROUP BY 1, 2),
chi AS (SELECT feature, sum((o - e) * (o - e) / e) AS statistic, count(*) AS k FROM
  (SELECT feature, a::DOUBLE / sum(a) OVER (PARTITION BY feature) * sum(b) OVER (PARTITION BY feature) + 1e-8 AS e, b + 1e-8 AS o FROM cv) GROUP BY 1)"""

ERFC = "(t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x))"
RANKS = f"""rk AS (SELECT feature, a, b, a + b AS t, coalesce(sum(a + b) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nv),
 s AS (SELECT feature, sum(a * (before + (t + 1) / 2.0::DOUBLE)) AS r, sum(a)::DOUBLE AS n, sum(b)::DOUBLE AS m, sum(t * t * t - t)::DOUBLE AS ties FROM rk GROUP BY 1),
 mz AS (SELECT feature, r - n * (n + 1) / 2 AS u, greatest(abs(r - n * (n + 1) / 2 - n * m / 2) - 0.5::DOUBLE, 0) / sqrt(n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1)))) AS z FROM s),
 mw AS (SELECT feature, u, z, {ERFC} AS p FROM (SELECT feature, u, z, z / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * (z / sqrt(2.0::DOUBLE))) AS t FROM mz))"""
#: The numbers of categories are odd here, so the tail is a finite sum.
CHI_P = "exp(-statistic / 2) * list_sum(list_transform(range(0, ((k - 1) // 2)::BIGINT), lambda i: (statistic / 2) ** i / gamma(i + 1)))"
DRIFT = f"""{SIDES}, {RANKS},
 mom AS (SELECT feature, avg(value) FILTER (a = 1) AS m0, avg(value) FILTER (b = 1) AS m1, stddev_samp(value) FILTER (a = 1) AS s0, stddev_samp(value) FILTER (b = 1) AS s1 FROM num GROUP BY 1),
 ninfo AS (SELECT feature, p_value < 0.05 AS drift_detected, statistic, p_value,
   CASE WHEN p < 0.05 THEN printf('Distribution shift detected (MW p=%.4f). ', p) ELSE '' END || CASE WHEN abs(m1 - m0) / (s0 + 1e-8) > 2 THEN printf('Significant mean shift: %.2f std devs. ', abs(m1 - m0) / (s0 + 1e-8)) ELSE '' END
   || CASE WHEN s1 / (s0 + 1e-8) > 2 OR s1 / (s0 + 1e-8) < 0.5 THEN printf('Variance change detected: %.2fx baseline. ', s1 / (s0 + 1e-8)) ELSE '' END AS info FROM ksp JOIN mw USING (feature) JOIN mom USING (feature)),
 newc AS (SELECT feature, array_to_string(list_sort(list(value))[1:5], ', ') AS new FROM cv WHERE a = 0 GROUP BY 1),
 fd AS (SELECT feature, drift_detected, statistic AS drift_score, 'distributional' AS drift_type, statistic AS test_statistic, p_value,
   CASE WHEN NOT drift_detected THEN 'No significant drift detected.' WHEN statistic > 0.3 THEN 'High drift detected. ' || info || 'Consider immediate model retraining.' WHEN statistic > 0.15 THEN 'Moderate drift detected. ' || info || 'Schedule model validation.' ELSE 'Low drift detected. ' || info || 'Monitor closely.' END AS recommendation FROM ninfo
  UNION ALL SELECT feature, p < 0.05, 1 - p, 'categorical', statistic, p, CASE WHEN new IS NOT NULL THEN 'New categories detected: ' || new || '. Consider retraining.' WHEN p < 0.05 THEN 'Monitor category distribution changes' ELSE 'No action needed' END
   FROM (SELECT *, {CHI_P} AS p FROM chi LEFT JOIN newc USING (feature)))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def wide(spark, d):
    return X.engineered(S.transactions(spark, d))


def scored(spark, d):
    return wide(spark, d).select("trans_num", "is_fraud", "amt", (F.col("total_risk_score") / 13.0).alias("score"))


def sides(spark, d):
    t = F.col("trans_date_trans_time")
    rows = S.transactions(spark, d).withColumn("hour", F.hour(t)).withColumn("daypart", F.when(F.hour(t) < 12, "am").when(t >= L.at("2024-01-25 00:00:00"), "late").otherwise("pm"))
    return rows.where(t < L.at(f"{SPLIT} 00:00:00")), rows.where(t >= L.at(f"{SPLIT} 00:00:00"))


def some(name: str, columns: str, source: str = "feat", base: str = FEATURES):
    """SQL that selects columns of a shared view."""
    return f"WITH {base} SELECT {columns} FROM {source}"


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


# -- sources and joins -------------------------------------------------------------------------
@query(f"WITH {TX} SELECT trans_num, ts AS trans_date_trans_time, cc_num, merchant, category, amt, merch_lat, merch_long, is_fraud, epoch_us(ts) // 1000000 AS unix_time FROM tx")
def scan_transactions(spark, d):
    return S.complete_transactions(S.transactions(spark, d))


@query("SELECT c_custkey AS cc_num, c_name AS first, n_name AS state, c_acctbal AS balance, c_mktsegment AS job, 'U' AS gender, 'Unknown' AS city, '00000' AS zip, '1970-01-01' AS dob, 100000 AS city_pop FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def customer_defaults(spark, d):
    return S.complete_customers(S.customers(spark, d))


@query("SELECT doc_id AS trans_num, CASE WHEN quality IS NULL THEN 0 ELSE least(greatest(round_even(quality * 1.5 - 0.5, 0), 0), 1)::INT END AS is_fraud FROM labels")
def label_sanitize(spark, d):
    return S.table(spark, d, "labels").select(F.col("doc_id").alias("trans_num"), S.clean_label(F.col("quality") * 1.5 - 0.5).alias("is_fraud"))


@query(f"WITH {TX} SELECT t.trans_num, t.amt, coalesce(l.quality, 0) AS is_fraud FROM tx t LEFT JOIN labels l ON t.trans_num = l.doc_id")
def join_labels(spark, d):
    labels = S.table(spark, d, "labels").select(F.col("doc_id").alias("trans_num"), F.col("quality").alias("is_fraud"))
    return X.join_labels(S.transactions(spark, d), labels).select("trans_num", "amt", "is_fraud")


@query(f"WITH {TX} SELECT trans_num, cc_num, c_name AS first, n_name AS state, c_acctbal AS balance, c_mktsegment AS job FROM tx LEFT JOIN customer ON cc_num = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_customers(spark, d):
    return X.join_customers(S.transactions(spark, d), S.customers(spark, d)).select("trans_num", "cc_num", "first", "state", "balance", "job")


# -- features ----------------------------------------------------------------------------------
@query(some("velocity", "trans_num, seconds_since_last_trans, is_rapid_trans"))
def velocity(spark, d):
    return X.velocity(S.transactions(spark, d)).select("trans_num", "seconds_since_last_trans", "is_rapid_trans")


@query(some("daily", "trans_num, daily_trans_count, daily_amount_sum, daily_merchant_count"))
def daily_velocity(spark, d):
    return X.daily_velocity(S.transactions(spark, d)).select("trans_num", "daily_trans_count", "daily_amount_sum", "daily_merchant_count")


PROFILE = ["customer_amt_mean", "customer_amt_median", "customer_amt_std", "customer_amt_min", "customer_amt_max", "customer_merchant_nunique", "customer_category_nunique", "amt_vs_customer_median", "amt_vs_customer_max", "amt_zscore"]


@query(some("profile", "trans_num, " + ", ".join(PROFILE)))
def customer_profile(spark, d):
    return X.customer_profile(S.transactions(spark, d)).select("trans_num", *PROFILE)


@query(some("first", "trans_num, merchant_use_count, is_first_merchant_use"))
def first_merchant(spark, d):
    return X.first_merchant(S.transactions(spark, d)).select("trans_num", "merchant_use_count", "is_first_merchant_use")


MERCHANT = ["merchant_fraud_rate", "merchant_fraud_count", "merchant_amt_mean", "merchant_amt_std", "merchant_unique_cards", "is_rare_merchant", "amt_vs_merchant_mean"]


@query(some("merchant", "trans_num, " + ", ".join(MERCHANT)))
def merchant_risk(spark, d):
    return X.merchant_risk(S.transactions(spark, d)).select("trans_num", *MERCHANT)


@query(some("category", "trans_num, category_fraud_rate"))
def category_risk(spark, d):
    return X.category_risk(S.transactions(spark, d)).select("trans_num", "category_fraud_rate")


TIMES = ["hour", "day_of_week", "day_of_month", "month", "is_weekend", "is_night", "is_high_risk_hour"]


@query(some("time", "trans_num, " + ", ".join(TIMES) + ", round(hour_sin, 6) + 0 AS hour_sin, round(hour_cos, 6) + 0 AS hour_cos"))
def time_features(spark, d):
    return X.time_features(S.transactions(spark, d)).select("trans_num", *TIMES, *six("hour_sin", "hour_cos"))


AMOUNTS = ["is_round_amount", "is_whole_dollar", "prev_amt", "amt_change_ratio", "is_increasing_amounts", "is_high_risk_category"]


@query(some("amount", "trans_num, " + ", ".join(AMOUNTS) + ", round(amt_log, 6) AS amt_log"))
def amount_patterns(spark, d):
    return X.amount_patterns(S.transactions(spark, d)).select("trans_num", *AMOUNTS, *six("amt_log"))


GEO = ["prev_lat", "prev_long", "distance_from_prev", "speed_kmh", "impossible_speed"]


@query(some("geo", "trans_num, " + ", ".join(GEO)))
def geo_velocity(spark, d):
    return X.geo_velocity(X.velocity(S.transactions(spark, d))).select("trans_num", *GEO)


RISKS = ["velocity_risk", "merchant_risk", "time_risk", "amount_risk", "total_risk_score"]


@query(some("risk", "trans_num, " + ", ".join(RISKS)))
def risk_scores(spark, d):
    return wide(spark, d).select("trans_num", *RISKS)


FULL = ["seconds_since_last_trans", "is_rapid_trans", "daily_trans_count", "daily_amount_sum", "daily_merchant_count", *PROFILE, "merchant_use_count", "is_first_merchant_use", *MERCHANT, "category_fraud_rate", *TIMES, *AMOUNTS, *GEO, *RISKS]


@query(f"WITH {FEATURES} SELECT trans_num, is_fraud, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in FULL) + ", round(hour_sin, 6) + 0 AS hour_sin, round(hour_cos, 6) + 0 AS hour_cos, round(amt_log, 6) AS amt_log FROM feat")
def engineered_full(spark, d):
    return wide(spark, d).select("trans_num", "is_fraud", *FULL, *six("hour_sin", "hour_cos", "amt_log"))


#: Fixed: the numeric columns of the engineered table, in order.
SCHEMA = [
    "amt", "merch_lat", "merch_long", "seconds_since_last_trans", "is_rapid_trans", "daily_trans_count", "daily_amount_sum", "daily_merchant_count",
    "merchant_use_count", "is_first_merchant_use", "customer_amt_mean", "customer_amt_median", "customer_amt_std", "customer_amt_min", "customer_amt_max",
    "customer_merchant_nunique", "customer_category_nunique", "amt_vs_customer_median", "amt_vs_customer_max", "amt_zscore", "prev_amt", "is_round_amount",
    "is_whole_dollar", "amt_log", "amt_change_ratio", "is_increasing_amounts", "is_high_risk_category", "prev_lat", "prev_long", "distance_from_prev", "speed_kmh",
    "impossible_speed", "hour", "day_of_week", "day_of_month", "month", "is_weekend", "is_night", "is_high_risk_hour", "hour_sin", "hour_cos", "merchant_fraud_rate",
    "merchant_fraud_count", "merchant_amt_mean", "merchant_amt_std", "merchant_unique_cards", "is_rare_merchant", "amt_vs_merchant_mean", "category_fraud_rate",
    "velocity_risk", "merchant_risk", "time_risk", "amount_risk", "total_risk_score",
]


@query("SELECT (row_number() OVER () - 1)::INT AS place, feature FROM (SELECT unnest(" + str(SCHEMA) + ") AS feature)")
def feature_schema(spark, d):
    return spark.createDataFrame([(i, c) for i, c in enumerate(X.feature_columns(wide(spark, d)))], "place int, feature string")


@query(f"WITH {TX} SELECT count(*) AS rows, sum(is_fraud)::BIGINT AS frauds, sum(is_fraud)::DOUBLE / count(*) AS fraud_ratio, 9::BIGINT AS columns FROM tx")
def dataset_summary(spark, d):
    return X.dataset_summary(S.transactions(spark, d))


@query("SELECT l_suppkey AS merchant, sum(f)::DOUBLE / count(*) AS merchant_fraud_rate, sum(f)::BIGINT AS merchant_fraud_count, count(DISTINCT o_custkey) AS merchant_unique_cards FROM (SELECT l_suppkey, o_custkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
def merchant_stats_lineitem(spark, d):
    rows = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("l_suppkey").alias("merchant"), F.col("o_custkey").alias("cc_num"), F.col("l_extendedprice").alias("amt"), (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"))
    return X.merchant_stats(rows).select("merchant", "merchant_fraud_rate", "merchant_fraud_count", "merchant_unique_cards")


# -- evaluation --------------------------------------------------------------------------------
@query(f"WITH {TX}, r AS (SELECT trans_num, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(trans_num || '-42'), trans_num) AS k, count(*) OVER (PARTITION BY is_fraud) AS n FROM tx) SELECT trans_num, is_fraud, k <= round_even(0.2 * n, 0) AS is_test FROM r")
def stratified_split(spark, d):
    return E.stratified_split(S.transactions(spark, d).select("trans_num", "is_fraud"), "trans_num", "is_fraud")


@query(f"WITH {TX} SELECT trans_num, amt FROM tx ORDER BY md5(trans_num || '-42'), trans_num LIMIT 500")
def sample_n(spark, d):
    return E.sample_n(S.transactions(spark, d).select("trans_num", "amt"), "trans_num", 500)


@query(f"WITH {TX}, m AS (SELECT count(c)::HUGEINT AS n, sum(c)::HUGEINT AS s, sum(c::HUGEINT * c) AS q FROM tx) SELECT trans_num, (c * n - s)::DOUBLE / sqrt((n * q - s * s)::DOUBLE) AS amt_scaled FROM tx, m")
def standardize(spark, d):
    return E.standardize_money(S.transactions(spark, d), "amt").select("trans_num", "amt_scaled")


@query(f"WITH {TX} SELECT trans_num, amt, merch_lat, merch_long, 0::DOUBLE AS amt_zscore, 0::DOUBLE AS category_encoded FROM tx")
def score_default_fill(spark, d):
    return E.default_fill(S.transactions(spark, d), ["amt", "merch_lat", "merch_long", "amt_zscore", "category_encoded"])


@query(f"WITH {FEATURES} SELECT trans_num, score, CASE WHEN score > 0.5 THEN 'fraudulent' ELSE 'legitimate' END AS prediction, CASE WHEN score > 0.5 THEN score ELSE 1 - score END AS confidence FROM scored")
def score_decision(spark, d):
    return E.decide(scored(spark, d).select("trans_num", "score"), "score")


def _rates(source: str, more: str = "") -> str:
    return f"""SELECT {more} tp, fp, fn, tn, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
      coalesce(2 * coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) * coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) / nullif(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) + coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 0), 0) AS f1,
      coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0) AS accuracy FROM {source}"""


COUNTS = "count(*) FILTER (is_fraud = 1 AND score >= t) AS tp, count(*) FILTER (is_fraud <> 1 AND score >= t) AS fp, count(*) FILTER (is_fraud = 1 AND score < t) AS fn, count(*) FILTER (is_fraud <> 1 AND score < t) AS tn"


@query(f"WITH {FEATURES}, n AS (SELECT {COUNTS} FROM scored, (SELECT 0.4::DOUBLE AS t)) " + _rates("n"))
def confusion_metrics(spark, d):
    return E.confusion(scored(spark, d), "is_fraud", "score", 0.4)


SWEEP = f"WITH {FEATURES}, n AS (SELECT t AS threshold, {COUNTS} FROM scored, (SELECT unnest({THRESHOLDS})::DOUBLE AS t) GROUP BY 1), sweep AS ({_rates('n', 'threshold,')})"


@query(SWEEP + " SELECT * FROM sweep")
def threshold_sweep(spark, d):
    return E.threshold_sweep(scored(spark, d), "is_fraud", "score", THRESHOLDS)


@query(SWEEP + " SELECT *, f1 AS objective FROM sweep ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return E.best_threshold(threshold_sweep(spark, d))


CURVE = f"WITH {FEATURES}, n AS (SELECT t AS threshold, {COUNTS} FROM scored, (SELECT DISTINCT score AS t FROM scored) GROUP BY 1), r AS ({_rates('n', 'threshold,')}), curve AS (SELECT threshold, \"precision\", recall, f1 FROM r)"


@query(CURVE + " SELECT * FROM curve")
def pr_curve(spark, d):
    return E.pr_curve(scored(spark, d), "is_fraud", "score")


@query(CURVE + " SELECT min(CASE WHEN \"precision\" >= 0.05 AND recall >= 0.3 THEN threshold END) AS threshold FROM curve")
def optimal_threshold(spark, d):
    return E.optimal_threshold(pr_curve(spark, d), 0.05, 0.3)


@query(SWEEP + ' SELECT *, "precision" >= 0.7 AND recall >= 0.7 AS meets, "precision" >= 0.7 - 0.02::DOUBLE AND recall >= 0.7 AS close, "precision" >= 0.7 - 0.05::DOUBLE AND recall >= 0.7 - 0.05::DOUBLE AS near FROM sweep')
def requirement_gate(spark, d):
    return E.requirement_gate(threshold_sweep(spark, d))


# -- drift -------------------------------------------------------------------------------------
@query(f"WITH {TX} SELECT * FROM (SELECT unnest(['trans_num', 'cc_num', 'merchant', 'amt', 'merch_lat', 'merch_long', 'is_fraud']) AS feature, 'numeric' AS kind, NULL::BIGINT AS n_values UNION ALL SELECT 'category', 'categorical', count(DISTINCT category) FROM tx)")
def monitored_features(spark, d):
    return D.monitored_features(S.transactions(spark, d))


@query(f"WITH {SIDES} SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, median(value) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, min(value) AS min, max(value) AS max FROM num WHERE a = 1 GROUP BY 1")
def baseline_profile(spark, d):
    return D.profile(sides(spark, d)[0], NUMERIC).select("feature", "n", *six("mean", "std"), "median", *six("q25", "q75"), "min", "max")


@query(f"WITH {TX} SELECT category AS value, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM tx GROUP BY 1")
def category_freq(spark, d):
    return D.frequencies(S.transactions(spark, d), "category")


@query("SELECT quality AS value, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def label_distribution(spark, d):
    return D.frequencies(S.table(spark, d, "labels"), "quality")


@query(f"WITH {TX}, q AS (SELECT count(*) AS labels, avg(quality) AS label_rate, count(*) FILTER (quality = 0) / count(quality)::DOUBLE AS legitimate, count(*) FILTER (quality = 1) / count(quality)::DOUBLE AS fraudulent FROM labels) SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM customer) AS customers, labels, legitimate, fraudulent, label_rate, 'success' AS status FROM q")
def data_quality(spark, d):
    labels = S.table(spark, d, "labels").select(F.col("doc_id").alias("trans_num"), F.col("quality").alias("is_fraud"))
    return S.quality_summary(S.transactions(spark, d), S.table(spark, d, "customer"), labels).drop("error")


@query("SELECT 'k' AS \"column\", count(*) FILTER (x IS NULL) AS nulls, count(*) FILTER (isinf(x)) AS infinities FROM (SELECT CASE WHEN event_type = 'click' THEN NULL WHEN value > 100 THEN 'infinity'::DOUBLE ELSE value END AS x FROM events) UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL), 0 FROM events")
def unusable_values(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    rows = S.table(spark, d, "events").select(F.when(kind == "click", None).when(value > 100, float("inf")).otherwise(value).alias("k"), "event_type")
    return S.unusable_counts(rows)


@query(f"WITH {SIDES} SELECT feature, statistic, n_base::BIGINT AS n_base, n_other::BIGINT AS n_other, round(p_value, 6) AS p_value FROM ksp")
def drift_ks(spark, d):
    return D.ks(*sides(spark, d), NUMERIC).select("feature", "statistic", "n_base", "n_other", *six("p_value"))


@query(f"WITH {SIDES}, {RANKS} SELECT feature, u, round(z, 6) AS z, round(p, 6) AS p_value FROM mw")
def drift_mann_whitney(spark, d):
    return D.mann_whitney(*sides(spark, d), NUMERIC).select("feature", "u", *six("z", "p_value"))


@query(f"WITH {SIDES} SELECT feature, round(ln(statistic), 6) AS log_statistic, k, round({CHI_P}, 6) AS p_value FROM chi")
def drift_chisq(spark, d):
    found = D.chi_square(*sides(spark, d), CATEGORICAL)
    return found.select("feature", F.round(F.log("statistic"), 6).alias("log_statistic"), "k", *six("p_value"))  # a new category makes a statistic of fifteen digits, so logarithms are compared


@query(f"WITH {SIDES} SELECT feature, value FROM cv WHERE a = 0")
def drift_new_categories(spark, d):
    return D.new_categories(*sides(spark, d), CATEGORICAL)


@query(f"WITH {DRIFT} SELECT feature, drift_detected, round(drift_score, 6) AS drift_score, drift_type FROM fd ORDER BY fd.drift_score DESC, feature LIMIT 5")
def drift_top(spark, d):
    found = D.feature_drift(*sides(spark, d), NUMERIC, CATEGORICAL, exact=False)
    top = found.orderBy(F.desc("drift_score"), "feature").limit(5)
    return top.select("feature", "drift_detected", *six("drift_score"), "drift_type")


@query(f"WITH {DRIFT} SELECT feature, drift_detected, round(drift_score, 6) AS drift_score, drift_type, round(ln(test_statistic), 6) AS log_statistic, round(p_value, 6) AS p_value, recommendation FROM fd")
def drift_features(spark, d):
    """With asymptotic p-values, which SQL can express; the operator's own are exact for small samples."""
    found = D.feature_drift(*sides(spark, d), NUMERIC, CATEGORICAL, exact=False)
    return found.select("feature", "drift_detected", *six("drift_score"), "drift_type", F.round(F.log("test_statistic"), 6).alias("log_statistic"), *six("p_value"), "recommendation")


@query(f"""WITH {DRIFT}, o AS (SELECT count(*) AS features, count(*) FILTER (drift_detected) AS drifted, avg(CASE WHEN drift_detected THEN drift_score END) AS ms,
  list_sort(list(feature) FILTER (drift_detected AND drift_score > 0.3))[1:3] AS top, count(*) FILTER (drift_detected AND drift_score > 0.15 AND drift_score <= 0.3) AS medium,
  count(*) FILTER (drift_detected AND drift_type = 'categorical') AS c, count(*) FILTER (drift_detected AND drift_type = 'distributional') AS n FROM fd),
 q AS (SELECT *, drifted * 100.0::DOUBLE / features AS pc FROM o)
 SELECT features, drifted, pc AS drift_percentage, round(coalesce(ms, 0), 6) AS mean_score,
  CASE WHEN drifted = 0 THEN 'none' WHEN drifted > 0.5 * features OR ms > 0.3 THEN 'high' WHEN drifted > 0.25 * features OR ms > 0.15 THEN 'medium' ELSE 'low' END AS severity,
  concat_ws(' | ', CASE WHEN pc > 50 THEN 'CRITICAL: Over 50% of features show drift. Immediate model retraining required.' WHEN pc > 25 THEN 'HIGH: Significant drift detected. Schedule model validation and potential retraining.' WHEN pc > 10 THEN 'MEDIUM: Some drift detected. Increase monitoring frequency.' END,
   CASE WHEN len(top) > 0 THEN 'Priority features for immediate attention: ' || array_to_string(top, ', ') END, CASE WHEN medium > 0 THEN 'Monitor closely: ' || medium || ' features showing moderate drift' END,
   CASE WHEN c > 0 THEN 'Categorical drift detected - check for new data sources or encoding changes' END, CASE WHEN n > 0 THEN 'Distributional drift detected - validate data processing pipeline' END, CASE WHEN drifted = 0 THEN 'No significant drift detected. Continue normal monitoring.' END) AS recommendations FROM q""")
def drift_report(spark, d):
    one = D.drift_report(D.feature_drift(*sides(spark, d), NUMERIC, CATEGORICAL, exact=False))
    return one.withColumns({"mean_score": F.round("mean_score", 6), "recommendations": F.array_join("recommendations", " | ")})


def _weeks(spark, d):
    base, other = sides(spark, d)
    return D.drift_by_period(base, other.withColumn("week", F.floor(F.datediff("trans_date_trans_time", F.lit("2024-01-01").cast("date")) / 4)), "week", NUMERIC)


PERIODS = f"""WITH {SIDES}, o AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 4 AS period, feature, value FROM (SELECT ts, unnest(['amt', 'merchant', 'merch_lat', 'merch_long', 'hour']) AS feature, unnest([amt, merchant::DOUBLE, merch_lat, merch_long, hour::DOUBLE]) AS value FROM h) WHERE ts >= '{SPLIT}'),
 z AS (SELECT period, feature, value, sum(a) AS a, sum(b) AS b FROM (SELECT p.period, feature, value, 1 AS a, 0 AS b FROM num, (SELECT DISTINCT period FROM o) p WHERE a = 1 UNION ALL SELECT period, feature, value, 0, 1 FROM o) GROUP BY 1, 2, 3),
 k AS (SELECT period, feature, max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS statistic, any_value(na) AS na, any_value(nb) AS nb FROM (SELECT period, feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM z WINDOW p AS (PARTITION BY period, feature), w AS (PARTITION BY period, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1, 2)
"""


@query(PERIODS + " SELECT period, feature, statistic FROM k")
def drift_periods(spark, d):
    return _weeks(spark, d).select("period", "feature", "statistic")


@query(PERIODS + """, kp AS (SELECT *, CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0::DOUBLE * j * j * lam * lam))))) END AS p FROM (SELECT *, statistic * sqrt(na::DOUBLE * nb / (na + nb)) AS lam FROM k)),
 pp AS (SELECT period, count(*) FILTER (p < 0.05) * 100.0::DOUBLE / count(*) AS pc FROM kp GROUP BY 1), l AS (SELECT list(pc ORDER BY period) AS p, count(*) AS n FROM pp),
 m AS (SELECT n, list_avg(p) AS av, CASE WHEN n >= 3 THEN list_avg(p[-3:]) END AS recent, CASE WHEN n > 3 THEN list_avg(p[1:n - 3]) WHEN n = 3 THEN p[1] END AS earlier FROM l)
 SELECT n AS periods, round(av, 6) AS avg_drift_percentage, round(recent, 6) AS recent, round(earlier, 6) AS earlier, CASE WHEN n < 3 THEN 'insufficient_data' WHEN recent > earlier * 1.2 THEN 'increasing' WHEN recent < earlier * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM m""")
def drift_trend(spark, d):
    return D.drift_trend(_weeks(spark, d)).select("periods", *six("avg_drift_percentage", "recent", "earlier"), "trend")


@query(f"""WITH {SIDES}, o AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 4 AS period, feature, value, count(*) AS b FROM (SELECT ts, unnest(['category', 'daypart']) AS feature, unnest([category, daypart]) AS value FROM h) WHERE ts >= '{SPLIT}' GROUP BY 1, 2, 3),
 base AS (SELECT feature, value, sum(a) AS a FROM cat WHERE a = 1 GROUP BY 1, 2), p AS (SELECT period, feature, sum(b) AS nb FROM o GROUP BY 1, 2), n AS (SELECT feature, sum(a) AS na FROM base GROUP BY 1),
 v AS (SELECT feature, value FROM base UNION SELECT feature, value FROM o),
 x AS (SELECT p.period, p.feature, coalesce(base.a, 0)::DOUBLE / na * nb + 1e-8::DOUBLE AS e, coalesce(o.b, 0) + 1e-8::DOUBLE AS q FROM p JOIN n ON n.feature = p.feature JOIN v ON v.feature = p.feature
       LEFT JOIN base ON base.feature = v.feature AND base.value = v.value LEFT JOIN o ON o.period = p.period AND o.feature = v.feature AND o.value = v.value WHERE base.a IS NOT NULL OR o.b IS NOT NULL)
 SELECT period, feature, round(ln(sum((q - e) * (q - e) / e)), 6) AS log_statistic, count(*) AS k FROM x GROUP BY 1, 2""")
def drift_periods_categorical(spark, d):
    base, other = sides(spark, d)
    weeks = other.withColumn("week", F.floor(F.datediff("trans_date_trans_time", F.lit("2024-01-01").cast("date")) / 4))
    return D.categories_by_period(base, weeks, "week", CATEGORICAL).select("period", "feature", F.round(F.log("statistic"), 6).alias("log_statistic"), "k")


# -- logs --------------------------------------------------------------------------------------
@query(f"WITH {LOGS} SELECT id, ts, event_type FROM logs WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{AS_OF}'")
def logs_recent(spark, d):
    return L.recent(S.log_events(spark, d), AS_OF).select("id", "ts", "event_type")


@query(f"WITH {LOGS} SELECT {METRICS} FROM logs WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{AS_OF}'")
def log_metrics(spark, d):
    return L.metrics(L.recent(S.log_events(spark, d), AS_OF))


@query(f"WITH {LOGS} SELECT event_type, coalesce(endpoint, 'unknown') AS endpoint, count(*) AS n FROM logs GROUP BY 1, 2")
def log_event_breakdown(spark, d):
    return L.breakdown(S.log_events(spark, d))


@query(f"WITH {LOGS} SELECT hour(ts) AS hour, count(*) AS n FROM logs WHERE CAST(ts AS DATE) = '{DAY}' GROUP BY 1")
def log_hourly(spark, d):
    return L.hourly(S.log_events(spark, d), f"{DAY} 00:00:00")


@query(f"WITH {LOGS}, x AS (SELECT * FROM logs WHERE CAST(ts AS DATE) = '{DAY}'), hh AS (SELECT hour(ts) AS h, count(*) AS n FROM x GROUP BY 1) SELECT {METRICS}, count(*) FILTER (event_type = 'model_training') AS trainings, count(*) FILTER (event_type = 'dataset_creation') AS datasets, '{DAY} 00:00:00' AS report_date, (SELECT h FROM hh ORDER BY n DESC, h LIMIT 1) AS peak_hour FROM x")
def log_daily_report(spark, d):
    return L.daily_report(S.log_events(spark, d), f"{DAY} 00:00:00")


@query(f"WITH {LOGS} SELECT id, ts, \"precision\", recall, coalesce(2 * \"precision\" * recall / nullif(\"precision\" + recall, 0), 0) AS f1_score FROM logs WHERE event_type = 'model_training' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS AND ts <= TIMESTAMP '{AS_OF}'")
def log_model_history(spark, d):
    return L.model_history(S.log_events(spark, d), AS_OF)


@query(f"WITH {LOGS} SELECT id, ts, 'm' || id AS model_id, \"precision\", recall, coalesce(2 * \"precision\" * recall / nullif(\"precision\" + recall, 0), 0) AS f1_score, \"precision\" AS accuracy FROM logs WHERE event_type = 'model_training' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS AND ts <= TIMESTAMP '{AS_OF}'")
def log_model_history_nested(spark, d):
    """Training logs in the shape in which they are written."""
    performance = F.struct("precision", "recall", F.lit(None).cast("double").alias("f1_score"), F.col("precision").alias("accuracy"))
    metrics = F.struct(F.concat(F.lit("m"), F.col("id")).alias("model_id"), performance.alias("performance"), F.lit(None).cast("double").alias("training_duration_seconds"))
    rows = S.log_events(spark, d).select("id", "ts", "event_type", F.when(F.col("precision").isNotNull(), metrics).alias("training_metrics"))
    return L.model_history(rows, AS_OF).drop("training_seconds")


ROTATE = "2024-02-10 00:00:00"


@query(f"WITH y AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, lpad(event_id::VARCHAR, 12, '0') DESC) AS k FROM events WHERE ts >= TIMESTAMP '{ROTATE}' - INTERVAL 30 DAYS) SELECT 'log_' || lpad(event_id::VARCHAR, 12, '0') AS path, 'age' AS reason FROM events WHERE ts < TIMESTAMP '{ROTATE}' - INTERVAL 30 DAYS UNION ALL SELECT 'log_' || lpad(event_id::VARCHAR, 12, '0'), 'count' FROM y WHERE k > 1000")
def log_rotation(spark, d):
    files = S.table(spark, d, "events").select(F.concat(F.lit("log_"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("path"), F.col("ts").alias("modified"))
    return L.rotation(files, ROTATE)


ALERTS = f"""WITH {LOGS}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, {METRICS} FROM logs GROUP BY 1),
 alerts AS (SELECT window_start, 'high_error_rate' AS alert, error_rate AS value FROM w WHERE error_rate > 10 UNION ALL SELECT window_start, 'slow_response', avg_seconds FROM w WHERE avg_seconds > 5 UNION ALL SELECT window_start, 'high_fraud_rate', fraud_rate FROM w WHERE fraud_rate > 25)"""


@query(ALERTS + " SELECT * FROM alerts")
def alerts_hourly(spark, d):
    return L.alerts(L.windowed(S.log_events(spark, d)))


@query(ALERTS + f" SELECT * FROM alerts WHERE window_start >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS")
def alerts_recent(spark, d):
    return L.recent_alerts(alerts_hourly(spark, d), AS_OF)


@query(f"""WITH {LOGS}, x AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (prediction = 'fraudulent') AS f, count(*) FILTER (prediction = 'legitimate') AS l FROM logs GROUP BY 1)
 SELECT day, f AS fraudulent, coalesce(f * 100.0::DOUBLE / nullif(f + l, 0), 0) AS rate, coalesce(sum(f) OVER w * 100.0::DOUBLE / nullif(sum(f + l) OVER w, 0), 0) AS rolling_rate FROM x WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""")
def rolling_rates(spark, d):
    return L.rolling_rates(S.log_events(spark, d))


@query(f"WITH {LOGS}, w AS (SELECT window_start, {METRICS} FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, * FROM logs) GROUP BY 1), last AS (SELECT max(ts) - INTERVAL 10 MINUTES AS t FROM logs), alerts AS (SELECT window_start, 'high_error_rate' AS alert, error_rate AS value FROM w WHERE error_rate > 10 UNION ALL SELECT window_start, 'slow_response', avg_seconds FROM w WHERE avg_seconds > 5 UNION ALL SELECT window_start, 'high_fraud_rate', fraud_rate FROM w WHERE fraud_rate > 25) SELECT alerts.* FROM alerts, last WHERE window_start + INTERVAL 1 HOUR <= t")
def stream_alerts(spark, d):
    """The alerts of completed windows, by a streaming query over the log table until it is used up."""
    base = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    S.log_events(spark, d).write.parquet(f"{base}/logs")
    schema = spark.read.parquet(f"{base}/logs").schema
    run = monitor.run_alerts(monitor.log_stream(spark, f"{base}/logs", schema), f"{base}/alerts", f"{base}/state")
    run.awaitTermination()
    return spark.read.schema("window_start timestamp_ntz, alert string, value double").parquet(f"{base}/alerts")


# -- learning ----------------------------------------------------------------------------------
RATIO = 0.08
WHOLE = [c for c in SCHEMA if c not in ("hour_sin", "hour_cos", "amt_log")]


def learnable(spark, d):
    """Every feature of each transaction, those of transcendental functions rounded."""
    return wide(spark, d).select("trans_num", "is_fraud", *WHOLE, *six("hour_sin", "hour_cos", "amt_log"))


def _folds(spark, d):
    rows = E.stratified_split(Scratch(spark, "folds").keep(learnable(spark, d), "rows"), "trans_num", "is_fraud")
    return rows.where("not is_test").drop("is_test"), rows.where("is_test").drop("is_test")


@query(None)
def adasyn(spark, d):
    return M.oversampled(learnable(spark, d), SCHEMA, ratio=RATIO)[0]


@query(f"""WITH {FEATURES}, p AS (SELECT trans_num, is_fraud AS y, {", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in WHOLE)}, round(hour_sin, 6) + 0 AS hour_sin, round(hour_cos, 6) + 0 AS hour_cos, round(amt_log, 6) AS amt_log FROM feat),
 d AS (SELECT a.trans_num AS t, b.y, {" + ".join(f"(b.{c} - a.{c}) * (b.{c} - a.{c})" for c in SCHEMA)} AS d2 FROM p a JOIN p b ON a.y = 1 AND a.trans_num <> b.trans_num),
 k AS (SELECT t, y FROM d QUALIFY row_number() OVER (PARTITION BY t ORDER BY d2, y) <= 5),
 m AS (SELECT t AS trans_num, count(*) FILTER (y = 0) AS majority FROM k GROUP BY t), n AS (SELECT count(*) FILTER (y = 1) AS ones, count(*) FILTER (y = 0) AS zeros FROM p)
 SELECT trans_num, majority, round_even(majority::DOUBLE / (SELECT sum(majority) FROM m)::DOUBLE * floor({RATIO} * zeros - ones), 0)::BIGINT AS copies FROM m, n""")
def adasyn_shares(spark, d):
    """How many of the five nearest rows of each minority row are of the majority, and how many synthetic rows it gets."""
    own = M.Minority(learnable(spark, d), SCHEMA, keep=("trans_num",))
    return own.shares.select("trans_num", "majority", own.copies(RATIO).alias("copies"))


@query(None)
def train_and_score(spark, d):
    """The production configuration, boosted trees that are dropped at times, in the image's number of rounds, on all features and oversampled rows."""
    train, test = _folds(spark, d)
    rows, made = M.oversampled(train, SCHEMA, ratio=0.05)
    model = B.train(rows, SCHEMA, settings=replace(B.CONFIGS["aggressive"], rounds=100), at_hand=made)
    return M.score(model, test).select("trans_num", "is_fraud", "fraud_probability", "prediction", "confidence")


@query(None)
def training_factors(spark, d):
    """Second-order boosted trees with each of three factors that positives weigh, in the configured rounds."""
    train, test = _folds(spark, d)
    return spark.createDataFrame(M.weighted(train, test, SCHEMA), "config string, factor double, tp long, fp long, fn long, tn long, precision double, recall double, f1 double, accuracy double")


@query(None)
def training_grid(spark, d):
    """Four configurations by four ratios of oversampling, in the configured rounds."""
    train, test = _folds(spark, d)
    found = M.grid(train, test, SCHEMA)
    return spark.createDataFrame(found, "config string, ratio double, oversampled boolean, trees int, loss double, tp long, fp long, fn long, tn long, precision double, recall double, f1 double, accuracy double, best_threshold double, best_f1 double")


@query(None)
def feature_importance(spark, d):
    model = M.train(_folds(spark, d)[0], SCHEMA, kind="rf")
    return spark.createDataFrame(M.importances(model, SCHEMA), "feature string, importance double")


# -- privacy and quality checks that the application's documents describe ----------------------
@query(f"WITH {TX} SELECT trans_num, sha256(cc_num::VARCHAR) AS card_hash, round(merch_lat, 3) AS merch_lat, round(merch_long, 3) AS merch_long FROM tx")
def masked_transactions(spark, d):
    return S.transactions(spark, d).select("trans_num", F.sha2(F.col("cc_num").cast("string"), 256).alias("card_hash"), F.round("merch_lat", 3).alias("merch_lat"), F.round("merch_long", 3).alias("merch_long"))


@query(f"WITH {FEATURES} SELECT trans_num, amt_zscore FROM feat WHERE abs(amt_zscore) > 3")
def outliers(spark, d):
    return X.customer_profile(S.transactions(spark, d)).where("abs(amt_zscore) > 3").select("trans_num", "amt_zscore")
