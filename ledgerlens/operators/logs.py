"""Log analytics: metrics, reports, alerts and rotation. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed alert limits, strict: percent of errors, mean seconds, percent of frauds.
LIMITS = {"high_error_rate": 10.0, "slow_response": 5.0, "high_fraud_rate": 25.0}


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def recent(logs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Logs of the hours before a time."""
    return logs.where(F.col("ts") >= at(as_of) - F.expr(f"interval {hours} hours")).where(F.col("ts") <= at(as_of))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def metric_columns() -> list[Column]:
    t = F.col("processing_time_seconds")
    said = lambda p: F.count_if((F.col("event_type") == "prediction_request") & (F.col("prediction") == p))
    n, errors = F.count(F.lit(1)), F.count_if(F.col("event_type") == "system_error")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = F.try_divide(F.sum(F.round(t * 1000).cast("long")), F.count(t)) / 1000
    return [
        n.alias("total_events"), zero(mean).alias("avg_seconds"), zero(F.max(t)).alias("max_seconds"), zero(F.min(t)).alias("min_seconds"), F.count(t).alias("timed"),
        errors.alias("errors"), _percent(errors, n).alias("error_rate"), said("fraudulent").alias("fraudulent"), said("legitimate").alias("legitimate"),
        _percent(said("fraudulent"), said("fraudulent") + said("legitimate")).alias("fraud_rate"),
    ]


def metrics(logs: DataFrame) -> DataFrame:
    """One row of performance, error and prediction metrics."""
    return logs.agg(*metric_columns())


def breakdown(logs: DataFrame) -> DataFrame:
    """Events by type and endpoint, unknown where absent."""
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    return logs.groupBy(known("event_type"), known("endpoint")).agg(F.count(F.lit(1)).alias("n"))


def usage_maps(logs: DataFrame) -> DataFrame:
    """event_breakdown and endpoint_usage as maps."""
    by = breakdown(logs)
    one = lambda c: by.groupBy(c).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(c, "n"))))
    return one("event_type").toDF("event_breakdown").join(one("endpoint").toDF("endpoint_usage"), F.lit(True))


def hourly(logs: DataFrame, day: str) -> DataFrame:
    own = logs.where((F.col("ts") >= at(day)) & (F.col("ts") < at(day) + F.expr("interval 1 day")))
    return own.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def daily_report(logs: DataFrame, day: str) -> DataFrame:
    """Totals of a day, its peak hour (the earliest at ties) and its metrics."""
    own = logs.where((F.col("ts") >= at(day)) & (F.col("ts") < at(day) + F.expr("interval 1 day")))
    peak = hourly(logs, day).agg(F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak_hour"))
    of = lambda k, name: F.count_if(F.col("event_type") == k).alias(name)
    return own.agg(*metric_columns(), of("model_training", "trainings"), of("dataset_creation", "datasets")).withColumn("report_date", F.lit(day)).join(F.broadcast(peak), F.lit(True))


def with_performance(logs: DataFrame) -> DataFrame:
    """Training logs with precision, recall, f1_score, accuracy, model_id and training_seconds at the top level.

    Logs as written carry them in training_metrics: null for what a record lacks.
    """
    if "training_metrics" not in logs.columns:
        return logs
    m = "training_metrics"
    names = {c: f"{m}.performance.{c}" for c in ("precision", "recall", "f1_score", "accuracy")} | {"model_id": f"{m}.model_id", "training_seconds": f"{m}.training_duration_seconds"}
    kept = {c: F.coalesce(F.col(c), F.col(at_)) if c in logs.columns else F.col(at_) for c, at_ in names.items()}
    return logs.withColumns(kept)


def model_history(logs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Training sessions of the last days with their precision, recall and F1 (worked out where a record lacks it)."""
    p, r = F.col("precision"), F.col("recall")
    own = with_performance(recent(logs, as_of, 24 * days).where(F.col("event_type") == "model_training"))
    made = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    f1 = F.coalesce(F.col("f1_score"), made) if "f1_score" in own.columns else made
    return own.where(p.isNotNull()).select(*[c for c in ("id", "ts", "model_id") if c in own.columns], "precision", "recall", f1.alias("f1_score"), *[c for c in ("accuracy", "training_seconds") if c in own.columns])


def rotation(files: DataFrame, as_of: str, max_age_days: int = 30, max_files: int = 1000) -> DataFrame:
    """What a clean-up would delete (path, reason): files over age, then all but the newest of the rest.

    The newest are found by a bounded top-k; no window runs over all files.
    """
    old = F.col("modified") < at(as_of) - F.expr(f"interval {max_age_days} days")
    young = files.where(~old)
    kept = young.orderBy(F.desc("modified"), F.desc("path")).limit(max_files).select(F.col("path").alias("__kept"))
    return files.where(old).select("path", F.lit("age").alias("reason")).unionByName(young.join(kept, F.col("path") == F.col("__kept"), "left_anti").select("path", F.lit("count").alias("reason")))


def directory_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min_by("path", F.struct("modified", "path")).alias("oldest"), F.max_by("path", F.struct("modified", "path")).alias("newest"))


def alerts(windows: DataFrame) -> DataFrame:
    """(window_start, alert, value) of windows whose metrics exceed a limit."""
    of = lambda name, c: F.when(F.col(c) > LIMITS[name], F.struct(F.lit(name).alias("alert"), F.col(c).alias("value")))
    found = F.array_compact(F.array(of("high_error_rate", "error_rate"), of("slow_response", "avg_seconds"), of("high_fraud_rate", "fraud_rate")))
    return windows.select("window_start", F.explode(found).alias("a")).select("window_start", "a.alert", "a.value")


def windowed(logs: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Metrics of event-time windows; on a stream, add a watermark first."""
    w = F.window(F.col("ts").cast("timestamp"), length, slide or length)
    return logs.groupBy(w.alias("w")).agg(*metric_columns()).withColumn("window_start", F.col("w.start").cast("timestamp_ntz")).drop("w")


def recent_alerts(found: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return found.where(F.col("window_start") >= at(as_of) - F.expr(f"interval {hours} hours"))


def rolling_rates(logs: DataFrame, days: int = 7) -> DataFrame:
    """Daily fraud rates with a rolling rate of the days up to each, and a smoothed one with limits of two deviations."""
    said = lambda p: F.count_if(F.col("prediction") == p)
    daily = logs.groupBy(F.to_date("ts").alias("day")).agg(said("fraudulent").alias("f"), said("legitimate").alias("l"))
    w = W.orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-(days - 1), 0)
    return daily.select("day", F.col("f").alias("fraudulent"), _percent(F.col("f"), F.col("f") + F.col("l")).alias("rate"), _percent(F.sum("f").over(w), F.sum(F.col("f") + F.col("l")).over(w)).alias("rolling_rate"))
