"""Structured Streaming forms of log monitoring and scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators import logs as L
from ledgerlens.operators.learning import score
from ledgerlens.operators.trees import TreeModel


def log_stream(spark: SparkSession, folder: str, schema, form: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder)


def metric_stream(stream: DataFrame, lateness: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Event-time window metrics of a log stream (ts as timestamp_ntz); state is dropped behind the watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    w = F.window("ts", length, slide or length)
    return timed.groupBy(w.alias("w")).agg(*L.metric_columns()).withColumn("window_start", F.col("w.start").cast("timestamp_ntz")).drop("w")


def run_alerts(stream: DataFrame, sink: str, checkpoint: str, lateness: str = "10 minutes", slide: str | None = None, every: str | None = None) -> StreamingQuery:
    """Alerts of completed windows of an hour, appended to a Parquet table: until the source is used up, or every so often until the query is stopped.

    slide: how far apart windows begin, for a sliding hour.
    """
    found = L.alerts(metric_stream(stream, lateness, slide=slide))
    writer = found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_scores(stream: DataFrame, model: PipelineModel | TreeModel, sink: str, checkpoint: str, threshold: float = 0.5) -> StreamingQuery:
    """Scores of a stream of feature rows by a model, appended to a Parquet table."""
    scored = score(model, stream, threshold)
    return scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
