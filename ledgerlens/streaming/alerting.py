"""A running monitor: alert rules over the last hour of a log stream, with state.

Tasks of a micro-batch count its events by minute, so few rows reach the
state. Every rule keeps the counts of the last hour's minutes and the alert
that it has open. An alert is given in the batch in which its limit is
exceeded, not again while it is open, and as closed in the batch in which the
limit is kept again; one that is open for a day is given anew. The clock is the
newest event: events that come late, but within the hour, are counted in their
minute, older ones no longer matter. A batch without events changes nothing.

Alerts are written by batch: a batch that is run again after a restart replaces
what it wrote before, so none is repeated and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlens.operators.logs import LIMITS

HOUR, DAY = 60, 24 * 60
COUNTS = ["events", "errors", "milliseconds", "timed", "fraudulent", "legitimate"]
ALERTS = "rule string, state string, at timestamp_ntz, value double"
#: The value of each rule, of an hour's counts.
RULES: dict[str, Callable[[dict[str, int]], float]] = {
    "high_error_rate": lambda c: 100.0 * c["errors"] / c["events"] if c["events"] else 0.0,
    "slow_response": lambda c: c["milliseconds"] / c["timed"] / 1000 if c["timed"] else 0.0,
    "high_fraud_rate": lambda c: 100.0 * c["fraudulent"] / (c["fraudulent"] + c["legitimate"]) if c["fraudulent"] + c["legitimate"] else 0.0,
}


def minute_counts(logs: DataFrame) -> DataFrame:
    """(rule, minute, COUNTS) of log events, summed within a task's rows, once for every rule."""
    kind, said = F.col("event_type"), F.col("prediction")
    asked = kind == "prediction_request"
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    seconds = F.col("processing_time_seconds")
    rows = logs.where("ts is not null").select(
        F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("long").alias("minute"), F.lit(1).cast("long").alias("events"), flag(kind == "system_error").alias("errors"),
        F.coalesce(F.round(seconds * 1000), F.lit(0)).cast("long").alias("milliseconds"), seconds.isNotNull().cast("long").alias("timed"), flag(asked & (said == "fraudulent")).alias("fraudulent"), flag(asked & (said == "legitimate")).alias("legitimate"),
    )

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = pd.DataFrame(columns=["minute", *COUNTS], dtype="int64")
        for b in batches:
            total = pd.concat([total, b]).groupby("minute", as_index=False).sum()
        yield total

    summed = rows.mapInPandas(add, ", ".join(f"{c} long" for c in ("minute", *COUNTS)))
    return summed.select(F.explode(F.array(*map(F.lit, RULES))).alias("rule"), "*")


class Watch(StatefulProcessor):
    """The state of a rule: counts of the last hour's minutes, and since when its alert is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.minutes = handle.getMapState("minutes", "minute long", ", ".join(f"{c} long" for c in COUNTS))
        self.open = handle.getValueState("open", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (rule,) = key
        fresh = pd.concat(list(rows)).groupby("minute")[COUNTS].sum()
        kept = {m[0]: c for m, c in self.minutes.iterator()} if self.minutes.exists() else {}
        for minute, counts in fresh.iterrows():
            old = kept.get(int(minute), (0,) * len(COUNTS))
            kept[int(minute)] = tuple(int(a) + int(b) for a, b in zip(old, counts))
            self.minutes.updateValue((int(minute),), kept[int(minute)])
        now = max(kept)
        for minute in [m for m in kept if m <= now - HOUR]:
            self.minutes.removeKey((minute,))
            del kept[minute]
        value = RULES[rule](dict(zip(COUNTS, map(sum, zip(*kept.values())))))
        since = self.open.get()[0] if self.open.exists() else None
        out = []
        if value > LIMITS[rule]:
            if since is None or now - since >= DAY:
                self.open.update((now,))
                out.append("opened")
        elif since is not None:
            self.open.clear()
            out.append("closed")
        text = lambda v: pd.Series(v, dtype=object)
        yield pd.DataFrame({"rule": text([rule] * len(out)), "state": text(out), "at": pd.to_datetime([now * 60] * len(out), unit="s"), "value": [value] * len(out)})

    def close(self) -> None:
        pass


def alert_stream(logs: DataFrame) -> DataFrame:
    """(rule, state, at, value): alerts as they open and close, of a stream of logs."""
    return minute_counts(logs).groupBy("rule").transformWithStateInPandas(Watch(), ALERTS, "append", "None")


def run_monitor(logs: DataFrame, sink: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes alerts by batch below sink: until the source is used up, or every so often until the query is stopped."""
    spark = logs.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the store that such state needs

    def write(alerts: DataFrame, batch: int) -> None:
        alerts.coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    writer = alert_stream(logs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def alerts_of(spark: SparkSession, sink: str) -> DataFrame:
    """What run_monitor() has written: batch, rule, state, at and value."""
    return spark.read.schema(f"{ALERTS}, batch long").parquet(sink)


def open_alerts(alerts: DataFrame) -> DataFrame:
    """The rules whose last alert is not closed: rule, since and value."""
    last = alerts.groupBy("rule").agg(F.max_by(F.struct("state", "at", "value"), F.struct("batch", "at")).alias("last"))
    return last.where("last.state = 'opened'").select("rule", F.col("last.at").alias("since"), "last.value")
