"""Sinks: versioned datasets, JSON logs, reports and label maps."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: the four events and their endpoints.
EVENTS = {"prediction_request": "/predict", "dataset_creation": "/create_dataset", "model_training": "/train_model", "system_error": None}


MANIFEST = "_manifest.json"


def put(spark, path: str, text: str) -> None:
    """A new small file; an error if there is one of that name already. No job runs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get(spark, path: str) -> str:
    """The text of a small file. No job runs."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_dataset(df: DataFrame, folder: str, name: str = "engineered", form: str = "parquet", as_of: datetime | None = None) -> str:
    """A dataset version: a folder named by time, in Parquet, CSV or JSON; its path.

    No two versions share a folder, however close they are. A manifest of the
    files is put last: without one, a folder is not a version, so readers of
    versions() see whole ones only.
    """
    path = f"{folder}/{name}_{(as_of or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S_%f')}_{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("error")
    writer.csv(path, header=True) if form == "csv" else writer.format(form).save(path)
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = [(s.getPath().getName(), s.getLen()) for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    put(spark, f"{path}/{MANIFEST}", json.dumps({"form": form, "columns": df.columns, "files": [f for f in files if not f[0].startswith(("_", "."))]}))
    return path


def versions(spark, folder: str, name: str = "engineered") -> list[str]:
    """The paths of a dataset's whole versions, the oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}_*/{MANIFEST}")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(str(s.getPath().getParent()) for s in found)


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels as JSON objects: one entry a row, many rows a file; load_labels() reads them, and one object of all as well."""
    labels.select(F.to_json(F.map_from_arrays(F.array(F.col("trans_num").cast("string")), F.array(F.col("is_fraud")))).alias("value")).write.mode("overwrite").text(path)


def log_event(kind: str, as_of: datetime | None = None, **fields) -> dict:
    """A typed log event."""
    if kind not in EVENTS:
        raise ValueError(f"no such event: {kind}")
    event = {"event_type": kind, "system_timestamp": (as_of or datetime.now(timezone.utc)).replace(tzinfo=None).isoformat(), **fields}
    return event | ({"endpoint": EVENTS[kind]} if EVENTS[kind] else {})


def append_logs(spark, events: list[dict], folder: str) -> str:
    """Log events as JSON lines in a new file of the folder, named by time to the millisecond; its path. No job runs."""
    path = f"{folder}/log_{datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S_%f')[:-3]}_{uuid.uuid4().hex[:8]}.json"
    put(spark, path, "".join(json.dumps(e, default=str) + "\n" for e in events))
    return path


def append_request(spark, request: dict, folder: str, as_of: datetime | None = None) -> str:
    """An ad-hoc record of a request, with a timestamp but no event type; readers of events skip it."""
    return append_logs(spark, [{"timestamp": (as_of or datetime.now(timezone.utc)).replace(tzinfo=None).isoformat(), **request}], folder)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def drift_summary(report: dict, features: list[dict], trend: dict | None = None) -> str:
    """A Markdown summary of a drift report; features: one dict per monitored feature; trend: a row of drift_trend()."""
    drifted = sorted((f for f in features if f["drift_detected"]), key=lambda f: -f["drift_score"])
    lines = ["# Drift report", "", f"- Features: {report['features']}", f"- Drifted: {report['drifted']} ({report['drift_percentage']:.1f} %)", f"- Severity: {report['severity']}", "", "| Feature | Type | Score | p | Recommendation |", "|---|---|---|---|---|"]
    lines += [f"| {f['feature']} | {f['drift_type']} | {f['drift_score']:.4f} | {f['p_value']:.4g} | {f['recommendation']} |" for f in drifted[:5]]
    if report.get("recommendations"):
        lines += ["", "## Recommendations", "", *[f"- {r}" for r in report["recommendations"]]]
    if trend:
        lines += ["", "## Trend", "", f"- Trend: {trend['trend']}", f"- Periods: {trend['periods']}", f"- Average share of drifted features: {trend['avg_drift_percentage'] or 0:.1f} %"]
    return "\n".join(lines) + "\n"
