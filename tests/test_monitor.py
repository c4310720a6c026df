"""The running monitor against plain Python, batch after batch, with late files and a restart."""

import random
from datetime import datetime, timedelta

import pytest

from ledgerlens.operators.logs import LIMITS
from ledgerlens.streaming import alerting as A

SCHEMA = "ts timestamp_ntz, event_type string, prediction string, processing_time_seconds double"
START = datetime(2024, 1, 1)


def events(rng, at, n, bad):
    out = []
    for _ in range(n):
        kind = "system_error" if rng.random() < bad else "prediction_request"
        said = None if kind == "system_error" else "fraudulent" if rng.random() < bad else "legitimate"
        out.append((at + timedelta(seconds=rng.randrange(1800)), kind, said, rng.random() * 4 + 20 * bad if rng.random() < 0.9 else None))
    return out


def plain(batches):
    minutes, opened, out = {}, {}, []
    for k, rows in enumerate(batches):
        for ts, kind, said, seconds in rows:
            c = minutes.setdefault(int((ts - START).total_seconds() // 60), [0] * 6)
            for i, v in enumerate((1, kind == "system_error", round(seconds * 1000) if seconds is not None else 0, seconds is not None, said == "fraudulent", said == "legitimate")):
                c[i] += v
        now = max(minutes)
        minutes = {m: c for m, c in minutes.items() if m > now - 60}
        total = dict(zip(A.COUNTS, map(sum, zip(*minutes.values()))))
        for rule, of in A.RULES.items():
            value, since = of(total), opened.get(rule)
            if value > LIMITS[rule] and (since is None or now - since >= 24 * 60):
                opened[rule] = now
                out.append((k, rule, "opened", START + timedelta(minutes=now), pytest.approx(value)))
            elif value <= LIMITS[rule] and since is not None:
                del opened[rule]
                out.append((k, rule, "closed", START + timedelta(minutes=now), pytest.approx(value)))
    return out, opened


def test_alerts_open_once_and_close(spark, tmp_path):
    rng = random.Random(5)
    when = [0, 30, 60, 90, 45, 120, 150, 400, 430, 430 + 26 * 60]  # minutes; 45 comes late, the last one a day after an alert
    bad = [0.0, 0.0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.6, 0.6, 0.7]
    batches = [events(rng, START + timedelta(minutes=m), 60, b) for m, b in zip(when, bad)]
    want, opened = plain(batches)
    assert {w[2] for w in want} == {"opened", "closed"} and len(want) >= 9 and len(opened) == 3
    folder, sink, state = (f"{tmp_path}/{n}" for n in ("logs", "alerts", "state"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if k in (4, 6, 9):  # stopped and started again in between
            A.run_monitor(stream(), sink, state).awaitTermination()
    got = sorted((r.batch, r.rule, r.state, r.at, r.value) for r in A.alerts_of(spark, sink).collect())
    assert got == sorted(want, key=lambda w: w[:3])
    assert {r.rule for r in A.open_alerts(A.alerts_of(spark, sink)).collect()} == set(opened)
    A.run_monitor(stream(), sink, state).awaitTermination()  # nothing new
    assert A.alerts_of(spark, sink).count() == len(want)
