"""Logs with many events a file, the log store, dataset versions, samples of large groups and bounded sets."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import drift as D
from ledgerlens.operators import evaluation as E
from ledgerlens.service import RiskService
from ledgerlens.sources import sinks
from ledgerlens.sources import tables as S
from ledgerlens.sources.logstore import LogStore


def test_all_events_of_a_file_are_read(spark, tmp_path):
    events = [sinks.log_event("prediction_request", as_of=datetime(2024, 1, 1, 0, k), prediction="legitimate", request_data={"a": "} {"}) for k in range(5)]
    sinks.append_logs(spark, events, f"{tmp_path}/logs")
    (tmp_path / "logs" / "log_20240102_000000_000_x.json").write_text('{\n  "event_type": "system_error",\n  "error_info": {\n    "a": "b"\n  },\n  "system_timestamp": "2024-01-02T00:00:00"\n}\n')
    (tmp_path / "logs" / "log_20240103_000000_000_x.json").write_text('{"event_type": "broken\n')
    assert S.load_logs(spark, f"{tmp_path}/logs").count() == 6
    assert LogStore(spark, f"{tmp_path}/logs").read().where("event_type = 'system_error'").first().error_info == {"a": "b"}
    service = RiskService(spark, str(tmp_path), str(tmp_path))
    assert service.system_metrics("2024-01-02 00:00:00", 48)["total_events"] == 6


def test_log_store(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    assert store.read().count() == 0 and store.compact("2030-01-01") == 0
    for day in range(1, 7):
        for hour in (3, 15):
            (tmp_path / f"log_202401{day:02d}_{hour:02d}0000_000_{day}{hour}.json").write_text("".join(f'{{"event_type": "e", "system_timestamp": "2024-01-{day:02d}T{h:02d}:30:00"}}\n' for h in range(hour - 3, hour)))
    recent = store.files("2024-01-06 02:00:00")
    assert [f.rsplit("_", 2)[-3:][0] for f in recent] and len(recent) == 2  # those of the last day alone
    want = sorted(r.system_timestamp for r in store.read().collect())
    assert len(want) == 36
    assert store.compact("2024-01-04 00:00:00") == 6 and len(store.files()) == 6
    assert sorted(r.system_timestamp for r in store.read().collect()) == want
    (tmp_path / "log_20240102_233000_000_late.json").write_text('{"event_type": "e", "system_timestamp": "2024-01-02T23:00:00"}')
    assert store.compact("2024-01-05 00:00:00") == 3
    assert sorted(r.system_timestamp for r in store.read().collect()) == sorted([*want, "2024-01-02T23:00:00"])
    assert store.read("2024-01-02 12:30:00", "2024-01-02 23:00:00").count() == 4
    assert len(store.manifest()["tables"]) == 2 and [f.rsplit("/", 1)[-1] for f in store.read("2024-01-06 00:00:00").inputFiles()] == [f.rsplit("/", 1)[-1] for f in store.files("2024-01-06 00:00:00")]
    with pytest.raises(Exception, match="exist"):
        sinks.put(spark, f"{tmp_path}/_manifest_000000002.json", "{}")


def test_dataset_versions(spark, tmp_path):
    df, now = spark.range(3), datetime(2024, 1, 1)
    paths = [sinks.write_dataset(df.limit(n), f"{tmp_path}/sets", form=form, as_of=now) for n, form in ((1, "parquet"), (2, "csv"), (3, "json"))]
    df.write.parquet(f"{tmp_path}/sets/engineered_20240102_000000_000000_half")  # as a job that died would leave it
    assert sorted(sinks.versions(spark, f"{tmp_path}/sets")) == sorted(f"file:{p}" for p in paths)
    assert [S.load_dataset(spark, p).count() for p in paths] == [1, 2, 3]
    assert sinks.versions(spark, f"{tmp_path}/none") == []


@pytest.mark.parametrize("ranked, groups", [(100_000, 200_000), (20, 200_000), (20, 0)])
def test_exact_samples_at_any_number_of_ranked_rows(spark, monkeypatch, ranked, groups):
    monkeypatch.setattr(E, "RANKED_ROWS", ranked)
    monkeypatch.setattr(E, "EDGE_GROUPS", groups)
    monkeypatch.setattr(E, "DIGITS", 1)
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "x").when(F.col("id") % 10 < 8, "y").alias("g")).unionByName(spark.createDataFrame([(7, "y")] * 60, "k long, g string"))
    order = {r.k: r.o for r in df.select("k", E.seeded_order("k").alias("o")).collect()}
    got = E.first_by_hash(df, "k", share=F.lit(0.3), by="g").collect()
    assert len(got) == 3060
    for g in ("x", "y", None):
        own = sorted((order[r.k], r.k, not r["__taken"]) for r in got if r.g == g)
        n = round(0.3 * len(own))
        assert sum(not x[2] for x in own) == n and [x[1] for x in own if not x[2]] == [x[1] for x in own[:n]]
    for n in (0, 1, 500, 3060, 5000):
        assert E.sample_n(df, "k", n).count() == min(n, 3060)


def test_few_values_in_one_pass(spark):
    df = spark.range(400, numPartitions=5).select(F.col("id").cast("string").alias("many"), (F.col("id") % 50).cast("string").alias("fifty"), (F.col("id") % 51).cast("string").alias("more"), F.when(F.col("id") < 9, "a").alias("one"), F.lit(None).cast("string").alias("none"), "id")
    assert {r.column: r.n for r in D.few_values(df, ["many", "fifty", "more", "one", "none"]).collect()} == {"many": 51, "fifty": 50, "more": 51, "one": 1}
    assert {(r.feature, r.n_values) for r in D.monitored_features(df).collect()} == {("id", None), ("fifty", 50), ("one", 1), ("none", 0)}
    assert "Expand" not in D.monitored_features(df)._jdf.queryExecution().toString()
