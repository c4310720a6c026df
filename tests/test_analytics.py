"""Evaluation, drift, logs, streaming and learning."""

import itertools
import json
import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions.ranges import running
from ledgerlens.operators import drift as D
from ledgerlens.operators import evaluation as E
from ledgerlens.operators import learning as M
from ledgerlens.operators import logs as L
from ledgerlens.sources import sinks, tables as S
from ledgerlens.streaming import monitor

DATA = "/root/testdata/sf0.001"


def scalar(spark, c):
    return spark.range(1).select(c).first()[0]


def test_exact_shares_and_samples(spark):
    rows = spark.range(5003).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    split = E.stratified_split(rows, "id", "y")
    assert {(r.y, r.n) for r in split.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(y, round(0.2 * n)) for y, n in ((1, 715), (0, 4288))}
    assert E.sample_n(rows, "id", 17).count() == 17 and E.sample_n(rows, "id", 10**6).count() == 5003 and E.sample_n(rows, "id", 0).count() == 0
    assert E.sample_n(rows, "id", 17).exceptAll(E.sample_n(rows.repartition(7), "id", 17)).count() == 0


def test_rates(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.2)], "y int, s double")
    r = E.confusion(rows, "y", "s").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1) and r.precision == r.recall == pytest.approx(2 / 3)
    assert E.confusion(rows.where("y = 0"), "y", "s", 2.0).first().f1 == 0
    curve = {r.threshold: (r.precision, r.recall) for r in E.pr_curve(rows, "y", "s").collect()}
    sweep = {r.threshold: (r.precision, r.recall) for r in E.threshold_sweep(rows, "y", "s", [0.9, 0.5, 0.2, 0.1]).collect()}
    assert curve == sweep
    assert E.optimal_threshold(E.pr_curve(rows, "y", "s"), 0.6, 0.6).first()[0] == 0.1
    assert E.best_threshold(E.threshold_sweep(rows, "y", "s", [0.9, 0.2])).first().threshold == 0.2
    gate = E.requirement_gate(spark.createDataFrame([(0.7, 0.7), (0.69, 0.9), (0.6, 0.9)], "precision double, recall double")).collect()
    assert [(r.meets, r.close) for r in gate] == [(True, True), (False, True), (False, False)]
    assert [r.prediction for r in E.decide(rows, "s").orderBy("s").collect()] == ["legitimate"] * 4 + ["fraudulent"]
    assert E.default_fill(rows, ["s", "none"]).first().asDict()["none"] == 0.0
    flat = E.standardize_money(spark.createDataFrame([(2.0,), (2.0,)], "a double"), "a")
    assert {r.a_scaled for r in flat.collect()} == {0.0}


def test_p_values(spark):
    assert scalar(spark, C.erfc(F.lit(1.0))) == pytest.approx(math.erfc(1.0), abs=2e-7)
    for x, k in ((3.84, 1), (5.99, 2), (7.81, 3), (18.3, 10), (100.0, 5)):
        h = x / 2
        want = math.exp(-h) * sum(h**i / math.factorial(i) for i in range(k // 2)) if k % 2 == 0 else math.erfc(math.sqrt(h)) + sum(h ** (i - 0.5) * math.exp(-h) / math.gamma(i + 0.5) for i in range(1, (k + 1) // 2))
        assert scalar(spark, C.chisq_p(F.lit(x), F.lit(k))) == pytest.approx(want, abs=1e-9)
    assert scalar(spark, C.ks_p(F.lit(0.0), F.lit(10), F.lit(10))) == 1.0 and scalar(spark, C.chisq_p(F.lit(0.0), F.lit(0))) is None


def made(spark, shift, n=1000, seed=1):
    rng = random.Random(seed)
    kinds = ["a", "b", "c"] + ["new"] * shift
    rows = [(float(rng.gauss(75, 25) if shift else rng.gauss(50, 20)), float(rng.gauss(35 if shift else 40, 5)), float(i), rng.choice(kinds)) for i in range(n)]
    return spark.createDataFrame(rows, "amt double, merch_lat double, same double, category string")


def test_drift_finds_injected_shifts_only(spark):
    watch = D.DriftMonitor(["amt", "merch_lat", "same"], ["category"])
    with pytest.raises(ValueError):
        watch.check(made(spark, 0))
    watch.initialize(made(spark, 0))
    results, report = watch.check(made(spark, 1, seed=2))
    found = {r.feature: r for r in results.collect()}
    assert {f for f, r in found.items() if r.drift_detected} == {"amt", "merch_lat", "category"} and found["same"].test_statistic == 0
    assert "new" in found["category"].recommendation and "MW p=" in found["amt"].recommendation
    r = report.first()
    assert (r.features, r.drifted, r.severity) == (4, 3, "high") and r.recommendations[0].startswith("CRITICAL")
    again, none = watch.check(made(spark, 0))
    assert none.first().severity == "none" and all(x.drift_score == pytest.approx(0, abs=1e-6) for x in again.collect())
    assert watch.status()["checks"] == 2
    text = sinks.drift_summary(r.asDict(), [x.asDict() for x in results.collect()])
    assert "Severity: high" in text and text.count("\n| ") >= 3
    assert D.drift_report(results.where("false")).first().severity == "unknown"


def test_trends(spark):
    rows = lambda pcs: spark.createDataFrame([(p, f"f{i}", i < n) for p, n in enumerate(pcs) for i in range(10)], "period int, feature string, drift_detected boolean")
    trend = lambda pcs: D.drift_trend(rows(pcs)).first().trend
    assert [trend(x) for x in ([1, 2], [1, 5, 5], [5, 1, 1, 1], [5, 5, 5, 5])] == ["insufficient_data", "increasing", "decreasing", "stable"]
    assert [(r.feature, r.drifts) for r in D.drift_counts(rows([1, 2])).collect()] == [("f0", 2), ("f1", 1)]
    assert D.drift_trend(rows([1, 2])).first().avg_drift_percentage == 15.0


def test_logs_from_files(spark, tmp_path):
    events = [sinks.log_event("prediction_request", prediction=p, processing_time_seconds=t, fraud_probability=0.5, request_data={"a": "1"}) for p, t in (("fraudulent", 1.0), ("legitimate", 20.0), ("test", 2.0))] + [sinks.log_event("system_error", error_info={"m": "x"})]
    for i, e in enumerate(events):
        (tmp_path / f"log_{i}.json").write_text(json.dumps(e, indent=1))
    (tmp_path / "log_bad.json").write_text("{oops")
    (tmp_path / "log_old.json").write_text('{"timestamp": "2024-01-01T00:00:00", "endpoint": "/predict"}')
    logs = S.load_logs(spark, f"{tmp_path}/log_*.json")
    r = L.metrics(logs).first()
    assert (r.total_events, r.timed, r.errors, r.fraudulent, r.legitimate, r.fraud_rate, r.error_rate, r.avg_seconds) == (4, 3, 1, 1, 1, 50.0, 25.0, pytest.approx(23 / 3, abs=1e-3))
    maps = L.usage_maps(logs).first()
    assert maps.event_breakdown == {"prediction_request": 3, "system_error": 1} and maps.endpoint_usage == {"/predict": 3, "unknown": 1}
    assert L.metrics(logs.where("false")).first().error_rate == 0
    with pytest.raises(ValueError):
        sinks.log_event("other")
    sinks.append_logs(spark, events, f"{tmp_path}/appended")
    sinks.append_logs(spark, events, f"{tmp_path}/appended")
    assert spark.read.text(f"{tmp_path}/appended").count() == 8
    assert L.directory_stats(S.dataset_paths(spark, f"{tmp_path}/log_*.json")).first().files == 6


def test_history_gap_of_the_writer_is_closed(spark, tmp_path):
    """The performance that training events carry is read, from files, under the names it is written with."""
    performance = {"precision": 0.8, "recall": 0.5, "accuracy": 0.9}
    sinks.append_logs(spark, [sinks.log_event("model_training", training_metrics={"model_id": "m1", "performance": performance, "training_duration_seconds": 2.5})], f"{tmp_path}")
    sinks.append_logs(spark, [sinks.log_event("model_training", training_metrics={"model_id": "m2"})], f"{tmp_path}")
    path = sinks.append_request(spark, {"amt": 1}, f"{tmp_path}")
    assert re.search(r"log_\d{8}_\d{6}_\d{3}_", path)
    logs = S.load_logs(spark, f"{tmp_path}/log_*.json")
    assert logs.count() == 2
    (r,) = L.model_history(logs, "2100-01-01 00:00:00", 40_000).collect()
    assert (r.model_id, r.precision, r.recall, r.accuracy, r.training_seconds) == ("m1", 0.8, 0.5, 0.9, 2.5) and r.f1_score == pytest.approx(2 * 0.4 / 1.3)


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), float(v), rng.randint(0, 9)) for v in rng.sample(range(10_000), 3000)] + [(None, 1.0, 5)]
    frame = spark.createDataFrame(rows, "k string, v double, n long")
    got = {(r.k, r.v): (r.n_upto, r.n_all) for r in running(frame, ["k"], "v", ["n"]).collect()}
    for key in ("a", "b", None):
        total = 0
        own = sorted(r for r in rows if r[0] == key)
        for _, v, n in own:
            total += n
            assert got[key, v] == (total, sum(r[2] for r in own))
    last = min(running(frame.where("k is not null").drop("k"), [], "v", ["n"], descending=True).collect(), key=lambda r: r.v)
    assert last.n_upto == last.n_all == sum(r[2] for r in rows[:-1])
    plan = running(frame, ["k"], "v", ["n"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_plans_of_curves_and_periods(spark):
    """No exchange of all rows to one task, and no nested loops."""
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.rand(1).alias("s"), (F.col("id") % 4).alias("week"))
    for plan in (E.pr_curve(rows, "y", "s"), D.drift_by_period(rows, rows, "week", ["s"]), E.sample_n(rows, "k", 20)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    text = E.sample_n(rows, "k", 20)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window") == 1


def test_drift_without_values_to_compare(spark):
    base = made(spark, 0)
    other = base.withColumn("amt", F.lit(None).cast("double")).withColumn("category", F.lit(None).cast("string"))
    found = {r.feature: r for r in D.feature_drift(base, other, ["amt", "same"], ["category"]).collect()}
    for f in ("amt", "category"):
        assert (found[f].drift_detected, found[f].drift_score, found[f].test_statistic, found[f].p_value) == (False, 0.0, 0.0, 1.0)
    assert set(found) == {"amt", "same", "category"}


def test_exact_and_far_p_values(spark):
    rows = spark.createDataFrame([(1100.0, 1100), (390.0, 400), (1500.0, 300)], "x double, k int")
    got = [r[0] for r in rows.select(C.chisq_p(F.col("x"), F.col("k"))).collect()]
    assert got[0] == pytest.approx(0.49433, abs=1e-4) and got[1] == pytest.approx(0.6304029949942671, rel=1e-9) and got[2] == pytest.approx(1.508e-158, rel=1e-3)
    for n, m, d in ((4, 5, 0.6), (6, 6, 0.5), (3, 7, 1.0)):
        far = total = 0
        for own in itertools.combinations(range(n + m), n):
            i = j = 0
            apart = 0.0
            for k in range(n + m):
                i, j = (i + 1, j) if k in own else (i, j + 1)
                apart = max(apart, abs(i / n - j / m))
            far, total = far + (apart >= d - 1e-12), total + 1
        assert C.ks_exact(pd.Series([d]), pd.Series([n]), pd.Series([m]))[0] == pytest.approx(far / total)
    few = lambda *x: spark.createDataFrame([(float(v),) for v in x], "v double")
    assert D.ks(few(1, 2, 3, 4), few(2.5, 5, 6, 7, 8), ["v"], exact=True).first().p_value == pytest.approx(C.ks_exact(pd.Series([0.8]), pd.Series([4]), pd.Series([5]))[0])


def test_sources_of_a_folder(spark, tmp_path):
    people = S.sample_customers(spark, 5)
    trades = S.sample_transactions(people, 40)
    trades.write.parquet(f"{tmp_path}/transactions_release.parquet")
    sinks.write_labels(S.sample_labels(trades, 0.3), f"{tmp_path}/fraud_release.json")
    found = S.load_all(spark, f"{tmp_path}")
    assert {k: v.count() for k, v in found.items()} == {"transactions": 40, "customers": 0, "labels": 40}
    summary = S.quality_summary(*found.values()).first()
    assert summary.status == "error" and summary.error == "no customers" and summary.legitimate + summary.fraudulent == pytest.approx(1.0)
    (tmp_path / "one_fraud.json").write_text('{\n "T1": 1.0,\n "T2": NaN\n}')
    assert {tuple(r) for r in S.load_labels(spark, f"{tmp_path}/one_fraud.json").collect()} == {("T1", 1), ("T2", 0)}
    odd = spark.createDataFrame([(1.0, "a"), (float("inf"), None), (None, "b")], "x double, y string")
    assert {tuple(r) for r in S.unusable_counts(odd).collect()} == {("x", 1, 1), ("y", 1, 0)}


def test_stream_equals_batch(spark, tmp_path):
    logs = S.log_events(spark, DATA)
    for i in range(3):
        logs.where(F.floor((F.dayofmonth("ts") - 1) / 10) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/logs")
    stream = monitor.log_stream(spark, f"{tmp_path}/logs", logs.schema)
    monitor.run_alerts(stream, f"{tmp_path}/alerts", f"{tmp_path}/state").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/alerts").collect()}
    running_ = monitor.run_alerts(stream, f"{tmp_path}/sliding", f"{tmp_path}/state2", slide="30 minutes", every="1 second")
    running_.processAllAvailable()
    assert running_.isActive
    running_.stop()
    assert got <= {tuple(r) for r in spark.read.parquet(f"{tmp_path}/sliding").collect()}
    want = {tuple(r) for r in L.alerts(L.windowed(logs)).collect()}
    last = max(w[0] for w in want)
    assert got <= want and {w for w in want if w[0] < last} <= got


def test_errors_of_oversampling_are_raised(spark, monkeypatch):
    monkeypatch.setattr(M, "adasyn", lambda *a, **k: [].index(1))
    with pytest.raises(ValueError):
        M.oversampled(spark.createDataFrame([(1, 1.0, 0)], "trans_num long, a double, is_fraud int"), ["a"])


def test_adasyn_and_models(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), 0) for i in range(600)] + [(1000 + i, rng.gauss(1.5, 0.7), rng.gauss(1.5, 0.7), 1) for i in range(30)]
    df = spark.createDataFrame(rows, "trans_num long, a double, b double, is_fraud int")
    more, made_ = M.oversampled(df, ["a", "b"], ratio=0.1)
    n = more.where("is_fraud = 1").count()
    assert made_ and 55 <= n <= 65 and more.where("is_fraud = 0").count() == 600
    new = more.where("trans_num is null").collect()
    low, high = (min(r[1] for r in rows if r[3]), max(r[1] for r in rows if r[3]))
    assert all(low <= r.a <= high for r in new)
    assert M.oversampled(df, ["a", "b"], ratio=0.01)[1] is False
    for kind, settings in (("gbt", {"maxIter": 5, "maxDepth": 3}), ("rf", {"numTrees": 5, "maxDepth": 3})):
        model = M.train(more, ["a", "b"], kind=kind, scale=kind == "rf", **settings)
        rates = E.confusion(M.score(model, df), "is_fraud", "fraud_probability").first()
        assert rates.recall > 0.5
    assert M.importances(model, ["a", "b"])[0][1] >= 0.4
    registry = M.ModelRegistry(spark, f"{tmp_path}/models")
    assert registry.latest() is None
    name = registry.save(model, {"precision": 0.5, "recall": 0.6}, ["a", "b"])
    loaded, info = registry.load(registry.latest())
    assert info["model_id"] == name and M.score(loaded, df).count() == 630
    assert registry.resolve([f"{tmp_path}/none", f"{tmp_path}/models"]) == f"{tmp_path}/models"
    assert {r.fraud_probability for r in M.score(None, df.limit(3)).collect()} == {0.5}
    df.select("trans_num", "a", "b").write.parquet(f"{tmp_path}/in")
    plain = M.train(more, ["a", "b"], maxIter=2, maxDepth=2)
    monitor.run_scores(spark.readStream.schema("trans_num long, a double, b double").parquet(f"{tmp_path}/in"), plain, f"{tmp_path}/out", f"{tmp_path}/st").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 630
    found = M.weighted(more, df, ["a", "b"], rounds=20)
    assert {r["factor"] for r in found} == {1.0, 0.5, 0.2} and max(r["recall"] for r in found) > 0.5
    assert len(M.importances(plain, ["a", "b"], top=1)) == 1
    best = M.grid(more, df, ["a", "b"], ratios=(0.15,), configs=("balanced",), rounds=2)
    assert best[0]["config"] == "balanced"


def test_registered_queries(spark):
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 50
    assert entry.entry(spark).columns
    path = sinks.write_dataset(found["dataset_summary"](spark, DATA), "/tmp/ledgerlens-test", form="csv")
    assert spark.read.option("header", True).csv(path).count() == 1
