"""The application's calls, one after another on made-up sources."""

import pytest

from ledgerlens.service import RiskService
from ledgerlens.sources import sinks
from ledgerlens.sources import tables as S


def test_calls(spark, tmp_path):
    data, storage = f"{tmp_path}/data", f"{tmp_path}/storage"
    service = RiskService(spark, data, storage)
    for call in (service.create_dataset, service.train_model, service.drift_check, lambda: service.predict(spark.range(1))):
        with pytest.raises(LookupError):
            call()
    people = S.sample_customers(spark, 20)
    trades = S.sample_transactions(people, 400)
    people.coalesce(1).write.option("header", True).csv(f"{data}/customer_release.csv")
    trades.write.parquet(f"{data}/transactions_release.parquet")
    sinks.write_labels(S.sample_labels(trades, 0.2), f"{data}/fraud_release.json")
    made = service.create_dataset()
    assert made["rows"] == 400 and 30 < made["frauds"] < 130
    trained = service.train_model(rounds=3, depth=3)
    assert trained["features"] > 40 and 0 <= trained["f1"] <= 1
    again = RiskService(spark, data, storage)
    assert again.health() == {"status": "healthy", "model_loaded": True, "features": trained["features"]}
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = jobs()
    answer = again.predict_one({"amt": 12.5, "cc_num": "7", "merchant": "m"})
    assert jobs() == before  # no Spark job for a request
    batch = again.predict(spark.createDataFrame([(12.5,)], "amt double")).first()
    assert (answer["predict"], answer["confidence"]) == (batch.prediction, pytest.approx(batch.confidence, abs=1e-12))
    assert answer["predict"] in ("fraudulent", "legitimate") and 0.5 <= answer["confidence"] <= 1
    with pytest.raises(ValueError):
        again.predict_one({})
    metrics = again.system_metrics("2100-01-01 00:00:00", 24 * 365 * 100)
    assert metrics["total_events"] == 3 and metrics["event_breakdown"] == {"dataset_creation": 1, "model_training": 1, "prediction_request": 1}
    logged = again.test_logging()
    assert logged["log_dir"] in logged["test_log_created"] and again.system_metrics("2100-01-01 00:00:00", 24 * 365 * 100)["legitimate"] >= 1
    assert again.drift_check()["severity"] == "none" and again.monitoring_status()["checks"] == 1
    table = RiskService(spark, data, f"{tmp_path}/as-csv")
    assert table.create_dataset(form="csv")["rows"] == 400
    assert table.train_model(kind="gbt", maxIter=1, maxDepth=2)["features"] == trained["features"] and table.drift_check()["severity"] == "none"
