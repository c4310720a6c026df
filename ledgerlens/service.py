"""The application's calls as functions: health, predict, create_dataset, train_model, system_metrics, drift_check, monitoring_status.

Each returns a plain dictionary. There is no HTTP server here; a caller that
wants one wraps these. Errors are raised: ValueError for a bad request,
LookupError where a dataset or model is missing.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import boosting as B
from ledgerlens.operators import drift as D
from ledgerlens.operators import evaluation as E
from ledgerlens.operators import features as X
from ledgerlens.operators import learning as M
from ledgerlens.operators import logs as L
from ledgerlens.operators.trees import TreeModel, from_pipeline
from ledgerlens.sources import sinks
from ledgerlens.sources import tables as S
from ledgerlens.sources.logstore import LogStore

#: Cards with more rows than a task should hold.
HOT_ROWS = 2_000_000


class RiskService:
    """Sources in data_dir; datasets, models, logs and reports below storage_dir."""

    def __init__(self, spark: SparkSession, data_dir: str, storage_dir: str, threshold: float = 0.5):
        self.spark, self.data, self.storage, self.threshold = spark, data_dir, storage_dir, threshold
        self.registry, self.logs = M.ModelRegistry(spark, f"{storage_dir}/models"), LogStore(spark, f"{storage_dir}/logs")
        self.monitor: D.DriftMonitor | None = None
        self.model, self.features, self.trees = None, [], None
        if name := self.registry.latest():
            self._use(name)

    def _use(self, name: str) -> None:
        model, info = self.registry.load(name)
        self._take(model, info["features"])

    def _take(self, model, features: list[str]) -> None:
        """Uses a model; as plain trees for single requests, if it has that form."""
        self.model, self.features = model, features
        try:
            self.trees = model if isinstance(model, TreeModel) else from_pipeline(model)
        except ValueError:
            self.trees = None

    def _log(self, kind: str, **fields) -> None:
        sinks.append_logs(self.spark, [sinks.log_event(kind, **fields)], f"{self.storage}/logs")

    def health(self) -> dict:
        return {"status": "healthy", "model_loaded": self.model is not None, "features": len(self.features)}

    def create_dataset(self, fallback: str = "zero", form: str = "parquet") -> dict:
        """Joins and engineers the sources into a dataset version."""
        find = lambda name, ends: S.find_source(self.spark, self.data, name, ends)
        trades = find("transaction", (".parquet", ".csv"))
        if trades is None:
            raise LookupError("no transactions")
        df, people, labels = S.load_transactions(self.spark, trades), find("customer", (".csv",)), find("fraud", (".json",))
        if dict(df.dtypes)["trans_date_trans_time"] != "timestamp_ntz":
            df = df.withColumn("trans_date_trans_time", F.col("trans_date_trans_time").cast("timestamp_ntz"))
        df = X.join_labels(df, S.load_labels(self.spark, labels) if labels else None, fallback)
        if people:
            df = X.join_customers(df, S.load_customers(self.spark, people))
        path = sinks.write_dataset(X.engineered(df, hot_rows=HOT_ROWS), f"{self.storage}/datasets", form=form)
        summary = X.dataset_summary(S.load_dataset(self.spark, path)).first().asDict()
        self._log("dataset_creation", dataset_info={k: str(v) for k, v in summary.items()})
        return {"path": path, **summary}

    def datasets(self) -> list[str]:
        return sinks.versions(self.spark, f"{self.storage}/datasets")

    def train_model(self, ratio: float = 0.03, seed: int = 42, kind: str = "aggressive", **settings) -> dict:
        """Trains on the latest dataset, evaluates on exact stratified shares, saves and uses the model.

        kind: a configuration of boosting.CONFIGS, changed by settings; or gbt or rf, Spark ML's boosted trees and forest, with their settings.
        """
        found = self.datasets()
        if not found:
            raise LookupError("no dataset")
        df = S.load_dataset(self.spark, found[-1])
        if "is_fraud" not in df.columns:
            raise ValueError("the dataset has no label")
        features = X.feature_columns(df)
        rows = E.stratified_split(df.select("trans_num", "is_fraud", *features), "trans_num", "is_fraud", seed=seed)
        train, test = rows.where("not is_test").drop("is_test"), rows.where("is_test").drop("is_test")
        train, made = M.oversampled(train, features, ratio=ratio, seed=seed)
        if kind in B.CONFIGS:
            model = B.train(train, features, settings=replace(B.CONFIGS[kind], seed=seed, **settings))
        else:
            model = M.train(train, features, kind=kind, seed=seed, **settings)
        rates = E.requirement_gate(E.confusion(M.score(model, test), "is_fraud", "fraud_probability", self.threshold)).first().asDict()
        name = self.registry.save(model, rates, features)
        self._take(model, features)
        self._log("model_training", training_metrics={"model_id": name, "performance": {"precision": rates["precision"], "recall": rates["recall"], "f1_score": rates["f1"], "accuracy": rates["accuracy"]}})
        return {"model_id": name, "oversampled": made, "features": len(features), **rates}

    def predict(self, rows: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
        """Decisions for rows. Features that they lack are 0, or those of profiles (per cc_num), if given."""
        if self.model is None:
            raise LookupError("no model")
        if not rows.columns:
            raise ValueError("empty request")
        if profiles is not None:
            rows = rows.join(profiles.select("cc_num", *[c for c in profiles.columns if c not in rows.columns]), "cc_num", "left")
        return M.score(self.model, E.default_fill(rows, self.features), self.threshold)

    def predict_one(self, request: dict) -> dict:
        """One request, answered and logged; of a model of trees on the driver, without a Spark job."""
        if not request:
            raise ValueError("empty request")
        if self.model is None:
            raise LookupError("no model")
        began = datetime.now(timezone.utc)
        if self.trees:
            p = self.trees.probability_one(request)
            fraud = self.trees.margin_one(request) > self.trees.limit(self.threshold)
            said, sure = ("fraudulent", p) if fraud else ("legitimate", 1 - p)
        else:
            row = {k: float(v) for k, v in request.items() if k in self.features and v is not None}
            r = self.predict(self.spark.createDataFrame([row or {"amt": 0.0}])).first()
            p, said, sure = r.fraud_probability, r.prediction, r.confidence
        seconds = (datetime.now(timezone.utc) - began).total_seconds()
        self._log("prediction_request", request_data={k: str(v) for k, v in request.items()}, prediction=said, fraud_probability=p, processing_time_seconds=seconds)
        return {"predict": said, "confidence": sure, "fraud_probability": p, "features_used": len(self.features)}

    def test_logging(self) -> dict:
        """Writes a prediction event and says where."""
        event = sinks.log_event("prediction_request", request_data={"test": "data"}, prediction="legitimate", fraud_probability=0.1, processing_time_seconds=0.005)
        path = sinks.append_logs(self.spark, [event], f"{self.storage}/logs")
        return {"logger_exists": True, "log_dir": f"{self.storage}/logs", "test_log_created": path, "current_time": event["system_timestamp"]}

    def system_metrics(self, as_of: str, hours: int = 24) -> dict:
        since = datetime.fromisoformat(as_of) - timedelta(hours=hours)
        own = L.recent(self.logs.read(since.isoformat(sep=" ")), as_of, hours)
        return L.metrics(own).first().asDict() | L.usage_maps(own).first().asDict()

    def drift_check(self) -> dict:
        """The newest dataset against the oldest."""
        found = self.datasets()
        if not found:
            raise LookupError("no dataset")
        base, other = S.load_dataset(self.spark, found[0]), S.load_dataset(self.spark, found[-1])
        kinds = {r.feature: r.kind for r in D.monitored_features(base).collect()}
        self.monitor = self.monitor or D.DriftMonitor([f for f, k in kinds.items() if k == "numeric"], [f for f, k in kinds.items() if k == "categorical"])
        self.monitor.initialize(base)
        results, report = self.monitor.check(other)
        rows = [r.asDict() for r in results.collect()]  # a row per feature
        one = report.first().asDict()
        sinks.write_report(results, f"{self.storage}/drift/{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}")
        return one | {"summary": sinks.drift_summary(one, rows)}

    def monitoring_status(self) -> dict:
        return self.monitor.status() if self.monitor else {"initialized": False, "features": 0, "checks": 0}
