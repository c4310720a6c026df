"""Transaction-risk analytics on Spark: features, evaluation, drift and log analytics as DataFrame operators."""
