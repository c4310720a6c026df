"""Distribution drift between a baseline and a comparison table.

All features are tested on one table: values are unpivoted to (feature, value,
side), counted per distinct value and written in ranges of values with their
running counts. Profiles, quantiles, Kolmogorov-Smirnov and rank sums all
follow from these, so no task holds a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.columns import chisq_p, erfc, ks_exact, ks_p
from ledgerlens.functions.ranges import running
from ledgerlens.sources.scratch import Scratch

P_LIMIT, MAX_CATEGORIES, TINY = 0.05, 50, 1e-8
#: Samples of up to so many values get exact Kolmogorov-Smirnov p-values.
EXACT_VALUES = 10_000


@dataclass(frozen=True)
class MonitoringConfig:
    """Fixed defaults of a monitoring set-up."""

    daily_hours: int = 24
    weekly_days: int = 7
    high_drift_percentage: float = 50.0
    medium_drift_percentage: float = 25.0
    low_drift_percentage: float = 10.0
    p_limit: float = P_LIMIT


def few_values(df: DataFrame, columns: list[str], most: int = MAX_CATEGORIES) -> DataFrame:
    """column and n of distinct values that aren't null, counted up to most + 1: a task hands on no more of a column, in one pass over df."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, set] = {c: set() for c in columns}
        for b in batches:
            for c in columns:
                if len(found[c]) <= most:
                    found[c] |= set(b.column(c).unique().to_pylist()[: most + 2])
                    found[c].discard(None)
        rows = [(c, v) for c in columns for v in sorted(found[c])[: most + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["column", "value"])

    values = df.select(*columns).mapInArrow(seen, "column string, value string").dropDuplicates()
    return values.groupBy("column").agg(F.least(F.count(F.lit(1)), F.lit(most + 1)).alias("n"))


def monitored_features(df: DataFrame) -> DataFrame:
    """feature, kind and distinct values: every numeric column, and text columns of at most 50 values."""
    numeric = [c for c, k in df.dtypes if k in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    text = [c for c, k in df.dtypes if k == "string"]
    rows = [df.sparkSession.createDataFrame([(c, "numeric", None) for c in numeric], "feature string, kind string, n_values long")]
    if text:
        counts = _all_features(df, text).join(few_values(df, text), F.col("feature") == F.col("column"), "left")
        n = F.coalesce("n", F.lit(0).cast("long"))
        rows.append(counts.where(n <= MAX_CATEGORIES).select("feature", F.lit("categorical").alias("kind"), n.alias("n_values")))
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def long_form(df: DataFrame, features: list[str], kind: str = "double") -> DataFrame:
    """(feature, value) rows without nulls and NaN."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in features])
    rows = df.select(F.inline(parts)).where("value is not null")
    return rows.where(~F.isnan("value")) if kind == "double" else rows


def two_sided(base: DataFrame, other: DataFrame, features: list[str], kind: str = "double") -> DataFrame:
    """Per feature and distinct value: how often it occurs in the baseline (a) and the comparison (b)."""
    both = long_form(base, features, kind).withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(long_form(other, features, kind).withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    return both.groupBy("feature", "value").agg(F.sum("a").cast("long").alias("a"), F.sum("b").cast("long").alias("b"))


def counted(base: DataFrame, other: DataFrame, features: list[str]) -> DataFrame:
    """two_sided() with running counts a_upto, b_upto and totals a_all, b_all of each feature, written."""
    return running(two_sided(base, other, features), ["feature"], "value", ["a", "b"])


def profile_of(counts: DataFrame, side: str = "a") -> DataFrame:
    """Mean, deviation, quartiles and range of features on one side of counted()."""
    v, n, upto, whole = F.col("value"), F.col(side), F.col(f"{side}_upto"), F.col(f"{side}_all")
    own = counts.where(n > 0)

    def at(place):
        return F.max(F.when((upto - n <= place) & (place < upto), v))

    def quantile(q, name):
        place = (whole - 1) * F.lit(q)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return (low + F.max(place - F.floor(place)) * (high - low)).alias(name)

    one = own.groupBy("feature").agg(F.sum(n).alias("n"), (F.sum(v * n) / F.sum(n)).alias("mean"), quantile(0.5, "median"), quantile(0.25, "q25"), quantile(0.75, "q75"), F.min(v).alias("min"), F.max(v).alias("max"))
    mean = one.select(F.col("feature").alias("of"), F.col("mean").alias("m"))  # a row per feature
    spread = own.join(mean, F.col("feature") == F.col("of")).groupBy("feature").agg(F.when(F.sum(n) > 1, F.sqrt(F.sum(n * (v - F.col("m")) * (v - F.col("m"))) / (F.sum(n) - 1))).alias("std"))
    return one.join(spread, "feature").select("feature", "n", "mean", "std", "median", "q25", "q75", "min", "max")


def profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, deviation, quartiles and range of features."""
    return profile_of(counted(df, df.limit(0), features))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values, nulls left out."""
    own = df.where(F.col(column).isNotNull())
    by = own.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by.join(F.broadcast(own.agg(F.count(F.lit(1)).alias("__all"))), F.lit(True)).withColumn("share", F.col("n") / F.col("__all").cast("double")).drop("__all")  # one row


def _ks_columns() -> list[Column]:
    apart = F.abs(F.try_divide(F.col("a_upto").cast("double"), F.col("a_all")) - F.try_divide(F.col("b_upto").cast("double"), F.col("b_all")))
    return [F.max(apart).alias("statistic"), F.first("a_all").alias("n_base"), F.first("b_all").alias("n_other")]


def _with_ks(df: DataFrame, exact: bool) -> DataFrame:
    p = ks_p(F.col("statistic"), F.col("n_base"), F.col("n_other"))
    if exact:
        small = F.greatest("n_base", "n_other") <= EXACT_VALUES
        run_exact = F.pandas_udf(ks_exact, "double")
        p = F.coalesce(run_exact(F.when(small, F.col("statistic")), F.col("n_base"), F.col("n_other")), p)  # a row per feature
    return df.withColumn("p_value", p)


def ks(base: DataFrame, other: DataFrame, features: list[str], counts: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p-value per feature: asymptotic, or exact where both samples are of at most EXACT_VALUES."""
    run = counted(base, other, features) if counts is None else counts
    return _with_ks(run.groupBy("feature").agg(*_ks_columns()), exact)


def _rank_columns() -> list[Column]:
    """Sums that Mann-Whitney follows from: r (ranks of the baseline), n, m and ties."""
    t = F.col("a") + F.col("b")
    rank = F.col("a_upto") + F.col("b_upto") - t + (t + 1) / 2
    t_ = t.cast("decimal(19,0)")
    return [F.sum(F.col("a") * rank).alias("r"), F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum((t_ * t_ * t_ - t_).cast("decimal(38,0)")).cast("double").alias("ties")]


def _ranked() -> tuple[Column, Column, Column]:
    """u, z and the p-value of _rank_columns()."""
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    u = F.col("r") - n * (n + 1) / 2
    sigma = F.sqrt(n * m / 12 * ((n + m + 1) - F.col("ties") / ((n + m) * (n + m - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n * m / 2) - 0.5, F.lit(0.0)), sigma)
    return u, z, F.when(z.isNull(), 1.0).otherwise(erfc(z / F.sqrt(F.lit(2.0))))


def mann_whitney(base: DataFrame, other: DataFrame, features: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Two-sided Mann-Whitney U with tie and continuity corrections."""
    run = counted(base, other, features) if counts is None else counts
    u, z, p = _ranked()
    return run.groupBy("feature").agg(*_rank_columns()).select("feature", u.alias("u"), z.alias("z"), p.alias("p_value"))


def numeric_summary(counts: DataFrame, exact: bool = False) -> DataFrame:
    """Per feature of counted(): statistic, p_value, mw (the Mann-Whitney p-value), and mean and deviation of both sides (m0, s0, m1, s1), in two passes."""
    v = F.col("value")
    own = lambda c, x: F.sum(F.when(F.col(c) > 0, x))
    means = [F.try_divide(own(c, v * F.col(c)), F.sum(c)).alias(m) for c, m in (("a", "m0"), ("b", "m1"))]
    one = _with_ks(counts.groupBy("feature").agg(*_ks_columns(), *_rank_columns(), *means), exact)
    one = Scratch(counts.sparkSession, "drift").keep(one.withColumn("mw", _ranked()[2]), "features")  # a row per feature
    off = lambda c, m: F.when(F.sum(c) > 1, F.sqrt(F.try_divide(own(c, F.col(c) * (v - F.col(m)) * (v - F.col(m))), F.sum(c) - 1)))
    spread = counts.join(one.select(F.col("feature").alias("of"), "m0", "m1"), F.col("feature") == F.col("of")).groupBy("feature").agg(off("a", "m0").alias("s0"), off("b", "m1").alias("s1"))
    return one.join(spread, "feature").where("n_base > 0 and n_other > 0")


def chi_square(base: DataFrame, other: DataFrame, features: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Goodness of fit of the comparison's categories to the baseline's shares; one category cannot drift."""
    whole = W.partitionBy("feature")
    own = two_sided(base, other, features, "string") if counts is None else counts
    aligned = own.withColumns({"na": F.sum("a").over(whole), "nb": F.sum("b").over(whole)})
    e = F.col("a").cast("double") / F.col("na") * F.col("nb") + TINY
    o = F.col("b").cast("double") + TINY
    done = aligned.where("na > 0 and nb > 0").groupBy("feature").agg(F.sum((o - e) * (o - e) / e).alias("statistic"), F.count(F.lit(1)).alias("k"))
    return done.withColumn("p_value", chisq_p(F.col("statistic"), F.col("k") - 1)).withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))


def new_categories(base: DataFrame, other: DataFrame, features: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Values of the comparison that the baseline lacks."""
    return (two_sided(base, other, features, "string") if counts is None else counts).where("a = 0").select("feature", "value")


#: Fixed: recommendations for a numeric feature by its statistic, and for a categorical one.
HIGH, MODERATE, LOW, NO_DRIFT = "Consider immediate model retraining.", "Schedule model validation.", "Monitor closely.", "No significant drift detected."
NEW_VALUES, CHANGED, NO_ACTION, NO_TEST = "New categories detected: ", "Monitor category distribution changes", "No action needed", "Unable to perform the test: no values to compare"


def _numeric_advice(d: Column, drifted: Column, info: Column) -> Column:
    level = F.when(d > 0.3, F.concat(F.lit("High drift detected. "), info, F.lit(HIGH))).when(d > 0.15, F.concat(F.lit("Moderate drift detected. "), info, F.lit(MODERATE))).otherwise(F.concat(F.lit("Low drift detected. "), info, F.lit(LOW)))
    return F.when(drifted, level).otherwise(NO_DRIFT)


def _all_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, features))).alias("feature"))


def feature_drift(base: DataFrame, other: DataFrame, numeric: list[str], categorical: list[str], p_limit: float = P_LIMIT, detailed: bool = True, exact: bool = True) -> DataFrame:
    """One row per feature: drift_detected, drift_score, drift_type, test_statistic, p_value, recommendation.

    A feature without values on one side has not drifted: score and statistic 0, p 1.
    """
    parts = []
    none, p = F.lit(""), F.coalesce("p_value", F.lit(1.0))
    statistic = F.coalesce("statistic", F.lit(0.0))
    if numeric:
        n = numeric_summary(counted(base, other, numeric), exact)
        n = _all_features(base, numeric).join(n, "feature", "left")
        shift, ratio = F.abs(F.col("m1") - F.col("m0")) / (F.col("s0") + TINY), F.col("s1") / (F.col("s0") + TINY)
        info = F.concat(
            F.when(F.col("mw") < p_limit, F.format_string("Distribution shift detected (MW p=%.4f). ", F.col("mw"))).otherwise(none),
            F.when(shift > 2, F.format_string("Significant mean shift: %.2f std devs. ", shift)).otherwise(none),
            F.when((ratio > 2) | (ratio < 0.5), F.format_string("Variance change detected: %.2fx baseline. ", ratio)).otherwise(none),
        ) if detailed else none
        drifted = p < p_limit
        advice = F.when(F.col("statistic").isNull(), NO_TEST).otherwise(_numeric_advice(statistic, drifted, info))
        parts.append(n.select("feature", drifted.alias("drift_detected"), statistic.alias("drift_score"), F.lit("distributional").alias("drift_type"), statistic.alias("test_statistic"), p.alias("p_value"), advice.alias("recommendation")))
    if categorical:
        both = Scratch(base.sparkSession, "drift").keep(two_sided(base, other, categorical, "string"), "categories")
        new = new_categories(base, other, categorical, both).groupBy("feature").agg(F.slice(F.array_sort(F.collect_set("value")), 1, 5).alias("new"))
        c = chi_square(base, other, categorical, both).join(new, "feature", "left")
        c = _all_features(base, categorical).join(c, "feature", "left")
        drifted = p < p_limit
        advice = F.when(F.col("statistic").isNull(), NO_TEST).when(F.col("new").isNotNull(), F.concat(F.lit(NEW_VALUES), F.array_join("new", ", "), F.lit(". Consider retraining."))).when(drifted, CHANGED).otherwise(NO_ACTION)
        parts.append(c.select("feature", drifted.alias("drift_detected"), (1 - p).alias("drift_score"), F.lit("categorical").alias("drift_type"), statistic.alias("test_statistic"), p.alias("p_value"), advice.alias("recommendation")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def severity(features: Column, drifted: Column, score: Column) -> Column:
    share = F.try_divide(drifted.cast("double"), features)
    return F.when(features == 0, "unknown").when(drifted == 0, "none").when((share > 0.5) | (score > 0.3), "high").when((share > 0.25) | (score > 0.15), "medium").otherwise("low")


def drift_report(results: DataFrame) -> DataFrame:
    """The roll-up of feature_drift(): features, drifted, drift_percentage, mean_score, severity, recommendations."""
    d, s = F.col("drift_detected"), F.col("drift_score")
    of = lambda kind: F.count_if(d & (F.col("drift_type") == kind)).alias(kind)
    one = results.agg(F.count(F.lit(1)).alias("features"), F.count_if(d).alias("drifted"), F.avg(F.when(d, s)).alias("mean_score"), F.slice(F.array_sort(F.collect_list(F.when(d & (s > 0.3), F.col("feature")))), 1, 3).alias("top"), F.count_if(d & (s > 0.15) & (s <= 0.3)).alias("medium"), of("categorical"), of("distributional"))
    one = one.withColumn("drift_percentage", F.coalesce(F.try_divide(F.col("drifted") * 100.0, F.col("features")), F.lit(0.0)))
    pc = F.col("drift_percentage")
    advice = F.array_compact(F.array(
        F.when(pc > 50, "CRITICAL: Over 50% of features show drift. Immediate model retraining required.").when(pc > 25, "HIGH: Significant drift detected. Schedule model validation and potential retraining.").when(pc > 10, "MEDIUM: Some drift detected. Increase monitoring frequency."),
        F.when(F.size("top") > 0, F.concat(F.lit("Priority features for immediate attention: "), F.array_join("top", ", "))),
        F.when(F.col("medium") > 0, F.concat(F.lit("Monitor closely: "), F.col("medium").cast("string"), F.lit(" features showing moderate drift"))),
        F.when(F.col("categorical") > 0, "Categorical drift detected - check for new data sources or encoding changes"),
        F.when(F.col("distributional") > 0, "Distributional drift detected - validate data processing pipeline"),
        F.when(F.col("drifted") == 0, "No significant drift detected. Continue normal monitoring."),
    ))
    return one.select("features", "drifted", "drift_percentage", F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), severity(F.col("features"), F.col("drifted"), F.col("mean_score")).alias("severity"), advice.alias("recommendations"))


def drift_by_period(base: DataFrame, other: DataFrame, period: str, features: list[str], categorical: list[str] | None = None) -> DataFrame:
    """KS of every period of the comparison against the baseline: one job over (period, feature), not a loop; for categorical features categories_by_period().

    Between two values of a period its distribution is level, so the largest
    distance to the baseline's is at its own values or just below them. The
    baseline's running counts there are those of one table of all values, so
    the baseline is not repeated for each period.
    """
    scratch = Scratch(base.sparkSession, "periods")
    rows = other.select(F.col(period).alias("period"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))).where("value is not null and not isnan(value)")
    after = scratch.keep(rows.groupBy("period", "feature", "value").agg(F.count(F.lit(1)).alias("c")), "after")
    counts = counted(base, other, features).select(F.col("feature").alias("of"), F.col("value").alias("v"), "a", "a_upto", "a_all")
    run = running(after, ["period", "feature"], "value", ["c"]).join(counts, (F.col("feature") == F.col("of")) & (F.col("value") == F.col("v")))
    share = lambda x, n: F.try_divide(x.cast("double"), F.col(n))
    here = F.abs(share(F.col("a_upto"), "a_all") - share(F.col("c_upto"), "c_all"))
    below = F.abs(share(F.col("a_upto") - F.col("a"), "a_all") - share(F.col("c_upto") - F.col("c"), "c_all"))
    done = run.groupBy("period", "feature").agg(F.max(F.greatest(here, below)).alias("statistic"), F.first("a_all").alias("na"), F.first("c_all").alias("nb"))
    done = done.select("period", "feature", "statistic", F.coalesce(ks_p(F.col("statistic"), F.col("na"), F.col("nb")) < P_LIMIT, F.lit(False)).alias("drift_detected"))
    return done.unionByName(categories_by_period(base, other, period, categorical).drop("k")) if categorical else done


def categories_by_period(base: DataFrame, other: DataFrame, period: str, features: list[str]) -> DataFrame:
    """Chi-square of every period of the comparison against the baseline's shares, over the categories of either: period, feature, statistic, k, drift_detected."""
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in features]))
    scratch, key = Scratch(base.sparkSession, "periods"), ["period", "feature", "value"]
    own = scratch.keep(other.select(F.col(period).alias("period"), values).where("value is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("b")), "categories")
    known = scratch.keep(base.select(values).where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("a")), "baseline")
    sizes = own.groupBy("period", "feature").agg(F.sum("b").alias("nb")).join(known.groupBy("feature").agg(F.sum("a").alias("na")), "feature")  # a row per period and feature
    # A period has a row for each category of the baseline, and for its own new ones.
    old = sizes.join(known, "feature").join(own, key, "left").select(*key, "a", F.coalesce("b", F.lit(0)).alias("b"), "na", "nb")
    new = own.join(known, ["feature", "value"], "left_anti").join(sizes, ["period", "feature"]).select(*key, F.lit(0).cast("long").alias("a"), "b", "na", "nb")
    e = F.col("a").cast("double") / F.col("na") * F.col("nb") + TINY
    o = F.col("b").cast("double") + TINY
    done = old.unionByName(new).groupBy("period", "feature").agg(F.sum((o - e) * (o - e) / e).alias("statistic"), F.count(F.lit(1)).alias("k"))
    return done.withColumn("drift_detected", F.coalesce(chisq_p(F.col("statistic"), F.col("k") - 1) < P_LIMIT, F.lit(False)))


def drift_trend(periods: DataFrame) -> DataFrame:
    """Trend of the share of drifted features by period: the last three against those before, by a fifth either way."""
    by = periods.groupBy("period").agg((F.count_if("drift_detected") * 100.0 / F.count(F.lit(1))).alias("pc"))
    all_ = by.agg(F.array_sort(F.collect_list(F.struct("period", "pc"))).alias("p")).select(F.transform("p", lambda x: x["pc"]).alias("p"))
    n = F.size("p")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    last, earlier = F.slice("p", -3, 3), F.when(n > 3, F.slice("p", F.lit(1), n - 3)).otherwise(F.slice("p", 1, 1))
    recent, before = F.when(n >= 3, mean(last)), F.when(n >= 3, mean(earlier))
    trend = F.when(n < 3, "insufficient_data").when(recent > before * 1.2, "increasing").when(recent < before * 0.8, "decreasing").otherwise("stable")
    return all_.select(n.cast("long").alias("periods"), F.when(n > 0, mean(F.col("p"))).alias("avg_drift_percentage"), recent.alias("recent"), before.alias("earlier"), trend.alias("trend"))


def drift_counts(periods: DataFrame) -> DataFrame:
    """How many periods each feature drifted in, the most first; those that never did are left out."""
    return periods.groupBy("feature").agg(F.count_if("drift_detected").alias("drifts")).where("drifts > 0").orderBy(F.desc("drifts"), "feature")


class DriftMonitor:
    """A baseline, checked against new datasets."""

    def __init__(self, numeric: list[str], categorical: list[str], config: MonitoringConfig | None = None):
        self.numeric, self.categorical, self.config = numeric, categorical, config or MonitoringConfig()
        self.baseline: DataFrame | None = None
        self.checks = 0

    def initialize(self, baseline: DataFrame) -> None:
        self.baseline = baseline

    def check(self, other: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Feature results and their report."""
        if self.baseline is None:
            raise ValueError("no baseline")
        self.checks += 1
        results = feature_drift(self.baseline, other, self.numeric, self.categorical, self.config.p_limit)
        return results, drift_report(results)

    def status(self) -> dict:
        return {"initialized": self.baseline is not None, "features": len(self.numeric) + len(self.categorical), "checks": self.checks}
