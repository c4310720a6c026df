"""Sources: transaction, customer, label and log scans, and the bundled tables read as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: names, kinds and default values of the fields of transactions, customers and logs.
TRANSACTION_DEFAULTS = {"merch_lat": 40.7128, "merch_long": -74.006}
CUSTOMER_DEFAULTS = {"gender": "U", "city": "Unknown", "state": "Unknown", "zip": "00000", "job": "Unknown", "dob": "1970-01-01", "city_pop": 100000}
CUSTOMER_SCHEMA = "cc_num long, index int, first string, last string, sex string, street string, city string, state string, zip string, lat double, long double, city_pop int, job string, dob string"
LOG_SCHEMA = (
    "event_type string, endpoint string, system_timestamp string, timestamp string, processing_time_seconds double, prediction string, fraud_probability double, request_data map<string,string>, "
    "training_metrics struct<model_id:string,timestamp:string,performance:struct<precision:double,recall:double,f1_score:double,accuracy:double>,training_duration_seconds:double>, "
    "dataset_info map<string,string>, error_info map<string,string>, _corrupt string"
)
#: Where one JSON object of a file ends and another begins.
OBJECTS = r"(?<=\})\s*\n\s*(?=\{)"


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """df with columns it lacks."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def complete_transactions(df: DataFrame) -> DataFrame:
    """Transactions with unix_time and places, where a source lacks them; 0 for a time that can't be read."""
    if "unix_time" not in df.columns and "trans_date_trans_time" in df.columns:
        df = df.withColumn("unix_time", F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.col("trans_date_trans_time").cast("string"))), F.lit(0)).cast("long"))
    return with_defaults(df, TRANSACTION_DEFAULTS)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def load_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV scan; an empty table if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "trans_num string, trans_date_trans_time timestamp_ntz, cc_num long, merchant string, category string, amt double, unix_time long, merch_lat double, merch_long double")
    df = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return complete_transactions(df)


def complete_customers(df: DataFrame) -> DataFrame:
    """Customers under the key cc_num, with defaults for the demographics they lack."""
    if "credit_card_number" in df.columns and "cc_num" not in df.columns:
        df = df.withColumnRenamed("credit_card_number", "cc_num")
    return with_defaults(df, CUSTOMER_DEFAULTS)


def load_customers(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], CUSTOMER_SCHEMA)
    return complete_customers(spark.read.option("header", True).option("inferSchema", True).csv(path))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """(trans_num, is_fraud) of JSON objects of labels, one or many a file; null, NaN and infinite values are cleaned."""
    if not exists(spark, path):
        return spark.createDataFrame([], "trans_num string, is_fraud int")
    objects = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", OBJECTS)).alias("value"))
    pairs = objects.select(F.explode(F.from_json("value", "map<string,double>", {"allowNonNumericNumbers": "true"})).alias("trans_num", "is_fraud"))
    return pairs.withColumn("is_fraud", clean_label(F.col("is_fraud")))


def clean_label(x: Column) -> Column:
    """0 for null, NaN and infinity; else rounded half to even and held within 0 and 1."""
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, 0).otherwise(F.least(F.greatest(F.rint(F.when(odd, 0.0).otherwise(x)), F.lit(0.0)), F.lit(1.0))).cast("int")


def find_source(spark: SparkSession, folder: str, name: str, suffixes: tuple[str, ...]) -> str | None:
    """The first path in a folder whose name contains a word and has one of the suffixes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*{name}*")
    found = sorted(str(s.getPath()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or [])
    return next((f for f in found if f.endswith(suffixes)), None)


def dataset_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """path, bytes and modified of the files a pattern matches; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def newest_and_oldest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("modified", "path")).alias("newest"), F.min_by("path", F.struct("modified", "path")).alias("oldest"))


def load_logs(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """JSON log events, one or many a file, on a line each or over several lines; malformed ones and those without a system timestamp are left out.

    A file is what a call or a process has appended, and is read whole.
    """
    lines = spark.read.text(pattern, wholetext=True).select(F.explode(F.split("value", OBJECTS)).alias("value"), F.col("_metadata.file_path").alias("file"))
    logs = lines.select(F.from_json("value", LOG_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e"), "file").select("e.*", "file")
    return logs.where("_corrupt is null and system_timestamp is not null").drop("_corrupt").withColumn("ts", F.expr("try_to_timestamp(system_timestamp)").cast("timestamp_ntz")).where("ts is not null")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset as write_dataset() left it, in Parquet, CSV or JSON; LookupError if there is none."""
    for form in ("parquet", "csv", "json"):
        if exists(spark, f"{path}/*.{form}*"):
            reader = spark.read.option("header", True).option("inferSchema", True) if form == "csv" else spark.read
            return reader.format(form).load(path)
    raise LookupError(f"no dataset at {path}")


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """transactions, customers and labels of a folder, found by name; empty tables for what it lacks."""
    find = lambda name, ends: find_source(spark, folder, name, ends) or f"{folder}/none-{name}"
    return {
        "transactions": load_transactions(spark, find("transaction", (".parquet", ".csv"))),
        "customers": load_customers(spark, find("customer", (".csv",))),
        "labels": load_labels(spark, find("fraud", (".json",))),
    }


def unusable_counts(df: DataFrame) -> DataFrame:
    """column, nulls, and infinities of numeric columns."""
    kinds = dict(df.dtypes)
    odd = lambda c: F.count_if(F.abs(F.col(f"`{c}`")) == float("inf")) if kinds[c] in ("double", "float") else F.lit(0).cast("long")
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), odd(c).alias("infinities")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return one.select(F.inline(F.array(*[f"c{i}" for i in range(len(df.columns))])))


def quality_summary(transactions: DataFrame, customers: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, the shares of both labels, the label rate, and status: success, or error with what is missing."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = n(transactions, "transactions").join(n(customers, "customers"), F.lit(True))  # one row each
    y = F.col("is_fraud")
    if "is_fraud" not in labels.columns:
        labels = labels.withColumn("is_fraud", F.lit(None).cast("int"))
    share = lambda v: F.coalesce(F.try_divide(F.count_if(y == v).cast("double"), F.count(y)), F.lit(0.0))
    one = one.join(labels.agg(F.count(F.lit(1)).alias("labels"), share(0).alias("legitimate"), share(1).alias("fraudulent"), F.avg(y).alias("label_rate")), F.lit(True))
    missing = F.concat_ws(", ", *[F.when(F.col(c) == 0, c) for c in ("transactions", "customers", "labels")])
    return one.withColumn("status", F.when(missing == "", "success").otherwise("error")).withColumn("error", F.when(missing != "", F.concat(F.lit("no "), missing)))


def request_row(spark: SparkSession, body: str, schema: str) -> DataFrame:
    """A scoring request, a JSON object, as one row."""
    return spark.createDataFrame([(body,)], "body string").select(F.inline(F.array(F.from_json("body", schema))))


# -- made-up tables ----------------------------------------------------------------------------
def synthetic_features(spark: SparkSession, rows: int = 10_000, seed: int = 42, columns: int = 57, fraud: float = 0.01) -> DataFrame:
    """Log-normal amounts, uniform times and places, and Gaussian features."""
    u = lambda i, a, b: F.lit(a) + F.rand(seed + i) * (b - a)
    base = spark.range(rows).select(
        F.exp(3.5 + 1.5 * F.randn(seed)).alias("amt"), u(1, 1.6e9, 1.7e9).cast("long").alias("unix_time"), u(2, 25.0, 50.0).alias("merch_lat"), u(3, -125.0, -65.0).alias("merch_long"),
        u(4, 1e15, 9e15).cast("long").alias("cc_num"), (F.rand(seed + 5) < fraud).cast("int").alias("is_fraud"), *[F.randn(seed + 10 + i).alias(f"feature_{i + 5}") for i in range(columns)],
    )
    return base


def _pick(values: list[str], seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))


def sample_customers(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        (F.lit(4 * 10**15) + i).alias("cc_num"), i.cast("int").alias("index"), F.format_string("First%d", i).alias("first"), F.format_string("Last%d", i).alias("last"), _pick(["M", "F"], seed).alias("sex"),
        F.format_string("%d Main St", i).alias("street"), _pick(["Austin", "Boston", "Chicago", "Denver"], seed + 1).alias("city"), _pick(["TX", "MA", "IL", "CO"], seed + 1).alias("state"),
        F.lpad((F.floor(F.rand(seed + 2) * 90000) + 10000).cast("string"), 5, "0").alias("zip"), (25 + F.rand(seed + 3) * 25).alias("lat"), (-125 + F.rand(seed + 4) * 60).alias("long"),
        (F.floor(F.rand(seed + 5) * 1e6) + 1000).cast("int").alias("city_pop"), _pick(["Engineer", "Teacher", "Nurse", "Clerk"], seed + 6).alias("job"), F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (F.rand(seed + 7) * 18000).cast("int")), "yyyy-MM-dd").alias("dob"),
    )


def sample_transactions(customers: DataFrame, n: int = 1000, seed: int = 42, until: str = "2024-12-31") -> DataFrame:
    """Transactions of random customers in the year before a day."""
    spark = customers.sparkSession
    cards = customers.count()
    rows = spark.range(n).withColumn("at", F.floor(F.rand(seed) * cards).cast("int"))
    own = customers.select(F.col("index").alias("at"), "cc_num", "first", "last", F.col("sex").alias("gender"), "street", "city", "state", "zip", "lat", "long", "city_pop", "job", "dob")
    seconds = F.unix_timestamp(F.lit(until), "yyyy-MM-dd") - (F.rand(seed + 1) * 365 * 86400).cast("long")
    df = rows.join(own, "at").withColumn("unix_time", seconds)
    return df.select(
        F.format_string("T%06d", "id").alias("trans_num"), F.from_unixtime("unix_time").alias("trans_date_trans_time"), "cc_num", _pick([f"merchant_{i}" for i in range(8)], seed + 2).alias("merchant"),
        _pick(["grocery_pos", "gas_transport", "shopping_net", "food_dining", "entertainment", "health_fitness"], seed + 3).alias("category"), F.round(F.exp(3 + F.randn(seed + 4)), 2).alias("amt"),
        "first", "last", "gender", "street", "city", "state", "zip", "lat", "long", "city_pop", "job", "dob", "unix_time", (F.col("lat") + 0.1 * F.randn(seed + 5)).alias("merch_lat"), (F.col("long") + 0.1 * F.randn(seed + 6)).alias("merch_long"),
    )


def sample_labels(transactions: DataFrame, rate: float = 0.05, seed: int = 42) -> DataFrame:
    return transactions.select("trans_num", (F.rand(seed) < rate).cast("double").alias("is_fraud"))


# -- the bundled tables ------------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as card transactions."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    category = F.when(kind == "purchase", "shopping_net").when(kind == "view", "gas_transport").when(kind == "click", "grocery_pos").when(kind == "signup", "food_dining").otherwise("entertainment")
    return table(spark, sf_dir, "events").withColumn("k", k).select(
        F.col("event_id").alias("trans_num"), F.col("ts").alias("trans_date_trans_time"), F.col("user_id").alias("cc_num"), F.col("k").alias("merchant"), category.alias("category"), F.col("value").alias("amt"),
        (25 + F.pmod(F.col("k") * 7, F.lit(100)) / 4).alias("merch_lat"), (-125 + F.pmod(F.col("k") * 13, F.lit(100)) / 2).alias("merch_long"), F.coalesce((F.col("value") >= 100) & (F.col("k") % 4 == 0), F.lit(False)).cast("int").alias("is_fraud"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"], "left").select(F.col("c_custkey").alias("cc_num"), F.col("c_name").alias("first"), F.col("n_name").alias("state"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("job"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as application logs."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    name = F.when(kind == "error", "system_error").when(kind.isin("purchase", "view"), "prediction_request").when(kind == "click", "dataset_creation").otherwise("model_training")
    endpoint = F.when(kind == "error", None).when(kind.isin("purchase", "view"), "/predict").when(kind == "click", "/create_dataset").otherwise("/train_model")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts"), name.alias("event_type"), endpoint.alias("endpoint"), F.when(kind.isin("purchase", "view", "click"), F.col("value")).alias("processing_time_seconds"),
        F.when(kind == "purchase", "fraudulent").when(kind == "view", "legitimate").alias("prediction"), F.when(kind == "signup", k / 100).alias("precision"), F.when(kind == "signup", F.col("value") / 500).alias("recall"),
    )
