"""The given tables in the roles the operators work on. Pure projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.functions import columns as C
from scoreline.operators import metrics
from scoreline.spec import FeatureSpec

CUSTOMERS = FeatureSpec(
    id="customerID",
    target_raw="Churn",
    target="churn",
    numeric=("tenure", "MonthlyCharges", "TotalCharges"),
    int_binary=("SeniorCitizen",),
    yes_no=("PaperlessBilling",),
    categorical=("Contract", "Region"),
    lenient=("TotalCharges",),
    segment="Contract",
)

CURRENT_FROM = "2024-01-16"
TIEBREAK = ("event_id",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_predictions(table(spark, sf_dir, "events"))


def as_predictions(e: DataFrame) -> DataFrame:
    """events as a prediction log: many scores per customer, many equal scores."""
    p = F.least(F.col("value"), F.lit(100.0)) / 100.0
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id",
        F.col("user_id").cast("string").alias("customer_id"),
        p.alias("churn_probability"),
        C.threshold_label(p).alias("prediction"),
        (k >= 50).cast("bigint").alias("actual_churn"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("processed_ts"),
        F.when(k % 7 != 0, F.concat(F.lit("v"), k % 5)).alias("model_version"),
        F.col("event_type").alias("contract"),
    )


def windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions before and from the cut day."""
    p = predictions(spark, sf_dir)
    cut = F.lit(CURRENT_FROM).cast("timestamp")
    return p.where(F.col("processed_ts") < cut), p.where(F.col("processed_ts") >= cut)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clean row per customer that has orders.

    Orders are summed per customer first, so the join moves one row per customer. Prices are
    summed as whole cents: the result does not depend on the order of the rows.
    """
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    sums = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("tenure"),
            F.sum(cents).alias("cents"),
            F.count(F.lit(1)).alias("n"),
            F.max("o_orderdate").alias("last_order"),
        )
    )
    mean_cents = F.expr("(2 * cents + n) div (2 * n)")
    per_customer = sums.withColumns(
        {"MonthlyCharges": mean_cents / 100.0, "TotalCharges": F.col("cents") / 100.0}
    )
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    joined = (
        table(spark, sf_dir, "customer")
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.col("c_custkey").cast("string").alias("customerID"),
        "tenure",
        "MonthlyCharges",
        "TotalCharges",
        (F.col("c_acctbal") < 0).cast("bigint").alias("SeniorCitizen"),
        (F.col("c_acctbal") > 5000).cast("bigint").alias("PaperlessBilling"),
        F.col("c_mktsegment").alias("Contract"),
        F.col("r_name").alias("Region"),
        (F.col("last_order") < F.lit("2000-10-01").cast("timestamp_ntz")).cast("bigint").alias("churn"),
    )


def _cents(c: Column) -> Column:
    """A double with two decimals as text that every engine reads back to the same double."""
    return F.concat(F.round(c * 100).cast("bigint").cast("string"), F.lit("e-2"))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as it would arrive in a file: text, padding, blanks and some bad cells."""
    c = customers(spark, sf_dir)
    key = F.col("customerID").cast("bigint")

    def word(test: Column) -> Column:
        return F.when(test, "Yes").otherwise("No")

    return c.select(
        F.when(key % 3 == 0, F.concat(F.lit("  "), "customerID", F.lit("\t")))
        .otherwise(F.col("customerID"))
        .alias("customerID"),
        F.when(key % 101 == 100, "abc")
        .otherwise(F.concat(F.lit(" "), F.col("tenure").cast("bigint").cast("string")))
        .alias("tenure"),
        _cents(F.col("MonthlyCharges")).alias("MonthlyCharges"),
        F.when(key % 11 == 0, " ")
        .when(key % 13 == 0, "n/a")
        .when(key % 17 == 0, "NaN")
        .otherwise(_cents(F.col("TotalCharges")))
        .alias("TotalCharges"),
        F.when(key % 103 != 102, F.col("SeniorCitizen").cast("string")).alias("SeniorCitizen"),
        F.when(key % 107 == 106, "Maybe")
        .otherwise(F.concat(F.lit(" "), word(F.col("PaperlessBilling") == 1)))
        .alias("PaperlessBilling"),
        F.concat(F.lit(" "), "Contract", F.lit("\t\n")).alias("Contract"),
        F.col("Region"),
        F.concat(word(F.col("churn") == 1), F.lit("　")).alias("Churn"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def as_messages(e: DataFrame) -> DataFrame:
    """events as JSON text on a topic, some of it broken in known ways."""
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    fields = [
        F.col("user_id").cast("string").alias("customerID"),
        k.alias("tenure"),
        F.col("value").alias("MonthlyCharges"),
        F.when(i % 11 == 0, F.lit(" ")).otherwise(F.lit("12.5")).alias("TotalCharges"),
        (k % 2).alias("SeniorCitizen"),
        F.when(i % 79 == 0, "Maybe").when(k % 3 == 0, "Yes").otherwise("No").alias("PaperlessBilling"),
        F.col("event_type").alias("Contract"),
        F.concat(F.lit("R"), F.col("user_id") % 5).alias("Region"),
        F.when(k >= 50, "Yes").otherwise("No").alias("Churn"),
        C.iso_second(F.col("ts")).alias("event_ts"),
    ]
    whole = F.to_json(F.struct(*fields))
    partly = F.to_json(F.struct(*[f for n, f in enumerate(fields) if n not in (1, 7)]))
    text = (
        F.when(i % 97 == 0, F.concat(whole, F.lit(" trailing")))
        .when(i % 89 == 0, partly)
        .when(i % 83 == 0, F.lit("[1, 2]"))
        .otherwise(whole)
    )
    return e.select("event_id", F.col("user_id").cast("string").alias("key"), text.alias("value"))


def score_from_charges(df: DataFrame) -> DataFrame:
    """A scorer whose result every engine can recompute; above 100 it leaves the range."""
    return df.withColumn("probability", F.col("MonthlyCharges") / 100.0)


#: Columns that some scoring files lack.
OPTIONAL = ("TotalCharges", "SeniorCitizen", "Region")


def score_from_profile(df: DataFrame) -> DataFrame:
    """A scorer that reads a numeric, a binary and a categorical column; whole 64ths, so that every
    engine gets the same double."""
    steps = F.pmod(F.col("tenure").cast("bigint"), F.lit(32)) + 16 * F.col("SeniorCitizen")
    steps = steps + F.when(F.col("Region") == "No", 8).otherwise(F.char_length("Region") % 8)
    return df.withColumn("probability", F.least(steps, F.lit(64)) / 64.0)


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score that depends on their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    p = F.least(F.col("n_chars"), F.lit(10_000).cast("bigint")) / 10_000.0
    return joined.select(
        "doc_id", F.col("quality").cast("bigint").alias("y"), p.alias("p"),
        (p >= 0.1).cast("bigint").alias("predicted"),
    )


def _with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("processed_ts", "yyyy-MM-dd"))


def drift_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drift history: each day's contracts and labels against the whole log."""
    p = _with_day(predictions(spark, sf_dir))
    cells = p.groupBy("day", "contract").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == "Yes").alias("yes")
    )
    per_day = cells.groupBy("day").agg(F.sum("n").alias("day_n"), F.sum("yes").alias("day_yes"))
    per_contract = cells.groupBy("contract").agg(F.sum("n").alias("all_n"))
    whole = cells.agg(F.struct(F.sum("n").alias("n"), F.sum("yes").alias("yes"))).scalar()
    c, r = F.col("n") / F.col("day_n"), F.col("all_n") / F.col("w.n")

    def row(feature: Column, kind: str, name: str, value: Column, limit: float) -> Column:
        return F.struct(
            feature.alias("feature_name"),
            F.lit(kind).alias("drift_type"),
            F.lit(name).alias("statistic_name"),
            F.round(value, 6).alias("statistic_value"),
            F.lit(limit).alias("threshold"),
            (F.round(value, 6) >= limit).alias("is_drifted"),
        )

    expected = F.col("day_n") * r
    features = (
        cells.join(per_day, "day")
        .join(per_contract, "contract")
        .withColumn("w", whole)
        .select(
            "day",
            F.inline(
                F.array(
                    row(F.col("contract"), "data", "psi", (c - r) * F.log(c / r), 0.005),
                    row(F.col("contract"), "data", "ks", F.abs(c - r), 0.03),
                    row(F.col("contract"), "data", "chi_square",
                        F.pow(F.col("n") - expected, F.lit(2.0)) / expected, 3.0),
                )
            ),
        )
    )
    cy, ry = F.col("day_yes") / F.col("day_n"), F.col("w.yes") / F.col("w.n")
    psi = (cy - ry) * F.log(cy / ry) + (ry - cy) * F.log((1 - cy) / (1 - ry))
    overall = per_day.withColumn("w", whole).select(
        "day",
        F.inline(F.array(row(F.lit(None).cast("string"), "prediction", "psi", psi, 0.002))),
    )
    return features.unionByName(overall).withColumnRenamed("day", "computed_at")


def performance_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A performance report per day."""
    p = _with_day(predictions(spark, sf_dir))
    y = F.col("actual_churn")
    cells = metrics.classification_metrics(p, y, (F.col("prediction") == "Yes").cast("int"), ["day"])
    areas = metrics.roc_auc(p, y, F.col("churn_probability"), ["day"])
    auc = F.round("roc_auc", 6)
    return cells.join(areas, "day").select(
        F.col("day").alias("computed_at"),
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("sample_size"),
        *[F.round(c, 6).alias(c) for c in metrics.METRICS],
        auc.alias("roc_auc"),
        F.lit(True).alias("has_ground_truth"),
        (auc < 0.5).alias("degraded"),
        F.concat(F.lit("area "), C.four_digits(auc)).alias("reason"),
        F.lit(0.55).alias("baseline_roc_auc"),
        F.lit(0.05).alias("degradation_tolerance"),
    )


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """performance_metrics rows: one per day and metric."""
    return performance_reports(spark, sf_dir).unpivot(
        ["computed_at", "sample_size"], [*metrics.METRICS, "roc_auc"], "metric_name", "metric_value"
    )


def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _with_day(predictions(spark, sf_dir))
    return p.groupBy(F.col("day").alias("computed_at")).agg(F.count(F.lit(1)).alias("records_processed"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every customer of the log as a model version, its scores as the run's metric history."""
    e = table(spark, sf_dir, "events")
    run = F.concat(F.lit("run-"), F.col("user_id"))
    listed = e.groupBy("user_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    version = listed.select(F.col("user_id").alias("version"), run.alias("run_id"))
    history = e.select(
        run.alias("run_id"),
        F.col("event_id").alias("step"),
        (F.least(F.col("value"), F.lit(100.0)) / 100.0).alias("value"),
    )
    ends = listed.agg(F.min("user_id").alias("production"), F.max("user_id").alias("staging"))
    aliases = ends.unpivot([], ["production", "staging"], "alias", "version")
    return version, history, aliases
