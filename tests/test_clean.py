from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scoreline import TELCO
from scoreline.operators import clean, quality


def raw_row(i: int, **changes):
    row = {
        "customerID": f"line-{i:04d}", "tenure": str(i), "MonthlyCharges": "41.20",
        "TotalCharges": " " if i == 6 else f" {i * 10}.5", "SeniorCitizen": str(i % 2),
        "Partner": "Yes", "Dependents": " No ", "PhoneService": "Yes", "PaperlessBilling": "No",
        "gender": "Female", "MultipleLines": "No phone service", "InternetService": "DSL",
        "OnlineSecurity": "No", "OnlineBackup": "Yes", "DeviceProtection": "No", "TechSupport": "No",
        "StreamingTV": "No", "StreamingMovies": "No", "Contract": "Month-to-month\t",
        "PaymentMethod": "Electronic check", "Churn": "Yes" if i % 4 == 0 else "No",
    }
    return {**row, **changes}


def raw(spark, rows):
    names = TELCO.raw_columns
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], TELCO.raw_schema())


def test_clean_gives_the_declared_schema_without_nulls(spark):
    df = clean.clean(raw(spark, [raw_row(i) for i in range(20)]), TELCO)
    assert [(f.name, f.dataType) for f in df.schema.fields] == [
        (f.name, f.dataType) for f in TELCO.clean_schema().fields
    ]
    rows = {r.customerID: r for r in df.collect()}
    assert rows["line-0006"].TotalCharges == 0.0 and rows["line-0002"].TotalCharges == 20.5
    assert rows["line-0004"].churn == 1 and rows["line-0005"].Dependents == 0
    assert rows["line-0001"].Contract == "Month-to-month"
    assert quality.null_profile(df).count() == 0


@pytest.mark.parametrize(
    "change, error",
    [
        ({"tenure": "abc"}, "tenure: not a number"),
        ({"tenure": "NaN"}, "tenure: not a number"),
        ({"Partner": "Maybe"}, "Partner: expected Yes or No"),
        ({"Churn": "Maybe"}, "churn: expected Yes or No"),
        ({"SeniorCitizen": None}, "SeniorCitizen: not an integer"),
        ({"Contract": None}, "Contract: missing value"),
        ({"customerID": None}, "customerID: missing value"),
    ],
)
def test_bad_rows(spark, change, error):
    df = raw(spark, [raw_row(1), raw_row(2, **change)])
    flagged = clean.clean(df, TELCO, on_error="flag")
    assert [r[0] for r in flagged.where("clean_error is not null").select("clean_error").collect()] == [f"ValueError: {error}"]
    assert clean.clean(df, TELCO, on_error="drop").count() == 1
    with pytest.raises(Exception, match="ValueError"):
        clean.clean(df, TELCO).collect()


def test_scoring_input_fills_absent_columns_only(spark):
    df = clean.clean(raw(spark, [raw_row(1)]), TELCO).drop("OnlineSecurity", "tenure", "Partner")
    one = clean.scoring_input(df, TELCO).first()
    assert (one.OnlineSecurity, one.tenure, one.Partner) == ("No", 0.0, 0)
    assert "churn" not in one.asDict()
    nulls = clean.fill_missing_columns(df.withColumn("Contract", F.lit(None).cast("string")), TELCO)
    assert nulls.first().Contract is None
    filled = clean.fill_missing_columns(nulls, TELCO, fill_nulls=True)
    assert filled.first().Contract == "No"


def test_quality_reports_all_violations(spark):
    good = clean.clean(raw(spark, [raw_row(i) for i in range(120)]), TELCO)
    quality.assert_valid(good, TELCO)
    bad = good.withColumn("tenure", F.when(F.col("customerID") != "line-0007", F.col("tenure")))
    bad = bad.withColumn("churn", F.when(F.col("customerID") == "line-0008", 99).otherwise(F.col("churn")).cast("bigint"))
    bad = bad.unionByName(bad.where("customerID = 'line-0001'"))
    found = quality.violations(bad, TELCO)
    assert found == ["not_null tenure: 1", "domain churn: 1", "unique customerID: 1"]
    assert quality.violations(good.limit(50), TELCO) == ["min_rows *: 1"]
    with pytest.raises(ValueError, match="missing_column tenure"):
        quality.assert_valid(good.drop("tenure"), TELCO)
    assert quality.schema_violations(good.withColumn("tenure", F.col("tenure").cast("int")), TELCO) == [
        ("wrong_type", "tenure", "int")
    ]


def test_quality_of_an_empty_table(spark):
    empty = spark.createDataFrame([], TELCO.clean_schema())
    assert quality.violations(empty, TELCO) == ["min_rows *: 1"]
