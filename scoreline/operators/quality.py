"""Rule checks over whole tables. Results are long rows (rule, column_name, violations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.spec import FeatureSpec


def _missing(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    empty = column.isNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        empty = empty | F.isnan(column)
    return empty


def null_profile(df: DataFrame, only_violations: bool = True) -> DataFrame:
    """Null or NaN cells per column, one pass over the table."""
    totals = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in df.columns])
    long = totals.unpivot([], list(df.columns), "column_name", "null_count")
    return long.where("null_count > 0") if only_violations else long


def schema_violations(df: DataFrame, spec: FeatureSpec) -> list[tuple[str, str, str]]:
    """Missing columns and wrong types. Reads the schema only, runs no job."""
    have = {f.name: f.dataType for f in df.schema.fields}
    found = []
    for field in spec.clean_schema().fields:
        if field.name not in have:
            found.append(("missing_column", field.name, field.dataType.simpleString()))
        elif have[field.name] != field.dataType:
            found.append(("wrong_type", field.name, have[field.name].simpleString()))
    return found


def quality_report(df: DataFrame, spec: FeatureSpec, min_rows: int = 100) -> DataFrame:
    """Every rule with its number of violations, from one scan and one shuffle on the id.

    The counters are pre-summed per id on the map side, so a frequent id travels as one row
    per task; the rows beyond the first of an id are its duplicates.
    """
    tests: dict[tuple[str, str], Column] = {
        ("not_null", c): _missing(df, c) for c in df.columns if c != spec.id
    }
    if spec.target in df.columns:
        allowed = F.col(spec.target).isin(0, 1)
        tests["domain", spec.target] = ~F.coalesce(allowed, F.lit(False))
    per_id = df.groupBy(F.col(spec.id).alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(test).alias(f"t{i}") for i, test in enumerate(tests.values())],
    )
    totals = per_id.agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.sum(F.col("n") - 1).alias("repeats"),
        *[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(tests))],
    )
    rows = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(column).alias("column_name"),
            F.coalesce(F.col(f"t{i}"), F.lit(0)).cast("bigint").alias("violations"),
        )
        for i, (rule, column) in enumerate(tests)
    ]

    def row(rule: str, column: str, violations: Column) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"),
            F.lit(column).alias("column_name"),
            F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"),
        )

    rows += [
        row("not_null", spec.id, F.col("no_id")),
        row("unique", spec.id, F.col("repeats")),
        row("min_rows", "*", (F.coalesce(F.col("n"), F.lit(0)) < min_rows).cast("bigint")),
    ]
    return totals.select(F.inline(F.array(*rows)))


def violations(df: DataFrame, spec: FeatureSpec, min_rows: int = 100) -> list[str]:
    """All violations as text; the number of rules is fixed by the specification."""
    found = [f"{rule} {column}: {detail}" for rule, column, detail in schema_violations(df, spec)]
    if any(text.startswith("missing_column") for text in found):
        return found
    report = quality_report(df, spec, min_rows).where("violations > 0")
    return found + [f"{r.rule} {r.column_name}: {r.violations}" for r in report.collect()]


def assert_valid(df: DataFrame, spec: FeatureSpec, min_rows: int = 100) -> None:
    found = violations(df, spec, min_rows)
    if found:
        raise ValueError("; ".join(found))


def range_rules(
    df: DataFrame, spec: FeatureSpec, threshold: str | None = None, out: str = "broken_rules"
) -> DataFrame:
    """Names of the range rules each row breaks."""
    rules = {f"{c}_not_negative": F.col(c) >= 0 for c in spec.numeric}
    rules |= {f"{c}_is_0_or_1": F.col(c).isin(0, 1) for c in spec.int_binary}
    if threshold:
        rules[f"{threshold}_in_unit"] = F.col(threshold).between(0.0, 1.0)
    named = F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])
    return df.withColumn(out, F.array_compact(named))
