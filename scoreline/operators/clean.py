"""Typing and cleaning of raw tables. All projections: no shuffle, no action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.functions import columns as C
from scoreline.spec import FeatureSpec

ERROR = "clean_error"


def strip_strings(df: DataFrame) -> DataFrame:
    """Strip every string column, leave the others alone."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: C.strip(F.col(c)) for c in texts})


def typed(
    df: DataFrame, spec: FeatureSpec, source=F.col, target: str = "required", also: Column | None = None
) -> DataFrame:
    """Adds the struct `typed` (cleaned columns) and `clean_error` (first broken rule or null).

    `source` turns a column name into the raw column, so that tables and parsed events share
    the rules. `target` is "required", "optional" (null counts as No) or "absent". `also` is an
    error that goes before the rules.

    Stripping, reading and checking are projections of their own: each cell is stripped and
    read once, however often the result is tested. The result is generated as one row per row,
    which keeps a filter on the error from being evaluated on the raw cells again.
    """
    raw = {c: source(c) for c in spec.features}
    if target != "absent":
        word = source(spec.target_raw)
        raw[spec.target] = F.coalesce(word, F.lit("No")) if target == "optional" else word
    numbers = [*spec.numeric, *spec.int_binary]
    texts = df.select(
        "*", *[C.strip(c.cast("string")).alias(f"__text_{n}") for n, c in raw.items()]
    )
    read = texts.select(
        "*", *[C.text_to_double(F.col(f"__text_{n}")).alias(f"__number_{n}") for n in numbers]
    )
    cells: dict[str, Column] = {}
    reasons: dict[str, str] = {}
    for n in spec.numeric:
        value = C.null_if_nan(F.col(f"__number_{n}"))
        if n in spec.lenient:
            cells[n] = F.coalesce(value, F.lit(0.0))
        else:
            cells[n], reasons[n] = value, "not a number"
    for n in spec.yes_no:
        cells[n], reasons[n] = C.text_to_flag(F.col(f"__text_{n}")), "expected Yes or No"
    if target != "absent":
        flag = C.text_to_flag(F.col(f"__text_{spec.target}"))
        cells[spec.target], reasons[spec.target] = flag, "expected Yes or No"
    for n in spec.int_binary:
        cells[n], reasons[n] = C.double_to_whole(F.col(f"__number_{n}")), "not an integer"
    for n in spec.categorical:
        cells[n], reasons[n] = F.col(f"__text_{n}"), "missing value"
    checked = read.select(*df.columns, *[c.alias(f"__cell_{n}") for n, c in cells.items()])
    error = F.coalesce(
        *([also] if also is not None else []),
        *[
            F.when(F.col(f"__cell_{n}").isNull(), F.lit(f"ValueError: {n}: {reason}"))
            for n, reason in reasons.items()
        ],
    )
    row = F.struct(
        F.struct(*[F.col(f"__cell_{n}").alias(n) for n in cells]).alias("typed"), error.alias(ERROR)
    )
    return checked.select(*df.columns, F.inline(F.array(row)))


def clean(df: DataFrame, spec: FeatureSpec, on_error: str = "raise") -> DataFrame:
    """Raw table to typed table without nulls.

    on_error: "raise" fails the job at the first bad row, "flag" keeps every row and adds
    `clean_error`, "drop" keeps the good rows only (quarantine the others with "flag").
    """
    if on_error not in ("raise", "flag", "drop"):
        raise ValueError(f"unknown on_error: {on_error}")
    keyed = df.withColumn(spec.id, C.strip(F.col(spec.id).cast("string")))
    no_id = F.when(F.col(spec.id).isNull(), F.lit(f"ValueError: {spec.id}: missing value"))
    rows = typed(keyed, spec)
    order = [f.name for f in spec.clean_schema().fields if f.name != spec.id]
    out = rows.select(
        spec.id,
        *[F.col("typed")[c].alias(c) for c in order],
        F.coalesce(F.col(ERROR), no_id).alias(ERROR),
    )
    if on_error == "flag":
        return out
    if on_error == "drop":
        return out.where(F.col(ERROR).isNull()).drop(ERROR)
    # The check rides on the id so that column pruning cannot remove it.
    checked = F.when(F.col(ERROR).isNull(), F.col(spec.id)).otherwise(F.raise_error(F.col(ERROR)))
    return out.withColumn(spec.id, checked).drop(ERROR)


def project_features(df: DataFrame, spec: FeatureSpec, keep_id: bool = True) -> DataFrame:
    """The feature columns in canonical order; everything else is dropped."""
    head = [spec.id] if keep_id and spec.id in df.columns else []
    return df.select(*head, *spec.features)


def column_defaults(spec: FeatureSpec) -> dict[str, Column]:
    """What a feature counts as where it wasn't given."""
    return (
        {c: F.lit(0.0) for c in spec.numeric}
        | {c: F.lit(0).cast("bigint") for c in spec.binary}
        | {c: F.lit("No") for c in spec.categorical}
    )


def fill_missing_columns(df: DataFrame, spec: FeatureSpec, fill_nulls: bool = False) -> DataFrame:
    """Absent columns get a default; null cells only when asked for."""
    defaults = column_defaults(spec)
    new = {c: v for c, v in defaults.items() if c not in df.columns}
    if fill_nulls:
        new |= {c: F.coalesce(F.col(c), v) for c, v in defaults.items() if c in df.columns}
    return df.withColumns(new) if new else df


def scoring_input(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """What a scorer may see: id and features, never a target that came along."""
    return project_features(fill_missing_columns(df.drop(spec.target, spec.target_raw), spec), spec)
