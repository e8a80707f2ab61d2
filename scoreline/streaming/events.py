"""JSON events: encoding, strict decoding, validation, scoring and routing.

Everything here is a projection over (key, value) rows, so it runs unchanged on a table and on
a micro-batch, in one narrow stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.functions import columns as C
from scoreline.operators.clean import ERROR, typed
from scoreline.spec import FeatureSpec

Scorer = Callable[[DataFrame], DataFrame]
"""Adds a column `probability` to a frame that has the feature columns."""

# Error prefixes and the key of records without one.
JSON_ERROR = "json_parse_error: not valid JSON"
NOT_OBJECT = "ValidationError: event is not a JSON object"
MISSING = "ValidationError: missing required fields: "
OUT_OF_RANGE = "ValueError: probability out of range"
UNKNOWN_KEY = "unknown"

#: Columns that a scorer may add about itself; messages carry them.
LINEAGE = ("model_source", "model_version")

_END = "__scoreline_end"
_JSON_SPACE = " \t\r\n"


def encode(df: DataFrame, key: str, event_ts: Column | None = None) -> DataFrame:
    """Rows to keyed JSON: one object per row, NaN and infinity as null, plus event_ts."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        fields.append(c.alias(f.name))
    stamp = C.iso_second(C.now_second()) if event_ts is None else event_ts
    fields = [c for c, f in zip(fields, df.schema.fields) if f.name != "event_ts"]
    body = F.struct(*fields, stamp.alias("event_ts"))
    return df.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("value"),
    )


def _present(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def decode(df: DataFrame, spec: FeatureSpec, value: str = "value") -> DataFrame:
    """Adds `payload` (all fields as text), and `decode_error`.

    The parser alone would accept text after the object. Read as the first element of an array
    that must end in our own marker, the value has to be exactly one JSON document.
    """
    names = [*spec.required_fields, spec.target_raw, "event_ts"]
    schema = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in [*names, _END]]))
    text = F.col(value).cast("string")
    framed = F.concat(F.lit("["), text, F.lit(f',{{"{_END}":"1"}}]'))
    # One generated row per input row: everything below refers to the parsed document, where a
    # plain column would be parsed again for every expression that is pushed into a filter.
    parsed = df.select("*", F.explode_outer(F.array(F.from_json(framed, schema))).alias("__doc"))
    looks_object = _present(F.btrim(text, F.lit(_JSON_SPACE)).startswith("{"))
    closed = _present((F.size("__doc") == 2) & (F.get("__doc", F.lit(1))[_END] == "1"))
    tested = parsed.withColumn("__is_event", looks_object & closed)
    # Reached only by rows that are no single object.
    loose = F.from_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')), "array<string>")
    is_json = _present((F.size(loose) == 2) & (F.get(loose, F.lit(1)) == _END))
    out = tested.withColumn("payload", F.when(F.col("__is_event"), F.get("__doc", F.lit(0))))
    some_null = F.lit(False)
    for n in spec.required_fields:
        some_null = some_null | F.col("payload")[n].isNull()
    # A field may be null but must be there; keys are listed only for rows with a null field.
    required = F.array(*[F.lit(n) for n in sorted(spec.required_fields)])
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    missing = F.array_except(required, keys)
    missing_text = F.concat(F.lit(MISSING + "['"), F.array_join(missing, "', '"), F.lit("']"))
    error = (
        F.when(~F.col("__is_event") & ~looks_object & is_json, NOT_OBJECT)
        .when(~F.col("__is_event"), JSON_ERROR)
        .when(some_null & (F.size(missing) > 0), missing_text)
    )
    return out.withColumn("decode_error", error).drop("__doc", "__is_event")


def _typed_events(df: DataFrame, spec: FeatureSpec, value: str) -> DataFrame:
    payload = F.col("payload")
    return typed(
        decode(df, spec, value),
        spec,
        source=lambda n: payload[n],
        target="optional",
        also=F.col("decode_error"),
    )


def feature_rows(df: DataFrame, spec: FeatureSpec, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Raw events as typed feature rows, and the rejected events with their error.

    One bad event costs only itself, not the window it came in.
    """
    rows = _typed_events(df, spec, value)
    good = rows.where(F.col(ERROR).isNull()).select(
        F.col("payload")[spec.id].alias(spec.id), *[F.col("typed")[c].alias(c) for c in spec.features]
    )
    bad = rows.where(F.col(ERROR).isNotNull()).select(*df.columns, F.col(ERROR).alias("error"))
    return good, bad


def route(
    df: DataFrame,
    spec: FeatureSpec,
    scorer: Scorer,
    *,
    threshold: float | Column = 0.5,
    processed_ts: Column | None = None,
    value: str = "value",
) -> DataFrame:
    """Every input row once, with either a prediction or an `error`.

    Adds event_key, actual (ground truth or null), event_ts, the features, probability,
    prediction, processed_ts and error (the first rule that failed).
    """
    if isinstance(threshold, float) and not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be in [0, 1], is {threshold}")
    payload = F.col("payload")
    rows = _typed_events(df, spec, value)
    cleaned = rows.select(
        *df.columns,
        payload[spec.id].alias("event_key"),
        C.ground_truth(payload[spec.target_raw]).alias("actual"),
        payload["event_ts"].alias("event_ts"),
        *[F.col("typed")[c].alias(c) for c in spec.features],
        F.col(ERROR).alias("row_error"),
    )
    scored = scorer(cleaned)
    p = F.col("probability")
    in_range = _present(p.between(0.0, 1.0) & ~F.isnan(p))
    error = F.coalesce(F.col("row_error"), F.when(~in_range, OUT_OF_RANGE))
    stamp = C.now_second() if processed_ts is None else processed_ts
    routed = scored.withColumn("error", error)
    ok = F.col("error").isNull()
    return routed.withColumns(
        {
            "prediction": F.when(ok, C.threshold_label(p, threshold)),
            "probability": F.when(ok, p),
            "processed_ts": stamp,
        }
    ).drop("row_error")


def predictions(
    routed: DataFrame, spec: FeatureSpec, include_ground_truth: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The accepted rows as prediction messages (probability rounded, label from the full value)."""
    actual = F.col("actual") if include_ground_truth else F.lit(None).cast("string")
    segment = [F.col(spec.segment)] if spec.segment else []
    lineage = [c for c in LINEAGE if c in routed.columns]
    return routed.where(F.col("error").isNull()).select(
        *keep,
        F.col("event_key").alias(spec.id),
        C.round_half_even(F.col("probability"), 4).alias("churn_probability"),
        "prediction",
        "event_ts",
        C.iso_second(F.col("processed_ts")).alias("processed_ts"),
        actual.alias("actual_churn"),
        *segment,
        *lineage,
    )


def encode_predictions(messages: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Keyed JSON of prediction messages; the ground truth is left out where there is none."""
    plain = [c for c in messages.columns if c not in ("actual_churn", spec.segment)]
    always = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
    labelled = F.to_json(F.struct(*plain, "actual_churn"), {"ignoreNullFields": "false"})
    value = F.when(F.col("actual_churn").isNull(), always).otherwise(labelled)
    return messages.select(F.col(spec.id).alias("key"), value.alias("value"))


def dead_letters(routed: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rejected rows with their original text kept as it came."""
    return routed.where(F.col("error").isNotNull()).select(
        *keep,
        F.coalesce(F.nullif(F.col("event_key"), F.lit("")), F.lit(UNKNOWN_KEY)).alias("key"),
        F.col(value).cast("string").alias("original"),
        "error",
        C.iso_second(F.col("processed_ts")).alias("failed_ts"),
    )


def counts() -> list[Column]:
    """consumed, predicted and dead_lettered of routed rows."""
    return [
        F.count(F.lit(1)).alias("consumed"),
        F.count_if(F.col("error").isNull()).alias("predicted"),
        F.count_if(F.col("error").isNotNull()).alias("dead_lettered"),
    ]


def counters(routed: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """consumed, predicted and dead_lettered."""
    return routed.groupBy(*groups).agg(*counts())
