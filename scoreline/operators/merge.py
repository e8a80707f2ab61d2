"""Insert-only merge and backfill of the prediction log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.functions import columns as C

KEY = ("customer_id", "processed_ts")


def message_to_row(df: DataFrame, field=F.col, present: Sequence[str] | None = None) -> DataFrame:
    """Prediction messages (all text) to typed log rows.

    Adds the struct `row` and `row_error`: rows without id, probability or label cannot be
    stored, and the caller quarantines them.
    """
    have = set(df.columns if present is None else present)

    def get(*names: str) -> Column:
        texts = [F.nullif(field(n).cast("string"), F.lit("")) for n in names if n in have]
        return F.coalesce(*texts, F.lit(None).cast("string"))

    typed = {
        "customer_id": get("customerID", "customer_id"),
        "churn_probability": C.strict_double(get("churn_probability")),
        "prediction": get("prediction"),
        "actual_churn": C.ground_truth_int(get("actual_churn")),
        "event_ts": C.parse_timestamp(get("event_ts")),
        "processed_ts": C.parse_timestamp(get("processed_ts")),
        "model_source": get("model_source"),
        "model_version": get("model_version"),
        "contract": get("Contract", "contract"),
    }
    needed = ("customer_id", "churn_probability", "prediction")
    row = F.struct(*[v.alias(k) for k, v in typed.items()])
    error = F.coalesce(
        *[F.when(F.col("row")[c].isNull(), F.lit(f"unusable {c}")) for c in needed]
    )
    return df.withColumn("row", row).withColumn("row_error", error)


def log_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The storable rows of message_to_row(), under their table names."""
    return df.where(F.col("row_error").isNull()).select(*keep, "row.*")


def _with_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key as one struct. Null fields of a struct compare equal, so one equi-join serves."""
    return df.withColumn("__key", F.struct(*key))


def last_of_batch(df: DataFrame, arrival: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """The last arrival per key; planned as a group limit ahead of the shuffle."""
    return _last(_with_key(df, key), arrival).drop("__key")


def _last(keyed: DataFrame, arrival: Sequence[str]) -> DataFrame:
    order = Window.partitionBy("__key").orderBy(*[F.col(c).desc() for c in arrival])
    ranked = keyed.withColumn("__rank", F.row_number().over(order))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def new_rows(
    batch: DataFrame, existing: DataFrame, arrival: Sequence[str], key: Sequence[str] = KEY
) -> DataFrame:
    """Rows to append: the batch's last row per key, minus keys the log already has.

    Null timestamps compare equal, so a row without one is stored once per customer. Ranking and
    join use the same key column: the batch is shuffled once for both.
    """
    fresh = _last(_with_key(batch, key), arrival)
    have = _with_key(existing.select(*key), key).select("__key")
    return fresh.join(have, "__key", "left_anti").drop("__key")


def backfill(
    log: DataFrame,
    source: DataFrame,
    column: str = "contract",
    key: str = "customer_id",
    arrival: Sequence[str] = (),
) -> DataFrame:
    """Fills null cells of `column` from the newest known value in `source`.

    Only the null rows take part in the join. The lookup has one row per key, so a customer
    with very many null rows is a one-sided skew that adaptive execution splits.
    """
    known = source.where(F.col(column).isNotNull())
    order = F.struct(*[F.col(c) for c in arrival]) if arrival else F.lit(0)
    lookup = known.groupBy(key).agg(F.max_by(column, order).alias("__known"))
    filled = (
        log.where(F.col(column).isNull())
        .join(lookup, key, "left")
        .withColumn(column, F.col("__known"))
        .select(*log.columns)
    )
    return log.where(F.col(column).isNotNull()).unionByName(filled)
