"""Feature export in long form and sliding activity features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.snapshots import latest_per_key

NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def numeric_columns(df: DataFrame, leave_out: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC and f.name not in leave_out
    ]


def long_features(
    product: DataFrame, key: str = "customer_id", columns: Sequence[str] | None = None, stamp: Column | None = None
) -> DataFrame:
    """One row per key and numeric column; NULL values are not features."""
    names = list(columns) if columns is not None else numeric_columns(product, [key])
    wide = product.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    tall = wide.unpivot([key], names, "feature_name", "value").filter(F.col("value").isNotNull())
    return tall if stamp is None else tall.withColumn("updated_at", stamp)


def merged_features(current: DataFrame, arriving: DataFrame, key: str = "customer_id") -> DataFrame:
    """Upsert: the newest value of every key and feature wins."""
    return latest_per_key(current.unionByName(arriving), [key, "feature_name"], ["updated_at", "value"])


def sliding_activity(
    events: DataFrame,
    key: str,
    *,
    ts: str = "ts",
    amount: str = "amount",
    length: str = "7 days",
    slide: str = "1 day",
) -> DataFrame:
    """Trailing count and sum per key, one row for every slide of the window.

    A finished table is first folded to one row per key and slide, so that only those few
    rows, not every event, are copied to all windows they lie in. A slide begins inside
    the same windows as its events when the length is a multiple of the slide.
    """
    n, total = F.count(F.lit(1)), F.sum(amount)
    if not events.isStreaming:
        step = F.window(F.col(ts), slide)
        events = events.groupBy(step, key).agg(n.alias("__n"), total.alias("__total")).withColumn(ts, F.col("window.start"))
        events, n, total = events.drop("window"), F.sum("__n"), F.sum("__total")
    return (
        events.groupBy(F.window(F.col(ts), length, slide), key)
        .agg(n.alias("txn_count"), total.alias("txn_amount"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            key,
            "txn_count",
            F.round("txn_amount", 2).alias("txn_amount"),
        )
    )
