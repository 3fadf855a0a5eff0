"""Periodic snapshots: newest row per key, and slowly changing versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN_END = "9999-12"


def _descending(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence[str]) -> DataFrame:
    """One row per key: the newest by ``newest_first`` (later names break ties).

    The rank filter lets Spark put a group limit in front of the exchange, so each
    map task ships at most one row per key, however many rows one key holds.
    """
    rank = "__newest_rank"
    order = W.partitionBy(*keys).orderBy(*_descending(newest_first))
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)


def latest_delivery(df: DataFrame, keys: Sequence[str], newest_first: Sequence[str], used: Sequence[str]) -> DataFrame:
    """``latest_per_key`` without a random survivor: a key delivered twice in one batch keeps its later delivery, as far
    as ``df`` knows deliveries, and then the greater values of the columns ``used`` afterwards (those that exist). Rows
    still equal are equal in everything the caller reads."""
    known = [c for c in ("_ingested_at", "_source_file", *used) if c in df.columns]
    return latest_per_key(df, keys, [*newest_first, *known])


def drop_redelivered(df: DataFrame, hash_column: str = "_record_hash", batch: str = "_batch_id") -> DataFrame:
    """Keep the newest delivery of every record, told apart by its natural-key hash."""
    ties = [c for c in ("_ingested_at", "_source_file") if c in df.columns]
    return latest_per_key(df, [hash_column], [batch, *ties])


def version_history(
    snapshots: DataFrame,
    key: str,
    batch: str,
    tracked: Sequence[str],
    *,
    collapse: bool = True,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """SCD2 versions out of periodic snapshots.

    A version starts where there is no earlier snapshot, where any tracked attribute
    differs from the previous snapshot (NULL-safe), or where the first tracked
    attribute was NULL before. Attributes that are not tracked stay as they were when
    the version began. ``collapse`` first reduces repeated deliveries of one
    ``(key, batch)`` to one, which bounds every window group by the number of batches.
    All windows share one partitioning and one ordering: one exchange, one sort.
    """
    if collapse:
        snapshots = latest_per_key(snapshots, [key, batch], list(tie_break) or [batch])
    history = W.partitionBy(key).orderBy(batch)
    lead = tracked[0]
    changed = F.lag(lead).over(history).isNull()
    for name in tracked:
        changed = changed | ~F.col(name).eqNullSafe(F.lag(name).over(history))
    running = history.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        snapshots.withColumn("__starts", changed.cast("int"))
        .withColumn("version_no", F.sum("__starts").over(running))
        .filter(F.col("__starts") == 1)
        .withColumn("__next", F.lead(batch).over(history))
        .withColumn("valid_from_batch", F.col(batch))
        .withColumn("valid_to_batch", F.coalesce("__next", F.lit(OPEN_END)))
        .withColumn("is_current", F.col("__next").isNull())
        .drop("__starts", "__next", batch)
    )


def current_versions(history: DataFrame) -> DataFrame:
    return history.filter(F.col("is_current"))
