"""The batch operators on Structured Streaming sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import conform, features, monitoring
from ledgerloom.session import scratch_path
from ledgerloom.sources.zones import Zones


def read_files(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Parquet files below a folder (or one file) as a stream."""
    folder, _, name = path.rstrip("/").rpartition("/")
    # A glob makes a single file and a folder of files equally valid sources.
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}")


def with_event_time(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Watermarked event time; zone-less timestamps are read as UTC first."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def conformed_card_stream(cards: DataFrame) -> DataFrame:
    """Stateless: the same projection the batch conformation uses."""
    return conform.conform_transactions(conform.card_rail(cards))


def deduplicated(records: DataFrame, ts: str, lateness: str, hash_column: str = "_record_hash") -> DataFrame:
    """Re-delivered records dropped within the lateness bound; state expires with it."""
    return with_event_time(records, ts, lateness).dropDuplicatesWithinWatermark([hash_column])


def alarm_stream(
    calls: DataFrame, keys: Sequence[str], *, ts: str = "ts", lateness: str = "10 minutes", **thresholds
) -> DataFrame:
    """Five-minute alarms; rows later than the bound are dropped."""
    counts = monitoring.alarm_counts(with_event_time(calls, ts, lateness), keys, ts=ts, approximate=True)
    return monitoring.alarms(counts, **thresholds)


def activity_stream(
    events: DataFrame, key: str, *, ts: str = "ts", amount: str = "amount", lateness: str = "1 day", **window
) -> DataFrame:
    return features.sliding_activity(with_event_time(events, ts, lateness), key, ts=ts, amount=amount, **window)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, commit it to Parquet exactly once, and stop."""
    (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def settled(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is available and read the result back.

    Sink and offsets live in the session's durable folder.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    run_available(stream, f"{base}/sink", f"{base}/offsets")
    return spark.read.schema(stream.schema).parquet(f"{base}/sink")


def export_features(stream: DataFrame, path: str, checkpoint: str, key: str = "customer_id") -> None:
    """Feature changes as an append log, one folder per micro-batch.

    A retried batch rewrites its own folder, so the log is exact; readers take the newest
    value of each feature (``read_features``) and no batch rewrites the whole table.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        newest = features.latest_per_key(batch, [key, "feature_name"], ["updated_at", "value"])
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _log_parts(spark: SparkSession, path: str) -> tuple[int, dict[str, int], set[str]]:
    """The newest complete snapshot (or -1), the folders to read, and all folders by batch id."""
    zones = Zones(spark, path)
    numbered = {folder: int(folder.rsplit("=", 1)[1]) for folder in zones.folders() if "=" in folder.rsplit("/", 1)[1]}
    whole = {f: n for f, n in numbered.items() if "/snapshot=" in f and zones.folder_exists(f"{f}/_SUCCESS")}
    newest = max(whole.values(), default=-1)
    current = {f for f, n in whole.items() if n == newest} | {f for f, n in numbered.items() if "/batch=" in f and n > newest}
    return newest, numbered, current


def read_features(spark: SparkSession, path: str, key: str = "customer_id") -> DataFrame:
    """Newest value of every feature: the last snapshot and the batches after it."""
    _, _, parts = _log_parts(spark, path)
    return features.latest_per_key(spark.read.parquet(*sorted(parts)), [key, "feature_name"], ["updated_at", "value"])


def compact_features(spark: SparkSession, path: str, key: str = "customer_id") -> None:
    """Fold the log into one snapshot and drop what it replaces; run it between exports.

    The snapshot counts only once it is complete, so a failed compaction changes nothing.
    """
    newest, numbered, _ = _log_parts(spark, path)
    last = max(numbered.values(), default=-1)
    if last <= newest:
        return
    read_features(spark, path, key).write.mode("overwrite").parquet(f"{path}/snapshot={last}")
    zones = Zones(spark, path)
    for folder, n in numbered.items():
        if ("/batch=" in folder and n <= last) or ("/snapshot=" in folder and n < last):
            zones.drop_folder(folder)
