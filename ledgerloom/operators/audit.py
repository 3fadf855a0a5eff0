"""The retained answer log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.snapshots import latest_per_key
from ledgerloom.sources.zones import Zones

# How long a record is kept.
RETENTION_DAYS = 400
INDEXED = ("outcome", "agent", "engine", "provider", "model_id", "refused")
BULKY = ("preview", "trace")
#: Later than any expiry.
NEVER = 2**62


def _payload(columns: list[str], *, trimmed: bool) -> Column:
    fields = [F.array().alias(c) if trimmed and c in BULKY else F.col(c) for c in columns]
    if trimmed:
        fields.append(F.lit(True).alias("truncated_for_retention"))
    return F.to_json(F.struct(*fields))


def answer_records(
    answers: DataFrame, *, ttl_days: int = RETENTION_DAYS, max_payload_bytes: int | None = None
) -> DataFrame:
    """Answers shaped for retention: JSON payload, indexed fields, expiry.

    Payload and question are kept whole. A caller whose store limits the size of a record
    names that limit; a larger payload then loses its bulky parts rather than the record,
    and ``trimmed`` says so. ``asked_at`` is taken from the answer, so the same input
    always gives the same record.
    """
    full = _payload(answers.columns, trimmed=False)
    oversized = F.lit(False) if max_payload_bytes is None else F.octet_length("__full") > max_payload_bytes
    expiry = F.unix_seconds(F.col("asked_at").cast("timestamp")) + ttl_days * 86_400
    question = ["question"] if "question" in answers.columns else []
    return answers.withColumn("__full", full).select(
        "trace_id",
        F.col("asked_at").cast("string").alias("asked_at"),
        expiry.alias("expires_at"),
        F.when(oversized, _payload(answers.columns, trimmed=True)).otherwise(F.col("__full")).alias("payload"),
        oversized.alias("trimmed"),
        *question,
        *[F.col(c) for c in INDEXED if c in answers.columns],
    )


def append_answers(records: DataFrame, path: str) -> None:
    """Append to the log, partitioned by day so that expiry drops whole folders."""
    day = F.to_date(F.left("asked_at", F.lit(10)))
    records.withColumn("asked_on", day).write.mode("append").partitionBy("asked_on").parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_answers(log: DataFrame) -> DataFrame:
    """The newest record of every trace id."""
    return latest_per_key(log, ["trace_id"], ["asked_at", "payload"])


def latest_answer(log: DataFrame, trace_id: str) -> DataFrame:
    """One trace: the filter reaches the scan, then a top-1."""
    return log.filter(F.col("trace_id") == trace_id).orderBy(F.col("asked_at").desc()).limit(1)


def recent_answers(log: DataFrame, limit: int = 20) -> DataFrame:
    """The newest answers without their payload, newest first."""
    slim = log.drop("payload")
    return slim.orderBy(F.col("asked_at").desc(), F.col("trace_id")).limit(max(1, limit))


def answers_per_trace(log: DataFrame) -> DataFrame:
    return log.groupBy("trace_id").agg(F.count(F.lit(1)).alias("answers"))


def drop_expired(spark: SparkSession, path: str, now_epoch: int, *, grace_seconds: int = 0) -> list[str]:
    """Delete the day folders in which every record expired at least ``grace_seconds`` ago; returns the days.

    Records of one day may have different expiries, so the latest of a day decides; a record without an expiry keeps its
    day. A day that is only partly expired stays as it is and ``unexpired`` hides its expired records, so no kept record
    is ever rewritten and a killed call loses nothing: the next one drops what is left. Readers filter with ``unexpired``;
    with a grace longer than the longest read, no open reader needs a dropped file. One row per day reaches the driver.
    """
    zones = Zones(spark, path)
    if not zones.has_files(path):
        return []
    kept = F.max(F.coalesce("expires_at", F.lit(NEVER)))
    by_day = read_answers(spark, path).groupBy(F.col("asked_on").cast("string").alias("day")).agg(kept.alias("last"))
    days = sorted(r["day"] for r in by_day.filter(F.col("last") <= now_epoch - grace_seconds).collect() if r["day"])
    for day in days:
        zones.drop_folder(f"{path.rstrip('/')}/asked_on={day}")
    return days


def unexpired(log: DataFrame, now_epoch: int) -> DataFrame:
    return log.filter(F.col("expires_at") > now_epoch)
