"""Landing extracts into bronze: schema drift, provenance columns, holdouts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.zones import Zones

# Source systems and the entities each of them delivers.
SOURCES = {
    "s_crm": ("customers",),
    "s_core": ("accounts", "transactions"),
    "s_loans": ("loans", "repayments"),
    "s_cards": ("cards", "card_transactions"),
    "s_bureau": ("credit_records",),
    "s_payments": ("payment_transactions",),
}
HOLDOUT = "ops.fraud_ground_truth"
KEY_SEPARATOR = "\u0001"


def natural_key_hash(keys: Sequence[str]) -> Column:
    parts = [F.col(k).cast("string") for k in keys]
    return F.xxhash64(F.concat_ws(KEY_SEPARATOR, *parts)).cast("string")


def with_ingest_metadata(
    df: DataFrame,
    *,
    source: str,
    entity: str,
    batch_id: Column | str,
    ingested_at: datetime,
    keys: Sequence[str],
    source_file: Column | str | None = None,
) -> DataFrame:
    """The five provenance columns every bronze row carries.

    ``source_file`` defaults to the file Spark read the row from.
    """
    file_column = F.col("_metadata.file_path") if source_file is None else source_file
    as_column = lambda value: value if isinstance(value, Column) else F.lit(value)
    return df.select(
        *df.columns,
        F.lit(ingested_at).cast("timestamp_ntz").alias("_ingested_at"),
        F.lit(f"{source}/{entity}").alias("_source_system"),
        as_column(file_column).alias("_source_file"),
        as_column(batch_id).alias("_batch_id"),
        natural_key_hash(keys).alias("_record_hash"),
    )


def united(batches: Sequence[DataFrame]) -> DataFrame:
    """Batches of one source with every column any of them has, in alphabetical order."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
    return union.select(*sorted(union.columns))


def read_extracts(spark: SparkSession, folder: str) -> DataFrame:
    """All files of an extract tree; batch folders are only layout and add no column.

    Files may differ in columns. If they also differ in the type of a column (an int that
    became a bigint), Parquet schemas cannot be merged; then each batch folder is read by
    itself and the union takes the wider type.
    """
    read = (
        spark.read.option("recursiveFileLookup", "true")
        .option("mergeSchema", "true")
        .option("pathGlobFilter", "*.parquet")
    )
    try:
        df = read.parquet(folder)
    except Exception as problem:
        batches = Zones(spark, folder).folders()
        if "CANNOT_MERGE_SCHEMAS" not in str(problem) or not batches:
            raise
        return united([read.parquet(batch) for batch in batches])
    return df.select(*sorted(df.columns))


def ingest(zones: Zones, dataset: str, folder: str, *, partition_by: Sequence[str] = ()) -> int:
    """Copy one extract tree verbatim into the lake; returns the rows written."""
    if not zones.folder_exists(folder):
        raise FileNotFoundError(f"source directory {folder} does not exist")
    if not zones.has_files(folder):
        return 0
    return zones.write(dataset, read_extracts(zones.spark, folder), partition_by=partition_by)


def ingest_labels(zones: Zones, landing: str) -> int:
    """Confirmed labels go to ``ops`` only; no product or metric query can name that table."""
    folder = f"{landing}/_holdout/fraud_labels"
    return ingest(zones, HOLDOUT, folder) if zones.folder_exists(folder) else 0


def ingest_new_files(zones: Zones, dataset: str, folder: str, checkpoint: str) -> None:
    """Incremental form: a file stream that takes what is new and then stops."""
    schema = read_extracts(zones.spark, folder).schema
    (
        zones.spark.readStream.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(folder)
        .writeStream.format("parquet")
        .option("path", zones.path(dataset))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
