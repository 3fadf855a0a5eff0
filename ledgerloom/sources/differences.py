"""Locating what differs between two deliveries, through a two-level tree of fingerprints.

A delivery is kept in one folder per key bucket, with a small table of one summary (rows, XOR and sum of row hashes) per
bucket; a group summary adds up the buckets of a group. Two deliveries are compared from the top: groups first, then the
buckets of unequal groups, and only the folders of unequal buckets are opened. Equal buckets cost no read at all.

Memory: a summary table has at most ``buckets`` rows; keys are folded map-side before they meet, so a key may have any
number of rows. A hot bucket is split among tasks when it is written. Keys may be NULL; NULL equals NULL. Row order and
column order do not matter; a column that only one delivery has makes all its keys differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerloom.sources.manifest import SUM_MODULUS
from ledgerloom.sources.zones import Zones

BUCKET, HASH = "_bucket", "_row_hash"


@dataclass(frozen=True)
class KeptDelivery:
    """A delivery stored as ``dataset``, and its summaries as ``<dataset>__tree``."""

    zones: Zones
    dataset: str
    #: The key columns with their types.
    key_types: StructType
    buckets: int = 1024
    #: Buckets of one group.
    fan: int = 32

    @property
    def keys(self) -> list[str]:
        return self.key_types.names

    def tree(self) -> DataFrame:
        """(bucket, group, rows, x, s): one row per bucket that has rows."""
        return self.zones.read(f"{self.dataset}__tree", merge_schema=False)

    def folders(self, buckets: Sequence[int]) -> DataFrame:
        """Keys and row hashes of these buckets; no other folder is listed or opened."""
        root, spark = self.zones.path(self.dataset), self.zones.spark
        found = [path for b in buckets if self.zones.folder_exists(path := f"{root}/{BUCKET}={b}")]
        if not found:
            return spark.createDataFrame([], StructType([*self.key_types.fields, StructField(HASH, LongType())]))
        return spark.read.option("basePath", root).parquet(*found).select(*self.keys, HASH)


def keep_delivery(
    zones: Zones, dataset: str, df: DataFrame, keys: Sequence[str], *, buckets: int = 1024, fan: int = 32
) -> KeptDelivery:
    """Store a delivery by key bucket, then its summaries, read from what was written."""
    hashed = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    # A NULL key leaves its hash unchanged, which only puts it into a bucket like any other.
    dealt = df.withColumns({HASH: hashed, BUCKET: F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})
    kept = KeptDelivery(zones, dataset, df.select(*keys).schema, buckets, fan)
    zones.write(dataset, dealt.hint("rebalance", F.col(BUCKET)), partition_by=[BUCKET])
    stored = zones.read(dataset, merge_schema=False) if zones.exists(dataset) else dealt
    leaves = stored.groupBy(F.col(BUCKET).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(HASH).alias("x"), F.sum(F.pmod(HASH, F.lit(SUM_MODULUS))).alias("s")
    )
    group = F.floor(F.col("bucket") / fan).cast("int").alias("group")
    zones.write(f"{dataset}__tree", leaves.select("bucket", group, "rows", "x", "s").coalesce(1))
    return kept


def _unequal(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose summed summaries differ, with the rows on both sides. XOR over both sides is zero if they agree."""
    sides = before.withColumn("__sign", F.lit(-1)).unionByName(after.withColumn("__sign", F.lit(1)))
    folded = sides.groupBy(*keys).agg(
        F.sum(F.when(F.col("__sign") < 0, F.col("rows")).otherwise(0)).alias("rows_before"),
        F.sum(F.when(F.col("__sign") > 0, F.col("rows")).otherwise(0)).alias("rows_after"),
        F.bit_xor("x").alias("__x"),
        F.sum(F.col("__sign") * F.col("s")).alias("__s"),
    )
    differs = (F.col("rows_before") != F.col("rows_after")) | (F.col("__x") != 0) | (F.col("__s") != 0)
    return folded.filter(differs).drop("__x", "__s")


def unequal_buckets(before: KeptDelivery, after: KeptDelivery) -> list[int]:
    """The buckets that differ; at most ``buckets`` numbers."""
    if (before.keys, before.buckets, before.fan) != (after.keys, after.buckets, after.fan):
        raise ValueError("deliveries are comparable only with the same keys, buckets and fan")
    groups = [r["group"] for r in _unequal(before.tree(), after.tree(), ["group"]).select("group").collect()]
    if not groups:
        return []
    near, far = (d.tree().filter(F.col("group").isin(groups)) for d in (before, after))
    return sorted(r["bucket"] for r in _unequal(near, far, ["bucket"]).select("bucket").collect())


def differing_keys(before: KeptDelivery, after: KeptDelivery) -> DataFrame:
    """One row per key that was added, removed or changed, with its rows before and after."""
    buckets, keys = unequal_buckets(before, after), before.keys

    def rows(delivery: KeptDelivery) -> DataFrame:
        return delivery.folders(buckets).select(
            *keys, F.lit(1).cast("long").alias("rows"), F.col(HASH).alias("x"), F.pmod(HASH, F.lit(SUM_MODULUS)).alias("s")
        )

    change = F.when(F.col("rows_before") == 0, "added").when(F.col("rows_after") == 0, "removed").otherwise("changed")
    return _unequal(rows(before), rows(after), keys).select(*keys, change.alias("change"), "rows_before", "rows_after")
