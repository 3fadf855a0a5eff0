"""Stored states that take in one new snapshot at a time, without reading the old ones again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.snapshots import OPEN_END, latest_per_key, version_history
from ledgerloom.sources.zones import Zones

LIFE = ("version_no", "valid_from_batch", "valid_to_batch", "is_current")


def merge_versions(open_versions: DataFrame, snapshot: DataFrame, key: str, batch: str, tracked: Sequence[str]) -> DataFrame:
    """What the open versions become when the snapshot of a later ``batch`` arrives: open rows and newly closed ones.

    ``open_versions`` has one row per key, ``snapshot`` one row per key it knows. As every change of a tracked attribute
    starts a version, an open version still shows the attributes of its key's last snapshot, so comparing with it is
    comparing with that snapshot (and a NULL in the first tracked attribute still forces a new version). Keys that the
    snapshot lacks stay as they are. One join of key-sized tables.
    """
    values = sorted({*open_versions.columns, *snapshot.columns} - {*LIFE, key})
    known = open_versions.select(F.col(key), F.struct(*open_versions.columns).alias("__was"))
    news = snapshot.select(F.col(key), F.struct(*snapshot.columns).alias("__new"))
    was, new = F.col("__was"), F.col("__new")
    starts = new.isNotNull() & (was.isNull() | was[tracked[0]].isNull())
    for name in tracked:
        starts = starts | (new.isNotNull() & ~new[name].eqNullSafe(was[name]))
    kinds = {**{f.name: f.dataType for f in snapshot.schema.fields}, **{f.name: f.dataType for f in open_versions.schema.fields}}

    def row(source: Column, known_columns: Sequence[str], life: dict[str, Column]) -> Column:
        carried = [
            (source[c] if c in known_columns else F.lit(None)).cast(kinds[c]).alias(c) for c in values
        ]
        return F.struct(F.col(key).alias(key), *carried, *[life[c].alias(c) for c in LIFE])

    closed = row(
        was,
        open_versions.columns,
        {
            "version_no": was["version_no"].cast("long"),
            "valid_from_batch": was["valid_from_batch"],
            "valid_to_batch": F.when(F.col("__starts"), F.lit(batch)).otherwise(F.lit(OPEN_END)),
            "is_current": ~F.col("__starts"),
        },
    )
    opened = row(
        new,
        snapshot.columns,
        {
            "version_no": F.coalesce(was["version_no"], F.lit(0)).cast("long") + 1,
            "valid_from_batch": F.lit(batch),
            "valid_to_batch": F.lit(OPEN_END),
            "is_current": F.lit(True),
        },
    )
    joined = known.join(news, key, "full").withColumn("__starts", F.coalesce(starts, F.lit(False)))
    both = F.array_compact(F.array(F.when(was.isNotNull(), closed), F.when(F.col("__starts"), opened)))
    return joined.select(F.inline(both))


def merge_latest(state: DataFrame, snapshot: DataFrame, keys: Sequence[str], newest_first: Sequence[str]) -> DataFrame:
    """The newest row per key of a state that already is one row per key, and a new snapshot."""
    return latest_per_key(state.unionByName(snapshot, allowMissingColumns=True), keys, newest_first)


def key_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class VersionStore:
    """An SCD2 history in two tables, so that a new batch neither reads nor writes versions closed before it.

    Open versions are laid out by key bucket; closed versions by key bucket and the batch that closed them. ``apply``
    reads the open versions of the snapshot's buckets, rewrites these and adds one folder of closed versions per bucket.
    An older batch that arrives late or again goes through ``rebuild``, which derives the buckets of its keys anew.
    """

    def __init__(self, zones: Zones, dataset: str, key: str, tracked: Sequence[str], buckets: int = 64) -> None:
        self.zones, self.dataset, self.key, self.tracked, self.buckets = zones, dataset, key, tuple(tracked), buckets
        self.open, self.closed = f"{dataset}__open", f"{dataset}__closed"

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", key_bucket(self.key, self.buckets))

    def _read(self, dataset: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        if not self.zones.exists(dataset):
            return None
        df = self.zones.read(dataset, merge_schema=True)
        return df if buckets is None else df.where(F.col("bucket").cast("int").isin(list(buckets)))

    def touched(self, keyed: DataFrame) -> list[int]:
        """The buckets of the keys of ``keyed``: at most as many numbers as there are buckets."""
        found = keyed.select(key_bucket(self.key, self.buckets).alias("b")).distinct()
        return sorted(r["b"] for r in found.collect())

    def apply(self, snapshot: DataFrame, batch: str) -> list[int]:
        """Take in the snapshot (one row per key) of a batch later than all before; returns the buckets written."""
        buckets = self.touched(snapshot)
        held = self._read(self.open, buckets)
        if held is None:
            empty = F.lit(None)
            held = snapshot.limit(0).withColumns(
                {"version_no": empty.cast("long"), "valid_from_batch": empty.cast("string"), "valid_to_batch": empty.cast("string"), "is_current": empty.cast("boolean")}
            )
        merged = self._bucketed(merge_versions(held.drop("bucket"), snapshot, self.key, batch, self.tracked))
        # Written beside the tables first: open versions are read while they are replaced.
        staged = f"{self.dataset}__staged"
        self.zones.write(staged, merged)
        found = self.zones.read(staged, merge_schema=False)
        # Closed versions first: if the run ends here, the same batch is found again and rebuilt.
        gone = found.where(~F.col("is_current")).withColumn("closed_in", F.lit(batch))
        self.zones.write(self.closed, gone.repartition("bucket"), partition_by=("bucket", "closed_in"), only_these_partitions=True)
        self.zones.write(self.open, found.where("is_current").repartition("bucket"), partition_by=("bucket",), only_these_partitions=True)
        self.zones.drop_folder(self.zones.path(staged))
        return buckets

    def rebuild(self, snapshots: DataFrame, batch: str, buckets: Sequence[int]) -> list[int]:
        """Derive whole buckets anew from the snapshots of all batches (column ``batch`` names a row's batch)."""
        own = snapshots.where(key_bucket(self.key, self.buckets).isin(list(buckets)))
        return self.load(version_history(own, self.key, batch, self.tracked, collapse=False), buckets)

    def load(self, versions: DataFrame, buckets: Sequence[int]) -> list[int]:
        """Put whole buckets of a history in place."""
        staged = f"{self.dataset}__staged"
        self.zones.write(staged, self._bucketed(versions))
        found = self.zones.read(staged, merge_schema=False)
        for bucket in buckets:
            for dataset in (self.closed, self.open):
                self.zones.drop_folder(f"{self.zones.path(dataset)}/bucket={bucket}")
        gone = found.where(~F.col("is_current")).withColumn("closed_in", F.col("valid_to_batch"))
        self.zones.write(self.closed, gone.repartition("bucket"), partition_by=("bucket", "closed_in"), only_these_partitions=True)
        self.zones.write(self.open, found.where("is_current").repartition("bucket"), partition_by=("bucket",), only_these_partitions=True)
        self.zones.drop_folder(self.zones.path(staged))
        return list(buckets)

    def current(self, buckets: Sequence[int] | None = None) -> DataFrame:
        held = self._read(self.open, buckets)
        if held is None:
            raise FileNotFoundError(f"{self.dataset} has no version yet")
        return held.drop("bucket")

    def history(self, buckets: Sequence[int] | None = None) -> DataFrame:
        closed = self._read(self.closed, buckets)
        held = self.current(buckets)
        return held if closed is None else held.unionByName(closed.drop("bucket", "closed_in"), allowMissingColumns=True)
