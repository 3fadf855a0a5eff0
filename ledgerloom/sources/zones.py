"""Parquet tables addressed as ``<zone>.<table>`` below one root folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ZONES = ("bronze", "silver", "gold", "ops")


class EmptyOutputError(RuntimeError):
    """A transform produced no row; that means it is wrong, not that the data is quiet."""


class Zones:
    """Reads, writes and registers the tables of a lake root (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # -- addressing ----------------------------------------------------------
    @staticmethod
    def split(dataset: str) -> tuple[str, str]:
        zone, _, table = dataset.partition(".")
        if zone not in ZONES or not table:
            raise ValueError(f"'{dataset}' is not a <zone>.<table> name; zones are {', '.join(ZONES)}")
        return zone, table

    def path(self, dataset: str) -> str:
        zone, table = self.split(dataset)
        return f"{self.root}/{zone}/{table}"

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def has_files(self, path: str, suffix: str = ".parquet") -> bool:
        fs, location = self._fs(path)
        if not fs.exists(location):
            return False
        files = fs.listFiles(location, True)
        while files.hasNext():
            if files.next().getPath().getName().endswith(suffix):
                return True
        return False

    def folder_exists(self, path: str) -> bool:
        fs, location = self._fs(path)
        return fs.exists(location)

    def folders(self) -> list[str]:
        """The folders directly below the root that hold Parquet files."""
        fs, location = self._fs(self.root)
        found = [entry.getPath().toString() for entry in fs.listStatus(location) if entry.isDirectory()]
        return sorted(path for path in found if self.has_files(path))

    def drop_folder(self, path: str) -> None:
        fs, location = self._fs(path)
        fs.delete(location, True)

    def file_states(self) -> list[tuple[str, int, int]]:
        """Path, size and time of every file below the root."""
        fs, location = self._fs(self.root)
        files, found = fs.listFiles(location, True), []
        while files.hasNext():
            entry = files.next()
            found.append((entry.getPath().toString(), entry.getLen(), entry.getModificationTime()))
        return sorted(found)

    def exists(self, dataset: str) -> bool:
        return self.has_files(self.path(dataset))

    def tables(self, zone: str) -> list[str]:
        fs, location = self._fs(f"{self.root}/{zone}")
        if not fs.exists(location):
            return []
        names = [entry.getPath().getName() for entry in fs.listStatus(location) if entry.isDirectory()]
        return sorted(name for name in names if self.has_files(f"{self.root}/{zone}/{name}"))

    # -- reading and writing -------------------------------------------------
    def read(self, dataset: str, *, merge_schema: bool | None = None) -> DataFrame:
        """The whole table; bronze files may differ in columns and are united by name."""
        if not self.exists(dataset):
            raise FileNotFoundError(f"{dataset} not found under {self.root}")
        merge = dataset.startswith("bronze.") if merge_schema is None else merge_schema
        return self.spark.read.option("mergeSchema", str(merge).lower()).parquet(self.path(dataset))

    def write(
        self,
        dataset: str,
        df: DataFrame,
        *,
        partition_by: Sequence[str] = (),
        only_these_partitions: bool = False,
        allow_empty: bool = True,
    ) -> int:
        """Replace the table (or, on request, just the partitions present in ``df``).

        The row count is observed while the write runs, so the empty-output guard
        costs no second pass.
        """
        seen = Observation()
        writer = (
            df.observe(seen, F.count(F.lit(1)).alias("rows"))
            .write.mode("overwrite")
            .option("compression", "zstd")
            .option("partitionOverwriteMode", "dynamic" if only_these_partitions else "static")
        )
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(dataset))
        rows = int(seen.get["rows"])
        if rows == 0 and not allow_empty:
            raise EmptyOutputError(f"{dataset} produced 0 rows")
        return rows

    def take_over(self, dataset: str, other: Zones) -> None:
        """Put the table of another lake in the place of ours, by renaming; ours is dropped last."""
        fs, here = self._fs(self.path(dataset))
        _, new = self._fs(other.path(dataset))
        _, old = self._fs(f"{self.path(dataset)}__replaced")
        fs.delete(old, True)
        fs.mkdirs(here.getParent())
        if fs.exists(here) and not fs.rename(here, old):
            raise OSError(f"could not set {dataset} aside")
        if not fs.rename(new, here):
            fs.rename(old, here)
            raise OSError(f"could not publish {dataset}")
        fs.delete(old, True)

    # -- SQL names -----------------------------------------------------------
    def register(self, dataset: str) -> None:
        """Expose one table to SQL as ``zone.table``, seeing its newest files."""
        zone, table = self.split(dataset)
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{zone}` LOCATION '{self.root}/{zone}'")
        self.spark.sql(f"DROP TABLE IF EXISTS `{zone}`.`{table}`")
        columns = self.read(dataset).schema.toDDL()
        self.spark.sql(
            f"CREATE TABLE `{zone}`.`{table}` ({columns}) USING parquet LOCATION '{self.path(dataset)}'"
        )

    def register_all(self) -> list[str]:
        names = [f"{zone}.{table}" for zone in ZONES for table in self.tables(zone)]
        for name in names:
            self.register(name)
        return names
