"""The batch log: which delivery of which batch a lake has taken in, and what it touched."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.snapshots import drop_redelivered
from ledgerloom.sources import manifest
from ledgerloom.sources.ingest import read_extracts
from ledgerloom.sources.zones import Zones

LOG = "ops.batch_log"
LOG_SCHEMA = "dataset string, batch string, rows long, fingerprint string, files string, touches array<string>, state string"
LANDED, APPLIED = "LANDED", "APPLIED"
WRITING = threading.Lock()


@dataclass(frozen=True)
class Entry:
    """The newest delivery of one batch. ``touches`` names the other batches that hold records of it."""

    dataset: str
    batch: str
    rows: int
    fingerprint: str
    files: str
    touches: tuple[str, ...] = ()
    state: str = LANDED


class BatchLog:
    """One row per dataset and batch, kept as one folder each, so that writing an entry rewrites nothing else."""

    def __init__(self, zones: Zones) -> None:
        self.zones = zones

    def entries(self) -> dict[tuple[str, str], Entry]:
        if not self.zones.exists(LOG):
            return {}
        rows = self.zones.spark.read.schema(LOG_SCHEMA).parquet(self.zones.path(LOG)).collect()  # a row per batch
        return {(r["dataset"], r["batch"]): Entry(**{**r.asDict(), "touches": tuple(r["touches"])}) for r in rows}

    def put(self, entries: Sequence[Entry]) -> None:
        if not entries:
            return
        with WRITING:  # entities land at the same time, the log is one table
            rows = [(e.dataset, e.batch, e.rows, e.fingerprint, e.files, list(e.touches), e.state) for e in entries]
            frame = self.zones.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1)
            self.zones.write(LOG, frame, partition_by=("dataset", "batch"), only_these_partitions=True)


def batch_folders(zones: Zones, folder: str) -> dict[str, str]:
    """Batch name to folder; ``batch=1998-01-01`` and ``1998-01-01`` name the same batch."""
    if not zones.folder_exists(folder):
        return {}
    return {path.rstrip("/").rpartition("/")[2].rpartition("=")[2]: path for path in Zones(zones.spark, folder).folders()}


def file_stamp(zones: Zones, folder: str) -> str:
    """Names, sizes and times of a folder's files: equal stamps need not be read again."""
    root = len(folder)
    states = [(path[-(len(path) - root):], size, time) for path, size, time in Zones(zones.spark, folder).file_states()]
    return hashlib.sha256(repr(states).encode()).hexdigest()[:32]


def has_key() -> Column:
    """False for records without any key value: they share one hash, but are not deliveries of one another."""
    return F.col("_record_hash") != F.xxhash64(F.lit("")).cast("string")


def of_batches(df: DataFrame, batches: Sequence[str]) -> DataFrame:
    """Rows of some batches of a table laid out by ``batch``; the filter prunes folders."""
    return df.where(F.col("batch").isin(list(batches)))


def land(zones: Zones, dataset: str, folder: str) -> list[Entry]:
    """Take new and changed batches of one extract tree into bronze; returns their log entries (not yet applied).

    A batch whose files are as logged is not opened; one whose rows are as logged (delivered again unchanged) is noted
    and not rewritten. Otherwise only the batch's own folder of the bronze table is replaced. Which other batches hold
    records of the old or the new delivery is found from two narrow columns, before the old one is gone.
    """
    log = BatchLog(zones)
    known, changed = log.entries(), []
    for batch, path in sorted(batch_folders(zones, folder).items()):
        entry, stamp = known.get((dataset, batch)), file_stamp(zones, path)
        if entry and entry.files == stamp:
            changed += [entry] if entry.state == LANDED else []
            continue
        delivered = read_extracts(zones.spark, path)
        found = manifest.fingerprint(delivered).first()
        if entry and entry.state == APPLIED and (entry.rows, entry.fingerprint) == (found["rows"], found["fingerprint"]):
            log.put([Entry(**{**entry.__dict__, "files": stamp})])
            continue
        # A delivery that was landed but never applied still counts: what it touched stays touched.
        touches = set(entry.touches if entry and entry.state == LANDED else ())
        hashes = delivered.select("_record_hash").where(has_key())
        if zones.exists(dataset):
            held = zones.read(dataset).select("_record_hash", "batch")
            old = of_batches(held, [batch]).select("_record_hash").where(has_key())
            others = held.where(F.col("batch") != batch).join(hashes.union(old).distinct(), "_record_hash", "left_semi")
            touches |= {r["batch"] for r in others.select("batch").distinct().collect()}  # names of batches
        entry = Entry(dataset, batch, found["rows"], found["fingerprint"], stamp, tuple(sorted(touches)))
        # Logged first: a run that ends within the write finds the entry and takes the batch again.
        log.put([Entry(**{**entry.__dict__, "files": ""})])
        zones.drop_folder(f"{zones.path(dataset)}/batch={batch}")
        if found["rows"]:
            zones.write(dataset, delivered.withColumn("batch", F.lit(batch)), partition_by=("batch",), only_these_partitions=True)
        log.put([entry])
        changed.append(entry)
    return changed


def newest_deliveries(bronze: DataFrame, batches: Sequence[str]) -> DataFrame:
    """Rows of ``batches`` that no later delivery of the same record replaces (within a batch the last one ingested).

    Only these batches are read whole; of the others two columns are.
    """
    own = of_batches(bronze, batches)
    own = drop_redelivered(own.where(has_key()), batch="batch").unionByName(own.where(~has_key()))
    later = bronze.where(~F.col("batch").isin(list(batches))).select(F.col("_record_hash").alias("__hash"), F.col("batch").alias("__batch"))
    later = later.where(F.col("__hash") != F.xxhash64(F.lit("")).cast("string"))
    return own.join(later, (F.col("_record_hash") == F.col("__hash")) & (F.col("__batch") > F.col("batch")), "left_anti")
