"""Small helpers shared by the training-data operators: words, stored tables and shared files."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import scratch_path
from ledgerloom.sources.zones import Zones

#: ``bytes.split()`` cuts at exactly these bytes, so words are ``[^\x20\x09-\x0D]+``.
WHITE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: Rows of a narrow table that are worth a task and a file of their own.
ROWS_PER_FILE = 200_000


def store(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: the plan is cut and survives lost executors.

    ``rows``, if known, is an upper bound of the rows of a narrow table; a small one is then written by few tasks
    instead of as one tiny file for every shuffle partition.
    """
    path = scratch_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_FILE)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*stored: DataFrame) -> None:
    """Remove tables of ``store`` that no plan reads any more."""
    for df in stored:
        session = df.sparkSession
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            Zones(session, folder).drop_folder(folder)


SHIPPED: set[str] = set()
#: (setting, Spark's default, ours): whole texts are large rows, so batches are kept small; other choices are left alone.
ARROW = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"),
)


def ship(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in SHIPPED:
        return
    for name, usual, value in ARROW:
        if spark.conf.get(name) == usual:
            spark.conf.set(name, value)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):  # else it is an archive already, handed over by whoever submitted it
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "ledgerloom.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        spark.sparkContext.addPyFile(archive)
    SHIPPED.add(app)


def shared_folder(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)


def with_small(df: DataFrame, small: DataFrame, on: Column, how: str = "inner", most: int = 10_000) -> DataFrame:
    """Join a stored table that is expected to be small; it is broadcast only if it has at most ``most`` rows."""
    counted = small.limit(most + 1).count()
    return df.join(F.broadcast(small) if counted <= most else small, on, how)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for rows that models never learn from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and path of a folder that Spark names (``s3a`` is Spark's name for ``s3``)."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class SharedFile:
    """A file that appears under its name only when it is complete, so that a retried task replaces it whole."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.part = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> str:
        self.stream.close()
        self.fs.move(self.part, self.path)
        return self.path
