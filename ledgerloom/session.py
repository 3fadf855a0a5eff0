"""Session defaults and the durable folder used to cut lineage."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_DEFAULTS = {
    # Timestamps in the sources carry no zone; UTC keeps every cast reproducible.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A fact keyed by customer can be heavily skewed; let AQE split the hot
    # partitions of a join even when that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Batch ids look like dates but are strings, also as partition folders.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Python call sites on every column cost more than planning itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword ``conf`` entries override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (a unit test) may name none; it gets a folder of its own. On a
    cluster such a folder would be another one on every machine, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the durable folder (each call returns a new one)."""
    return f"{durable_dir(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut a plan with a table in the durable folder, so a lost executor costs no recomputation.

    Columnar and compressed: a checkpoint of the same rows is several times larger.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed_rows(spark: SparkSession, rows: Iterable[Mapping[str, object]], schema: str) -> DataFrame:
    """A small table of facts known to the program (rules, contracts, policy).

    It is one literal inside the plan, so Spark knows how small it is and joins it
    without an exchange.
    """
    entries = F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(entries))
