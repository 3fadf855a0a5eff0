"""Registered queries: a Spark plan, and where SQL can say it, the same in SQL."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, StringType, TimestampNTZType, TimestampType

from ledgerloom.session import durable_dir
from ledgerloom.sources.zones import Zones
from ledgerloom.workload.tables import Tables
from ledgerloom.workload.views_sql import statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _plain(df: DataFrame) -> DataFrame:
    """Dates, timestamps and string lists as text, so that any client compares them alike."""

    def shown(field) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DateType):
            return F.date_format(column, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, TimestampType | TimestampNTZType):
            return F.date_format(column, TIME_FORMAT).alias(field.name)
        if isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StringType):
            return F.array_join(column, "|").alias(field.name)
        return column

    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under a name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = lambda spark, folder: _plain(build(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = statement(sql)
        return build

    return register


class Published:
    """The products of one folder, written once per session and read by later queries.

    This is how the products are used for real: built by a run, then queried many times.
    They are kept under the state of the input files (path, size and time), so data that
    were rewritten in the same folder are built anew.
    """

    def __init__(self, tables: Tables) -> None:
        self.tables = tables
        zones = Zones(tables.spark, tables.folder)
        state = hashlib.sha256(json.dumps([tables.folder, zones.file_states()]).encode()).hexdigest()[:16]
        session = tables.spark.sparkContext.applicationId
        self.zones = Zones(tables.spark, f"{durable_dir(tables.spark)}/ledgerloom/published-{session}-{state}")

    def read(self, dataset: str, build: Callable[[], DataFrame] | None = None) -> DataFrame:
        if not self._written(dataset):
            self.zones.write(dataset, build() if build else self._build(dataset))
        return self.zones.read(dataset, merge_schema=False)

    def _from_silver(self) -> Tables:
        """The tables, with the silver ones that are already written read from there instead of built again."""
        t = self.tables
        for name in ("customers", "accounts", "transactions"):
            if self._written(f"silver.{name}"):
                setattr(t, f"s_{name}", self.zones.read(f"silver.{name}", merge_schema=False))
        return t

    def _written(self, dataset: str) -> bool:
        # Spark writes this marker last, so a half-written table is built again.
        return self.zones.folder_exists(f"{self.zones.path(dataset)}/_SUCCESS")

    def _build(self, dataset: str) -> DataFrame:
        t = self.tables
        return {
            "gold.customer_360": lambda: self._from_silver().customer_360,
            # In order within files, for date filters, without moving the whole fact once more.
            "gold.transaction": lambda: self._from_silver().transaction.sortWithinPartitions("transaction_date"),
            "gold.credit_risk": lambda: self._from_silver().credit_risk,
            "silver.customers": lambda: t.s_customers,
            "silver.accounts": lambda: t.s_accounts,
            "silver.transactions": lambda: t.s_transactions,
            "bronze.s_core_accounts": lambda: t.accounts,
        }[dataset]()
