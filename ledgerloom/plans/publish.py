"""Operational tables derived from the published products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.context import RunContext
from ledgerloom.plans import catalog
from ledgerloom.session import fixed_rows


# -- SLA ---------------------------------------------------------------------
def product_state(product: str, df: DataFrame, sla_hours: int, availability: float = 0.995) -> DataFrame:
    """Rows and newest update of one product table, in one aggregate."""
    newest = F.max("_gold_updated_at") if "_gold_updated_at" in df.columns else F.lit(None)
    return df.agg(F.count(F.lit(1)).alias("row_count"), newest.cast("timestamp_ntz").alias("last_updated")).select(
        F.lit(product).alias("product"),
        F.lit(f"gold.{product}").alias("dataset"),
        "row_count",
        F.lit(sla_hours).cast("long").alias("sla_freshness_hours"),
        F.lit(availability).alias("sla_availability"),
        "last_updated",
    )


def sla_status(states: Sequence[DataFrame], dq_results: DataFrame, ctx: RunContext) -> DataFrame:
    """Freshness and rule outcome per product; DEGRADED on a critical failure or stale data."""
    failing = F.col("status") == "FAIL"
    outcomes = dq_results.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("dq_rules"),
        F.count_if(F.col("status") == "PASS").alias("dq_passed"),
        F.count_if(failing & (F.col("severity") == "critical")).alias("dq_critical_failures"),
        F.count_if(failing & (F.col("severity") == "warning")).alias("dq_warning_failures"),
    )
    zero = F.lit(0).cast("long")
    age = (F.unix_micros(ctx.stamp.cast("timestamp")) - F.unix_micros(F.col("last_updated").cast("timestamp"))) / 3.6e9
    fresh = F.col("age_hours").isNull() | (age <= F.col("sla_freshness_hours"))
    return (
        reduce(DataFrame.unionByName, states)
        .join(outcomes, "dataset", "left")
        .withColumn("age_hours", F.round(age, 3))
        .select(
            "product",
            "dataset",
            "row_count",
            "sla_freshness_hours",
            "last_updated",
            "age_hours",
            F.coalesce(age <= F.col("sla_freshness_hours"), F.lit(False)).alias("freshness_ok"),
            *[
                F.coalesce(name, zero).alias(name)
                for name in ("dq_rules", "dq_passed", "dq_critical_failures", "dq_warning_failures")
            ],
            "sla_availability",
            F.when((F.coalesce("dq_critical_failures", zero) == 0) & fresh, "OK").otherwise("DEGRADED").alias("status"),
            ctx.stamp.alias("last_successful_run"),
        )
    )


# -- lineage -----------------------------------------------------------------
@dataclass(frozen=True)
class Job:
    """A transform, the table it writes and the tables it is given."""

    name: str
    output: str
    inputs: tuple[str, ...]


def lineage_edges(spark: SparkSession, jobs: Sequence[Job], ctx: RunContext) -> DataFrame:
    """One edge per declared input; a job only ever receives what it declares."""
    pairs = sorted({(i, j.output, j.name) for j in jobs for i in j.inputs if i != j.output})
    edges = [{"from_dataset": i, "to_dataset": o, "transform_id": name} for i, o, name in pairs]
    return fixed_rows(spark, edges, "from_dataset: string, to_dataset: string, transform_id: string").select(
        "from_dataset",
        F.lit("").alias("from_column"),
        "to_dataset",
        F.lit("").alias("to_column"),
        "transform_id",
        F.lit("dataframe").alias("transform_type"),
        ctx.stamp.alias("last_seen_ts"),
    )


# -- catalogue ---------------------------------------------------------------
def list_products(contracts: DataFrame, sla: DataFrame) -> DataFrame:
    """Contract facts beside the live status; a product never published is UNKNOWN."""
    live = sla.select("product", "row_count", "status", "age_hours", "dq_critical_failures")
    zero = F.lit(0).cast("long")
    return contracts.join(live, "product", "left").select(
        *contracts.columns,
        F.coalesce("row_count", zero).alias("row_count"),
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
        "age_hours",
        F.coalesce("dq_critical_failures", zero).alias("dq_critical_failures"),
    )


def catalog_snapshot(contracts: DataFrame, sla: DataFrame, ctx: RunContext) -> DataFrame:
    kept = (
        "product", "version", "domain", "owner", "description", "grain", "classification", "allowed_use",
        "not_allowed_use", "sla_freshness_hours", "row_count", "status",
    )
    return list_products(contracts, sla).select(*kept, ctx.stamp.cast("string").alias("last_updated"))


def quality_of(results: DataFrame, product: str) -> DataFrame:
    """Rules about a product: on its own table in any zone, or mentioning it in their text."""
    own = F.col("dataset").isin(*[f"{zone}.{product}" for zone in ("gold", "silver", "bronze")])
    return results.filter(own | F.contains(F.col("rule_text"), F.lit(product)))


def quality_summary(results: DataFrame, product: str | None = None) -> DataFrame:
    """Counts by outcome; a rule that could not run counts as a failure here."""
    scoped = results if product is None else quality_of(results, product)
    bad = F.col("status") != "PASS"
    return scoped.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~bad).alias("passed"),
        F.count_if(bad & (F.col("severity") == "critical")).alias("critical_failures"),
        F.count_if(bad & (F.col("severity") == "warning")).alias("warning_failures"),
    )


def quality_failures(results: DataFrame, product: str | None = None) -> DataFrame:
    """All failures listed beside a summary."""
    scoped = results if product is None else quality_of(results, product)
    return (
        scoped.filter(F.col("status") != "PASS")
        .select("dataset", "rule_id", "severity", "status", "rule_text", "detail")
        .orderBy("dataset", "rule_id")
    )


def platform_status(listing: DataFrame, metrics: int | None = None) -> DataFrame:
    degraded = F.array_sort(F.collect_list(F.when(F.col("status") != "OK", F.col("product"))))
    total = F.sum("metrics") if metrics is None else F.lit(metrics)
    return listing.agg(
        F.count(F.lit(1)).alias("products"), degraded.alias("degraded"), total.cast("long").alias("metrics")
    )


# -- contracts against tables -------------------------------------------------
def contract_problems(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    contracts: Mapping[str, catalog.Contract] | None = None,
) -> DataFrame:
    """Where published tables and their contracts disagree, one row per problem.

    Column differences are known from the schema; key NULLs, key duplicates and the row
    floor come from aggregates over the table.
    """
    contracts = catalog.CONTRACTS if contracts is None else contracts
    static: list[dict[str, object]] = []
    checks: list[DataFrame] = []
    for name, contract in contracts.items():
        df = tables.get(name)
        if df is None:
            static.append({"product": name, "problem": "gold table missing", "rows": 1})
            continue
        published, declared = set(df.columns), set(contract.schema.names)
        keys = [k for k in contract.primary_key if k in published]
        found = [f"declared column not published: {c}" for c in sorted(declared - published)]
        found += [f"published column not declared: {c}" for c in sorted(published - declared)]
        found += [f"primary key not published: {k}" for k in contract.primary_key if k not in published]
        static += [{"product": name, "problem": problem, "rows": 1} for problem in found]
        wanted = [F.count_if(F.col(k).isNull()).alias(f"primary key has nulls: {k}") for k in keys]
        floor = contract.row_count_floor
        short = F.greatest(F.lit(floor) - F.count(F.lit(1)), F.lit(0))
        counted = df.agg(*wanted, short.alias(f"rows below the declared floor {floor}"))
        checks.append(_tall(counted, name))
        if keys:
            groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            checks.append(_tall(groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("primary key repeats")), name))
    parts = [fixed_rows(spark, static, "product: string, problem: string, rows: bigint"), *checks]
    return reduce(DataFrame.unionByName, parts)


def _tall(counted: DataFrame, product: str) -> DataFrame:
    """One row per non-zero count of a one-row frame."""
    entries = [
        F.struct(F.lit(name).alias("problem"), F.col(f"`{name}`").cast("long").alias("rows"))
        for name in counted.columns
    ]
    return (
        counted.select(F.explode(F.array(*entries)).alias("c"))
        .select(F.lit(product).alias("product"), "c.problem", "c.rows")
        .filter(F.col("rows") > 0)
    )
