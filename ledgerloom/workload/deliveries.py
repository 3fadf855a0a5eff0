"""Queries over incremental operators: states folded batch by batch give the result over all batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import conform, snapshots
from ledgerloom.operators.merges import VersionStore
from ledgerloom.session import materialise, scratch_path
from ledgerloom.sources import batches, differences, ingest
from ledgerloom.sources.zones import Zones
from ledgerloom.workload.registry import query
from ledgerloom.workload.tables import month_id
from ledgerloom.workload.views_sql import day

#: Batches that are merged one by one onto the history of those before.
FOLDED = 6


@query(
    "scd2_merge_fold",
    """SELECT customer_id, region, city, marketing_segment, kyc_status, annual_income, _batch_id AS valid_from_batch,
              valid_to_batch, is_current, CAST(version_no AS BIGINT) AS version_no
       FROM s_customers""",
)
def _(t):
    crm = materialise(t.crm)
    months = sorted(r[0] for r in crm.select("_batch_id").distinct().collect())
    first, rest = months[:-FOLDED], months[-FOLDED:]
    store = VersionStore(
        Zones(t.spark, scratch_path(t.spark, "versions")), "bronze.crm_versions", "customer_id", conform.TRACKED_CUSTOMER_ATTRIBUTES, buckets=8
    )
    before = crm.where(F.col("_batch_id").isin(first))
    store.load(snapshots.version_history(before, "customer_id", "_batch_id", store.tracked, collapse=False), range(8))
    for month in rest:
        store.apply(crm.where(F.col("_batch_id") == month).drop("_batch_id"), month)
    return store.history().select(
        "customer_id", "region", "city", "marketing_segment", "kyc_status", "annual_income", "valid_from_batch", "valid_to_batch",
        "is_current", F.col("version_no").cast("long").alias("version_no"),
    )


@query(
    "redelivered_conformation",
    f"""WITH delivered AS (
            SELECT 'P' || l_orderkey || '-' || l_linenumber AS transaction_id, date_trunc('month', l_shipdate) AS batch,
                   l_shipdate AS ts, l_extendedprice AS amount, l_linestatus, l_partkey * 1000003 + l_suppkey AS tie
            FROM lineitem
            UNION ALL
            SELECT 'P' || l_orderkey || '-' || l_linenumber, date_trunc('month', l_shipdate) + INTERVAL 1 MONTH, l_shipdate,
                   l_extendedprice - l_quantity, l_linestatus, l_partkey * 1000003 + l_suppkey
            FROM lineitem WHERE l_returnflag = 'R')
        SELECT transaction_id, strftime(batch, '%Y-%m-01') AS _batch_id, {day("ts")} AS transaction_date, amount,
               CASE WHEN l_linestatus = 'F' THEN -amount ELSE amount END AS signed_amount
        FROM delivered QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY batch DESC, tie DESC) = 1""",
)
def _(t):
    # Returned lines come again in the next month's batch, with another amount.
    lines = t["lineitem"].withColumn("batch", month_id("l_shipdate"))
    again = lines.where(F.col("l_returnflag") == "R").withColumns(
        {
            "batch": F.add_months(F.trunc("l_shipdate", "MM"), 1).cast("string"),
            "l_extendedprice": F.col("l_extendedprice") - F.col("l_quantity"),
        }
    )
    shaped = lines.unionByName(again).select(
        F.concat(F.lit("P"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.col("l_shipdate").alias("transaction_ts"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_linestatus") == "F", "DEBIT").otherwise("CREDIT").alias("debit_credit"),
        F.lit("UPI").alias("channel"),
        (F.col("l_partkey") * 1000003 + F.col("l_suppkey")).alias("_source_file"),
        F.col("batch").alias("_batch_id"),
        "batch",
    )
    bronze = shaped.withColumn("_record_hash", ingest.natural_key_hash(["transaction_id"]))
    months = sorted(r[0] for r in bronze.select("batch").distinct().collect())
    # Every second batch at a time: each part sees the other only through hashes and batch names.
    parts = [conform.conform_transactions(conform.payment_rail(batches.newest_deliveries(bronze, months[k::2]))) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("transaction_id", "_batch_id", "transaction_date", "amount", "signed_amount")


@query(
    "delivery_differences",
    """WITH dated AS (SELECT o_orderkey, o_orderstatus, o_totalprice, date_trunc('month', o_orderdate) AS month FROM orders),
            earlier AS (SELECT o_orderkey, o_totalprice FROM dated WHERE month > (SELECT min(month) FROM dated)),
            later AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
                      FROM dated WHERE month < (SELECT max(month) FROM dated))
       SELECT o_orderkey,
              CASE WHEN e.o_totalprice IS NULL THEN 'added' WHEN l.o_totalprice IS NULL THEN 'removed' ELSE 'changed' END AS change,
              CAST(e.o_totalprice IS NOT NULL AS BIGINT) AS rows_before, CAST(l.o_totalprice IS NOT NULL AS BIGINT) AS rows_after
       FROM earlier e FULL JOIN later l USING (o_orderkey)
       WHERE e.o_totalprice IS DISTINCT FROM l.o_totalprice""",
)
def _(t):
    # The later delivery has lost the last month, has won the first, and has corrected the orders in progress.
    orders = t["orders"].withColumn("month", F.trunc("o_orderdate", "MM"))
    first, last = orders.agg(F.min("month"), F.max("month")).first()
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    zones = Zones(t.spark, scratch_path(t.spark, "deliveries"))
    earlier = orders.where(F.col("month") > F.lit(first)).drop("month")
    later = orders.where(F.col("month") < F.lit(last)).drop("month").withColumn("o_totalprice", price)
    kept = [
        differences.keep_delivery(zones, f"bronze.orders_{name}", df, ["o_orderkey"], buckets=64, fan=8)
        for name, df in (("earlier", earlier), ("later", later))
    ]
    return differences.differing_keys(*kept)
