"""Queries over ingest and conformation operators."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerloom.functions import bands, text
from ledgerloom.operators import conform, snapshots
from ledgerloom.sources import ingest, manifest
from ledgerloom.workload.registry import query
from ledgerloom.workload.tables import month_id
from ledgerloom.workload.views_sql import day, stamp

DRIFT = date(1998, 1, 1)


@query(
    "bronze_union_by_name",
    """SELECT o_custkey, o_orderkey, CASE WHEN o_orderdate >= DATE '1998-01-01' THEN o_orderpriority END
              AS o_orderpriority, o_orderstatus, o_totalprice FROM orders""",
)
def _(t):
    # The priority column is an additive change that only later batches carry.
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    before = t["orders"].filter(F.col("o_orderdate") < F.lit(DRIFT)).select(*columns)
    after = t["orders"].filter(F.col("o_orderdate") >= F.lit(DRIFT)).select("o_orderpriority", *columns)
    return ingest.united([before, after])


@query(
    "optional_column_default",
    """SELECT coalesce(region, 'UNKNOWN') AS region, 'UNKNOWN' AS preferred_language, count(*) AS snapshots
       FROM crm GROUP BY 1""",
)
def _(t):
    filled = conform.with_optional(t.crm, {"region": "UNKNOWN", "preferred_language": "UNKNOWN"})
    return filled.groupBy("region", "preferred_language").agg(F.count(F.lit(1)).alias("snapshots"))


@query(
    "ingest_metadata",
    """SELECT strftime(o_orderdate, '%Y-%m-01') AS _batch_id, 's_core/transactions' AS _source_system,
              '2024-01-30 00:00:00.000000' AS _ingested_at, count(*) AS row_count,
              count(DISTINCT o_orderkey) AS record_hashes
       FROM orders GROUP BY 1""",
)
def _(t):
    landed = ingest.with_ingest_metadata(
        t["orders"],
        source="s_core",
        entity="transactions",
        batch_id=month_id("o_orderdate"),
        ingested_at=datetime(2024, 1, 30),
        keys=["o_orderkey"],
    )
    # Distinct hashes by counting per hash first: no set of hashes is ever held.
    keys = ["_batch_id", "_source_system", "_ingested_at"]
    per_hash = landed.groupBy(*keys, "_record_hash").agg(F.count(F.lit(1)).alias("n"))
    return per_hash.groupBy(*keys).agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("record_hashes")
    )


@query(
    "dedup_by_record_hash",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS _batch_id
       FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY strftime(l_shipdate, '%Y-%m-%d') DESC, l_partkey * 1000003 + l_suppkey DESC) = 1""",
)
def _(t):
    delivered = t["lineitem"].select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("_batch_id"),
        (F.col("l_partkey") * 1000003 + F.col("l_suppkey")).alias("_source_file"),
        ingest.natural_key_hash(["l_orderkey", "l_linenumber"]).alias("_record_hash"),
    )
    return snapshots.drop_redelivered(delivered).drop("_source_file", "_record_hash")


def _fingerprint_sql(columns: list[str], source: str, by: str | None = None) -> str:
    """Rows and fingerprint of a relation, for each value of ``by`` if that is given."""
    texts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '<null>')" for c in columns)
    names = ",".join(columns)
    group = f"{by} AS batch, " if by else ""
    return f"""SELECT {"batch, rows, columns," if by else "rows,"}
               CASE WHEN rows = 0 THEN 'empty' ELSE left(sha256(concat_ws('|', rows, columns, x, s)), 32) END AS fingerprint
        FROM (SELECT {group}count(*) AS rows, '{names}' AS columns, bit_xor(h) AS x, sum(h % 2147483647) AS s
              FROM (SELECT *, CAST('0x' || left(md5(concat_ws(chr(1), {texts})), 15) AS BIGINT) AS h FROM {source})
              {"GROUP BY 1" if by else ""})"""


_BATCH_COLUMNS = ["_batch_id", "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"]


@query(
    "batch_manifest",
    _fingerprint_sql(_BATCH_COLUMNS, "(SELECT *, strftime(o_orderdate, '%Y-%m-01') AS _batch_id FROM orders)", "_batch_id"),
)
def _(t):
    batches = t["orders"].select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", month_id("o_orderdate").alias("_batch_id")
    )
    return manifest.batch_manifest(batches)


_LINE_COLUMNS = sorted(
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
)


@query("table_fingerprint", _fingerprint_sql(_LINE_COLUMNS, "lineitem"))
def _(t):
    return manifest.fingerprint(t["lineitem"])


@query(
    "scd2_customer_versions",
    f"""SELECT customer_id, region, state_code, city, pincode, marketing_segment, kyc_status, preferred_channel,
               'UNKNOWN' AS preferred_language, {day("onboarded_date")} AS onboarded_date, relationship_manager_id,
               annual_income, annual_income / 12.0 AS income_monthly, CAST(age AS INTEGER) AS age, age_group,
               _batch_id AS valid_from_batch, valid_to_batch, is_current, CAST(version_no AS BIGINT) AS version_no
        FROM s_customers""",
)
def _(t):
    return t.s_customers.drop(*[f"{k.lower()}_token" for k in text.TOKEN_KINDS], "_silver_updated_at")


@query(
    "scd2_current",
    """SELECT customer_id, city, kyc_status, _batch_id AS valid_from_batch, CAST(version_no AS BIGINT) AS version_no
       FROM s_customers WHERE is_current""",
)
def _(t):
    current = snapshots.current_versions(t.s_customers)
    return current.select("customer_id", "city", "kyc_status", "valid_from_batch", "version_no")


@query(
    "scd2_supplier_attributes",
    """WITH monthly AS (
           SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-01') AS batch, max(l_returnflag) AS flag,
                  max(l_linestatus) AS linestatus
           FROM lineitem GROUP BY 1, 2),
       changes AS (
           SELECT *, lag(flag) OVER w IS NULL OR flag IS DISTINCT FROM lag(flag) OVER w
                     OR linestatus IS DISTINCT FROM lag(linestatus) OVER w AS starts
           FROM monthly WINDOW w AS (PARTITION BY l_suppkey ORDER BY batch))
       SELECT l_suppkey, flag, linestatus, batch AS valid_from_batch,
              coalesce(lead(batch) OVER w, '9999-12') AS valid_to_batch, lead(batch) OVER w IS NULL AS is_current,
              row_number() OVER w AS version_no
       FROM changes WHERE starts WINDOW w AS (PARTITION BY l_suppkey ORDER BY batch)""",
)
def _(t):
    monthly = t["lineitem"].groupBy("l_suppkey", month_id("l_shipdate").alias("batch")).agg(
        F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("linestatus")
    )
    return snapshots.version_history(monthly, "l_suppkey", "batch", ["flag", "linestatus"], collapse=False)


@query(
    "pii_tokens",
    """SELECT customer_id, _batch_id AS valid_from_batch, md5(customer_id || '|NAME') AS name_token,
              md5(customer_id || '|EMAIL') AS email_token, md5(customer_id || '|PHONE') AS phone_token,
              md5(customer_id || '|ADDRESS') AS address_token, md5(customer_id || '|DOB') AS dob_token
       FROM s_customers""",
)
def _(t):
    tokens = [f"{k.lower()}_token" for k in text.TOKEN_KINDS]
    return t.s_customers.select("customer_id", "valid_from_batch", *tokens)


@query(
    "age_bands",
    """SELECT age_group, count(*) AS customers, count(age) AS with_age, CAST(min(age) AS INTEGER) AS youngest,
              CAST(max(age) AS INTEGER) AS oldest
       FROM s_customers WHERE is_current GROUP BY 1""",
)
def _(t):
    return snapshots.current_versions(t.s_customers).groupBy("age_group").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count("age").alias("with_age"),
        F.min("age").alias("youngest"),
        F.max("age").alias("oldest"),
    )


@query(
    "latest_snapshot",
    f"""SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, {day("o_orderdate")} AS o_orderdate
        FROM orders QUALIFY row_number() OVER (
            PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(t):
    orders = t["orders"].select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate")
    )
    return snapshots.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "region_conflict",
    """SELECT account_id, _batch_id AS snapshot_batch, branch_region, branch_region_raw, branch_region_missing_flag,
              customer_region, region_conflict_flag
       FROM s_accounts""",
)
def _(t):
    return t.s_accounts.select(
        "account_id", "snapshot_batch", "branch_region", "branch_region_raw", "branch_region_missing_flag",
        "customer_region", "region_conflict_flag",
    )


@query(
    "balance_remediation",
    """SELECT account_id, account_type, _batch_id AS snapshot_batch, balance_raw, balance, balance_anomaly_flag,
              overdraft_limit, interest_rate, status
       FROM s_accounts""",
)
def _(t):
    return t.s_accounts.select(
        "account_id", "account_type", "snapshot_batch", "balance_raw", "balance", "balance_anomaly_flag",
        "overdraft_limit", "interest_rate", "status",
    )


@query(
    "rails_union",
    f"""SELECT transaction_id, customer_id, account_id, {stamp("transaction_ts")} AS transaction_ts, amount, currency,
               debit_credit, channel, channel_group, merchant_id, merchant_category, merchant_country,
               is_international, card_id, device_id, narration, source_system, _batch_id
        FROM s_transactions""",
)
def _(t):
    return t.s_transactions.select(*conform.RAIL_SHAPE)


@query(
    "signed_amounts",
    f"""SELECT transaction_id, {day("transaction_date")} AS transaction_date,
               {stamp("transaction_month")} AS transaction_month, transaction_hour, amount, signed_amount
        FROM s_transactions""",
)
def _(t):
    return t.s_transactions.select(
        "transaction_id", "transaction_date", "transaction_month", "transaction_hour", "amount", "signed_amount"
    )


@query(
    "card_state_latest",
    f"""SELECT card_id, customer_id, card_type, network, masked_number, credit_limit,
               {day("issue_date")} AS issue_date, {day("expiry_date")} AS expiry_date, status,
               status = 'ACTIVE' AS is_active, card_type = 'CREDIT' AS is_credit, _batch_id AS snapshot_batch
        FROM cards QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY _batch_id DESC) = 1""",
)
def _(t):
    return conform.silver_cards(t.cards)


@query(
    "score_bands",
    f"""SELECT bureau_id, customer_id, CAST(credit_score AS INTEGER) AS credit_score,
               CASE WHEN credit_score >= 800 THEN 'EXCELLENT' WHEN credit_score >= 750 THEN 'GOOD'
                    WHEN credit_score >= 700 THEN 'FAIR' WHEN credit_score >= 650 THEN 'POOR' ELSE 'VERY_POOR' END
                   AS score_band,
               CAST(enquiries_6m AS INTEGER) AS enquiries_6m, CAST(delinquencies_24m AS INTEGER) AS delinquencies_24m,
               CAST(credit_vintage_months AS INTEGER) AS credit_vintage_months, total_exposure,
               CAST(active_tradelines AS INTEGER) AS active_tradelines, {day("as_of_date")} AS as_of_date,
               _batch_id AS snapshot_batch
        FROM bureau""",
)
def _(t):
    return t.s_credit


@query(
    "dpd_bands",
    f"""SELECT loan_id, customer_id, product, principal, interest_rate, CAST(tenor_months AS INTEGER) AS tenor_months,
               {day("disbursed_date")} AS disbursed_date, outstanding_principal,
               outstanding_principal / nullif(principal, 0) AS outstanding_ratio, CAST(dpd AS INTEGER) AS dpd,
               CASE WHEN dpd = 0 THEN 'CURRENT' WHEN dpd BETWEEN 1 AND 30 THEN 'DPD_1_30'
                    WHEN dpd BETWEEN 31 AND 60 THEN 'DPD_31_60' WHEN dpd BETWEEN 61 AND 90 THEN 'DPD_61_90'
                    ELSE 'DPD_90_PLUS' END AS dpd_band,
               dpd >= 90 AS npa_flag, status, collateral_type, collateral_value,
               collateral_value / nullif(outstanding_principal, 0) AS collateral_coverage_ratio,
               _batch_id AS snapshot_batch
        FROM loans""",
)
def _(t):
    return t.s_loans.drop("emi_amount")


@query(
    "emi_amounts",
    "SELECT loan_id, _batch_id AS snapshot_batch, principal, interest_rate, emi_amount FROM loans",
)
def _(t):
    return t.s_loans.select("loan_id", "snapshot_batch", "principal", "interest_rate", "emi_amount")


@query(
    "repayment_punctuality",
    f"""SELECT repayment_id, loan_id, customer_id, {day("due_date")} AS due_date, {day("paid_date")} AS paid_date,
               amount_due, amount_paid, amount_due - amount_paid AS amount_shortfall,
               amount_paid >= amount_due AS paid_in_full, CAST(dpd_at_payment AS INTEGER) AS dpd_at_payment,
               CASE WHEN dpd_at_payment = 0 THEN 'ON_TIME' WHEN dpd_at_payment BETWEEN 1 AND 30 THEN 'LATE_1_30'
                    ELSE 'LATE_30_PLUS' END AS punctuality_band,
               _batch_id AS snapshot_batch
        FROM repayments""",
)
def _(t):
    return conform.silver_repayments(t.repayments)


@query(
    "channel_group_mix",
    """SELECT channel_group, channel, source_system, count(*) AS transactions,
              round(sum(CAST(signed_amount AS DECIMAL(18, 2))), 2)::DOUBLE AS net_flow
       FROM s_transactions GROUP BY ALL""",
)
def _(t):
    exact = F.sum(F.col("signed_amount").cast("decimal(18,2)")).cast("double")
    return t.s_transactions.groupBy("channel_group", "channel", "source_system").agg(
        F.count(F.lit(1)).alias("transactions"), exact.alias("net_flow")
    )


@query(
    "account_balance_bands",
    """SELECT CASE WHEN c_acctbal >= 5000000 THEN 'Premium' WHEN c_acctbal >= 1500000 THEN 'HNI'
                   WHEN c_acctbal >= 300000 THEN 'Affluent' ELSE 'Mass' END AS segment,
              c_acctbal < 0 AS negative, count(*) AS customers
       FROM customer GROUP BY ALL""",
)
def _(t):
    segment = bands.value_segment(F.col("c_acctbal")).alias("segment")
    return t["customer"].groupBy(segment, (F.col("c_acctbal") < 0).alias("negative")).agg(
        F.count(F.lit(1)).alias("customers")
    )
