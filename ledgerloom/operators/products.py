"""The three published data products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.context import RunContext
from ledgerloom.functions import bands
from ledgerloom.operators.snapshots import current_versions, latest_delivery, latest_per_key

DISPUTE_WINDOW_DAYS = 90
ACTIVITY_WINDOW_DAYS = 90
# What is read of the latest account, loan and credit record; both loan summaries keep the same row of a tie.
ACCOUNT_STATE = (
    "customer_id", "status", "balance", "account_type", "overdraft_limit", "balance_anomaly_flag", "region_conflict_flag",
)
LOAN_STATE = (
    "customer_id", "status", "dpd", "outstanding_principal", "principal", "npa_flag", "product", "emi_amount",
    "collateral_value",
)
CREDIT_STATE = ("credit_score", "score_band", "enquiries_6m", "credit_vintage_months", "delinquencies_24m")


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def account_totals(accounts: DataFrame) -> DataFrame:
    """Latest state of every account, summed per customer."""
    held = F.coalesce("balance", F.lit(0.0))
    return (
        latest_delivery(accounts, ["account_id"], ["snapshot_batch"], ACCOUNT_STATE)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("account_count"),
            _count(F.col("status") == "ACTIVE").alias("active_accounts"),
            F.sum(held).alias("total_balance"),
            F.sum(F.when(F.col("account_type") == "FIXED_DEPOSIT", held).otherwise(0.0)).alias("total_deposits"),
            F.sum(F.coalesce("overdraft_limit", F.lit(0.0))).alias("total_overdraft_limit"),
            _count(F.col("balance_anomaly_flag")).alias("balance_anomaly_count"),
            _count(F.col("region_conflict_flag")).alias("region_conflict_count"),
        )
    )


def loan_totals(loans: DataFrame, *, open_only: bool = False) -> DataFrame:
    latest = latest_delivery(loans, ["loan_id"], ["snapshot_batch"], LOAN_STATE)
    if open_only:
        latest = latest.filter(F.col("status") != "CLOSED")
    return latest.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("loan_count"),
        F.sum("outstanding_principal").alias("loan_outstanding"),
        F.sum("principal").alias("total_loan_amount"),
        F.max("dpd").alias("dpd_max"),
        _count(F.col("npa_flag")).alias("npa_count"),
        F.coalesce(F.bool_or(F.col("product") == "BUSINESS"), F.lit(False)).alias("runs_business"),
    )


def trailing_activity(
    transactions: DataFrame, ctx: RunContext, *, days: int = ACTIVITY_WINDOW_DAYS, debits_only: bool = False
) -> DataFrame:
    """Activity per customer in the days before the anchor; the date filter reaches the scan."""
    on_card = F.col("channel_group") == "CARD"
    if debits_only:
        on_card = on_card & (F.col("debit_credit") == "DEBIT")
    return (
        transactions.filter(F.col("transaction_date") > ctx.days_back(days))
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("txn_count_90d"),
            F.sum(F.when(on_card, F.col("amount")).otherwise(0.0)).alias("card_spend_90d"),
            F.max("transaction_ts").alias("last_transaction_at"),
        )
    )


def latest_credit(credit_records: DataFrame) -> DataFrame:
    return latest_delivery(credit_records, ["customer_id"], ["snapshot_batch", "bureau_id"], CREDIT_STATE)


def customer_360(
    customers: DataFrame,
    accounts: DataFrame,
    loans: DataFrame,
    transactions: DataFrame,
    credit_records: DataFrame,
    ctx: RunContext,
    *,
    open_loans_only: bool = False,
    card_debits_only: bool = False,
) -> DataFrame:
    """One row per current customer.

    Every side is reduced to one row per customer before it is joined, so all joins
    run on the same key between tables of customer size, never on raw facts.
    """
    score = latest_credit(credit_records).select("customer_id", "credit_score", "score_band")
    joined = (
        current_versions(customers)
        .join(account_totals(accounts), "customer_id", "left")
        .join(loan_totals(loans, open_only=open_loans_only), "customer_id", "left")
        .join(trailing_activity(transactions, ctx, debits_only=card_debits_only), "customer_id", "left")
        .join(score, "customer_id", "left")
    )
    count = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    amount = lambda name: bands.money(F.col(name)).alias(name)
    return joined.select(
        "customer_id",
        F.when(F.col("runs_business"), "Business").otherwise("Individual").alias("customer_type"),
        "age",
        "age_group",
        "region",
        "city",
        "state_code",
        "marketing_segment",
        "kyc_status",
        "preferred_channel",
        count("account_count"),
        count("active_accounts"),
        amount("total_balance"),
        amount("total_deposits"),
        amount("total_overdraft_limit"),
        count("loan_count"),
        amount("loan_outstanding"),
        amount("total_loan_amount"),
        count("npa_count"),
        amount("card_spend_90d"),
        count("txn_count_90d"),
        "last_transaction_at",
        "credit_score",
        "score_band",
        # The segment looks at the total before it is rounded for publication.
        bands.value_segment(F.coalesce("total_balance", F.lit(0.0))).alias("customer_segment"),
        bands.risk_category(F.col("credit_score")).alias("risk_category"),
        count("balance_anomaly_count"),
        count("region_conflict_count"),
        "valid_from_batch",
        ctx.stamp.alias("_gold_updated_at"),
    )


def transaction_product(transactions: DataFrame, labels: DataFrame, ctx: RunContext) -> DataFrame:
    """The transaction fact with labels shown only once they are known.

    Labels are filtered to those available at the anchor, and of a label delivered more
    than once the newest is taken, before the join; the flag is TRUE (confirmed), FALSE
    (dispute window closed) or NULL (still open).
    """
    available = labels.filter(F.col("label_available_date").cast("date") <= ctx.day)
    known = latest_per_key(available, ["transaction_id"], ["label_available_date", "fraud_method"]).select(
        "transaction_id", F.col("fraud_method").alias("confirmed_fraud_method"), F.lit(True).alias("__confirmed")
    )
    confirmed = F.col("__confirmed").isNotNull()
    closed = F.col("transaction_date") <= ctx.days_back(DISPUTE_WINDOW_DAYS)
    carried = [
        c for c in transactions.columns if c not in ("narration", "_batch_id", "_silver_updated_at", "source_system")
    ]
    return transactions.join(known, "transaction_id", "left").select(
        *carried,
        F.when(confirmed, True).when(closed, False).alias("fraud_flag"),
        "confirmed_fraud_method",
        F.when(confirmed, "CONFIRMED").when(closed, "CLEARED").otherwise("PENDING").alias("fraud_label_status"),
        "source_system",
        ctx.stamp.alias("_gold_updated_at"),
    )


def credit_risk(customers: DataFrame, loans: DataFrame, credit_records: DataFrame, ctx: RunContext) -> DataFrame:
    """Affordability and delinquency traits with the additive scorecard."""
    facilities = (
        latest_delivery(loans, ["loan_id"], ["snapshot_batch"], LOAN_STATE)
        .filter(F.col("status") != "CLOSED")
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("active_loan_count"),
            F.sum("principal").alias("total_loan_amount"),
            F.sum("outstanding_principal").alias("total_outstanding"),
            F.sum("emi_amount").alias("obligation_monthly"),
            F.sum("collateral_value").alias("collateral_value"),
            F.bool_or("npa_flag").alias("has_npa"),
            F.max(F.col("dpd").cast("int")).alias("dpd_current"),
        )
    )
    arrears = loans.groupBy("customer_id").agg(F.max(F.col("dpd").cast("int")).alias("dpd_max_12m"))
    bureau = latest_credit(credit_records).select(
        "customer_id",
        "credit_score",
        "score_band",
        F.col("enquiries_6m").alias("bureau_enquiries_6m"),
        "credit_vintage_months",
        F.col("delinquencies_24m").alias("bureau_delinquencies_24m"),
    )
    amount = lambda name: bands.money(F.col(name)).alias(name)
    base = (
        current_versions(customers)
        .select("customer_id", "region", "annual_income")
        .join(facilities, "customer_id", "left")
        .join(arrears, "customer_id", "left")
        .join(bureau, "customer_id", "left")
        .select(
            "customer_id",
            "region",
            "credit_score",
            "score_band",
            F.round(F.coalesce("annual_income", F.lit(0.0)) / 12.0, 2).alias("income_monthly"),
            amount("obligation_monthly"),
            F.coalesce("active_loan_count", F.lit(0).cast("long")).alias("active_loan_count"),
            amount("total_loan_amount"),
            amount("total_outstanding"),
            F.coalesce("dpd_current", F.lit(0)).alias("dpd_current"),
            F.coalesce("dpd_max_12m", F.lit(0)).alias("dpd_max_12m"),
            amount("collateral_value"),
            "bureau_enquiries_6m",
            "credit_vintage_months",
            "bureau_delinquencies_24m",
            bands.flag(F.col("has_npa")).alias("has_npa"),
        )
    )
    burden = F.when(F.col("income_monthly") > 0, F.col("obligation_monthly") / F.col("income_monthly"))
    cover = F.when(F.col("total_outstanding") > 0, F.col("collateral_value") / F.col("total_outstanding"))
    scored = base.withColumns(
        {
            "__burden": burden,
            "__points": bands.risk_points(
                F.col("credit_score"), F.col("dpd_max_12m"), F.coalesce(burden, F.lit(0.0)), F.col("has_npa")
            ),
        }
    )
    return scored.select(
        "customer_id",
        ctx.day.alias("as_of_date"),
        "region",
        "credit_score",
        "score_band",
        "income_monthly",
        "obligation_monthly",
        F.round("__burden", 4).alias("dti"),
        F.round("__burden", 4).alias("foir"),
        "active_loan_count",
        "total_loan_amount",
        "total_outstanding",
        "dpd_current",
        "dpd_max_12m",
        (F.col("dpd_max_12m") >= bands.NPA_FROM_DPD).alias("default_history_flag"),
        "collateral_value",
        F.round(cover, 4).alias("collateral_coverage_ratio"),
        "bureau_enquiries_6m",
        "credit_vintage_months",
        "bureau_delinquencies_24m",
        F.round("__points", 2).alias("risk_score"),
        bands.risk_band(F.col("__points")).alias("risk_band"),
        ctx.stamp.alias("_gold_updated_at"),
    )
