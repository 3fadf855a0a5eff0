"""Conformation of raw source extracts into the silver vocabulary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.context import RunContext
from ledgerloom.functions import bands, text
from ledgerloom.operators.snapshots import latest_delivery, version_history

# The shared transaction shape and its vocabulary.
RAIL_SHAPE = {
    "transaction_id": "string",
    "customer_id": "string",
    "account_id": "string",
    "transaction_ts": "timestamp_ntz",
    "amount": "double",
    "currency": "string",
    "debit_credit": "string",
    "channel": "string",
    "channel_group": "string",
    "merchant_id": "string",
    "merchant_category": "string",
    "merchant_country": "string",
    "is_international": "boolean",
    "card_id": "string",
    "device_id": "string",
    "narration": "string",
    "source_system": "string",
    "_batch_id": "string",
}
BRANCH_CHANNELS = ("BRANCH", "CASH_DEPOSIT", "CHEQUE")
DEPOSIT_ACCOUNTS = ("SAVINGS", "CURRENT", "SALARY")
TRACKED_CUSTOMER_ATTRIBUTES = ("region", "city", "marketing_segment", "kyc_status")
OPTIONAL_COLUMNS = {"preferred_language": "UNKNOWN"}


def optional_column(df: DataFrame, name: str, default: str) -> Column:
    """The column when the source ships it (NULL becomes the default), else the default."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def with_optional(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: optional_column(df, name, default) for name, default in columns.items()})


def _finish(df: DataFrame, ctx: RunContext | None) -> DataFrame:
    return df if ctx is None else ctx.stamped(df, "_silver_updated_at")


def silver_customers(crm: DataFrame, ctx: RunContext, *, collapse: bool = True) -> DataFrame:
    """Versioned customers; direct identifiers replaced by tokens, birth date by a band."""
    ties = [c for c in ("_ingested_at", "_source_file") if c in crm.columns]
    versions = version_history(
        with_optional(crm, OPTIONAL_COLUMNS), "customer_id", "_batch_id", TRACKED_CUSTOMER_ATTRIBUTES, collapse=collapse, tie_break=ties
    )
    return customer_versions(versions, ctx)


def customer_versions(versions: DataFrame, ctx: RunContext) -> DataFrame:
    """Versions of raw CRM rows in the silver vocabulary."""
    versions = with_optional(versions, OPTIONAL_COLUMNS)
    tokens = [
        text.pseudonym(F.col("customer_id"), kind).alias(f"{kind.lower()}_token") for kind in text.TOKEN_KINDS
    ]
    income = F.col("annual_income").cast("double")
    age = bands.calendar_years(F.col("date_of_birth"), ctx.as_of)
    return _finish(
        versions.select(
            "customer_id",
            *tokens,
            "region",
            "state_code",
            "city",
            "pincode",
            "marketing_segment",
            "kyc_status",
            "preferred_channel",
            "preferred_language",
            "onboarded_date",
            "relationship_manager_id",
            income.alias("annual_income"),
            (income / 12.0).alias("income_monthly"),
            age.alias("age"),
            bands.age_band(age).alias("age_group"),
            "valid_from_batch",
            "valid_to_batch",
            "is_current",
            "version_no",
        ),
        ctx,
    )


def silver_accounts(accounts: DataFrame, crm: DataFrame, ctx: RunContext | None = None) -> DataFrame:
    """Accounts per batch: surviving region, conflict flag, remediated balance.

    Both the branch's and the resident's region are kept, and an impossible negative
    deposit balance is nulled with the raw value preserved beside it.
    """
    told = [c for c in ("_ingested_at", "_source_file") if c in crm.columns]
    lived = crm.select("customer_id", F.col("region").alias("customer_region"), "_batch_id", *told)
    resident = latest_delivery(lived, ["customer_id"], ["_batch_id"], ["customer_region"]).select("customer_id", "customer_region")
    raw = F.col("balance").cast("double")
    anomaly = bands.flag(F.col("account_type").isin(*DEPOSIT_ACCOUNTS) & (raw < 0))
    branch, home = F.col("branch_region"), F.col("customer_region")
    return _finish(
        accounts.join(resident, "customer_id", "left").select(
            "account_id",
            "customer_id",
            "account_type",
            "branch_id",
            F.coalesce(branch, home).alias("branch_region"),
            branch.alias("branch_region_raw"),
            branch.isNull().alias("branch_region_missing_flag"),
            home.alias("customer_region"),
            (branch.isNotNull() & ~branch.eqNullSafe(home)).alias("region_conflict_flag"),
            "currency",
            "open_date",
            "status",
            raw.alias("balance_raw"),
            F.when(~anomaly, raw).alias("balance"),
            anomaly.alias("balance_anomaly_flag"),
            F.col("overdraft_limit").cast("double").alias("overdraft_limit"),
            F.col("interest_rate").cast("double").alias("interest_rate"),
            F.col("_batch_id").alias("snapshot_batch"),
        ),
        ctx,
    )


def on_rail(df: DataFrame, source: str, channel_group: Column) -> DataFrame:
    """One rail in the shared shape; what the rail lacks becomes a typed NULL."""
    supplied = {
        "channel_group": channel_group,
        "source_system": F.lit(source),
    }
    if "is_international" not in df.columns:
        supplied["is_international"] = F.lit(False)
    for name in RAIL_SHAPE:
        if name not in supplied:
            supplied[name] = F.col(name) if name in df.columns else F.lit(None)
    return df.select(*[supplied[name].cast(kind).alias(name) for name, kind in RAIL_SHAPE.items()])


def core_rail(df: DataFrame) -> DataFrame:
    channel = F.col("channel")
    group = F.when(channel == "ATM", "ATM").when(channel.isin(*BRANCH_CHANNELS), "BRANCH").otherwise("TRANSFER")
    return on_rail(df, "s_core", group)


def card_rail(df: DataFrame) -> DataFrame:
    return on_rail(df, "s_cards", F.lit("CARD"))


def payment_rail(df: DataFrame) -> DataFrame:
    return on_rail(df, "s_payments", F.lit("PAYMENT"))


def conform_transactions(rails: DataFrame, ctx: RunContext | None = None) -> DataFrame:
    """Derived time and sign columns; works on a batch or on a stream."""
    ts = F.col("transaction_ts")
    return _finish(
        rails.filter(F.col("transaction_id").isNotNull()).select(
            "transaction_id",
            "customer_id",
            "account_id",
            "transaction_ts",
            F.to_date(ts).alias("transaction_date"),
            F.date_trunc("month", ts).cast("timestamp_ntz").alias("transaction_month"),
            F.hour(ts).cast("long").alias("transaction_hour"),
            "amount",
            "currency",
            "debit_credit",
            bands.signed(F.col("amount"), F.col("debit_credit")).alias("signed_amount"),
            "channel",
            "channel_group",
            "merchant_id",
            "merchant_category",
            "merchant_country",
            bands.flag(F.col("is_international")).alias("is_international"),
            "card_id",
            "device_id",
            "narration",
            "source_system",
            "_batch_id",
        ),
        ctx,
    )


def silver_transactions(
    core: DataFrame, cards: DataFrame, payments: DataFrame, ctx: RunContext | None = None
) -> DataFrame:
    """All three rails as one fact; nothing is merged or dropped but rows without an id."""
    union = core_rail(core).unionByName(card_rail(cards)).unionByName(payment_rail(payments))
    return conform_transactions(union, ctx)


# What is kept of the latest row of a card.
CARD_STATE = ("customer_id", "status", "credit_limit", "card_type", "network", "masked_number", "issue_date", "expiry_date")


def silver_cards(cards: DataFrame, ctx: RunContext | None = None) -> DataFrame:
    latest = latest_delivery(cards, ["card_id"], ["_batch_id"], CARD_STATE)
    return _finish(
        latest.select(
            "card_id",
            "customer_id",
            "card_type",
            "network",
            "masked_number",
            F.col("credit_limit").cast("double").alias("credit_limit"),
            F.col("issue_date").cast("date").alias("issue_date"),
            F.col("expiry_date").cast("date").alias("expiry_date"),
            "status",
            bands.flag(F.col("status") == "ACTIVE").alias("is_active"),
            bands.flag(F.col("card_type") == "CREDIT").alias("is_credit"),
            F.col("_batch_id").alias("snapshot_batch"),
        ),
        ctx,
    )


def silver_credit_records(records: DataFrame, ctx: RunContext | None = None) -> DataFrame:
    """Bureau records; the band is always derived again from the score."""
    whole = lambda name: F.col(name).cast("int")
    return _finish(
        records.select(
            "bureau_id",
            "customer_id",
            whole("credit_score").alias("credit_score"),
            bands.score_band(whole("credit_score")).alias("score_band"),
            whole("enquiries_6m").alias("enquiries_6m"),
            whole("delinquencies_24m").alias("delinquencies_24m"),
            whole("credit_vintage_months").alias("credit_vintage_months"),
            F.col("total_exposure").cast("double").alias("total_exposure"),
            whole("active_tradelines").alias("active_tradelines"),
            F.col("as_of_date").cast("date").alias("as_of_date"),
            F.col("_batch_id").alias("snapshot_batch"),
        ),
        ctx,
    )


def silver_loans(loans: DataFrame, ctx: RunContext | None = None) -> DataFrame:
    dpd = F.col("dpd").cast("int")
    principal, outstanding, collateral = (
        F.col(name).cast("double") for name in ("principal", "outstanding_principal", "collateral_value")
    )
    return _finish(
        loans.select(
            "loan_id",
            "customer_id",
            "product",
            principal.alias("principal"),
            F.col("interest_rate").cast("double").alias("interest_rate"),
            F.col("tenor_months").cast("int").alias("tenor_months"),
            F.col("emi_amount").cast("double").alias("emi_amount"),
            F.col("disbursed_date").cast("date").alias("disbursed_date"),
            outstanding.alias("outstanding_principal"),
            bands.ratio(outstanding, principal).alias("outstanding_ratio"),
            dpd.alias("dpd"),
            bands.dpd_band(dpd).alias("dpd_band"),
            bands.flag(dpd >= bands.NPA_FROM_DPD).alias("npa_flag"),
            "status",
            "collateral_type",
            collateral.alias("collateral_value"),
            bands.ratio(collateral, outstanding).alias("collateral_coverage_ratio"),
            F.col("_batch_id").alias("snapshot_batch"),
        ),
        ctx,
    )


def silver_repayments(repayments: DataFrame, ctx: RunContext | None = None) -> DataFrame:
    due, paid = F.col("amount_due").cast("double"), F.col("amount_paid").cast("double")
    dpd = F.col("dpd_at_payment").cast("int")
    return _finish(
        repayments.select(
            "repayment_id",
            "loan_id",
            "customer_id",
            F.col("due_date").cast("date").alias("due_date"),
            F.col("paid_date").cast("date").alias("paid_date"),
            due.alias("amount_due"),
            paid.alias("amount_paid"),
            (due - paid).alias("amount_shortfall"),
            bands.flag(paid >= due).alias("paid_in_full"),
            dpd.alias("dpd_at_payment"),
            bands.punctuality_band(dpd).alias("punctuality_band"),
            F.col("_batch_id").alias("snapshot_batch"),
        ),
        ctx,
    )
