from datetime import date, datetime

from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.context import RunContext
from ledgerloom.operators import conform

CTX = RunContext(date(2024, 6, 30))
CRM = (
    "customer_id string, region string, state_code string, city string, pincode string, marketing_segment string, "
    "kyc_status string, preferred_channel string, onboarded_date date, relationship_manager_id string, "
    "annual_income double, date_of_birth date, first_name string, email string, _batch_id string"
)


def crm(spark, *entries):
    full = [
        (c, region, "S", "City", "1", "Retail", "VERIFIED", "ATM", None, "RM", 1200.0, date(1990, 5, 5), "Ann", "a@b.c", b)
        for c, region, b in entries
    ]
    return spark.createDataFrame(full, CRM)


def test_direct_identifiers_do_not_leave_and_an_absent_column_gets_its_default(spark):
    out = conform.silver_customers(crm(spark, ("C1", "N", "1")), CTX)
    assert not {"first_name", "email", "date_of_birth"} & set(out.columns)
    row = out.first()
    assert row["preferred_language"] == "UNKNOWN" and row["income_monthly"] == 100.0 and row["age"] == 34
    shipped = crm(spark, ("C1", "N", "1")).withColumn("preferred_language", F.lit(None).cast("string"))
    assert conform.silver_customers(shipped, CTX).first()["preferred_language"] == "UNKNOWN"


def test_region_survivorship_and_remediation(spark):
    accounts = spark.createDataFrame(
        [
            ("A1", "C1", "SAVINGS", "S", -5.0),
            ("A2", "C1", "FIXED_DEPOSIT", None, -5.0),
            ("A3", "C1", "CURRENT", "N", 7.0),
            ("A4", "C9", "SALARY", "N", None),
        ],
        "account_id string, customer_id string, account_type string, branch_region string, balance double",
    ).selectExpr(
        "*", "'B' AS branch_id", "'INR' AS currency", "DATE'2020-01-01' AS open_date", "'ACTIVE' AS status",
        "0D AS overdraft_limit", "1D AS interest_rate", "'1' AS _batch_id",
    )
    # The newest residence wins, not the first one.
    out = conform.silver_accounts(accounts, crm(spark, ("C1", "S", "1"), ("C1", "N", "2")))
    picked = rows(
        out, "account_id", "branch_region", "branch_region_missing_flag", "region_conflict_flag", "balance",
        "balance_raw", "balance_anomaly_flag",
    )
    assert picked == [
        ("A1", "S", False, True, None, -5.0, True),
        ("A2", "N", True, False, -5.0, -5.0, False),
        ("A3", "N", False, False, 7.0, 7.0, False),
        ("A4", "N", False, True, None, None, False),
    ]


def test_rails_share_one_shape(spark):
    base = "transaction_id string, customer_id string, account_id string, transaction_ts timestamp_ntz, amount double, currency string, debit_credit string, channel string, narration string, _batch_id string"
    at = datetime(2024, 3, 31, 23, 59, 59)
    core = spark.createDataFrame(
        [(f"T{i}", "C1", "A1", at, 10.0, "INR", "DEBIT", ch, "n", "1") for i, ch in enumerate(["ATM", "CHEQUE", "STANDING_INSTRUCTION"])]
        + [(None, "C1", "A1", at, 10.0, "INR", "DEBIT", "ATM", "n", "1")],
        base,
    )
    payments = spark.createDataFrame([("P1", "C1", "A1", at, 4.0, "INR", "CREDIT", "UPI", "n", "1")], base)
    cards = spark.createDataFrame(
        [("K1", "C1", "CARD1", at, 3.0, "USD", "DEBIT", "POS", "M1", "Fuel", "SGP", None, "D1", "1")],
        "transaction_id string, customer_id string, card_id string, transaction_ts timestamp_ntz, amount double, "
        "currency string, debit_credit string, channel string, merchant_id string, merchant_category string, "
        "merchant_country string, is_international boolean, device_id string, _batch_id string",
    )
    out = conform.silver_transactions(core, cards, payments)
    assert rows(out, "transaction_id", "channel_group", "source_system", "signed_amount") == [
        ("K1", "CARD", "s_cards", -3.0), ("P1", "PAYMENT", "s_payments", 4.0), ("T0", "ATM", "s_core", -10.0),
        ("T1", "BRANCH", "s_core", -10.0), ("T2", "TRANSFER", "s_core", -10.0),
    ]
    card = out.filter("transaction_id = 'K1'").first()
    assert card["is_international"] is False and card["account_id"] is None and card["narration"] is None
    assert card["transaction_hour"] == 23 and card["transaction_month"] == datetime(2024, 3, 1)
    assert out.filter("transaction_id = 'P1'").first()["is_international"] is False


def test_loans_and_repayments(spark):
    loans = spark.createDataFrame(
        [("L1", 90, 100.0, 50.0, 25.0), ("L2", 0, 0.0, 0.0, 10.0)],
        "loan_id string, dpd bigint, principal double, outstanding_principal double, collateral_value double",
    ).selectExpr(
        "*", "'C1' AS customer_id", "'HOME' AS product", "9D AS interest_rate", "12L AS tenor_months", "5D AS emi_amount",
        "DATE'2020-01-01' AS disbursed_date", "'ACTIVE' AS status", "'GOLD' AS collateral_type", "'1' AS _batch_id",
    )
    out = conform.silver_loans(loans)
    # dpd 90 is both the last band below 90+ and already non-performing.
    assert rows(out, "loan_id", "dpd_band", "npa_flag", "outstanding_ratio", "collateral_coverage_ratio") == [
        ("L1", "DPD_61_90", True, 0.5, 0.5), ("L2", "CURRENT", False, None, None),
    ]
    paid = spark.createDataFrame(
        [("R1", 10.0, 10.0, 0), ("R2", 10.0, 9.0, 31)], "repayment_id string, amount_due double, amount_paid double, dpd_at_payment bigint"
    ).selectExpr("*", "'L1' AS loan_id", "'C1' AS customer_id", "DATE'2020-01-01' AS due_date", "DATE'2020-01-02' AS paid_date", "'1' AS _batch_id")
    assert rows(conform.silver_repayments(paid), "repayment_id", "amount_shortfall", "paid_in_full", "punctuality_band") == [
        ("R1", 0.0, True, "ON_TIME"), ("R2", 1.0, False, "LATE_30_PLUS"),
    ]


def test_cards_keep_the_latest_state_and_bureau_bands_are_derived_again(spark):
    cards = spark.createDataFrame(
        [("K1", "1", "ACTIVE", "CREDIT"), ("K1", "2", "BLOCKED", "CREDIT"), ("K2", "1", "ACTIVE", "DEBIT")],
        "card_id string, _batch_id string, status string, card_type string",
    ).selectExpr(
        "*", "'C1' AS customer_id", "'VISA' AS network", "'xx' AS masked_number", "'10' AS credit_limit",
        "'2020-01-01' AS issue_date", "'2025-01-01' AS expiry_date",
    )
    assert rows(conform.silver_cards(cards), "card_id", "is_active", "is_credit", "snapshot_batch") == [
        ("K1", False, True, "2"), ("K2", True, False, "1"),
    ]
    bureau = spark.createDataFrame([("B1", 800), ("B2", None)], "bureau_id string, credit_score bigint").selectExpr(
        "*", "'C1' AS customer_id", "'POOR' AS score_band", "1L AS enquiries_6m", "1L AS delinquencies_24m",
        "1L AS credit_vintage_months", "1D AS total_exposure", "1L AS active_tradelines", "'2020-01-01' AS as_of_date", "'1' AS _batch_id",
    )
    assert rows(conform.silver_credit_records(bureau), "bureau_id", "score_band") == [("B1", "EXCELLENT"), ("B2", "VERY_POOR")]
