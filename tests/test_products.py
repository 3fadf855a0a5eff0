from datetime import date, datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.context import RunContext
from ledgerloom.operators import products

AS_OF = date(2024, 6, 30)
CTX = RunContext(AS_OF)


def customers(spark, *entries):
    df = spark.createDataFrame(list(entries), "customer_id string, annual_income double, is_current boolean")
    return df.selectExpr(
        "*", "30 AS age", "'26-35' AS age_group", "'N' AS region", "'c' AS city", "'s' AS state_code",
        "'Retail' AS marketing_segment", "'VERIFIED' AS kyc_status", "'ATM' AS preferred_channel", "'1' AS valid_from_batch",
    )


def loans(spark, *entries):
    df = spark.createDataFrame(
        list(entries),
        "loan_id string, customer_id string, snapshot_batch string, product string, status string, dpd int, principal double, outstanding_principal double",
    )
    return df.selectExpr("*", "dpd >= 90 AS npa_flag", "100D AS emi_amount", "50D AS collateral_value")


def accounts(spark, *entries):
    df = spark.createDataFrame(
        list(entries), "account_id string, customer_id string, snapshot_batch string, account_type string, status string, balance double"
    )
    return df.selectExpr("*", "1D AS overdraft_limit", "balance IS NULL AS balance_anomaly_flag", "false AS region_conflict_flag")


def transactions(spark, *entries):
    rows_ = [(i, c, d, g, a, datetime(d.year, d.month, d.day, 12)) for i, c, d, g, a in entries]
    df = spark.createDataFrame(
        rows_, "transaction_id string, customer_id string, transaction_date date, channel_group string, amount double, transaction_ts timestamp_ntz"
    )
    return df.selectExpr("*", "'DEBIT' AS debit_credit", "'s_cards' AS source_system")


def credit(spark, *entries):
    df = spark.createDataFrame(list(entries), "customer_id string, snapshot_batch string, credit_score int")
    return df.selectExpr("*", "'b' AS bureau_id", "'GOOD' AS score_band", "1 AS enquiries_6m", "2 AS credit_vintage_months", "3 AS delinquencies_24m")


def test_customer_360_uses_latest_states_and_zero_for_what_is_absent(spark):
    out = products.customer_360(
        customers(spark, ("C1", 1.0, True), ("C2", 1.0, True), ("C1", 1.0, False)),
        accounts(
            spark,
            ("A1", "C1", "1", "SAVINGS", "ACTIVE", 9e9), ("A1", "C1", "2", "SAVINGS", "DORMANT", 299999.99),
            ("A2", "C1", "1", "FIXED_DEPOSIT", "ACTIVE", 0.01), ("A3", "C1", "1", "CURRENT", "ACTIVE", None),
        ),
        loans(spark, ("L1", "C1", "1", "BUSINESS", "CLOSED", 90, 10.0, 5.0)),
        transactions(
            spark,
            ("T1", "C1", AS_OF - timedelta(days=90), "CARD", 5.0),
            ("T2", "C1", AS_OF - timedelta(days=89), "CARD", 7.0),
            ("T3", "C1", AS_OF, "ATM", 9.0),
        ),
        credit(spark, ("C1", "1", 800), ("C1", "2", 650)),
        CTX,
    )
    assert rows(
        out, "customer_id", "customer_type", "account_count", "active_accounts", "total_balance", "total_deposits",
        "customer_segment", "risk_category", "balance_anomaly_count", "npa_count", "txn_count_90d", "card_spend_90d",
    ) == [
        ("C1", "Business", 3, 2, 300000.0, 0.01, "Affluent", "Medium", 1, 1, 2, 7.0),
        ("C2", "Individual", 0, 0, 0.0, 0.0, "Mass", "Unknown", 0, 0, 0, 0.0),
    ]


def test_labels_show_only_when_available_at_the_anchor(spark):
    facts = transactions(
        spark,
        ("old", "C1", AS_OF - timedelta(days=90), "CARD", 1.0),
        ("recent", "C1", AS_OF - timedelta(days=89), "CARD", 1.0),
        ("known", "C1", AS_OF - timedelta(days=89), "CARD", 1.0),
        ("tomorrow", "C1", AS_OF - timedelta(days=89), "CARD", 1.0),
    )
    labels = spark.createDataFrame(
        # the first label is delivered three times
        [("known", "BURST", AS_OF - timedelta(days=1)), ("known", "GEO_JUMP", AS_OF), ("known", "GEO_JUMP", AS_OF), ("tomorrow", "GEO_JUMP", AS_OF + timedelta(days=1))],
        "transaction_id string, fraud_method string, label_available_date date",
    )
    out = products.transaction_product(facts, labels, CTX)
    assert rows(out, "transaction_id", "fraud_flag", "fraud_label_status", "confirmed_fraud_method") == [
        ("known", True, "CONFIRMED", "GEO_JUMP"), ("old", False, "CLEARED", None), ("recent", None, "PENDING", None),
        ("tomorrow", None, "PENDING", None),
    ]


def test_credit_risk_counts_open_loans_but_arrears_over_all_history(spark):
    out = products.credit_risk(
        customers(spark, ("C1", 12000.0, True), ("C2", None, True), ("C3", 0.0, True)),
        loans(
            spark,
            ("L1", "C1", "1", "HOME", "ACTIVE", 95, 10.0, 200.0), ("L1", "C1", "2", "HOME", "ACTIVE", 10, 10.0, 200.0),
            ("L2", "C1", "1", "HOME", "CLOSED", 0, 10.0, 500.0), ("L3", "C2", "1", "HOME", "ACTIVE", 0, 10.0, 0.0),
        ),
        credit(spark, ("C1", "1", 700)),
        CTX,
    )
    got = rows(
        out, "customer_id", "active_loan_count", "dpd_current", "dpd_max_12m", "default_history_flag", "dti",
        "collateral_coverage_ratio", "risk_score", "risk_band",
    )
    assert got == [
        ("C1", 1, 10, 95, True, 0.1, 0.25, 36.25, "MEDIUM"),
        ("C2", 1, 0, 0, False, None, None, 12.5, "LOW"),
        ("C3", 0, 0, 0, False, None, None, 12.5, "LOW"),
    ]


def test_options_for_open_loans_and_card_debits(spark):
    book = loans(spark, ("L1", "C1", "1", "HOME", "CLOSED", 0, 1.0, 1.0), ("L2", "C1", "1", "HOME", "ACTIVE", 0, 1.0, 2.0))
    assert products.loan_totals(book).first()["loan_count"] == 2
    assert products.loan_totals(book, open_only=True).first()["loan_outstanding"] == 2.0
    facts = transactions(spark, ("T1", "C1", AS_OF, "CARD", 5.0)).withColumn("debit_credit", F.lit("CREDIT"))
    assert products.trailing_activity(facts, CTX).first()["card_spend_90d"] == 5.0
    assert products.trailing_activity(facts, CTX, debits_only=True).first()["card_spend_90d"] == 0.0
