"""The published quality rules of the platform."""

from __future__ import annotations

from ledgerloom.operators.quality import WARNING, Rule

# Rule ids, thresholds, vocabularies and the sentences readers see.
C360, TXN, RISK = "gold.customer_360", "gold.transaction", "gold.credit_risk"
CUSTOMERS, TRANSACTIONS, ACCOUNTS = "silver.customers", "silver.transactions", "silver.accounts"
RAW_ACCOUNTS = "bronze.s_core_accounts"

PUBLISHED_RULES: tuple[Rule, ...] = (
    Rule(C360, "c360_unique_customer", "unique", ("customer_id",),
         description="customer_360 has exactly one row per customer"),
    Rule(C360, "c360_not_null_keys", "not_null", ("customer_id",)),
    Rule(C360, "c360_not_null_segment", "not_null", ("customer_segment",)),
    Rule(C360, "c360_not_null_risk", "not_null", ("risk_category",)),
    Rule(C360, "c360_segment_vocabulary", "vocabulary", ("customer_segment",),
         allowed=("Mass", "Affluent", "HNI", "Premium"),
         description="customer_segment is one of Mass/Affluent/HNI/Premium"),
    Rule(C360, "c360_risk_vocabulary", "vocabulary", ("risk_category",),
         allowed=("Low", "Medium", "High", "Unknown"),
         description="risk_category is one of Low/Medium/High/Unknown"),
    Rule(C360, "c360_credit_score_range", "range", ("credit_score",), minimum=300, maximum=900),
    Rule(C360, "c360_non_negative_balance", "range", ("total_balance",), minimum=0,
         description="total_balance can never be negative"),
    Rule(C360, "c360_row_count_floor", "row_count", minimum=100,
         description="customer_360 must not silently lose customers"),
    Rule(TXN, "txn_unique_id", "unique", ("transaction_id",)),
    Rule(TXN, "txn_not_null_id", "not_null", ("transaction_id",)),
    Rule(TXN, "txn_not_null_ts", "not_null", ("transaction_ts",)),
    Rule(TXN, "txn_not_null_amount", "not_null", ("amount",)),
    Rule(TXN, "txn_non_negative_amount", "range", ("amount",), minimum=0),
    Rule(TXN, "txn_not_null_direction", "not_null", ("debit_credit",)),
    Rule(TXN, "txn_label_status_vocabulary", "vocabulary", ("fraud_label_status",),
         allowed=("CONFIRMED", "CLEARED", "PENDING"),
         description="every transaction carries an explicit dispute-window label status"),
    Rule(TXN, "txn_recent_labels_withheld", "withheld", ("fraud_flag",), where=("fraud_label_status", "PENDING"),
         description="the last 90 days must contain no confirmed labels (dispute window open)"),
    Rule(RISK, "cr_unique_customer", "unique", ("customer_id",)),
    Rule(RISK, "cr_not_null_customer", "not_null", ("customer_id",)),
    Rule(RISK, "cr_dti_band", "range", ("dti",), minimum=0, maximum=5),
    Rule(RISK, "cr_risk_score_band", "range", ("risk_score",), minimum=0, maximum=100),
    Rule(RISK, "cr_risk_band_vocabulary", "vocabulary", ("risk_band",),
         allowed=("LOW", "MEDIUM", "HIGH", "VERY_HIGH")),
    Rule(CUSTOMERS, "silver_customer_unique_version", "unique", ("customer_id", "valid_from_batch"),
         description="(customer_id, valid_from_batch) is unique"),
    Rule(CUSTOMERS, "silver_customer_not_null", "not_null", ("customer_id",)),
    Rule(CUSTOMERS, "silver_customer_one_current", "one_current", ("customer_id", "is_current")),
    Rule(TRANSACTIONS, "silver_txn_unique", "unique", ("transaction_id",)),
    Rule(TRANSACTIONS, "silver_txn_amount_range", "range", ("amount",), minimum=0, maximum=100_000_000),
    Rule(ACCOUNTS, "silver_account_referential", "referential", ("customer_id",), reference=CUSTOMERS,
         reference_column="customer_id", threshold=0.999),
    Rule(ACCOUNTS, "silver_account_balance_flag_rate", "null_rate", ("balance",), threshold=0.05,
         description="no more than 5% of conformed balances may be nulled by remediation"),
    Rule(RAW_ACCOUNTS, "bronze_region_null_rate", "null_rate", ("branch_region",), threshold=0.02, severity=WARNING,
         description="historical incident: branch_region was missing on a slice of the month 9 extract while the "
                     "upstream system was degraded"),
    Rule(RAW_ACCOUNTS, "bronze_impossible_negative_balances", "range", ("balance",), minimum=0, severity=WARNING,
         description="historical incident: month 9 produced impossible negative savings balances; silver nulls and "
                     "flags them"),
)
