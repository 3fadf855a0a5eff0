"""Queries over the product operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import products
from ledgerloom.workload.registry import query
from ledgerloom.workload.views_sql import AS_OF, day, stamp


@query(
    "customer_360",
    f"SELECT * REPLACE ({stamp('last_transaction_at')} AS last_transaction_at) FROM customer_360",
)
def _(t):
    return t.customer_360.drop("_gold_updated_at")


@query(
    "customer_segments",
    """SELECT region, customer_segment, risk_category, count(*) AS customers,
              round(sum(CAST(total_balance AS DECIMAL(18, 2))), 2)::DOUBLE AS total_balance
       FROM customer_360 GROUP BY ALL""",
)
def _(t):
    exact = F.sum(F.col("total_balance").cast("decimal(18,2)")).cast("double")
    return t.customer_360.groupBy("region", "customer_segment", "risk_category").agg(
        F.count(F.lit(1)).alias("customers"), exact.alias("total_balance")
    )


@query(
    "trailing_90d_activity",
    f"""SELECT customer_id, txn_count_90d, round(card_spend_90d, 2) AS card_spend_90d,
               {stamp("last_transaction_at")} AS last_transaction_at
        FROM activity""",
)
def _(t):
    activity = products.trailing_activity(t.s_transactions, t.ctx)
    return activity.withColumn("card_spend_90d", F.round("card_spend_90d", 2))


@query(
    "trailing_90d_card_debits",
    f"""SELECT customer_id, count(*) AS txn_count_90d,
               round(coalesce(sum(amount) FILTER (channel_group = 'CARD' AND debit_credit = 'DEBIT'), 0), 2)
                   AS card_spend_90d
        FROM s_transactions WHERE transaction_date > {AS_OF} - 90 GROUP BY customer_id""",
)
def _(t):
    activity = products.trailing_activity(t.s_transactions, t.ctx, debits_only=True)
    return activity.select("customer_id", "txn_count_90d", F.round("card_spend_90d", 2).alias("card_spend_90d"))


@query(
    "time_gated_labels",
    f"""SELECT transaction_id, customer_id, {day("transaction_date")} AS transaction_date, amount, source_system,
               fraud_flag, confirmed_fraud_method, fraud_label_status
        FROM transaction_labelled""",
)
def _(t):
    return t.transaction.select(
        "transaction_id", "customer_id", "transaction_date", "amount", "source_system", "fraud_flag",
        "confirmed_fraud_method", "fraud_label_status",
    )


@query(
    "label_status_counts",
    """SELECT source_system, fraud_label_status, fraud_flag, count(*) AS transactions
       FROM transaction_labelled GROUP BY ALL""",
)
def _(t):
    return t.transaction.groupBy("source_system", "fraud_label_status", "fraud_flag").agg(
        F.count(F.lit(1)).alias("transactions")
    )


@query(
    "risk_scorecard",
    f"""SELECT customer_id, {day(AS_OF)} AS as_of_date, region, CAST(credit_score AS INTEGER) AS credit_score,
               score_band, income_monthly, obligation_monthly, dti, dti AS foir, active_loan_count, total_loan_amount,
               total_outstanding, CAST(dpd_current AS INTEGER) AS dpd_current,
               CAST(dpd_max_12m AS INTEGER) AS dpd_max_12m, default_history_flag, collateral_value,
               collateral_coverage_ratio, CAST(bureau_enquiries_6m AS INTEGER) AS bureau_enquiries_6m,
               CAST(credit_vintage_months AS INTEGER) AS credit_vintage_months,
               CAST(bureau_delinquencies_24m AS INTEGER) AS bureau_delinquencies_24m, risk_score, risk_band
        FROM credit_risk""",
)
def _(t):
    return t.credit_risk.drop("_gold_updated_at")


@query(
    "customer_type",
    """SELECT CASE WHEN runs_business THEN 'Business' ELSE 'Individual' END AS customer_type, count(*) AS customers,
              sum(loan_count)::BIGINT AS loans, sum(npa_count)::BIGINT AS impaired
       FROM loan_totals GROUP BY 1""",
)
def _(t):
    kind = F.when(F.col("runs_business"), "Business").otherwise("Individual").alias("customer_type")
    return products.loan_totals(t.s_loans).groupBy(kind).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("loan_count").alias("loans"),
        F.sum("npa_count").alias("impaired"),
    )


@query(
    "open_loan_totals",
    """SELECT customer_id, active_loan_count AS loan_count, round(total_outstanding, 2) AS loan_outstanding
       FROM facilities""",
)
def _(t):
    totals = products.loan_totals(t.s_loans, open_only=True)
    return totals.select("customer_id", "loan_count", F.round("loan_outstanding", 2).alias("loan_outstanding"))


@query(
    "balance_by_region",
    """SELECT r_name AS region, count(*) AS customers, sum(CAST(c_acctbal AS DECIMAL(18, 2)))::DOUBLE AS total_balance
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       GROUP BY 1 ORDER BY customers DESC, region""",
)
def _(t):
    people = t["customer"].join(t.places, F.col("c_nationkey") == F.col("n_nationkey"))
    exact = F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double")
    return (
        people.groupBy(F.col("r_name").alias("region"))
        .agg(F.count(F.lit(1)).alias("customers"), exact.alias("total_balance"))
        .orderBy(F.col("customers").desc(), "region")
    )
