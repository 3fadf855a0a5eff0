"""The same derived tables in SQL, as named subqueries for the oracle statements."""

from __future__ import annotations

import re

from ledgerloom.workload import tables as t


def case(column: str, values: dict[str, str], otherwise: str | None = None) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {column} {arms}" + (f" ELSE '{otherwise}'" if otherwise else "") + " END"


def day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


AS_OF = f"DATE '{t.AS_OF}'"
MONTH = "'%Y-%m-01'"

VIEWS: dict[str, str] = {
    "crm": f"""
        SELECT 'C' || c_custkey AS customer_id,
               CASE WHEN c_mktsegment = 'MACHINERY' AND o_orderpriority = '5-LOW' THEN NULL ELSE r_name END AS region,
               n_name AS state_code, o_orderpriority AS city, 'P' || n_nationkey AS pincode,
               c_mktsegment AS marketing_segment, o_orderstatus AS kyc_status,
               {case("r_name", t.PREFERRED_CHANNELS, "ATM")} AS preferred_channel,
               CAST(o_orderdate AS DATE) AS onboarded_date, 'RM' || n_nationkey AS relationship_manager_id,
               CASE WHEN NOT (c_acctbal < 0 AND c_mktsegment = 'HOUSEHOLD') THEN abs(c_acctbal) * 120 END
                   AS annual_income,
               CASE WHEN c_acctbal >= 0 THEN DATE '1935-01-01' + CAST((c_custkey * 733) % 25000 AS INTEGER) END
                   AS date_of_birth,
               strftime(o_orderdate, {MONTH}) AS _batch_id
        FROM (SELECT * FROM orders QUALIFY row_number() OVER (
                  PARTITION BY o_custkey, strftime(o_orderdate, {MONTH})
                  ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "order_months": f"""
        SELECT l_orderkey, strftime(l_shipdate, {MONTH}) AS _batch_id, max(l_suppkey) AS suppkey,
               arg_max(r_name, r_regionkey) FILTER (l_discount > 0) AS branch_region, max(l_linestatus) AS linestatus,
               max(l_returnflag) AS returnflag, max(l_discount) AS discount, max(l_linenumber) AS linenumber,
               max(l_shipdate) AS shipdate, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price,
               sum(CASE l_returnflag WHEN 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS net,
               any_value(o_orderkey) AS o_orderkey, any_value(o_custkey) AS o_custkey,
               any_value(o_orderpriority) AS o_orderpriority, any_value(o_orderdate) AS o_orderdate,
               any_value(o_totalprice) AS o_totalprice
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
        GROUP BY l_orderkey, strftime(l_shipdate, {MONTH})""",
    "accounts": f"""
        SELECT 'A' || o_orderkey AS account_id, 'C' || o_custkey AS customer_id,
               {case("o_orderpriority", t.ACCOUNT_TYPES)} AS account_type, 'B' || suppkey AS branch_id, branch_region,
               'INR' AS currency, CAST(o_orderdate AS DATE) AS open_date,
               CASE linestatus WHEN 'O' THEN 'ACTIVE' ELSE 'DORMANT' END AS status, round(net, 2) AS balance,
               quantity * 100 AS overdraft_limit, discount AS interest_rate, _batch_id
        FROM order_months""",
    "loan_terms": """
        SELECT *, round(discount * 100, 2) AS interest_rate, CAST(linenumber + 1 AS BIGINT) * 12 AS tenor_months
        FROM order_months""",
    "loans": f"""
        SELECT 'L' || o_orderkey AS loan_id, 'C' || o_custkey AS customer_id,
               {case("o_orderpriority", t.LOAN_PRODUCTS)} AS product, o_totalprice AS principal, interest_rate,
               tenor_months,
               -- a tie is rounded away from zero on the decimal value, not on its binary neighbour
               CAST(round(CAST(CASE WHEN interest_rate > 0
                     THEN o_totalprice * (interest_rate / 12.0 / 100.0)
                          / (1.0 - pow(interest_rate / 12.0 / 100.0 + 1.0, -tenor_months))
                     ELSE o_totalprice / tenor_months END AS DECIMAL(28, 10)), 2) AS DOUBLE) AS emi_amount,
               CAST(o_orderdate AS DATE) AS disbursed_date,
               round(greatest(0.0, o_totalprice - price), 2) AS outstanding_principal,
               greatest(0, date_diff('day', o_orderdate, shipdate)) % 121 AS dpd,
               CASE linestatus WHEN 'F' THEN 'CLOSED' ELSE 'ACTIVE' END AS status, returnflag AS collateral_type,
               round(price, 2) AS collateral_value, _batch_id
        FROM loan_terms""",
    "repayments": f"""
        SELECT 'R' || l_orderkey || '-' || l_linenumber AS repayment_id, 'L' || l_orderkey AS loan_id,
               'C' || o_custkey AS customer_id, CAST(o_orderdate AS DATE) + 30 AS due_date,
               CAST(l_shipdate AS DATE) AS paid_date, l_extendedprice AS amount_due,
               CASE l_returnflag WHEN 'R' THEN l_extendedprice - l_quantity ELSE l_extendedprice END AS amount_paid,
               greatest(0, date_diff('day', CAST(o_orderdate AS DATE) + 30, CAST(l_shipdate AS DATE))) % 61
                   AS dpd_at_payment,
               strftime(l_shipdate, {MONTH}) AS _batch_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "bureau": f"""
        SELECT 'B' || o_custkey || '-' || strftime(o_orderdate, {MONTH}) AS bureau_id,
               'C' || o_custkey AS customer_id, CAST(floor(max(o_totalprice)) AS BIGINT) % 601 + 300 AS credit_score,
               count(*) AS enquiries_6m, count(*) FILTER (o_orderstatus = 'F') AS delinquencies_24m,
               any_value(year(o_orderdate) * 12 + month(o_orderdate)) - 23900 AS credit_vintage_months,
               round(sum(o_totalprice), 2) AS total_exposure,
               count(*) FILTER (o_orderstatus = 'O') AS active_tradelines,
               CAST(strftime(o_orderdate, {MONTH}) AS DATE) AS as_of_date, strftime(o_orderdate, {MONTH}) AS _batch_id
        FROM orders GROUP BY o_custkey, strftime(o_orderdate, {MONTH})""",
    "cards": """
        SELECT 'K' || user_id AS card_id, 'C' || user_id AS customer_id,
               CASE max(event_type) WHEN 'view' THEN 'CREDIT' ELSE 'DEBIT' END AS card_type,
               upper(max(event_type)) AS network, 'XXXX' || user_id AS masked_number,
               max(value) * 100 AS credit_limit, min(CAST(ts AS DATE)) AS issue_date,
               min(CAST(ts AS DATE)) + 1095 AS expiry_date,
               CASE WHEN count(*) >= 2 THEN 'ACTIVE' ELSE 'BLOCKED' END AS status,
               strftime(ts, '%Y-%m-%d') AS _batch_id
        FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')""",
    "card_transactions": f"""
        SELECT 'E' || event_id AS transaction_id, 'C' || user_id AS customer_id, NULL::VARCHAR AS account_id,
               ts AS transaction_ts, value AS amount,
               CASE event_type WHEN 'signup' THEN 'USD' ELSE 'INR' END AS currency,
               CASE event_type WHEN 'error' THEN 'CREDIT' ELSE 'DEBIT' END AS debit_credit,
               {case("event_type", t.CARD_CHANNELS)} AS channel, 'CARD' AS channel_group,
               'M' || regexp_extract(props, '[0-9]+') AS merchant_id, event_type AS merchant_category,
               CASE event_type WHEN 'signup' THEN 'SGP' ELSE 'IND' END AS merchant_country,
               event_type = 'signup' AS is_international, 'K' || user_id AS card_id, 'D' || user_id AS device_id,
               NULL::VARCHAR AS narration, 's_cards' AS source_system, strftime(ts, {MONTH}) AS _batch_id
        FROM events""",
    "core_transactions": f"""
        SELECT 'O' || o_orderkey AS transaction_id, 'C' || o_custkey AS customer_id, 'A' || o_orderkey AS account_id,
               o_orderdate AS transaction_ts, o_totalprice AS amount, 'INR' AS currency,
               CASE o_orderstatus WHEN 'F' THEN 'DEBIT' ELSE 'CREDIT' END AS debit_credit,
               {case("o_orderpriority", t.CORE_CHANNELS)} AS channel,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'ATM' WHEN '2-HIGH' THEN 'BRANCH' WHEN '3-MEDIUM' THEN 'BRANCH'
                    ELSE 'TRANSFER' END AS channel_group,
               NULL::VARCHAR AS merchant_id, NULL::VARCHAR AS merchant_category, NULL::VARCHAR AS merchant_country,
               FALSE AS is_international, NULL::VARCHAR AS card_id, NULL::VARCHAR AS device_id,
               o_orderpriority AS narration, 's_core' AS source_system, strftime(o_orderdate, {MONTH}) AS _batch_id
        FROM orders""",
    "payment_transactions": f"""
        SELECT CASE WHEN l_quantity < 50 THEN 'P' || l_orderkey || '-' || l_linenumber END AS transaction_id,
               'C' || o_custkey AS customer_id, 'A' || l_orderkey AS account_id, l_shipdate AS transaction_ts,
               l_extendedprice AS amount, 'INR' AS currency,
               CASE l_linestatus WHEN 'F' THEN 'DEBIT' ELSE 'CREDIT' END AS debit_credit,
               {case("l_returnflag", t.PAYMENT_CHANNELS)} AS channel, 'PAYMENT' AS channel_group,
               NULL::VARCHAR AS merchant_id, NULL::VARCHAR AS merchant_category, NULL::VARCHAR AS merchant_country,
               FALSE AS is_international, NULL::VARCHAR AS card_id, NULL::VARCHAR AS device_id,
               l_returnflag AS narration, 's_payments' AS source_system, strftime(l_shipdate, {MONTH}) AS _batch_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "labels_known": f"""
        SELECT 'E' || event_id AS transaction_id, {case("event_type", t.FRAUD_METHODS)} AS fraud_method,
               'C' || user_id AS customer_id, CAST(ts AS DATE) + 10 AS label_available_date
        FROM events WHERE event_type IN ('purchase', 'click', 'error')""",
    "s_transactions": """
        SELECT *, CAST(transaction_ts AS DATE) AS transaction_date,
               date_trunc('month', transaction_ts) AS transaction_month,
               CAST(hour(transaction_ts) AS BIGINT) AS transaction_hour,
               CASE debit_credit WHEN 'DEBIT' THEN -amount ELSE amount END AS signed_amount
        FROM (FROM core_transactions UNION ALL BY NAME FROM card_transactions
              UNION ALL BY NAME FROM payment_transactions)
        WHERE transaction_id IS NOT NULL""",
    "crm_changes": """
        SELECT *, CASE WHEN lag(region) OVER w IS NULL
                         OR (region, city, marketing_segment, kyc_status) IS DISTINCT FROM
                            (lag(region) OVER w, lag(city) OVER w, lag(marketing_segment) OVER w,
                             lag(kyc_status) OVER w)
                       THEN 1 ELSE 0 END AS starts
        FROM crm WINDOW w AS (PARTITION BY customer_id ORDER BY _batch_id)""",
    "s_customers": f"""
        SELECT *, coalesce(lead(_batch_id) OVER w, '9999-12') AS valid_to_batch,
               lead(_batch_id) OVER w IS NULL AS is_current,
               year({AS_OF}) - year(date_of_birth) AS age,
               CASE WHEN year({AS_OF}) - year(date_of_birth) BETWEEN -100 AND 25 THEN '18-25'
                    WHEN year({AS_OF}) - year(date_of_birth) BETWEEN 26 AND 35 THEN '26-35'
                    WHEN year({AS_OF}) - year(date_of_birth) BETWEEN 36 AND 45 THEN '36-45'
                    WHEN year({AS_OF}) - year(date_of_birth) BETWEEN 46 AND 55 THEN '46-55'
                    WHEN year({AS_OF}) - year(date_of_birth) BETWEEN 56 AND 65 THEN '56-65' ELSE '65+' END AS age_group
        FROM (SELECT *, sum(starts) OVER (PARTITION BY customer_id ORDER BY _batch_id ROWS UNBOUNDED PRECEDING)
                     AS version_no FROM crm_changes)
        WHERE starts = 1 WINDOW w AS (PARTITION BY customer_id ORDER BY _batch_id)""",
    "residence": """
        SELECT customer_id, region AS customer_region FROM crm
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _batch_id DESC) = 1""",
    "s_accounts": """
        SELECT accounts.* EXCLUDE (branch_region, balance), branch_region AS branch_region_raw,
               coalesce(branch_region, customer_region) AS branch_region, branch_region IS NULL AS branch_region_missing_flag,
               customer_region,
               branch_region IS NOT NULL AND branch_region IS DISTINCT FROM customer_region AS region_conflict_flag,
               balance AS balance_raw,
               CASE WHEN balance < 0 AND account_type IN ('SAVINGS', 'CURRENT', 'SALARY') THEN NULL ELSE balance END AS balance,
               balance < 0 AND account_type IN ('SAVINGS', 'CURRENT', 'SALARY') AS balance_anomaly_flag
        FROM accounts LEFT JOIN residence USING (customer_id)""",
    "account_totals": """
        SELECT customer_id, count(*) AS account_count, count(*) FILTER (status = 'ACTIVE') AS active_accounts,
               sum(coalesce(balance, 0)) AS total_balance,
               coalesce(sum(balance) FILTER (account_type = 'FIXED_DEPOSIT'), 0) AS total_deposits,
               sum(overdraft_limit) AS total_overdraft_limit,
               count(*) FILTER (balance_anomaly_flag) AS balance_anomaly_count,
               count(*) FILTER (region_conflict_flag) AS region_conflict_count
        FROM (FROM s_accounts QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY _batch_id DESC) = 1)
        GROUP BY customer_id""",
    "loans_now": "FROM loans QUALIFY row_number() OVER (PARTITION BY loan_id ORDER BY _batch_id DESC) = 1",
    "loan_totals": """
        SELECT customer_id, count(*) AS loan_count, sum(outstanding_principal) AS loan_outstanding,
               sum(principal) AS total_loan_amount, count(*) FILTER (dpd >= 90) AS npa_count,
               bool_or(product = 'BUSINESS') AS runs_business
        FROM loans_now GROUP BY customer_id""",
    "activity": f"""
        SELECT customer_id, count(*) AS txn_count_90d,
               coalesce(sum(amount) FILTER (channel_group = 'CARD'), 0) AS card_spend_90d,
               max(transaction_ts) AS last_transaction_at
        FROM s_transactions WHERE transaction_date > {AS_OF} - 90 GROUP BY customer_id""",
    "score_now": """
        SELECT *, CASE WHEN credit_score >= 800 THEN 'EXCELLENT' WHEN credit_score >= 750 THEN 'GOOD'
                       WHEN credit_score >= 700 THEN 'FAIR' WHEN credit_score >= 650 THEN 'POOR'
                       ELSE 'VERY_POOR' END AS score_band
        FROM (FROM bureau QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _batch_id DESC) = 1)""",
    "customer_360": """
        SELECT c.customer_id, CASE WHEN runs_business THEN 'Business' ELSE 'Individual' END AS customer_type,
               CAST(age AS INTEGER) AS age, age_group, region, city, state_code, marketing_segment, kyc_status,
               preferred_channel, coalesce(account_count, 0) AS account_count,
               coalesce(active_accounts, 0) AS active_accounts, round(coalesce(total_balance, 0), 2) AS total_balance,
               round(coalesce(total_deposits, 0), 2) AS total_deposits,
               round(coalesce(total_overdraft_limit, 0), 2) AS total_overdraft_limit,
               coalesce(loan_count, 0) AS loan_count, round(coalesce(loan_outstanding, 0), 2) AS loan_outstanding,
               round(coalesce(total_loan_amount, 0), 2) AS total_loan_amount, coalesce(npa_count, 0) AS npa_count,
               round(coalesce(card_spend_90d, 0), 2) AS card_spend_90d, coalesce(txn_count_90d, 0) AS txn_count_90d,
               last_transaction_at, CAST(credit_score AS INTEGER) AS credit_score, score_band,
               CASE WHEN total_balance >= 5e6 THEN 'Premium' WHEN total_balance >= 1.5e6 THEN 'HNI'
                    WHEN total_balance >= 3e5 THEN 'Affluent' ELSE 'Mass' END AS customer_segment,
               CASE WHEN credit_score IS NULL THEN 'Unknown' WHEN credit_score >= 750 THEN 'Low'
                    WHEN credit_score >= 650 THEN 'Medium' ELSE 'High' END AS risk_category,
               coalesce(balance_anomaly_count, 0) AS balance_anomaly_count,
               coalesce(region_conflict_count, 0) AS region_conflict_count, c._batch_id AS valid_from_batch
        FROM (FROM s_customers WHERE is_current) c
        LEFT JOIN account_totals USING (customer_id) LEFT JOIN loan_totals USING (customer_id)
        LEFT JOIN activity USING (customer_id)
        LEFT JOIN (SELECT customer_id, credit_score, score_band FROM score_now) USING (customer_id)""",
    "transaction_labelled": f"""
        SELECT s.*, k.fraud_method AS confirmed_fraud_method,
               CASE WHEN k.transaction_id IS NOT NULL THEN TRUE WHEN transaction_date <= {AS_OF} - 90 THEN FALSE END
                   AS fraud_flag,
               CASE WHEN k.transaction_id IS NOT NULL THEN 'CONFIRMED' WHEN transaction_date <= {AS_OF} - 90
                    THEN 'CLEARED' ELSE 'PENDING' END AS fraud_label_status
        FROM s_transactions s
        LEFT JOIN (FROM labels_known WHERE label_available_date <= {AS_OF}) k USING (transaction_id)""",
    "facilities": """
        SELECT customer_id, count(*) AS active_loan_count, sum(principal) AS total_loan_amount,
               sum(outstanding_principal) AS total_outstanding, sum(emi_amount) AS obligation_monthly,
               sum(collateral_value) AS collateral_value, bool_or(dpd >= 90) AS has_npa, max(dpd) AS dpd_current
        FROM loans_now WHERE status <> 'CLOSED' GROUP BY customer_id""",
    "risk_base": """
        SELECT c.customer_id, region, credit_score, score_band,
               round(coalesce(annual_income, 0) / 12.0, 2) AS income_monthly,
               round(coalesce(obligation_monthly, 0), 2) AS obligation_monthly,
               coalesce(active_loan_count, 0) AS active_loan_count,
               round(coalesce(total_loan_amount, 0), 2) AS total_loan_amount,
               round(coalesce(total_outstanding, 0), 2) AS total_outstanding,
               coalesce(dpd_current, 0) AS dpd_current, coalesce(worst, 0) AS dpd_max_12m,
               round(coalesce(collateral_value, 0), 2) AS collateral_value, enquiries_6m AS bureau_enquiries_6m,
               credit_vintage_months, delinquencies_24m AS bureau_delinquencies_24m, coalesce(has_npa, FALSE) AS has_npa
        FROM (FROM s_customers WHERE is_current) c LEFT JOIN facilities USING (customer_id)
        LEFT JOIN (SELECT customer_id, max(dpd) AS worst FROM loans GROUP BY 1) USING (customer_id)
        LEFT JOIN (SELECT customer_id, credit_score, score_band, enquiries_6m, credit_vintage_months,
                          delinquencies_24m FROM score_now) USING (customer_id)""",
    "credit_risk": """
        SELECT *, round(burden, 4) AS dti, dpd_max_12m >= 90 AS default_history_flag,
               CASE WHEN total_outstanding > 0 THEN round(collateral_value / total_outstanding, 4) END
                   AS collateral_coverage_ratio,
               round(points, 2) AS risk_score,
               CASE WHEN points < 25 THEN 'LOW' WHEN points < 50 THEN 'MEDIUM' WHEN points < 75 THEN 'HIGH'
                    ELSE 'VERY_HIGH' END AS risk_band
        FROM (SELECT *, CASE WHEN income_monthly > 0 THEN obligation_monthly / income_monthly END AS burden,
                     least(100.0, greatest(0.0, CAST(750 - coalesce(credit_score, 700) AS DOUBLE)) * 0.25
                           + least(dpd_max_12m, 180) * CAST(0.25 AS DOUBLE)
                           + greatest(CAST(0 AS DOUBLE), coalesce(CASE WHEN income_monthly > 0
                                 THEN obligation_monthly / income_monthly END, 0) - CAST(0.30 AS DOUBLE)) * 100
                           + CASE WHEN has_npa THEN 40 ELSE 0 END) AS points
              FROM risk_base)""",
}


def statement(body: str) -> str:
    """Prefix a query with the named subqueries it uses, directly or not."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(?\s*{name}\b", text):
                needed.add(name)
                pending.append(VIEWS[name])
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    body = body.strip()
    if not parts:
        return body
    # A body with subqueries of its own continues the list.
    own = re.match(r"WITH\s+(?!RECURSIVE)", body)
    return f"WITH {', '.join(parts)}" + (f", {body[own.end():]}" if own else f" {body}")
