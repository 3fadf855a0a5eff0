"""Metric queries over the published products, policy verdicts and term matching."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import policy, search
from ledgerloom.plans import catalog, metric_query
from ledgerloom.plans.metric_query import Filter, MetricRequest
from ledgerloom.workload.registry import Published, query
from ledgerloom.workload.tables import AS_OF, mapped
from ledgerloom.workload.views_sql import day, stamp

ANCHOR = AS_OF
SQL_TABLES = {
    "customer_360": "customer_360", "transaction": "transaction_labelled", "credit_risk": "credit_risk",
}


def _answer(t, request: MetricRequest, rounded: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """Run a request on the stored product; float aggregates are shown to a few digits."""
    result = metric_query.metric_query(request, Published(t).read(f"gold.{request.product}"))
    return result.withColumns({name: F.round(name, digits) for name in rounded})


def metric(name: str, sql: str, request: MetricRequest, rounded: tuple[str, ...] = (), digits: int = 4) -> None:
    query(name, sql)(lambda t: _answer(t, request, rounded, digits))


metric(
    "metric_count_by_dim",
    "SELECT region, count(*) AS customer_count FROM customer_360 GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST",
    MetricRequest("customer_360", ["customer_count"], ["region"]),
)
metric(
    "metric_sum_by_dim",
    """SELECT customer_segment, round(sum(total_balance), 2) AS total_balance FROM customer_360 GROUP BY 1
       ORDER BY 2 DESC, 1""",
    MetricRequest("customer_360", ["total_balance"], ["customer_segment"]),
    ("total_balance",), 2,
)
metric(
    "metric_sums_by_two_dims",
    """SELECT region, risk_category, sum(account_count)::BIGINT AS account_count,
              sum(active_accounts)::BIGINT AS active_accounts, round(sum(total_deposits), 2) AS total_deposits,
              round(sum(loan_outstanding), 2) AS loan_outstanding, round(sum(card_spend_90d), 2) AS card_spend_90d,
              sum(txn_count_90d)::BIGINT AS txn_count_90d
       FROM customer_360 GROUP BY 1, 2 ORDER BY account_count DESC, 1 NULLS LAST, 2""",
    MetricRequest(
        "customer_360",
        ["account_count", "active_accounts", "total_deposits", "loan_outstanding", "card_spend_90d", "txn_count_90d"],
        ["region", "risk_category"],
    ),
    ("total_deposits", "loan_outstanding", "card_spend_90d"), 2,
)
metric(
    "metric_avg_by_dim",
    """SELECT region, round(avg(total_balance), 4) AS avg_balance_per_customer, round(avg(credit_score), 4) AS credit_score
       FROM customer_360 GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST""",
    MetricRequest("customer_360", ["avg_balance_per_customer", "credit_score"], ["region"]),
    ("avg_balance_per_customer", "credit_score"),
)
metric(
    "metric_max",
    """SELECT region, CAST(max(dpd_max_12m) AS INTEGER) AS dpd_max_12m FROM credit_risk GROUP BY 1
       ORDER BY 2 DESC, 1 NULLS LAST""",
    MetricRequest("credit_risk", ["dpd_max_12m"], ["region"]),
)
metric(
    "metric_share",
    """SELECT source_system, round(avg(CASE WHEN is_international THEN 1.0 ELSE 0.0 END), 4) AS international_share,
              round(avg(CASE WHEN debit_credit = 'DEBIT' THEN 1.0 ELSE 0.0 END), 4) AS debit_share
       FROM (SELECT * REPLACE (coalesce(is_international, FALSE) AS is_international) FROM transaction_labelled)
       GROUP BY 1 ORDER BY avg(CASE WHEN is_international THEN 1.0 ELSE 0.0 END) DESC, 1""",
    MetricRequest("transaction", ["international_share", "debit_share"], ["source_system"]),
    ("international_share", "debit_share"),
)
metric(
    "metric_credit_portfolio",
    """SELECT risk_band, count(*) AS count_risk_band, round(avg(dti), 4) AS dti,
              round(sum(obligation_monthly), 4) AS obligation_monthly,
              round(sum(total_outstanding), 4) AS total_outstanding, round(avg(risk_score), 4) AS risk_score,
              round(avg(CASE WHEN default_history_flag THEN 1.0 ELSE 0.0 END), 4) AS default_rate,
              round(avg(collateral_coverage_ratio), 4) AS collateral_coverage
       FROM credit_risk GROUP BY 1 ORDER BY 2 DESC, 1""",
    MetricRequest(
        "credit_risk",
        [
            "risk_band", "dti", "obligation_monthly", "total_outstanding", "risk_score", "default_rate",
            "collateral_coverage",
        ],
        ["risk_band"],
    ),
    ("dti", "obligation_monthly", "total_outstanding", "risk_score", "default_rate", "collateral_coverage"),
)
metric(
    "metric_scalar",
    "SELECT count(*) AS txn_count, round(avg(amount), 4) AS txn_amount_avg FROM transaction_labelled",
    MetricRequest("transaction", ["txn_count", "txn_amount_avg"]),
    ("txn_amount_avg",),
)
metric(
    "metric_threshold_count",
    """SELECT region, count(*) FILTER (total_balance >= 1000000) AS high_value_customer FROM customer_360 GROUP BY 1
       ORDER BY 2 DESC, 1 NULLS LAST""",
    MetricRequest("customer_360", ["high_value_customer"], ["region"], parameters={"threshold": 1_000_000}),
)
metric(
    "metric_topk_entity",
    """SELECT customer_id, round(sum(card_spend_90d), 2) AS card_spend_90d FROM customer_360 GROUP BY 1
       ORDER BY sum(card_spend_90d) DESC, 1 LIMIT 10""",
    MetricRequest(
        "customer_360", ["card_spend_90d"], ["customer_id"], limit=metric_query.RANKING_LIMIT
    ),
    ("card_spend_90d",), 2,
)
metric(
    "metric_bottomk_entity",
    """SELECT customer_id, round(sum(total_balance), 2) AS total_balance FROM customer_360 GROUP BY 1
       ORDER BY sum(total_balance), 1 LIMIT 25""",
    MetricRequest("customer_360", ["total_balance"], ["customer_id"], descending=False, limit=25),
    ("total_balance",), 2,
)
metric(
    "metric_topk_transactions",
    """SELECT transaction_id, round(sum(amount), 2) AS txn_amount_sum FROM transaction_labelled GROUP BY 1
       ORDER BY round(sum(amount), 2) DESC, 1 LIMIT 10""",
    MetricRequest("transaction", ["txn_count", "txn_amount_sum"], ["transaction_id"], limit=10),
    ("txn_amount_sum",), 2,
)
metric(
    "metric_enum_filter",
    """SELECT region, count(*) AS customer_count FROM customer_360 WHERE risk_category = 'High' GROUP BY 1
       ORDER BY 2 DESC, 1 NULLS LAST""",
    MetricRequest("customer_360", ["customer_count"], ["region"], [Filter("risk_category", "=", "High")]),
)
metric(
    "metric_bool_filter",
    """SELECT channel, count(*) AS txn_count FROM transaction_labelled
       WHERE fraud_flag AND coalesce(is_international, FALSE) = FALSE GROUP BY 1 ORDER BY 2 DESC, 1""",
    MetricRequest(
        "transaction", ["txn_count"], ["channel"],
        [Filter("fraud_flag", "=", True), Filter("is_international", "=", False)],
    ),
)
metric(
    "metric_numeric_filter",
    """SELECT customer_segment, count(*) AS count_customer_segment, round(avg(credit_score), 4) AS credit_score
       FROM customer_360 WHERE credit_score >= 700 AND total_balance > 100000 AND loan_count <= 20 GROUP BY 1
       ORDER BY 2 DESC, 1""",
    MetricRequest(
        "customer_360", ["customer_segment", "credit_score"], ["customer_segment"],
        [Filter("credit_score", ">=", 700), Filter("total_balance", ">", 100_000), Filter("loan_count", "<=", 20)],
    ),
    ("credit_score",),
)
metric(
    "metric_geo_filter",
    """SELECT state_code, count(*) AS customer_count, round(sum(total_balance), 2) AS total_balance FROM customer_360
       WHERE region = 'ASIA' AND city = '1-URGENT' GROUP BY 1 ORDER BY 2 DESC, 1""",
    MetricRequest(
        "customer_360", ["customer_count", "total_balance"], ["state_code"],
        [Filter("region", "=", "ASIA"), Filter("city", "=", "1-URGENT")],
    ),
    ("total_balance",), 2,
)

# One query per kind of time window, all by channel group.
WINDOWS = {
    "last_n_days": (metric_query.last(7, "day", ANCHOR), "DATE '2024-01-23'", "DATE '2024-01-30'"),
    "last_n_weeks": (metric_query.last(2, "week", ANCHOR), "DATE '2024-01-16'", "DATE '2024-01-30'"),
    "last_n_months": (
        metric_query.last(3, "month", date(2001, 5, 31)), "DATE '2001-02-28'", "DATE '2001-05-31'",
    ),
    "last_n_quarters": (
        metric_query.last(2, "quarter", date(2001, 5, 31)), "DATE '2001-05-31' - 182", "DATE '2001-05-31'",
    ),
    "last_n_years": (
        metric_query.last(1, "year", date(2001, 5, 31)), "DATE '2001-05-31' - 365", "DATE '2001-05-31'",
    ),
    "last_calendar_month": (
        metric_query.last_calendar_month(date(2000, 3, 15)), "DATE '2000-02-01'", "DATE '2000-02-29'",
    ),
    "mtd": (metric_query.month_to_date(ANCHOR), "DATE '2024-01-01'", "DATE '2024-01-30'"),
    "ytd": (metric_query.year_to_date(date(2001, 5, 31)), "DATE '2001-01-01'", "DATE '2001-05-31'"),
    "year": (metric_query.calendar_year(1998), "DATE '1998-01-01'", "DATE '1998-12-31'"),
    "month_of_year": (metric_query.month_of_year(1996, 2), "DATE '1996-02-01'", "DATE '1996-02-29'"),
    "since": (metric_query.since(date(2001, 1, 1), ANCHOR), "DATE '2001-01-01'", "DATE '2024-01-30'"),
}
for _name, (_window, _start, _end) in WINDOWS.items():
    metric(
        f"metric_window_{_name}",
        f"""SELECT channel_group, count(*) AS txn_count, round(sum(amount), 2) AS txn_amount_sum
            FROM transaction_labelled WHERE transaction_date >= {_start} AND transaction_date <= {_end} GROUP BY 1
            ORDER BY 2 DESC, 1""",
        MetricRequest("transaction", ["txn_count", "txn_amount_sum"], ["channel_group"], window=_window),
        ("txn_amount_sum",), 2,
    )

metric(
    "metric_by_month",
    f"""SELECT {stamp("transaction_month")} AS transaction_month, count(*) AS txn_count,
               round(sum(signed_amount), 2) AS net_flow
        FROM transaction_labelled GROUP BY 1 ORDER BY 2 DESC, 1""",
    MetricRequest("transaction", ["txn_count", "net_flow"], ["transaction_month"]),
    ("net_flow",), 2,
)
metric(
    "metric_by_date",
    f"""SELECT {day("transaction_date")} AS transaction_date, count(*) AS txn_count FROM transaction_labelled
        GROUP BY 1 ORDER BY 2 DESC, 1""",
    MetricRequest("transaction", ["txn_count"], ["transaction_date"]),
)
metric(
    "metric_by_hour",
    """SELECT transaction_hour, count(*) AS txn_count FROM transaction_labelled GROUP BY 1 ORDER BY 2 DESC, 1""",
    MetricRequest("transaction", ["txn_count"], ["transaction_hour"]),
)
metric(
    "metric_per_currency",
    """SELECT currency, round(sum(amount), 2) AS txn_amount_sum, round(avg(amount), 2) AS txn_amount_avg
       FROM transaction_labelled GROUP BY 1 ORDER BY 2 DESC, 1""",
    MetricRequest("transaction", ["txn_amount_sum", "txn_amount_avg"], ["currency"]),
    ("txn_amount_sum", "txn_amount_avg"), 2,
)


@query("data_anchor", f"SELECT {day('max(transaction_date)')} AS anchor FROM transaction_labelled")
def _(t):
    return metric_query.data_anchor(Published(t).read("gold.transaction"))


# -- policy -----------------------------------------------------------------------
REQUEST_PRODUCTS = {
    "purchase": "customer_360", "signup": "customer_360", "click": "transaction", "view": "credit_risk",
    "error": "ledger",
}
REQUEST_COLUMNS = {"0": "credit_score", "1": "age", "2": "fraud_flag", "3": "customer_id", "4": "salary"}
REQUEST_USES = {
    "0": "portfolio_analytics", "1": "Marketing Targeting on credit score", "2": "marketing_targeting",
    "3": "automated_credit_decision", "4": "credit_assessment", "5": "customer_facing_scoring",
    "6": "fraud_detection", "7": "marketing_targeting_on_age",
}


def _requests(t) -> DataFrame:
    """Every event as somebody asking to use a column of a product for something."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    base = t["events"].withColumns(
        {"__c": (k % 5).cast("string"), "__u": (F.col("user_id") % 8).cast("string")}
    )
    return base.select(
        "event_id",
        mapped("event_type", REQUEST_PRODUCTS).alias("product"),
        mapped("__c", REQUEST_COLUMNS).alias("column"),
        mapped("__u", REQUEST_USES).alias("use"),
    )


def _policy_values() -> str:
    rows = []
    for c in catalog.CONTRACTS.values():
        for name in REQUEST_COLUMNS.values():
            facts = c.facts(name)
            rows.append(
                f"('{c.product}', '{name}', {facts is not None}, {list(c.not_allowed_use)}, "
                f"{list((facts or {}).get('not_allowed_use', ()))}::VARCHAR[], "
                f"{list((facts or {}).get('allowed_use', ()))}::VARCHAR[])"
            )
    return "(VALUES " + ", ".join(rows) + ") AS p(product, \"column\", known, product_rules, column_rules, allow_list)"


def _case_of(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"


_FORBIDS = "len([r FOR r IN {rules} IF list_has_all(string_split(u, '_'), string_split(r, '_'))]) > 0"


_REQUESTS_SQL = f"""(SELECT *, replace(lower(trim(use)), ' ', '_') AS u FROM (
                  SELECT event_id,
                         CASE event_type WHEN 'purchase' THEN 'customer_360' WHEN 'signup' THEN 'customer_360'
                              WHEN 'click' THEN 'transaction' WHEN 'view' THEN 'credit_risk' ELSE 'ledger' END AS product,
                         {_case_of("CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 5", REQUEST_COLUMNS)} AS "column",
                         {_case_of("user_id % 8", REQUEST_USES)} AS use
                  FROM events))
        LEFT JOIN {_policy_values()} USING (product, "column")"""


@query(
    "use_policy_verdicts",
    f"""SELECT event_id, product, "column", use,
               coalesce(NOT ({_FORBIDS.format(rules="product_rules")}) AND known
                        AND NOT ({_FORBIDS.format(rules="column_rules")})
                        AND (len(allow_list) = 0 OR list_contains(allow_list, u)), FALSE) AS allowed
        FROM {_REQUESTS_SQL}""",
)
def _(t):
    return policy.verdicts(_requests(t), policy.policy_table(t.spark)).drop("reason")


def _hit(rules: str) -> str:
    """The rule of the same name, else the first whose words the use contains."""
    return f"""coalesce([r FOR r IN {rules} IF r = u][1],
                        [r FOR r IN {rules} IF list_has_all(string_split(u, '_'), string_split(r, '_'))][1])"""


_VERSIONS = {c.product: f"{c.product}@{c.version}" for c in catalog.CONTRACTS.values()}


@query(
    "use_policy_reasons",
    f"""SELECT product, "column", use, reason = 'permitted' AS allowed, reason, count(*) AS requests
        FROM (SELECT *, CASE
                WHEN source IS NULL THEN 'unknown product ''' || product || ''''
                WHEN product_hit IS NOT NULL THEN '''' || use || ''' is prohibited for all of ' || source
                     || CASE WHEN product_hit = u THEN '' ELSE ' because it is a form of ''' || product_hit || '''' END
                     || ' (field not_allowed_use)'
                WHEN NOT known THEN 'column ''' || "column" || ''' is not part of ' || source
                WHEN column_hit IS NOT NULL THEN '''' || use || ''' is prohibited for column ''' || "column" || ''' of '
                     || source || ' because it is a form of ''' || column_hit || ''' (column not_allowed_use)'
                WHEN len(allow_list) > 0 AND NOT list_contains(allow_list, u)
                     THEN 'column ''' || "column" || ''' of ' || source || ' is restricted to '
                          || array_to_string(allow_list, ', ') || '; ''' || use || ''' is not among them'
                ELSE 'permitted' END AS reason
              FROM (SELECT *, CASE product {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _VERSIONS.items())} END AS source,
                           {_hit("product_rules")} AS product_hit, {_hit("column_rules")} AS column_hit
                    FROM {_REQUESTS_SQL}))
        GROUP BY ALL""",
)
def _(t):
    verdicts = policy.verdicts(_requests(t), policy.policy_table(t.spark))
    return verdicts.groupBy("product", "column", "use", "allowed", "reason").agg(F.count(F.lit(1)).alias("requests"))


def _pattern_sql(pattern: str) -> str:
    return "'\\b(?:" + pattern + ")\\b'"


_MASKED_SQL = "text"
for _kind, _pattern in text.MASKED_PATTERNS.items():
    _MASKED_SQL = f"regexp_replace({_MASKED_SQL}, '{_pattern}', '{{{_kind}}}', 'g')"
_HITS_SQL = ", ".join(
    f"CAST(len(regexp_extract_all(text, {_pattern_sql(p)})) AS BIGINT) AS {kind}"
    for kind, p in {**text.BLOCKED_PATTERNS, **text.BLOCKED_INSTRUMENTS}.items()
)
_ANY_SQL = " OR ".join(
    f"coalesce(regexp_matches(text, {_pattern_sql(p)}), FALSE)"
    for p in {**text.BLOCKED_PATTERNS, **text.BLOCKED_INSTRUMENTS}.values()
)
_HITS_SQL += f", CASE WHEN {_ANY_SQL} THEN 'blocked' ELSE 'allowed' END AS verdict"


@query(
    "pii_mask_text",
    f"SELECT doc_id, md5({_MASKED_SQL}) AS masked_md5, {_MASKED_SQL} <> text AS changed, {_HITS_SQL} FROM documents",
)
def _(t):
    body = F.col("text")
    hits = [count.alias(kind) for kind, count in text.blocked_hits(body).items()]
    masked = t["documents"].withColumn("__masked", text.masked(body))
    return masked.select(
        "doc_id",
        F.md5("__masked").alias("masked_md5"),
        (F.col("__masked") != body).alias("changed"),
        *hits,
        text.verdict(body).alias("verdict"),
    )


@query(
    "pii_mask_conversations",
    f"SELECT conv_id, turn, md5({_MASKED_SQL}) AS masked_md5, {_HITS_SQL} FROM conversations",
)
def _(t):
    hits = [count.alias(kind) for kind, count in text.blocked_hits(F.col("text")).items()]
    masked = F.md5(text.masked(F.col("text"))).alias("masked_md5")
    return t["conversations"].select("conv_id", "turn", masked, *hits, text.verdict(F.col("text")).alias("verdict"))


# -- business terms -------------------------------------------------------------------
def _registry_values() -> str:
    rows = [
        f"('{m.name}', '{m.ref}', '{text.plain_term(m.name.replace('_', ' '))}', '{m.name.split('_')[0]}', "
        f"{[text.plain_term(s) for s in m.synonyms]}, {text.term_words(m.definition)})"
        for m in catalog.METRICS.values()
    ]
    return "(VALUES " + ", ".join(rows) + ") AS r(metric, ref, name, first, synonyms, words)"


_STOP = ", ".join(f"'{w}'" for w in text.TERM_STOPWORDS)


@query(
    "term_resolution",
    rf"""WITH terms AS (
            SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g')) AS needle
            FROM conversations),
         tokens AS (
            SELECT *, list_distinct([w FOR w IN regexp_split_to_array(needle, ' +')
                                     IF length(w) > 2 AND w NOT IN ({_STOP})]) AS tokens FROM terms),
         common AS (SELECT *, len(list_intersect(tokens, words)) AS n FROM tokens, {_registry_values()}),
         scored AS (
            SELECT conv_id, turn, metric, ref,
                   CASE WHEN needle = name THEN 'name' WHEN list_contains(synonyms, needle) THEN 'synonym'
                        WHEN contains(needle, name) OR len([s FOR s IN synonyms IF contains(needle, s)]) > 0
                             THEN 'phrase_contains'
                        WHEN list_contains(tokens, first) THEN 'name_token'
                        ELSE 'definition:' || array_to_string(list_sort(list_intersect(tokens, words))[1:3], ',') END AS matched_on,
                   CASE WHEN needle = name THEN 1.0::DOUBLE WHEN list_contains(synonyms, needle) THEN 0.95::DOUBLE
                        WHEN contains(needle, name) OR len([s FOR s IN synonyms IF contains(needle, s)]) > 0
                             THEN 0.85::DOUBLE
                        WHEN list_contains(tokens, first) THEN 0.6::DOUBLE
                        WHEN n > 0 THEN round(0.45::DOUBLE * (n::DOUBLE / greatest(len(tokens), 1))
                                              + least(0.3::DOUBLE, 0.1::DOUBLE * n), 4)
                        ELSE 0.0::DOUBLE END AS score
            FROM common),
         ranked AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, metric) AS place
            FROM scored WHERE score >= 0.45),
         best AS (
            SELECT conv_id, turn, count(*) AS candidates, max(ref) FILTER (place = 1) AS top_ref,
                   max(matched_on) FILTER (place = 1) AS matched_on,
                   max(score) FILTER (place = 1) AS first_score, max(score) FILTER (place = 2) AS second_score
            FROM ranked GROUP BY 1, 2)
         SELECT conv_id, turn, CAST(coalesce(candidates, 0) AS INTEGER) AS candidates,
                CASE WHEN candidates IS NULL THEN 'unresolved'
                     WHEN first_score - second_score <= 0.12::DOUBLE THEN 'ambiguous' ELSE 'resolved' END AS status,
                CASE WHEN candidates = 1 OR first_score - second_score > 0.12::DOUBLE THEN top_ref END AS resolved_ref,
                first_score AS best_score, matched_on
         FROM terms LEFT JOIN best USING (conv_id, turn)""",
)
def _(t):
    resolved = search.resolve_terms(t["conversations"].select("conv_id", "turn", "text"), "text")
    best = F.get("candidates", F.lit(0))
    return resolved.select(
        "conv_id", "turn", F.size("candidates").alias("candidates"), "status", "resolved_ref",
        best["score"].alias("best_score"), best["matched_on"].alias("matched_on"),
    )


