"""Queries over quality rules, SLA, lineage and the catalogue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import SEARCH_STOPWORDS
from ledgerloom.operators import graph, quality, search
from ledgerloom.operators.quality import WARNING, Rule
from ledgerloom.plans import catalog, publish
from ledgerloom.plans.rules import PUBLISHED_RULES
from ledgerloom.session import scratch_path
from ledgerloom.sources.zones import Zones
from ledgerloom.workload.registry import Published, query
from ledgerloom.workload.tables import coded
from ledgerloom.workload.views_sql import AS_OF

SHOWN = ("dataset", "rule_id", "kind", "severity", "status", "rows_evaluated", "rows_failed", "score")


# -- SQL side ----------------------------------------------------------------
def _twin(rule: Rule, source: str, evaluated: str, failed: str, passes: str = "bad = 0", table: str = "") -> str:
    return f"""SELECT '{rule.dataset}' AS dataset, '{rule.rule_id}' AS rule_id, '{rule.reported_kind}' AS kind,
        '{rule.severity}' AS severity, CASE WHEN {passes} THEN 'PASS' ELSE 'FAIL' END AS status,
        CAST(n AS BIGINT) AS rows_evaluated, CAST(bad AS BIGINT) AS rows_failed,
        CASE WHEN n > 0 THEN round(1.0 - CAST(bad AS DOUBLE) / n, 6) ELSE CAST(1 AS DOUBLE) END AS score
        FROM (SELECT {evaluated} AS n, {failed} AS bad FROM {source})"""


def _rule_sql(rule: Rule, source: str, references: dict[str, str]) -> str:
    """What a rule means, said once more in SQL and independently of the compiler."""
    c = rule.column
    if rule.kind == "unique":
        keys = ", ".join(rule.columns)
        groups = f"(SELECT count(*) AS k FROM {source} GROUP BY {keys})"
        return _twin(rule, groups, "coalesce(sum(k), 0)", "coalesce(sum(k), 0) - count(*)")
    if rule.kind == "not_null":
        return _twin(rule, source, "count(*)", f"count(*) - count({c})")
    if rule.kind == "null_rate":
        return _twin(rule, source, "count(*)", f"count(*) - count({c})", f"bad <= n * {rule.threshold or 0}")
    if rule.kind == "vocabulary":
        words = ", ".join(f"'{v}'" for v in rule.allowed)
        return _twin(rule, source, "count(*)", f"count(*) FILTER ({c} NOT IN ({words}))")
    if rule.kind == "range":
        tests = [f"TRY_CAST({c} AS DOUBLE) < {rule.minimum}"] if rule.minimum is not None else []
        tests += [f"TRY_CAST({c} AS DOUBLE) > {rule.maximum}"] if rule.maximum is not None else []
        return _twin(rule, source, f"count(TRY_CAST({c} AS DOUBLE))", f"count(*) FILTER ({' OR '.join(tests)})")
    if rule.kind == "referential":
        known = f"{c} IN (SELECT {rule.reference_column} FROM {references[rule.reference]})"
        return _twin(
            rule, source, "count(*)", f"count(*) - count(*) FILTER ({known})",
            f"(n - bad) >= n * CAST({rule.threshold or 1} AS DOUBLE)",
        )
    if rule.kind == "row_count":
        return _twin(rule, source, "count(*)", f"CASE WHEN count(*) >= {rule.minimum} THEN 0 ELSE 1 END")
    if rule.kind == "freshness":
        late = f"date_diff('day', CAST(max({c}) AS DATE), DATE '{rule.anchor}') > {rule.max_age_days}"
        return _twin(rule, source, "count(*)", f"CASE WHEN max({c}) IS NULL OR {late} THEN 1 ELSE 0 END")
    if rule.kind == "one_current":
        key, current = rule.columns
        groups = f"(SELECT count(*) FILTER ({current}) AS k FROM {source} GROUP BY {key})"
        return _twin(rule, groups, "count(*)", "count(*) FILTER (k <> 1)")
    column, value = rule.where
    inside = f"{column} = '{value}'"
    return _twin(rule, source, f"count(*) FILTER ({inside})", f"count({c}) FILTER ({inside})")


def _rules_sql(rules, sources: dict[str, str]) -> str:
    return " UNION ALL ".join(_rule_sql(r, sources[r.dataset], sources) for r in rules)


def _results(t, rules, tables: dict[str, DataFrame]) -> DataFrame:
    return quality.evaluate(t.spark, rules, tables).select(*SHOWN)


def _given(t, *names: str) -> dict[str, DataFrame]:
    return {name: t[name] for name in names}


# -- single kinds over the given tables ---------------------------------------
UNIQUE = (
    Rule("orders", "order_key_unique", "unique", ("o_orderkey",)),
    Rule("lineitem", "line_key_unique", "unique", ("l_orderkey", "l_linenumber")),
    Rule("events", "event_id_unique", "unique", ("event_id",)),
)
NOT_NULL = (
    Rule("orders", "order_customer_present", "not_null", ("o_custkey",)),
    Rule("documents", "document_text_present", "not_null", ("text",)),
    Rule("payments", "payment_id_present", "not_null", ("transaction_id",)),
)
NULL_RATE = (
    Rule("accounts", "branch_region_null_rate", "null_rate", ("branch_region",), threshold=0.02, severity=WARNING),
    Rule("accounts", "branch_region_null_rate_loose", "null_rate", ("branch_region",), threshold=0.9),
)
RANGE = (
    Rule("customer", "non_negative_balance", "range", ("c_acctbal",), minimum=0, severity=WARNING),
    Rule("lineitem", "discount_band", "range", ("l_discount",), minimum=0, maximum=0.1),
    Rule("orders", "total_price_band", "range", ("o_totalprice",), minimum=2000, maximum=450000),
    Rule("part", "size_from_text", "range", ("p_brand",), minimum=0, maximum=10),
)
VOCABULARY = (
    Rule("orders", "order_status_vocabulary", "vocabulary", ("o_orderstatus",), allowed=("F", "O", "P")),
    Rule("events", "event_type_vocabulary", "vocabulary", ("event_type",), allowed=("click", "view", "purchase")),
    Rule("accounts", "region_vocabulary", "vocabulary", ("branch_region",), allowed=("ASIA", "EUROPE")),
)
REFERENTIAL = (
    Rule("orders", "order_customer_known", "referential", ("o_custkey",), reference="customer",
         reference_column="c_custkey"),
    Rule("events", "event_user_is_supplier", "referential", ("user_id",), reference="supplier",
         reference_column="s_suppkey", threshold=0.999),
    Rule("labels", "label_document_known", "referential", ("doc_id",), reference="documents",
         reference_column="doc_id", threshold=0.5),
)
ROW_COUNT = (
    Rule("lineitem", "line_floor", "row_count", minimum=1000),
    Rule("nation", "nation_floor", "row_count", minimum=100),
)
FRESHNESS = (
    Rule("events", "events_fresh", "freshness", ("ts",), max_age_days=1, anchor=date(2024, 1, 31)),
    Rule("orders", "orders_stale", "freshness", ("o_orderdate",), max_age_days=30, anchor=date(2024, 1, 31)),
)
ONE_CURRENT = (Rule("customers", "one_current", "one_current", ("customer_id", "is_current")),)
WITHHELD = (
    Rule("transaction", "pending_labels_withheld", "withheld", ("fraud_flag",),
         where=("fraud_label_status", "PENDING")),
)


@query("dq_unique", _rules_sql(UNIQUE, {n: n for n in ("orders", "lineitem", "events")}))
def _(t):
    return _results(t, UNIQUE, _given(t, "orders", "lineitem", "events"))


@query(
    "dq_not_null",
    _rules_sql(NOT_NULL, {"orders": "orders", "documents": "documents", "payments": "payment_transactions"}),
)
def _(t):
    return _results(t, NOT_NULL, {**_given(t, "orders", "documents"), "payments": t.payment_transactions})


@query("dq_null_rate", _rules_sql(NULL_RATE, {"accounts": "accounts"}))
def _(t):
    return _results(t, NULL_RATE, {"accounts": t.accounts})


@query("dq_range", _rules_sql(RANGE, {n: n for n in ("customer", "lineitem", "orders", "part")}))
def _(t):
    return _results(t, RANGE, _given(t, "customer", "lineitem", "orders", "part"))


@query("dq_vocabulary", _rules_sql(VOCABULARY, {n: n for n in ("orders", "events", "accounts")}))
def _(t):
    return _results(t, VOCABULARY, {**_given(t, "orders", "events"), "accounts": t.accounts})


_REFERRED = ("orders", "customer", "events", "supplier", "labels", "documents")


@query("dq_referential", _rules_sql(REFERENTIAL, {n: n for n in _REFERRED}))
def _(t):
    return _results(t, REFERENTIAL, _given(t, *_REFERRED))


@query("dq_row_count", _rules_sql(ROW_COUNT, {n: n for n in ("lineitem", "nation")}))
def _(t):
    return _results(t, ROW_COUNT, _given(t, "lineitem", "nation"))


@query("dq_freshness", _rules_sql(FRESHNESS, {n: n for n in ("events", "orders")}))
def _(t):
    return _results(t, FRESHNESS, _given(t, "events", "orders"))


@query("dq_one_current", _rules_sql(ONE_CURRENT, {"customers": "s_customers"}))
def _(t):
    return _results(t, ONE_CURRENT, {"customers": t.s_customers})


@query("dq_labels_withheld", _rules_sql(WITHHELD, {"transaction": "transaction_labelled"}))
def _(t):
    return _results(t, WITHHELD, {"transaction": t.transaction})


@query(
    "dq_labels_exposed_early",
    f"""SELECT count(*) FILTER (transaction_date > {AS_OF} - 90) AS rows_evaluated,
               count(fraud_flag) FILTER (transaction_date > {AS_OF} - 90) AS rows_failed
        FROM transaction_labelled""",
)
def _(t):
    return quality.labels_exposed_early(t.transaction, t.ctx)


# -- the published rule set -----------------------------------------------------
_RULED_SQL = {
    "gold.customer_360": "customer_360",
    "gold.transaction": "transaction_labelled",
    "gold.credit_risk": "credit_risk",
    # The version column has another name on the SQL side.
    "silver.customers": "(SELECT *, _batch_id AS valid_from_batch FROM s_customers)",
    "silver.transactions": "s_transactions",
    "silver.accounts": "s_accounts",
    "bronze.s_core_accounts": "accounts",
}
ALL_RULES_SQL = _rules_sql(PUBLISHED_RULES, _RULED_SQL)


def _published_tables(t) -> dict[str, DataFrame]:
    store = Published(t)
    # Silver first: the products are then built from what is written.
    return {name: store.read(name) for name in sorted(_RULED_SQL, key=lambda name: name.startswith("gold."))}


def _evaluated(t) -> DataFrame:
    return quality.evaluate(t.spark, PUBLISHED_RULES, _published_tables(t))


def _published_results(t) -> DataFrame:
    """The rule results as a run stores them; status tables read these and no product."""
    return Published(t).read("ops.dq_results", lambda: _evaluated(t))


@query("dq_all_rules", ALL_RULES_SQL)
def _(t):
    return _evaluated(t).select(*SHOWN)


@query("dq_merged_states", ALL_RULES_SQL)
def _(t):
    # Three disjoint batches of rows, told apart within the same scans; what is judged are their stored states. Rows are
    # dealt by the columns that the rules read, so a scan reads no others.
    tables, zones = _published_tables(t), Zones(t.spark, scratch_path(t.spark, "rule-states"))
    read = {name: {c for r in PUBLISHED_RULES if r.dataset == name for c in r.needed} for name in tables}
    read = {name: [c for c in df.columns if c in read[name]] or df.columns for name, df in tables.items()}
    batches = {name: df.withColumn("batch", F.pmod(F.xxhash64(*read[name]), F.lit(3))) for name, df in tables.items()}
    states = quality.rule_states(PUBLISHED_RULES, batches, by=("batch",))
    # Told apart by a column and not by folders, for which every task would sort its states.
    rows = zones.write("ops.rule_states", states)
    return quality.verdict(t.spark, PUBLISHED_RULES, zones.read("ops.rule_states"), tables, rows).select(*SHOWN)


@query(
    "dq_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS passed,
               count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'ERROR') AS errors,
               count(*) FILTER (status = 'FAIL' AND severity = 'critical') AS critical_failures,
               count(*) FILTER (status = 'FAIL' AND severity = 'warning') AS warning_failures
        FROM ({ALL_RULES_SQL})""",
)
def _(t):
    return quality.summary(_published_results(t))


def _products(t) -> dict[str, DataFrame]:
    store = Published(t)
    return {name: store.read(f"gold.{name}") for name in catalog.CONTRACTS}


@query(
    "contract_violations",
    """SELECT * FROM (
           SELECT 'transaction' AS product, 'primary key repeats' AS problem,
                  count(*) - count(DISTINCT transaction_id) AS rows FROM transaction_labelled
           UNION ALL SELECT 'customer_360', 'rows below the declared floor 100', greatest(100 - count(*), 0)
                     FROM customer_360
           UNION ALL SELECT 'credit_risk', 'rows below the declared floor 100', greatest(100 - count(*), 0)
                     FROM credit_risk
           UNION ALL SELECT 'transaction', 'rows below the declared floor 1000', greatest(1000 - count(*), 0)
                     FROM transaction_labelled)
       WHERE rows > 0""",
)
def _(t):
    return publish.contract_problems(t.spark, _products(t))


# -- SLA and catalogue ------------------------------------------------------------
def _sla(t) -> DataFrame:
    states = [
        publish.product_state(name, df, catalog.CONTRACTS[name].freshness_hours, catalog.CONTRACTS[name].sla_availability)
        for name, df in _products(t).items()
    ]
    return publish.sla_status(states, _published_results(t), t.ctx)


SLA_SQL = f"""
    SELECT product, 'gold.' || product AS dataset, row_count, CAST(hours AS BIGINT) AS sla_freshness_hours,
           '2024-01-30 00:00:00.000000' AS last_updated, CAST(0 AS DOUBLE) AS age_hours, TRUE AS freshness_ok,
           coalesce(dq_rules, 0) AS dq_rules, coalesce(dq_passed, 0) AS dq_passed,
           coalesce(critical, 0) AS dq_critical_failures, coalesce(warnings, 0) AS dq_warning_failures,
           CAST(CASE product WHEN 'transaction' THEN 0.999 ELSE 0.995 END AS DOUBLE) AS sla_availability,
           CASE WHEN coalesce(critical, 0) = 0 THEN 'OK' ELSE 'DEGRADED' END AS status,
           '2024-01-30 00:00:00.000000' AS last_successful_run
    FROM (SELECT 'customer_360' AS product, 6 AS hours, count(*) AS row_count FROM customer_360
          UNION ALL SELECT 'transaction', 1, count(*) FROM transaction_labelled
          UNION ALL SELECT 'credit_risk', 24, count(*) FROM credit_risk)
    LEFT JOIN (SELECT dataset[6:] AS product, count(*) AS dq_rules, count(*) FILTER (status = 'PASS') AS dq_passed,
                      count(*) FILTER (status = 'FAIL' AND severity = 'critical') AS critical,
                      count(*) FILTER (status = 'FAIL' AND severity = 'warning') AS warnings
               FROM ({ALL_RULES_SQL}) GROUP BY dataset) USING (product)"""


@query("sla_status", SLA_SQL)
def _(t):
    return _sla(t)


@query(
    "product_listing",
    f"""SELECT product, version, columns, metrics, row_count, status, age_hours, dq_critical_failures
        FROM ({SLA_SQL}) JOIN (VALUES ('customer_360', '2.3.0', 30::BIGINT, 13::BIGINT),
                                      ('transaction', '1.6.0', 24::BIGINT, 7::BIGINT),
                                      ('credit_risk', '2.1.0', 23::BIGINT, 8::BIGINT))
             AS c(product, version, columns, metrics) USING (product)""",
)
def _(t):
    listing = publish.list_products(catalog.contract_table(t.spark), _sla(t))
    return listing.select(
        "product", "version", "columns", "metrics", "row_count", "status", "age_hours", "dq_critical_failures"
    )


@query(
    "quality_by_product",
    f"""SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS passed,
               count(*) FILTER (status <> 'PASS' AND severity = 'critical') AS critical_failures,
               count(*) FILTER (status <> 'PASS' AND severity = 'warning') AS warning_failures
        FROM ({ALL_RULES_SQL}) WHERE dataset = 'gold.transaction'
              OR rule_id = 'silver_txn_unique' -- the only other rule whose text names the product"""
)
def _(t):
    return publish.quality_summary(_published_results(t), "transaction")


@query(
    "quality_failures",
    f"""SELECT dataset, rule_id, severity, status FROM ({ALL_RULES_SQL}) WHERE status <> 'PASS'
        ORDER BY dataset, rule_id""",
)
def _(t):
    return publish.quality_failures(_published_results(t)).select("dataset", "rule_id", "severity", "status")


@query(
    "platform_status",
    f"""SELECT count(*) AS products,
               coalesce(string_agg(product, '|' ORDER BY product) FILTER (status <> 'OK'), '') AS degraded,
               28::BIGINT AS metrics
        FROM ({SLA_SQL})""",
)
def _(t):
    return publish.platform_status(publish.list_products(catalog.contract_table(t.spark), _sla(t)))


# -- lineage --------------------------------------------------------------------
def entity_edges(t, *, repeats: bool = False) -> DataFrame:
    """Which entity feeds which, derived from every line item, order, part and supplier; on request with repeated edges."""

    def edges(df, from_column, to_column, name):
        found = df.select(
            from_column.alias("from_dataset"), to_column.alias("to_dataset"), F.lit(name).alias("transform_id")
        )
        return found if repeats else found.distinct()

    lines = t["lineitem"]
    parts = [
        edges(t["nation"], coded("bronze.region_", "n_regionkey"), coded("bronze.nation_", "n_nationkey"), "geography"),
        edges(t["supplier"], coded("bronze.nation_", "s_nationkey"), coded("silver.supplier_", "s_suppkey"), "sites"),
        edges(t["customer"], coded("bronze.nation_", "c_nationkey"), coded("gold.customer_", "c_custkey"), "residence"),
        edges(lines, coded("silver.supplier_", "l_suppkey"), coded("silver.part_", "l_partkey"), "supply"),
        edges(lines, coded("silver.part_", "l_partkey"), coded("silver.order_", "l_orderkey"), "assembly"),
        edges(t["orders"], coded("silver.order_", "o_orderkey"), coded("gold.customer_", "o_custkey"), "purchase"),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


EDGES_SQL = """
    SELECT DISTINCT * FROM (
        SELECT 'bronze.region_' || n_regionkey AS from_dataset, 'bronze.nation_' || n_nationkey AS to_dataset,
               'geography' AS transform_id FROM nation
        UNION ALL SELECT 'bronze.nation_' || s_nationkey, 'silver.supplier_' || s_suppkey, 'sites' FROM supplier
        UNION ALL SELECT 'bronze.nation_' || c_nationkey, 'gold.customer_' || c_custkey, 'residence' FROM customer
        UNION ALL SELECT 'silver.supplier_' || l_suppkey, 'silver.part_' || l_partkey, 'supply' FROM lineitem
        UNION ALL SELECT 'silver.part_' || l_partkey, 'silver.order_' || l_orderkey, 'assembly' FROM lineitem
        UNION ALL SELECT 'silver.order_' || o_orderkey, 'gold.customer_' || o_custkey, 'purchase' FROM orders)"""
START = "gold.customer_7"
SUPPLIER = "silver.supplier_1"


def _trace_sql(start: str, direction: str) -> str:
    near, far = ("to_dataset", "from_dataset") if direction == "upstream" else ("from_dataset", "to_dataset")
    return f"""
        WITH RECURSIVE edges AS ({EDGES_SQL}),
        walk(node, level) AS (
            SELECT '{start}', 0
            UNION SELECT {far}, level + 1 FROM walk JOIN edges ON {near} = node),
        nearest AS (SELECT node, min(level) AS level FROM walk GROUP BY node)
        SELECT {far} AS dataset, transform_id, '{direction}' AS direction, CAST(level + 1 AS INTEGER) AS level
        FROM nearest JOIN edges ON {near} = node"""


@query("lineage_edges", EDGES_SQL)
def _(t):
    return entity_edges(t)


@query(
    "lineage_upstream",
    f"SELECT DISTINCT from_dataset AS dataset FROM ({EDGES_SQL}) WHERE to_dataset = '{START}' ORDER BY 1",
)
def _(t):
    return graph.upstream_of(entity_edges(t), START)


@query(
    "lineage_downstream",
    f"SELECT DISTINCT to_dataset AS dataset FROM ({EDGES_SQL}) WHERE from_dataset = '{SUPPLIER}' ORDER BY 1",
)
def _(t):
    return graph.downstream_of(entity_edges(t), SUPPLIER)


@query("lineage_trace", _trace_sql(START, "upstream"))
def _(t):
    return graph.trace(entity_edges(t), START)


@query("lineage_trace_downstream", _trace_sql(SUPPLIER, "downstream"))
def _(t):
    return graph.trace(entity_edges(t), SUPPLIER, "downstream")


@query(
    "lineage_roots",
    f"SELECT DISTINCT dataset FROM ({_trace_sql(START, 'upstream')}) WHERE dataset LIKE 'bronze.%' ORDER BY 1",
)
def _(t):
    return graph.roots(graph.trace(entity_edges(t), START))


@query(
    "lineage_roots_all",
    f"""WITH RECURSIVE edges AS ({EDGES_SQL}),
        walk(root, node) AS (
            SELECT DISTINCT from_dataset, from_dataset FROM edges WHERE from_dataset LIKE 'bronze.%'
            UNION SELECT root, to_dataset FROM walk JOIN edges ON from_dataset = node)
        SELECT node AS dataset, root FROM walk WHERE node LIKE 'gold.%'""",
)
def _(t):
    edges = entity_edges(t, repeats=True)  # the traversal drops them on its own way
    raw = edges.where(F.col("from_dataset").startswith("bronze.")).select(F.col("from_dataset").alias("start"))
    found = graph.reach(edges, raw, "downstream").where(F.col("dataset").startswith("gold."))
    return found.select("dataset", F.col("start").alias("root"))


# -- ranking --------------------------------------------------------------------
RANK_QUERY = "show me the heinhas, reunies and thereon of en sources"
_WORDS = ("en", "heinha", "reuny", "source", "thereon")


def _tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{word}'" for word in SEARCH_STOPWORDS)
    words = rf"string_split(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"
    stem = (
        "CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN left(w, -3) || 'y' "
        "WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END"
    )
    return f"list_distinct([{stem} FOR w IN {words} IF length(w) > 2 AND w NOT IN ({stop})])"


@query(
    "document_token_rank",
    f"""SELECT doc_id, score, round(least(score, 1.0), 3) AS match_score, matched_terms
        FROM (SELECT doc_id, array_to_string(matched, ',') AS matched_terms,
                     CAST(len(matched) AS DOUBLE) / 4
                     + CASE WHEN list_has_any({_tokens_sql("source || ' ' || lang")}, {list(_WORDS)!r})
                            THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score
              FROM (SELECT *, list_sort(list_intersect({_tokens_sql("text")}, {list(_WORDS[1:])!r})) AS matched
                    FROM documents))
        WHERE score > 0""",
)
def _(t):
    name = F.concat_ws(" ", "source", "lang")
    return search.rank_documents(t["documents"], "doc_id", F.col("text"), name, RANK_QUERY)

