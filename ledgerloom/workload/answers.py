"""Queries over the answer log and the scoring of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import audit, detectors, evaluation
from ledgerloom.session import scratch_path
from ledgerloom.workload.registry import query
from ledgerloom.workload.tables import FRAUD_METHODS, mapped
from ledgerloom.workload.views_sql import case

OUTCOMES = {
    "error": "REFUSED", "view": "NEEDS_CLARIFICATION", "signup": "NO_GOVERNED_METRIC", "click": "ANSWERED_FROM_DATA",
    "purchase": "ANSWERED_FROM_METADATA",
}


def _log(t) -> DataFrame:
    """Every event as a retained answer of the trace named after its user."""
    answers = t["events"].select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("trace_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("asked_at"),
        mapped("event_type", OUTCOMES).alias("outcome"),
        F.col("props").alias("question"),
        F.lit("copilot").alias("agent"),
        (F.col("event_type") == "error").alias("refused"),
        F.array(F.col("value")).alias("preview"),
        F.col("event_id"),
    )
    return audit.answer_records(answers).withColumn("event_id", F.get_json_object("payload", "$.event_id").cast("long"))


LOG_SQL = f"""SELECT 'T' || user_id AS trace_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS asked_at,
        {case("event_type", OUTCOMES)} AS outcome, props AS question, 'copilot' AS agent,
        event_type = 'error' AS refused, event_id, FALSE AS trimmed,
        CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) + 400 * 86400 AS expires_at
    FROM events"""
NOW = 1_740_000_000


@query(
    "audit_records",
    f"SELECT trace_id, asked_at, outcome, question, agent, refused, event_id, trimmed, expires_at FROM ({LOG_SQL})",
)
def _(t):
    return _log(t).drop("payload")


@query(
    "audit_latest",
    f"""SELECT trace_id, asked_at, outcome, event_id FROM ({LOG_SQL})
        QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY asked_at DESC) = 1""",
)
def _(t):
    return audit.latest_answers(_log(t)).select("trace_id", "asked_at", "outcome", "event_id")


@query(
    "audit_recent",
    f"SELECT trace_id, asked_at, outcome, event_id FROM ({LOG_SQL}) ORDER BY asked_at DESC, trace_id LIMIT 20",
)
def _(t):
    return audit.recent_answers(_log(t), 20).select("trace_id", "asked_at", "outcome", "event_id")


@query("audit_count_per_trace", f"SELECT trace_id, count(*) AS answers FROM ({LOG_SQL}) GROUP BY 1")
def _(t):
    return audit.answers_per_trace(_log(t))


@query(
    "audit_unexpired",
    f"SELECT trace_id, asked_at, expires_at FROM ({LOG_SQL}) WHERE expires_at > {NOW}",
)
def _(t):
    return audit.unexpired(_log(t), NOW).select("trace_id", "asked_at", "expires_at")


@query(
    "audit_retained_log",
    f"SELECT trace_id, asked_at, outcome, event_id, expires_at FROM ({LOG_SQL}) WHERE expires_at > {NOW}",
)
def _(t):
    # Written by day, expired days dropped, then read: the filter hides what is left of the boundary day.
    path = scratch_path(t.spark, "answers")
    audit.append_answers(_log(t), path)
    audit.drop_expired(t.spark, path, NOW)
    kept = audit.unexpired(audit.read_answers(t.spark, path), NOW)
    return kept.select("trace_id", "asked_at", "outcome", "event_id", "expires_at")


@query(
    "audit_payload",
    f"""SELECT 'T' || user_id AS trace_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS asked_at,
               {case("event_type", OUTCOMES)} AS outcome, props AS question, 'copilot' AS agent,
               event_type = 'error' AS refused, value AS preview, event_id
        FROM events""",
)
def _(t):
    fields = "trace_id string, asked_at string, outcome string, question string, agent string, refused boolean, preview array<double>, event_id long"
    body = _log(t).select(F.from_json("payload", fields).alias("p")).select("p.*")
    return body.withColumn("preview", F.element_at("preview", 1))


@query(
    "outcome_classification",
    """SELECT event_id,
              CASE WHEN event_type = 'error' THEN 'REFUSED' WHEN k < 20 THEN 'NEEDS_CLARIFICATION'
                   WHEN event_type = 'signup' THEN 'NO_GOVERNED_METRIC' WHEN value > 10 THEN 'ANSWERED_FROM_DATA'
                   WHEN event_type = 'view' THEN 'ANSWERED_FROM_METADATA' ELSE 'INCOMPLETE' END AS outcome
       FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)""",
)
def _(t):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    missing = F.when(F.col("event_type") == "signup", F.array(F.lit("salary"))).otherwise(
        F.array().cast("array<string>")
    )
    outcome = evaluation.outcome(
        F.col("event_type") == "error",
        k < 20,
        missing,
        F.when(F.col("value") > 10, F.col("value").cast("long")),
        F.col("event_type") == "view",
    )
    return t["events"].select("event_id", outcome.alias("outcome"))


def _answers(t) -> DataFrame:
    """Line items of an order as the evidence of the answer to that order's question."""
    facts = t["lineitem"].groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("flags"),
        F.array_sort(F.collect_set("l_linestatus")).alias("states"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("l_quantity").alias("latency_ms"),
    )
    flags, joined = F.col("flags"), F.array_join("flags", " ")
    return facts.select(
        "case_id",
        F.when(F.array_contains(flags, "R"), "ANSWERED_FROM_DATA").otherwise("REFUSED").alias("outcome"),
        F.transform(flags, lambda f: F.concat(F.lit("metric."), f)).alias("metrics"),
        F.transform("states", lambda s: F.concat(F.lit("gold."), s)).alias("tables"),
        F.transform("states", lambda s: F.concat(F.lit("tool_"), s)).alias("tools_called"),
        F.when(F.col("rows") > 1, F.concat(F.lit("select "), joined)).alias("sql"),
        F.concat(F.lit("Answer "), joined).alias("answer"),
        F.when(F.array_contains(flags, "R"), F.col("rows")).alias("row_count"),
        (F.col("rows") > 3).alias("has_metadata"),
        (F.col("rows") > 2).alias("has_quality"),
        F.when(F.array_contains(flags, "A"), F.array(F.lit("customer_360@2.3.0")))
        .otherwise(F.array().cast("array<string>"))
        .alias("products"),
        F.array_contains(flags, "N").alias("denial_recorded"),
        F.concat(F.lit("T"), F.col("case_id").cast("string")).alias("trace_id"),
        F.when(F.col("rows") > 0, F.lit("digest")).alias("contract_digest"),
        "latency_ms",
    )


def _expectations(t) -> DataFrame:
    """The order itself as what a good answer looks like."""
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    none = F.array().cast("array<string>")
    listed = lambda condition, *values: F.when(
        condition, F.array(*[F.lit(v) for v in values])
    ).otherwise(none)
    return t["orders"].select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderstatus") == "P", "REFUSED").otherwise("ANSWERED_FROM_DATA").alias("outcome"),
        listed(urgent, "metric.A", "metric.R").alias("metrics"),
        listed(low, "metric.N").alias("forbid_metrics"),
        listed(urgent, "SELECT", "r").alias("sql_contains"),
        listed(low, "a n").alias("sql_absent"),
        listed(~low, "gold.F").alias("tables"),
        listed(low, "tool_O").alias("tools"),
        listed(urgent, "tool_F").alias("forbid_tools"),
        F.when(urgent, F.lit(2).cast("long")).alias("min_rows"),
        F.when(low, F.lit(4).cast("long")).alias("max_rows"),
        listed(F.lit(True), "ANSWER").alias("answer_contains"),
        listed(urgent, "n r").alias("answer_absent"),
        urgent.alias("quality"),
        (~low).alias("cites_product"),
        F.when(urgent, 2.0).otherwise(1.0).alias("weight"),
        (F.col("o_orderstatus") == "P").alias("must_pass"),
        listed(low, "governance", "smoke").alias("tags"),
    )


def _scored(t) -> DataFrame:
    return evaluation.failures(_answers(t), _expectations(t))


SCORED_SQL = """
    SELECT case_id, weight, must_pass, tags, latency_ms, failures, len(failures) = 0 AS passed FROM (
      SELECT o_orderkey AS case_id, CASE WHEN urgent THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
             o_orderstatus = 'P' AS must_pass, CASE WHEN low THEN ['governance', 'smoke'] ELSE [] END AS tags, latency_ms,
             CASE WHEN flags IS NULL THEN ['error: no evidence produced'] ELSE [f FOR f IN [
               CASE WHEN want <> got THEN 'outcome: expected ' || want || ', got ' || got END,
               CASE WHEN urgent AND NOT list_contains(flags, 'A') THEN 'missing metric metric.A' END,
               CASE WHEN urgent AND NOT list_contains(flags, 'R') THEN 'missing metric metric.R' END,
               CASE WHEN low AND list_contains(flags, 'N') THEN 'forbidden metric metric.N' END,
               CASE WHEN urgent AND n <= 1 THEN 'sql: no query was run' END,
               CASE WHEN urgent AND n > 1 AND NOT contains(upper('select ' || joined), 'R') THEN 'sql: missing r' END,
               CASE WHEN low AND n > 1 AND contains('SELECT ' || joined, 'A N') THEN 'sql: must not contain a n' END,
               CASE WHEN NOT low AND NOT list_contains(states, 'F') THEN 'tables: not read gold.F' END,
               CASE WHEN low AND NOT list_contains(states, 'O') THEN 'tools: never called tool_O' END,
               CASE WHEN urgent AND list_contains(states, 'F') THEN 'tools: must not be called tool_F' END,
               CASE WHEN urgent AND coalesce(row_count, 0) < 2 THEN 'rows: fewer than 2' END,
               CASE WHEN low AND coalesce(row_count, 0) > 4 THEN 'rows: more than 4' END,
               CASE WHEN urgent AND contains(lower(joined), 'n r') THEN 'answer: must not contain n r' END,
               CASE WHEN urgent AND n <= 2 THEN 'quality: no quality state' END,
               CASE WHEN NOT low AND (row_count IS NOT NULL OR n > 3) AND NOT list_contains(flags, 'A')
                    THEN 'provenance: no product version cited' END,
               CASE WHEN want = 'REFUSED' AND NOT list_contains(flags, 'N')
                    THEN 'refusal: no denial with a reason was recorded' END
             ] IF f IS NOT NULL] END AS failures
      FROM (SELECT *, o_orderpriority = '1-URGENT' AS urgent, o_orderpriority = '5-LOW' AS low,
                   CASE o_orderstatus WHEN 'P' THEN 'REFUSED' ELSE 'ANSWERED_FROM_DATA' END AS want FROM orders)
      LEFT JOIN (SELECT *, array_to_string(flags, ' ') AS joined,
                        CASE WHEN list_contains(flags, 'R') THEN 'ANSWERED_FROM_DATA' ELSE 'REFUSED' END AS got,
                        CASE WHEN list_contains(flags, 'R') THEN n END AS row_count
                 FROM (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS flags,
                              list_sort(list_distinct(list(l_linestatus))) AS states, count(*) AS n,
                              sum(l_quantity) AS latency_ms
                       FROM lineitem GROUP BY 1)) ON l_orderkey = o_orderkey)"""


@query(
    "expectation_failures",
    f"SELECT case_id, array_to_string(failures, '|') AS failures, passed FROM ({SCORED_SQL})",
)
def _(t):
    return _scored(t).select("case_id", "failures", "passed")


_CRITICAL = "(must_pass OR list_has_any(tags, ['governance', 'security']))"


@query(
    "weighted_score",
    f"""SELECT round(sum(weight) FILTER (passed) / sum(weight), 4) AS score,
               count(*) FILTER ({_CRITICAL} AND NOT passed) AS critical_failed
        FROM ({SCORED_SQL})""",
)
def _(t):
    return evaluation.weighted_score(_scored(t))


@query(
    "evaluation_gate",
    f"""SELECT round(sum(weight) FILTER (passed) / sum(weight), 4) AS score,
               count(*) FILTER ({_CRITICAL} AND NOT passed) AS critical_failed,
               count(*) FILTER ({_CRITICAL} AND NOT passed) = 0
               AND sum(weight) FILTER (passed) / sum(weight) >= 0.97 AS gate_passed
        FROM ({SCORED_SQL})""",
)
def _(t):
    return evaluation.gate(_scored(t), 0.97)


@query(
    "run_summary",
    f"""SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
               count(*) FILTER ({_CRITICAL} AND NOT passed) AS critical_failed,
               round(avg(latency_ms), 1) AS latency_ms_mean
        FROM ({SCORED_SQL})""",
)
def _(t):
    return evaluation.run_summary(_scored(t))


@query(
    "detector_precision_recall",
    f"""WITH raised AS (
            SELECT transaction_id, 'GEO_JUMP' AS fraud_method FROM (
                SELECT *, lag(abroad) OVER w AS before, epoch_us(transaction_ts) - epoch_us(lag(transaction_ts) OVER w)
                          AS gap
                FROM (SELECT *, merchant_category IN ('signup', 'purchase') AS abroad FROM card_transactions)
                WINDOW w AS (PARTITION BY card_id ORDER BY transaction_ts, transaction_id))
            WHERE abroad AND NOT before AND gap <= 86400 * 1000000::BIGINT),
        matched AS (
            SELECT coalesce(r.fraud_method, k.fraud_method) AS fraud_method, r.transaction_id IS NOT NULL AS raised,
                   k.transaction_id IS NOT NULL AS actual
            FROM raised r FULL JOIN (FROM labels_known WHERE fraud_method = 'GEO_JUMP') k
                 ON r.transaction_id = k.transaction_id)
        SELECT fraud_method, count(*) FILTER (raised AND actual) AS tp, count(*) FILTER (raised AND NOT actual) AS fp,
               count(*) FILTER (actual AND NOT raised) AS fn,
               round(count(*) FILTER (raised AND actual) / count(*) FILTER (raised), 6) AS precision,
               round(count(*) FILTER (raised AND actual) / count(*) FILTER (actual), 6) AS recall
        FROM matched GROUP BY 1""",
)
def _(t):
    abroad = F.col("merchant_category").isin("signup", "purchase")
    cards = t.card_transactions.withColumn("is_international", abroad)
    raised = detectors.geo_jumps(cards, seconds=86_400).select(
        "transaction_id", F.lit("GEO_JUMP").alias("fraud_method")
    )
    truth = t.labels.filter(F.col("fraud_method") == FRAUD_METHODS["purchase"])
    return evaluation.precision_recall(raised, truth, "transaction_id", "fraud_method")
