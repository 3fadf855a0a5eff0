"""Queries over detectors, monitors, features and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import detectors, features, monitoring
from ledgerloom.sources import ingest
from ledgerloom.streaming import streams
from ledgerloom.workload.registry import Published, query
from ledgerloom.workload.tables import Tables
from ledgerloom.workload.views_sql import day, stamp

HOUR = 3_600


# -- detectors ------------------------------------------------------------------
def _median_sql(source: str, key: str, amount: str, floor: float) -> str:
    """Lower median per key in whole cents."""
    cents = f"CAST(round({amount} * 100) AS BIGINT)"
    return f"""SELECT {key}, greatest(quantile_disc({cents}, 0.5) / 100.0, {floor}) AS typical
               FROM {source} WHERE {amount} > 0 GROUP BY {key}"""


_CARD_TYPICAL = _median_sql("card_transactions", "customer_id", "amount", 5.0)


@query("typical_amounts", f"SELECT customer_id, typical FROM ({_CARD_TYPICAL})")
def _(t):
    return detectors.typical_amount(t.card_transactions, "customer_id", "amount", floor=5.0)


@query(
    "burst_detector",
    f"""SELECT transaction_id, card_id, amount, typical, burst_size FROM (
            SELECT *, count(*) OVER (PARTITION BY card_id, device_id ORDER BY epoch_us(transaction_ts)
                      RANGE BETWEEN {24 * HOUR * 10**6} PRECEDING AND CURRENT ROW) AS burst_size
            FROM card_transactions JOIN ({_CARD_TYPICAL}) USING (customer_id) WHERE amount >= 2.0::DOUBLE * typical)
        WHERE burst_size >= 2""",
)
def _(t):
    bursts = detectors.card_bursts(t.card_transactions, seconds=24 * HOUR, count=2, factor=2.0, floor=5.0)
    return bursts.select("transaction_id", "card_id", "amount", "typical", "burst_size")


@query(
    "jump_detector",
    f"""SELECT transaction_id, card_id, gap // 1000000 AS gap_seconds FROM (
            SELECT *, lag(abroad) OVER w AS before,
                   epoch_us(transaction_ts) - epoch_us(lag(transaction_ts) OVER w) AS gap
            FROM (SELECT *, coalesce(is_international, FALSE) AS abroad FROM card_transactions)
            WINDOW w AS (PARTITION BY card_id ORDER BY transaction_ts, transaction_id))
        WHERE abroad AND NOT before AND gap <= {150 * 60 * 10**6}""",
)
def _(t):
    cards = t.card_transactions.withColumn("is_international", F.coalesce("is_international", F.lit(False)))
    return detectors.geo_jumps(cards).select("transaction_id", "card_id", "gap_seconds")


def _probe_sql(probe: str, strike: str, seconds: int) -> str:
    return f"""SELECT transaction_id, card_id, amount, (us - probe_us) // 1000000 AS gap_seconds FROM (
            SELECT *, max(us) FILTER ({probe}) OVER (PARTITION BY card_id ORDER BY us
                      RANGE BETWEEN {seconds * 10**6} PRECEDING AND 1 PRECEDING) AS probe_us
            FROM (SELECT *, epoch_us(transaction_ts) AS us
                  FROM card_transactions JOIN ({_CARD_TYPICAL}) USING (customer_id)))
        WHERE probe_us IS NOT NULL AND {strike}"""


@query(
    "probe_then_drain",
    _probe_sql(
        "debit_credit = 'DEBIT' AND amount <= 5", "debit_credit = 'DEBIT' AND amount >= 3.0::DOUBLE * typical",
        12 * HOUR,
    ),
)
def _(t):
    found = detectors.probe_then_drain(t.card_transactions, key="card_id", seconds=12 * HOUR, factor=3.0, floor=5.0)
    return found.select("transaction_id", "card_id", "amount", "gap_seconds")


@query(
    "takeover_detector",
    _probe_sql(
        "debit_credit = 'CREDIT' AND amount <= 30 AND hour(transaction_ts) BETWEEN 1 AND 4",
        "debit_credit = 'DEBIT' AND amount >= 2.0::DOUBLE * typical",
        12 * HOUR,
    ),
)
def _(t):
    found = detectors.takeovers(
        t.card_transactions, key="card_id", seconds=12 * HOUR, probe_max=30.0, factor=2.0, floor=5.0
    )
    return found.select("transaction_id", "card_id", "amount", "gap_seconds")


@query(
    "collusion_ring",
    f"""SELECT a.l_suppkey, a.l_quantity, a.l_orderkey, a.l_linenumber, {day("a.l_shipdate")} AS l_shipdate,
               count(DISTINCT b.l_orderkey) AS ring_cards
        FROM (SELECT *, row_number() OVER () AS line FROM lineitem) a JOIN lineitem b
             ON a.l_suppkey = b.l_suppkey AND a.l_quantity = b.l_quantity
             AND b.l_shipdate BETWEEN a.l_shipdate - INTERVAL 5 DAY AND a.l_shipdate
        GROUP BY a.line, a.l_suppkey, a.l_quantity, a.l_orderkey, a.l_linenumber, a.l_shipdate
        HAVING count(DISTINCT b.l_orderkey) >= 2""",
)
def _(t):
    rings = detectors.collusion_rings(
        t["lineitem"].select("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_shipdate"),
        merchant="l_suppkey",
        amount="l_quantity",
        card="l_orderkey",
        ts="l_shipdate",
        order=("l_linenumber",),
        seconds=5 * 24 * HOUR,
        cards=2,
    )
    return rings.withColumn("l_shipdate", F.to_date("l_shipdate"))


# -- monitors --------------------------------------------------------------------
def _calls(events: DataFrame) -> DataFrame:
    """Events as calls of an agent: latency, errors and refusals."""
    return events.select(
        F.col("event_type").alias("agent"),
        "ts",
        F.floor(F.col("value") * 400).cast("long").alias("latency_ms"),
        (F.col("event_type") == "error").cast("long").alias("errors"),
        ((F.col("event_type") == "signup") & (F.col("value") > 100)).cast("long").alias("refusals"),
    )


CALLS_SQL = """SELECT event_type AS agent, ts, CAST(floor(value * 400) AS BIGINT) AS latency_ms,
        CAST(event_type = 'error' AS BIGINT) AS errors,
        CAST(event_type = 'signup' AND value > 100 AS BIGINT) AS refusals FROM events"""


def _alarm_sql(period: str) -> str:
    start = f"time_bucket(INTERVAL '{period}', ts, TIMESTAMP '1970-01-01')"
    return f"""SELECT {stamp("w")} AS window_start, {stamp(f"w + INTERVAL '{period}'")} AS window_end, agent,
               round(quantile_cont(latency_ms::DOUBLE, 0.95), 3) AS p95_ms, sum(errors)::BIGINT AS errors,
               sum(refusals)::BIGINT AS refusals, count(*) AS calls,
               quantile_cont(latency_ms::DOUBLE, 0.95) > 20000 AS latency_alarm, sum(errors) >= 5 AS error_alarm,
               sum(refusals) >= 1 AS refusal_alarm
        FROM (SELECT *, {start} AS w FROM ({CALLS_SQL})) GROUP BY w, agent
        HAVING latency_alarm OR error_alarm OR refusal_alarm"""


@query("alarm_5min_tumbling", _alarm_sql("5 minutes"))
def _(t):
    counts = monitoring.alarm_counts(_calls(t["events"]), ["agent"])
    return monitoring.alarms(counts).withColumn("p95_ms", F.round("p95_ms", 3))


@query("alarm_daily", _alarm_sql("1 day"))
def _(t):
    counts = monitoring.alarm_counts(_calls(t["events"]), ["agent"], period="1 day")
    return monitoring.alarms(counts).withColumn("p95_ms", F.round("p95_ms", 3))


@query(
    "monitor_hourly",
    f"""SELECT {stamp("w")} AS window_start, {stamp("w + INTERVAL 1 HOUR")} AS window_end, outcome, count(*) AS answers,
               sum(tokens)::BIGINT AS tokens, max(value) AS eval_score_max, min(k) AS evidence_complete_min
        FROM (SELECT *, date_trunc('hour', ts) AS w, event_type AS outcome, length(props) AS tokens,
                     CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
        GROUP BY w, outcome""",
)
def _(t):
    answers = t["events"].select(
        "ts",
        F.col("event_type").alias("outcome"),
        F.length("props").cast("long").alias("tokens"),
        F.col("value").alias("eval_score"),
        F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("evidence_complete"),
    )
    return monitoring.answer_monitor(answers)


@query(
    "monitor_sla_misses",
    f"""SELECT {stamp("w")} AS window_start, {stamp("w + INTERVAL 1 HOUR")} AS window_end,
               count(*) FILTER (event_type <> 'error') AS passed,
               count(*) FILTER (event_type = 'error' AND value < 20) AS warned,
               count(*) FILTER (event_type = 'error' AND value >= 20) AS misses,
               count(*) FILTER (event_type = 'error' AND value >= 20) >= 1 AS sla_alarm
        FROM (SELECT *, date_trunc('hour', ts) AS w FROM events) GROUP BY w""",
)
def _(t):
    outcomes = t["events"].select(
        "ts",
        F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("status"),
        F.when(F.col("value") < 20, "warning").otherwise("critical").alias("severity"),
    )
    return monitoring.sla_misses(outcomes)


# -- features -------------------------------------------------------------------
FEATURES = ("total_balance", "loan_outstanding", "card_spend_90d", "txn_count_90d", "credit_score")


@query(
    "feature_export_long",
    f"""UNPIVOT (SELECT customer_id, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)} FROM customer_360)
        ON {", ".join(FEATURES)} INTO NAME feature_name VALUE value""",
)
def _(t):
    return features.long_features(Published(t).read("gold.customer_360"), columns=FEATURES)


@query(
    "feature_merge_latest",
    f"""SELECT customer_id, feature_name, value, {day("day")} AS updated_at FROM (
            SELECT 'C' || user_id AS customer_id, 'peak_' || event_type AS feature_name, CAST(ts AS DATE) AS day,
                   max(value) AS value FROM events GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY customer_id, feature_name ORDER BY day DESC) = 1""",
)
def _(t):
    daily = t["events"].groupBy(
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("customer_id"),
        F.concat(F.lit("peak_"), F.col("event_type")).alias("feature_name"),
        F.to_date("ts").alias("updated_at"),
    ).agg(F.max("value").alias("value"))
    first_half = F.dayofmonth("updated_at") <= 15
    return features.merged_features(daily.filter(first_half), daily.filter(~first_half))


@query(
    "trailing_activity_sliding",
    f"""SELECT {stamp("w")} AS window_start, {stamp("w + INTERVAL 7 DAY")} AS window_end, user_id,
               count(*) AS txn_count, round(sum(value), 2) AS txn_amount
        FROM (SELECT *, date_trunc('day', ts) - to_days(CAST(unnest(range(7)) AS INTEGER)) AS w FROM events)
        GROUP BY w, user_id""",
)
def _(t):
    return features.sliding_activity(t["events"], "user_id", amount="value")


# -- streams --------------------------------------------------------------------
def _event_stream(t) -> DataFrame:
    return streams.read_files(t.spark, f"{t.folder}/events.parquet", t["events"].schema)


CONFORMED = ("transaction_id", "customer_id", "transaction_ts", "amount", "signed_amount", "channel", "channel_group",
             "merchant_id", "is_international", "transaction_hour")


@query(
    "stream_conform",
    f"""SELECT transaction_id, customer_id, {stamp("transaction_ts")} AS transaction_ts, amount, signed_amount, channel,
               channel_group, merchant_id, is_international, transaction_hour
        FROM s_transactions WHERE source_system = 's_cards'""",
)
def _(t):
    conformed = streams.conformed_card_stream(Tables.card_shape(_event_stream(t))).select(*CONFORMED)
    return streams.settled(conformed, "conformed-cards")


@query("stream_dedup", "SELECT event_id, user_id, event_type, value FROM events")
def _(t):
    # Every event is delivered twice; the hash of its natural key tells the copies apart.
    hashed = lambda df: df.withColumn("_record_hash", ingest.natural_key_hash(["event_id"]))
    twice = hashed(_event_stream(t)).unionByName(hashed(_event_stream(t)))
    unique = streams.deduplicated(twice, "ts", "1 hour").select("event_id", "user_id", "event_type", "value")
    return streams.settled(unique, "deduplicated-events")


@query(
    "stream_activity",
    f"""SELECT {stamp("w")} AS window_start, {stamp("w + INTERVAL 7 DAY")} AS window_end, user_id,
               count(*) AS txn_count, round(sum(value), 2) AS txn_amount
        FROM (SELECT *, date_trunc('day', ts) - to_days(CAST(unnest(range(7)) AS INTEGER)) AS w FROM events)
        WHERE w + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)
        GROUP BY w, user_id""",
)
def _(t):
    # Windows that end before the watermark are final; the rest wait for later events.
    activity = streams.activity_stream(_event_stream(t), "user_id", amount="value")
    return streams.settled(activity, "sliding-activity")


@query(
    "stream_alarms",
    f"""SELECT window_start, window_end, agent, errors, refusals, calls, error_alarm, refusal_alarm
        FROM ({_alarm_sql("5 minutes")})
        WHERE (error_alarm OR refusal_alarm) AND strptime(window_end, '%Y-%m-%d %H:%M:%S.%f') <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def _(t):
    raised = streams.alarm_stream(_calls(_event_stream(t)), ["agent"])
    # The stream estimates p95, so only the alarms on counts can be compared exactly.
    counted = raised.filter(F.col("error_alarm") | F.col("refusal_alarm")).drop("p95_ms", "latency_alarm")
    return streams.settled(counted, "alarms")
