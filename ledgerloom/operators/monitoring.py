"""Tumbling-window alarms and hourly monitors; the same functions serve streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alarm thresholds and periods.
LATENCY_P95_MS = 20_000
ERROR_COUNT = 5
REFUSAL_COUNT = 1
SLA_MISSES = 1
ALARM_PERIOD = "5 minutes"
MONITOR_PERIOD = "1 hour"


def _windowed(df: DataFrame, ts: str, period: str, keys: Sequence[str]):
    return df.groupBy(F.window(F.col(ts), period), *keys)


def _flatten(df: DataFrame, keys: Sequence[str], *rest: Column | str) -> DataFrame:
    start = F.col("window.start").alias("window_start")
    return df.select(start, F.col("window.end").alias("window_end"), *keys, *rest)


def alarm_counts(
    calls: DataFrame,
    keys: Sequence[str],
    *,
    ts: str = "ts",
    latency: str = "latency_ms",
    period: str = ALARM_PERIOD,
    approximate: bool = False,
) -> DataFrame:
    """p95 latency, errors and refusals per window and key.

    In batch, equal latencies are counted before the percentile, so one busy key is a
    histogram. A stream allows one aggregation and takes the
    mergeable estimate instead.
    """
    errors, refusals = F.sum("errors").alias("errors"), F.sum("refusals").alias("refusals")
    if approximate:
        p95 = F.percentile_approx(latency, 0.95, 10_000).cast("double")
        return _flatten(
            _windowed(calls, ts, period, keys).agg(
                p95.alias("p95_ms"), errors, refusals, F.count(F.lit(1)).alias("calls")
            ),
            keys, "p95_ms", "errors", "refusals", "calls",
        )
    counted = calls.groupBy(
        F.window(F.col(ts), period).alias("window"), *keys, F.col(latency).alias("__ms")
    ).agg(F.count(F.lit(1)).alias("__n"), errors, refusals)
    folded = counted.groupBy("window", *keys).agg(
        F.percentile("__ms", 0.95, F.col("__n")).alias("p95_ms"),
        F.sum("errors").alias("errors"),
        F.sum("refusals").alias("refusals"),
        F.sum("__n").alias("calls"),
    )
    return _flatten(folded, keys, "p95_ms", "errors", "refusals", "calls")


def alarms(
    counts: DataFrame,
    *,
    p95_ms: float = LATENCY_P95_MS,
    errors: int = ERROR_COUNT,
    refusals: int = REFUSAL_COUNT,
) -> DataFrame:
    """Windows that breach any threshold, with one flag per alarm."""
    return (
        counts.withColumns(
            {
                "latency_alarm": F.col("p95_ms") > p95_ms,
                "error_alarm": F.col("errors") >= errors,
                "refusal_alarm": F.col("refusals") >= refusals,
            }
        )
        .filter(F.col("latency_alarm") | F.col("error_alarm") | F.col("refusal_alarm"))
    )


def hourly(events: DataFrame, keys: Sequence[str], measures: dict[str, Column], *, ts: str = "ts") -> DataFrame:
    """Any set of mergeable measures per hour and key."""
    named = [column.alias(name) for name, column in measures.items()]
    return _flatten(_windowed(events, ts, MONITOR_PERIOD, keys).agg(*named), keys, *measures)


def answer_monitor(answers: DataFrame) -> DataFrame:
    """Hourly answers by outcome, tokens, best score and least complete evidence."""
    return hourly(
        answers,
        ["outcome"],
        {
            "answers": F.count(F.lit(1)),
            "tokens": F.sum("tokens"),
            "eval_score_max": F.max("eval_score"),
            "evidence_complete_min": F.min("evidence_complete"),
        },
    )


def sla_misses(dq_events: DataFrame, *, threshold: int = SLA_MISSES) -> DataFrame:
    """Hours in which at least ``threshold`` critical rules failed."""
    critical = (F.col("status") == "FAIL") & (F.col("severity") == "critical")
    counted = hourly(
        dq_events,
        [],
        {
            "passed": F.count_if(F.col("status") == "PASS"),
            "warned": F.count_if((F.col("status") == "FAIL") & (F.col("severity") == "warning")),
            "misses": F.count_if(critical),
        },
    )
    return counted.withColumn("sla_alarm", F.col("misses") >= threshold)
