"""Scoring of answers against expectations, and of detectors against a holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITICAL_TAGS = ("governance", "security")


def outcome(
    refused: Column,
    needs_clarification: Column,
    missing_metrics: Column,
    row_count: Column,
    has_metadata: Column,
) -> Column:
    """How a request was resolved; the first condition that holds decides."""
    return (
        F.when(refused, "REFUSED")
        .when(needs_clarification, "NEEDS_CLARIFICATION")
        .when(F.size(missing_metrics) > 0, "NO_GOVERNED_METRIC")
        .when(row_count.isNotNull(), "ANSWERED_FROM_DATA")
        .when(has_metadata, "ANSWERED_FROM_METADATA")
        .otherwise("INCOMPLETE")
    )


def _each(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def _one(condition: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))


def _list(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def failures(answers: DataFrame, expectations: DataFrame, key: str = "case_id") -> DataFrame:
    """Failed assertions per expectation; a case without an answer fails as a whole.

    ``expectations`` has one row per case. Set tests are array operations inside one row,
    so the only exchange is the join on the case.
    """
    e = expectations.alias("e")
    a = answers.withColumn("__answered", F.lit(True)).alias("a")
    want, got = (lambda n: F.col(f"e.{n}")), (lambda n: F.col(f"a.{n}"))
    metrics, tables, tools = (_list(got(n)) for n in ("metrics", "tables", "tools_called"))
    sql, answer = F.upper(F.coalesce(got("sql"), F.lit(""))), F.lower(F.coalesce(got("answer"), F.lit("")))
    rows = F.coalesce(got("row_count"), F.lit(0).cast("long"))
    no_sql = got("sql").isNull() & (F.size(_list(want("sql_contains"))) > 0)
    answered = F.coalesce(got("row_count").isNotNull(), F.lit(False)) | F.coalesce(got("has_metadata"), F.lit(False))
    checks = [
        _one(
            ~want("outcome").eqNullSafe(got("outcome")),
            F.concat(
                F.lit("outcome: expected "), want("outcome"), F.lit(", got "), F.coalesce(got("outcome"), F.lit("none"))
            ),
        ),
        _each("missing metric ", F.array_except(_list(want("metrics")), metrics)),
        _each("forbidden metric ", F.array_intersect(_list(want("forbid_metrics")), metrics)),
        _one(no_sql, "sql: no query was run"),
        _each(
            "sql: missing ",
            F.when(no_sql, F.array().cast("array<string>")).otherwise(
                F.filter(_list(want("sql_contains")), lambda f: ~F.contains(sql, F.upper(f)))
            ),
        ),
        _each("sql: must not contain ", F.filter(_list(want("sql_absent")), lambda f: F.contains(sql, F.upper(f)))),
        _each("tables: not read ", F.array_except(_list(want("tables")), tables)),
        _each("tools: never called ", F.array_except(_list(want("tools")), tools)),
        _each("tools: must not be called ", F.array_intersect(_list(want("forbid_tools")), tools)),
        _one(
            F.coalesce(rows < want("min_rows"), F.lit(False)),
            F.concat(F.lit("rows: fewer than "), want("min_rows").cast("string")),
        ),
        _one(
            F.coalesce(rows > want("max_rows"), F.lit(False)),
            F.concat(F.lit("rows: more than "), want("max_rows").cast("string")),
        ),
        _each("answer: missing ", F.filter(_list(want("answer_contains")), lambda p: ~F.contains(answer, F.lower(p)))),
        _each(
            "answer: must not contain ", F.filter(_list(want("answer_absent")), lambda p: F.contains(answer, F.lower(p)))
        ),
        _one(
            F.coalesce(want("quality"), F.lit(False)) & ~F.coalesce(got("has_quality"), F.lit(False)),
            "quality: no quality state",
        ),
        _one(
            F.coalesce(want("cites_product"), F.lit(True))
            & answered
            & ~F.exists(_list(got("products")), lambda p: F.contains(p, F.lit("@"))),
            "provenance: no product version cited",
        ),
        _one(
            (want("outcome") == "REFUSED") & ~F.coalesce(got("denial_recorded"), F.lit(False)),
            "refusal: no denial with a reason was recorded",
        ),
        _one(F.coalesce(got("trace_id"), F.lit("")) == "", "provenance: no trace id"),
        _one(F.coalesce(got("contract_digest"), F.lit("")) == "", "provenance: no contract digest"),
        _one(got("outcome").eqNullSafe("INCOMPLETE"), "incomplete: no usable outcome"),
    ]
    found = F.when(got("__answered").isNull(), F.array(F.lit("error: no evidence produced"))).otherwise(
        F.concat(*checks)
    )
    judged = e.join(a, key, "left").select(
        key, *[F.col(f"e.{c}") for c in ("weight", "must_pass", "tags")], F.col("a.latency_ms"), found.alias("failures")
    )
    # The list is built once: a projection that reads it twice is not folded into the one that builds it.
    return judged.withColumn("passed", F.size("failures") == 0)


def is_critical() -> Column:
    tagged = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in CRITICAL_TAGS]))
    return F.coalesce(F.col("must_pass"), F.lit(False)) | F.coalesce(tagged, F.lit(False))


def weighted_score(results: DataFrame) -> DataFrame:
    """Passed weight over all weight (1 when there is none), and critical failures."""
    total = F.sum("weight")
    earned = F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0))
    return results.agg(
        F.when(F.coalesce(total, F.lit(0.0)) > 0, F.round(earned / total, 4)).otherwise(1.0).alias("score"),
        F.count_if(is_critical() & ~F.col("passed")).alias("critical_failed"),
    )


def gate(results: DataFrame, fail_under: float) -> DataFrame:
    """Whether a run may be promoted: no critical failure, score not under the bar."""
    return weighted_score(results).withColumn(
        "gate_passed", (F.col("critical_failed") == 0) & ((F.lit(fail_under) <= 0) | (F.col("score") >= fail_under))
    )


def run_summary(results: DataFrame) -> DataFrame:
    latency = F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1)
    return results.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(is_critical() & ~F.col("passed")).alias("critical_failed"),
        latency.alias("latency_ms_mean"),
    )


def precision_recall(alerts: DataFrame, truth: DataFrame, key: str, method: str) -> DataFrame:
    """Hits, false alarms and misses per method, with precision and recall."""
    raised = alerts.select(key, method).distinct().withColumn("__raised", F.lit(True))
    actual = truth.select(key, method).distinct().withColumn("__actual", F.lit(True))
    both = raised.join(actual, [key, method], "full_outer")
    raised_only, actual_only = F.col("__raised").isNotNull(), F.col("__actual").isNotNull()
    counts = both.groupBy(method).agg(
        F.count_if(raised_only & actual_only).alias("tp"),
        F.count_if(raised_only & ~actual_only).alias("fp"),
        F.count_if(~raised_only & actual_only).alias("fn"),
    )
    return counts.select(
        "*",
        F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6).alias("precision"),
        F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6).alias("recall"),
    )
