import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.operators import audit, evaluation


@pytest.fixture
def answers(spark):
    return spark.createDataFrame(
        [
            ("t1", "2024-01-01 10:00:00", "ok?", "ANSWERED_FROM_DATA", False, [1.0], ["step"]),
            ("t1", "2024-01-02 10:00:00", "q" * 600, "REFUSED", True, [2.0], ["step"]),
            ("t2", "2024-01-01 09:00:00", "x", "INCOMPLETE", False, [3.0], ["step"]),
        ],
        "trace_id string, asked_at string, question string, outcome string, refused boolean, preview array<double>, trace array<string>",
    )


def test_records_carry_payload_index_and_expiry(answers):
    row = audit.answer_records(answers).filter("asked_at LIKE '2024-01-02%'").first()
    assert json.loads(row["payload"])["preview"] == [2.0] and not row["trimmed"]
    assert row["question"] == json.loads(row["payload"])["question"] and row["refused"] is True
    assert row["expires_at"] == 1704189600 + 400 * 86400


def test_an_oversized_payload_loses_its_bulk_but_not_the_record(answers):
    huge = answers.limit(1).withColumn("preview", F.sequence(F.lit(1.0).cast("int"), F.lit(90_000)).cast("array<double>"))
    assert len(json.loads(audit.answer_records(huge).first()["payload"])["preview"]) == 90_000
    row = audit.answer_records(huge, max_payload_bytes=400_000).first()
    body = json.loads(row["payload"])
    assert row["trimmed"] and body["preview"] == [] and body["trace"] == [] and body["truncated_for_retention"]
    assert body["outcome"] == "ANSWERED_FROM_DATA"


def test_expired_days_are_dropped_as_folders(spark, answers, scratch):
    path, day = f"{scratch}/log", 86_400
    audit.append_answers(audit.answer_records(answers), path)
    late = answers.limit(1).withColumns({"trace_id": F.lit("t3"), "asked_at": F.lit("2024-01-02 23:00:00")})
    audit.append_answers(audit.answer_records(late), path)
    keeps = answers.limit(1).withColumns({"trace_id": F.lit("t4"), "asked_at": F.lit("2023-12-30 01:00:00")})
    audit.append_answers(audit.answer_records(keeps, ttl_days=4000), path)
    now = 1704189600 + 400 * day  # the moment at which the record of 10:00 on the second day expires

    def folders():
        return sorted({f.rpartition("/")[0].rpartition("=")[2] for f in audit.read_answers(spark, path).inputFiles()})

    before = rows(audit.unexpired(audit.read_answers(spark, path), now), "trace_id", "asked_at")
    assert folders() == ["2023-12-30", "2024-01-01", "2024-01-02"]
    assert audit.drop_expired(spark, path, now, grace_seconds=2 * day) == []
    assert audit.drop_expired(spark, path, now) == ["2024-01-01"]
    assert folders() == ["2023-12-30", "2024-01-02"]
    assert rows(audit.unexpired(audit.read_answers(spark, path), now), "trace_id", "asked_at") == before
    assert [b[0] for b in before] == ["t3", "t4"]
    assert audit.drop_expired(spark, path, now) == [] and audit.drop_expired(spark, f"{scratch}/none", now) == []


def test_log_round_trip(spark, answers, scratch):
    path = f"{scratch}/log"
    audit.append_answers(audit.answer_records(answers), path)
    audit.append_answers(audit.answer_records(answers.limit(1).withColumn("trace_id", F.lit("t9"))), path)
    log = audit.read_answers(spark, path)
    assert rows(audit.latest_answers(log), "trace_id", "outcome") == [
        ("t1", "REFUSED"), ("t2", "INCOMPLETE"), ("t9", "ANSWERED_FROM_DATA"),
    ]
    assert audit.latest_answer(log, "t1").first()["outcome"] == "REFUSED"
    recent = audit.recent_answers(log, 2)
    assert "payload" not in recent.columns
    assert [r["asked_at"] for r in recent.collect()] == ["2024-01-02 10:00:00", "2024-01-01 10:00:00"]
    assert rows(audit.answers_per_trace(log)) == [("t1", 2), ("t2", 1), ("t9", 1)]
    assert audit.unexpired(log, 1704189600 + 400 * 86400 - 1).count() == 1


def test_the_first_condition_decides_the_outcome(spark):
    df = spark.createDataFrame(
        [
            (True, True, ["m"], 1, True), (False, True, ["m"], 1, True), (False, False, ["m"], 1, True),
            (False, False, [], 0, True), (False, False, [], None, True), (False, False, None, None, False),
        ],
        "r boolean, c boolean, m array<string>, n int, q boolean",
    )
    out = evaluation.outcome(F.col("r"), F.col("c"), F.col("m"), F.col("n"), F.col("q"))
    assert [r[0] for r in df.select(out).collect()] == [
        "REFUSED", "NEEDS_CLARIFICATION", "NO_GOVERNED_METRIC", "ANSWERED_FROM_DATA", "ANSWERED_FROM_METADATA", "INCOMPLETE",
    ]


ANSWER = (
    "case_id string, outcome string, metrics array<string>, tables array<string>, tools_called array<string>, sql string, "
    "answer string, row_count bigint, has_metadata boolean, has_quality boolean, products array<string>, "
    "denial_recorded boolean, trace_id string, contract_digest string, latency_ms double"
)
EXPECT = (
    "case_id string, outcome string, metrics array<string>, forbid_metrics array<string>, sql_contains array<string>, "
    "sql_absent array<string>, tables array<string>, tools array<string>, forbid_tools array<string>, min_rows bigint, "
    "max_rows bigint, answer_contains array<string>, answer_absent array<string>, quality boolean, cites_product boolean, "
    "weight double, must_pass boolean, tags array<string>"
)


def score(spark, answer, **expect):
    full = dict.fromkeys([f.split()[0] for f in EXPECT.split(", ")])
    full.update({"case_id": "c", "outcome": "ANSWERED_FROM_DATA", "weight": 1.0, "must_pass": False, "tags": []}, **expect)
    given = dict.fromkeys([f.split()[0] for f in ANSWER.split(", ")])
    given.update(
        {
            "case_id": "c", "outcome": "ANSWERED_FROM_DATA", "metrics": ["m1"], "tables": ["gold.t"], "tools_called": ["run"],
            "sql": "SELECT region FROM gold.t", "answer": "About 5 Regions", "row_count": 5, "products": ["t@1.0.0"],
            "trace_id": "x", "contract_digest": "d", "latency_ms": 4.0,
        },
        **(answer or {}),
    )
    answers = spark.createDataFrame([tuple(given.values())], ANSWER)
    if answer is None:
        answers = answers.limit(0)
    return evaluation.failures(answers, spark.createDataFrame([tuple(full.values())], EXPECT))


@pytest.mark.parametrize(
    ("answer", "expect", "failures"),
    [
        ({}, {}, []),
        (None, {}, ["error: no evidence produced"]),
        ({}, {"outcome": "REFUSED"}, ["outcome: expected REFUSED, got ANSWERED_FROM_DATA", "refusal: no denial with a reason was recorded"]),
        ({}, {"metrics": ["m1", "m2"], "forbid_metrics": ["m1"]}, ["missing metric m2", "forbidden metric m1"]),
        ({}, {"sql_contains": ["REGION", "city"], "sql_absent": ["from"]}, ["sql: missing city", "sql: must not contain from"]),
        ({"sql": None}, {"sql_contains": ["a", "b"]}, ["sql: no query was run"]),
        ({}, {"tables": ["gold.u"], "tools": ["plan"], "forbid_tools": ["run"]}, ["tables: not read gold.u", "tools: never called plan", "tools: must not be called run"]),
        ({}, {"min_rows": 6}, ["rows: fewer than 6"]),
        ({}, {"max_rows": 4}, ["rows: more than 4"]),
        ({}, {"answer_contains": ["regions"], "answer_absent": ["ABOUT"]}, ["answer: must not contain ABOUT"]),
        ({}, {"quality": True}, ["quality: no quality state"]),
        ({"products": ["t"]}, {}, ["provenance: no product version cited"]),
        ({"products": ["t"]}, {"cites_product": False}, []),
        ({"trace_id": "", "contract_digest": None}, {}, ["provenance: no trace id", "provenance: no contract digest"]),
    ],
)
def test_expectations(spark, answer, expect, failures):
    row = score(spark, answer, **expect).first()
    assert (row["failures"], row["passed"]) == (failures, not failures)


def test_score_gate_and_summary(spark):
    results = spark.createDataFrame(
        [("a", 2.0, True, [], 10.0, True), ("b", 1.0, False, ["golden"], 20.0, False), ("c", 1.0, False, ["security"], None, True)],
        "case_id string, weight double, must_pass boolean, tags array<string>, latency_ms double, passed boolean",
    )
    assert tuple(evaluation.gate(results, 0.7).first()) == (0.75, 0, True)
    assert evaluation.gate(results, 0.8).first()["gate_passed"] is False
    critical = results.withColumn("passed", F.col("case_id") != "c")
    assert evaluation.gate(critical, 0.0).first()["gate_passed"] is False
    assert tuple(evaluation.run_summary(results).first()) == (3, 2, 1, 0, 15.0)
    assert evaluation.weighted_score(results.limit(0)).first()["score"] == 1.0


def test_precision_and_recall(spark):
    alerts = spark.createDataFrame([("1", "J"), ("2", "J"), ("2", "J"), ("9", "B")], "id string, m string")
    truth = spark.createDataFrame([("1", "J"), ("3", "J")], "id string, m string")
    got = rows(evaluation.precision_recall(alerts, truth, "id", "m"))
    assert got == [("B", 0, 1, 0, 0.0, None), ("J", 1, 1, 1, 0.5, 0.5)]
