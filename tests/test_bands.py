from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import bands, text


def evaluate(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("out")).collect()]


def test_dpd_bands_meet_at_their_edges(spark):
    got = evaluate(spark, [0, 1, 30, 31, 60, 61, 90, 91, None], "int", bands.dpd_band)
    assert got == [
        "CURRENT", "DPD_1_30", "DPD_1_30", "DPD_31_60", "DPD_31_60", "DPD_61_90", "DPD_61_90", "DPD_90_PLUS",
        "DPD_90_PLUS",
    ]


def test_score_bands_and_risk_categories(spark):
    scores = [649, 650, 699, 700, 749, 750, 799, 800, None]
    assert evaluate(spark, scores, "int", bands.score_band) == [
        "VERY_POOR", "POOR", "POOR", "FAIR", "FAIR", "GOOD", "GOOD", "EXCELLENT", "VERY_POOR",
    ]
    assert evaluate(spark, scores, "int", bands.risk_category) == [
        "High", "Medium", "Medium", "Medium", "Medium", "Low", "Low", "Low", "Unknown",
    ]


def test_value_segments(spark):
    got = evaluate(
        spark, [299999.99, 300000.0, 1499999.99, 1500000.0, 4999999.99, 5000000.0], "double", bands.value_segment
    )
    assert got == ["Mass", "Affluent", "Affluent", "HNI", "HNI", "Premium"]


def test_risk_bands(spark):
    got = evaluate(spark, [24.99, 25.0, 49.99, 50.0, 74.99, 75.0, 100.0], "double", bands.risk_band)
    assert got == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "VERY_HIGH", "VERY_HIGH"]


def test_age_counts_year_boundaries_and_missing_birth_date_is_the_top_band(spark):
    days = [date(1990, 12, 31), date(1974, 1, 1), date(1975, 1, 1), None]
    as_of = date(2000, 1, 1)
    assert evaluate(spark, days, "date", lambda c: bands.calendar_years(c, as_of)) == [10, 26, 25, None]
    banded = evaluate(spark, days, "date", lambda c: bands.age_band(bands.calendar_years(c, as_of)))
    assert banded == ["18-25", "26-35", "18-25", "65+"]


def test_punctuality(spark):
    assert evaluate(spark, [0, 1, 30, 31], "int", bands.punctuality_band) == [
        "ON_TIME", "LATE_1_30", "LATE_1_30", "LATE_30_PLUS",
    ]


def test_emi_with_and_without_interest(spark):
    row = spark.range(1).select(
        bands.emi(F.lit(100000.0), F.lit(12.0), F.lit(12)).alias("a"),
        bands.emi(F.lit(1200.0), F.lit(0.0), F.lit(12)).alias("b"),
    ).first()
    assert row["a"] == pytest.approx(8884.88)
    assert row["b"] == 100.0


def test_scorecard_terms_add_up_and_are_capped(spark):
    frame = spark.createDataFrame(
        [(700, 0, 0.3, False), (600, 200, 0.5, True), (None, None, 0.0, False), (300, 180, 5.0, True)],
        "score int, dpd int, burden double, npa boolean",
    )
    points = bands.risk_points(F.col("score"), F.col("dpd"), F.col("burden"), F.col("npa"))
    got = [round(r[0], 6) for r in frame.select(points.alias("p")).collect()]
    # 50*.25; 150*.25 + 180*.25 + .2*100 + 40 = 142.5, capped; missing score counts as 700; capped
    assert got == [12.5, 100.0, 12.5, 100.0]


def test_ratio_is_null_instead_of_a_division_by_zero(spark):
    frame = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in frame.select(bands.ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.25]


PHONES = [
    f"call {n} now" for n in ("+91 98765 43210", "+1 (212) 555-0199", "+44-20-7946-0958", "+493012345678", "(212) 555-0199", "212-555-0199")
] + ["at 2001:0db8:85a3:0000:0000:8a2e:0370:7334", "at fe80::1:2", "at 10:30:45, 1-2-3, 2024-01-30 and 12 345"]


def test_tokens_are_singular_distinct_and_without_stop_words(spark):
    got = evaluate(
        spark, ["Show me the Customers and countries; customer class, glass!"], "string", text.search_tokens
    )[0]
    assert sorted(got) == ["class", "country", "customer", "glass"]
    assert text.query_words(spark, "Show me the Customers and countries; customer class, glass!") == sorted(got)


def test_pseudonyms_are_stable_md5_and_null_for_null(spark):
    got = evaluate(spark, ["C1", None], "string", lambda c: text.pseudonym(c, "NAME"))
    import hashlib

    assert got == [hashlib.md5(b"C1|NAME").hexdigest(), None]


def test_masking_and_blocking(spark):
    body = "Mail a.b@x.example.com or +1 (499) 555-6503 from 10.1.2.3; PAN ABCDE1234F, CUST-0000123, 4111 1111 1111 1111"
    df = spark.createDataFrame([(body,), (None,), ("nothing here",)], "t string")
    out = df.select(text.masked(F.col("t")).alias("m"), *[c.alias(k) for k, c in text.blocked_hits(F.col("t")).items()])
    first, none, plain = out.collect()
    assert first["m"].startswith("Mail {EMAIL} or {PHONE} from {IP_ADDRESS};")
    shown = evaluate(spark, PHONES, "string", text.masked)
    assert shown == ["call {PHONE} now"] * 6 + ["at {IPV6_ADDRESS}", "at {IPV6_ADDRESS}", "at 10:30:45, 1-2-3, 2024-01-30 and 12 345"]
    judged = evaluate(spark, ["CVV: 123", "exp 04/27", "SWIFT DEUTDEFF500", "PIN 1234", "tea at 4", None], "string", text.verdict)
    assert judged == ["blocked"] * 4 + ["allowed"] * 2
    assert (first["pan_number"], first["internal_customer_id"], first["card_number"]) == (1, 1, 1)
    assert none["m"] is None and none["pan_number"] is None
    assert plain["m"] == "nothing here" and plain["card_number"] == 0
