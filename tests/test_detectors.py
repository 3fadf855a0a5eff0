"""Detectors on written-out patterns, and against brute force on random rows."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.operators import detectors

START = datetime(2024, 3, 1, 2, 0, 0)
SHAPE = (
    "transaction_id string, card_id string, device_id string, account_id string, customer_id string, merchant_id string, "
    "transaction_ts timestamp_ntz, amount double, debit_credit string, is_international boolean"
)


def frame(spark, entries):
    base = dict(card="K1", device="D1", account="A1", customer="C1", merchant="M1", amount=10.0, side="DEBIT", abroad=False)
    data = []
    for i, (seconds, changes) in enumerate(entries):
        e = {**base, **changes}
        data.append(
            (f"T{i}", e["card"], e["device"], e["account"], e["customer"], e["merchant"], START + timedelta(seconds=seconds), e["amount"], e["side"], e["abroad"])
        )
    return spark.createDataFrame(data, SHAPE)


def ids(df):
    return [r[0] for r in rows(df, "transaction_id")]


def test_the_typical_amount_is_a_floored_lower_median(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1234.56, 1239.99, 99999.0)] + [("b", 3.0)], "k string, v double")
    assert rows(detectors.typical_amount(df, "k", "v", floor=5.0)) == [("a", 1234.56), ("b", 5.0)]
    rng = random.Random(8)
    paid = [(k, round(rng.choice((3.0, 40.0, 4e5)) * rng.random(), 2)) for k in "pq" for _ in range(301)]
    paid += [("p", 7.77)] * 99 + [(None, 5.0), ("q", -1.0), ("q", None)]
    found = dict(rows(detectors.typical_amount(spark.createDataFrame(paid, "k string, v double"), "k", "v", floor=0.0)))
    for k in "pq":
        own = sorted(v for key, v in paid if key == k and v is not None and v > 0)
        assert found[k] == own[(len(own) - 1) // 2]
    assert set(found) == {"p", "q"}


def test_rows_without_a_key_never_meet(spark):
    nobody = {"account": None, "card": None, "device": None, "merchant": None}
    usual = [(i * 86400 + 50000, {"amount": 600.0, "customer": c, "account": "A9"}) for i in range(1, 20) for c in ("C1", "C2")]
    drain = [(0, {**nobody, "amount": 1.0}), (300, {**nobody, "amount": 90000.0, "customer": "C2"})]
    token = [(9, {**nobody, "amount": 1.0, "side": "CREDIT"}), (500, {**nobody, "abroad": True})]
    ring = [(i, {**nobody, "card": f"K{i}", "amount": 77.0}) for i in range(5)]
    df = frame(spark, drain + token + ring + usual)
    assert ids(detectors.probe_then_drain(df)) == ids(detectors.takeovers(df)) == []
    assert ids(detectors.card_bursts(df.filter("account_id IS NULL"), factor=0.0, count=2)) == []
    assert ids(detectors.geo_jumps(df.filter("card_id IS NULL"))) == ids(detectors.collusion_rings(df)) == []


def test_a_burst_needs_five_large_debits_in_forty_minutes(spark):
    usual = [(i * 86400 + 9, {"amount": 600.0, "device": "D9"}) for i in range(1, 20)]
    burst = [(i * 200, {"amount": 6000.0}) for i in range(5)]
    found = detectors.card_bursts(frame(spark, burst + usual))
    assert rows(found, "transaction_id", "burst_size") == [("T4", 5)]
    assert ids(detectors.card_bursts(frame(spark, burst[:4] + [(3300, {"amount": 6000.0})] + usual))) == []


def test_a_jump_is_abroad_soon_after_home(spark):
    entries = [(0, {}), (150 * 60, {"abroad": True}), (150 * 60 + 60, {"abroad": True}), (20000, {}), (20000 + 150 * 60 + 1, {"abroad": True})]
    found = detectors.geo_jumps(frame(spark, entries))
    assert rows(found, "transaction_id", "gap_seconds") == [("T1", 9000)]


def test_a_probe_then_a_drain(spark):
    usual = [(i * 86400 + 5000, {"amount": 600.0, "account": "A2"}) for i in range(1, 20)]
    entries = [(0, {"amount": 5.0}), (700, {"amount": 13200.0}), (781, {"amount": 13200.0}), (90000, {"amount": 13200.0})]
    assert ids(detectors.probe_then_drain(frame(spark, entries + usual))) == ["T1"]


def test_a_takeover_starts_with_a_token_credit_at_night(spark):
    usual = [(i * 86400 + 50000, {"amount": 600.0, "account": "A2"}) for i in range(1, 20)]
    night = [(0, {"amount": 1.0, "side": "CREDIT"}), (600, {"amount": 18000.0})]
    day = [(6 * 3600, {"amount": 1.0, "side": "CREDIT", "account": "A3"}), (6 * 3600 + 600, {"amount": 18000.0, "account": "A3"})]
    assert ids(detectors.takeovers(frame(spark, night + day + usual))) == ["T1"]


def test_a_ring_counts_distinct_cards_only(spark):
    same = {"amount": 9999.0}
    entries = [(0, same), (60, same), (120, {**same, "card": "K2"}), (7200, {**same, "card": "K3"}), (7201, {**same, "card": "K4"})]
    found = detectors.collusion_rings(frame(spark, entries))
    # at 7200 the first charge still counts; at 7201 K1 counts through its second charge
    assert rows(found, "transaction_id", "ring_cards") == [("T3", 3), ("T4", 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_time_slices_change_nothing(spark, seed):
    """One hot card with dense, tied timestamps, compared with a look at every pair."""
    rng = random.Random(seed)
    entries = [
        (rng.randrange(0, 4000), {"card": rng.choice(["K1", "K1", "K2"]), "device": "D", "merchant": rng.choice("AB"), "abroad": rng.random() < 0.4, "amount": rng.choice([1.0, 20.0, 30.0])})
        for _ in range(150)
    ]
    df = frame(spark, entries).cache()
    data = [r.asDict() for r in df.collect()]
    us = lambda r: r["transaction_ts"]
    back = timedelta(seconds=300)

    bursts = detectors.card_bursts(df, seconds=300, count=3, factor=0.0, floor=0.0)
    assert rows(bursts, "transaction_id", "burst_size") == sorted(
        (r["transaction_id"], n)
        for r in data
        if (n := sum(o["card_id"] == r["card_id"] and us(r) - back <= us(o) <= us(r) for o in data)) >= 3
    )
    rings = detectors.collusion_rings(df, seconds=300, cards=2)
    assert rows(rings, "transaction_id", "ring_cards") == sorted(
        (r["transaction_id"], n)
        for r in data
        if (
            n := len({o["card_id"] for o in data if (o["merchant_id"], o["amount"]) == (r["merchant_id"], r["amount"]) and us(r) - back <= us(o) <= us(r)})
        )
        >= 2
    )
    probes = detectors._after_probe(df, F.col("amount") <= 5, F.col("amount") >= 20, key="card_id", ts="transaction_ts", seconds=300)
    assert ids(probes) == sorted(
        r["transaction_id"]
        for r in data
        if r["amount"] >= 20 and any(o["card_id"] == r["card_id"] and o["amount"] <= 5 and us(r) - back <= us(o) < us(r) for o in data)
    )
    jumps = detectors.geo_jumps(df, seconds=300)
    expected = []
    for card in ("K1", "K2"):
        line = sorted((r for r in data if r["card_id"] == card), key=lambda r: (us(r), r["transaction_id"]))
        expected += [
            b["transaction_id"] for a, b in zip(line, line[1:]) if b["is_international"] and not a["is_international"] and us(b) - us(a) <= back
        ]
    assert ids(jumps) == sorted(expected)


def test_a_hot_card_is_spread_over_its_slices(spark):
    df = frame(spark, [(i * 60, {}) for i in range(2000)])
    sliced = detectors.time_slices(df, "transaction_ts", 300)
    groups = sliced.groupBy("card_id", "__slice").count()
    assert groups.count() >= 2000 * 60 // 2400 and groups.agg(F.max("count")).first()[0] <= 2700 // 60 + 1
    assert sliced.filter("__own").count() == 2000
    with pytest.raises(ValueError):
        detectors.time_slices(df, "transaction_ts", 300, slice_seconds=10)


@pytest.mark.parametrize("hot_rows", [0, 40, 10**6])
@pytest.mark.parametrize("cards", [1, 2, 3])
def test_hot_prices_change_no_ring(spark, hot_rows, cards):
    """A dense price, sparse ones, ties, lone charges, both zeros and a missing time, compared with a look at every pair."""
    rng = random.Random(cards)
    entries = [(rng.randrange(0, 5000), {"card": rng.choice("abcde"), "amount": 7.0}) for _ in range(120)]
    entries += [
        (rng.randrange(0, 90000), {"card": rng.choice("abc"), "merchant": rng.choice("AB"), "amount": rng.choice([0.0, -0.0, 3.0])})
        for _ in range(150)
    ]
    entries += [(2400, {"card": c, "merchant": "E"}) for c in "aab"] + [(2100, {"card": "z", "merchant": "E"})]
    df = frame(spark, entries)
    data = [r.asDict() for r in df.collect()]
    lost = df.limit(2).withColumn("transaction_ts", F.lit(None).cast("timestamp_ntz"))
    back = timedelta(seconds=300)
    found = detectors.collusion_rings(df.unionByName(lost), seconds=300, cards=cards, hot_rows=hot_rows)
    assert rows(found, "transaction_id", "ring_cards") == sorted(
        (r["transaction_id"], n)
        for r in data
        if (
            n := len(
                {
                    o["card_id"]
                    for o in data
                    if (o["merchant_id"], o["amount"]) == (r["merchant_id"], r["amount"])
                    and r["transaction_ts"] - back <= o["transaction_ts"] <= r["transaction_ts"]
                }
            )
        )
        >= cards
    )
