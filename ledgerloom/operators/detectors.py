"""Detectors for five fraud patterns over time-ordered transactions.

Each pattern looks back a bounded time. So a group is never a whole card or account:
rows are cut into time slices, each slice borrows the last stretch of the slice before
it, and only a slice's own rows are reported. One hot card spreads over all its slices,
and the result is the same as with a window over the whole card.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.bands import as_micros

SECOND = 1_000_000
# The stretch of time and the amounts each pattern is defined by.
BURST_SECONDS, BURST_COUNT, BURST_FACTOR = 2_400, 5, 9.0
JUMP_SECONDS = 150 * 60
PROBE_SECONDS, PROBE_MAX, PROBE_FACTOR = 13 * 60, 5.0, 22.0
RING_SECONDS, RING_CARDS = 2 * 3_600, 3
TAKEOVER_SECONDS, TAKEOVER_MAX, TAKEOVER_FACTOR = 21 * 60, 1.0, 30.0
TAKEOVER_HOURS = (1, 5)
TYPICAL_FLOOR = 500.0
#: A slice is this many look-backs long, so about one row in eight is borrowed twice.
SLICES_PER_LOOKBACK = 8
#: Stretches of time within which a ring's cards are counted one by one.
STRETCHES_PER_LOOKBACK = 16
#: Groups of rings are counted in this many buckets; one with more rows than that is hot.
HEAT_BUCKETS, HOT_ROWS = 1 << 16, 1_000_000


def time_slices(df: DataFrame, ts: str, lookback: int, *, slice_seconds: int | None = None) -> DataFrame:
    """Adds ``__us`` (microseconds), ``__slice`` and ``__own``.

    A row within ``lookback`` seconds of the end of its slice also appears, not owned,
    in the next slice.
    """
    width = (slice_seconds or lookback * SLICES_PER_LOOKBACK) * SECOND
    if width < lookback * SECOND:
        raise ValueError("a slice must be at least as long as the look-back")
    us = F.col("__us")
    home = F.expr(f"(__us - pmod(__us, {width}L)) div {width}L")
    late = F.pmod(us, F.lit(width)) >= width - lookback * SECOND
    copies = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        df.withColumn("__us", as_micros(F.col(ts)))
        .withColumn("__home", home)
        .withColumn("__ahead", F.explode(copies))
        .withColumn("__slice", F.col("__home") + F.col("__ahead"))
        .withColumn("__own", F.col("__ahead") == 0)
        .drop("__home", "__ahead")
    )


def _own(df: DataFrame) -> DataFrame:
    return df.filter(F.col("__own")).drop("__us", "__slice", "__own")


def _known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that have the keys: a row without an account is not a row of one shared account."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def _count_within(keys: Sequence[str], seconds: int) -> Column:
    """Rows of the key in the closed stretch ``[now - seconds, now]``.

    A running count minus the running count that ended before the stretch: both frames
    only grow, so a busy key costs one pass over its slice.
    """
    order = W.partitionBy(*keys, "__slice").orderBy("__us")
    until_now = order.rangeBetween(W.unboundedPreceding, W.currentRow)
    too_early = order.rangeBetween(W.unboundedPreceding, -seconds * SECOND - 1)
    return F.count(F.lit(1)).over(until_now) - F.count(F.lit(1)).over(too_early)


def _rounded_cents(amount: Column, digits: int) -> Column:
    """Whole cents cut to their first ``digits`` digits (integer arithmetic)."""
    cents = F.round(amount * 100).cast("long")
    surplus = F.greatest(F.length(cents.cast("string")) - digits, F.lit(0))
    step = F.pow(F.lit(10.0), surplus).cast("long")
    return cents - F.pmod(cents, step)


def typical_amount(df: DataFrame, key: str, amount: str, *, digits: int = 3, floor: float = TYPICAL_FLOOR) -> DataFrame:
    """Exact lower median per key in whole cents, not under ``floor``.

    First the bin that holds the median: amounts cut to ``digits`` significant digits fall
    into a bounded number of bins (900 per power of ten for 3 digits), so a key is a short
    histogram after the map-side count, whatever its number of rows. Then the value inside
    that one bin, which again has a bounded number of different cents.
    """
    cents = F.round(F.col(amount) * 100).cast("long")
    paid = _known(df.filter(F.col(amount) > 0), key).select(
        key, cents.alias("__cents"), _rounded_cents(F.col(amount), digits).alias("__bin")
    )
    bins = paid.groupBy(key, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    reached = F.sum("__n").over(W.partitionBy(key).orderBy("__bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("__n").over(W.partitionBy(key))
    middle = (
        bins.withColumn("__before", reached - F.col("__n"))
        .withColumn("__rank", F.ceil(total / 2) - F.col("__before"))
        .filter((F.col("__rank") > 0) & (F.col("__rank") <= F.col("__n")))
        .select(key, "__bin", "__rank")
    )
    inside = paid.join(middle, [key, "__bin"]).groupBy(key, "__rank", "__cents").agg(F.count(F.lit(1)).alias("__n"))
    counted = F.sum("__n").over(W.partitionBy(key).orderBy("__cents").rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        inside.withColumn("__reached", counted)
        .filter(F.col("__reached") >= F.col("__rank"))
        .groupBy(key)
        .agg(F.greatest(F.min("__cents") / 100.0, F.lit(floor)).alias("typical"))
    )


def with_typical(df: DataFrame, key: str, amount: str, *, floor: float = TYPICAL_FLOOR) -> DataFrame:
    return df.join(typical_amount(df, key, amount, floor=floor), key, "left")


def card_bursts(
    txns: DataFrame,
    *,
    keys: Sequence[str] = ("card_id", "device_id"),
    customer: str = "customer_id",
    ts: str = "transaction_ts",
    amount: str = "amount",
    seconds: int = BURST_SECONDS,
    count: int = BURST_COUNT,
    factor: float = BURST_FACTOR,
    floor: float = TYPICAL_FLOOR,
) -> DataFrame:
    """Large debits in quick succession on one card and device; adds ``burst_size``."""
    large = with_typical(txns, customer, amount, floor=floor).filter(F.col(amount) >= factor * F.col("typical"))
    sliced = time_slices(_known(large, *keys), ts, seconds)
    sized = sliced.withColumn("burst_size", _count_within(keys, seconds))
    return _own(sized.filter(F.col("burst_size") >= count))


def geo_jumps(
    txns: DataFrame,
    *,
    key: str = "card_id",
    ts: str = "transaction_ts",
    order: Sequence[str] = ("transaction_id",),
    abroad: str = "is_international",
    seconds: int = JUMP_SECONDS,
) -> DataFrame:
    """An international charge soon after a domestic one on the same card; adds the gap."""
    sliced = time_slices(_known(txns, key), ts, seconds)
    before = W.partitionBy(key, "__slice").orderBy("__us", *order)
    gap = F.col("__us") - F.lag("__us").over(before)
    jumped = sliced.withColumns({"__came_from_home": ~F.lag(abroad).over(before), "__gap": gap}).filter(
        F.col(abroad) & F.col("__came_from_home") & (F.col("__gap") <= seconds * SECOND)
    )
    return _own(jumped.withColumn("gap_seconds", F.expr(f"__gap div {SECOND}L")).drop("__came_from_home", "__gap"))


def _after_probe(
    txns: DataFrame,
    probe: Column,
    strike: Column,
    *,
    key: str,
    ts: str,
    seconds: int,
) -> DataFrame:
    """Strikes preceded by a probe on the same key within ``seconds``; adds the gap."""
    sliced = time_slices(_known(txns, key), ts, seconds)
    # The newest of all earlier probes is the newest in the stretch, if any is: a frame that only grows.
    earlier = W.partitionBy(key, "__slice").orderBy("__us").rangeBetween(W.unboundedPreceding, -1)
    last_probe = F.max(F.when(probe, F.col("__us"))).over(earlier)
    return _own(
        sliced.withColumn("__probe", last_probe)
        .filter(strike & (F.col("__us") - F.col("__probe") <= seconds * SECOND))
        .withColumn("gap_seconds", F.expr(f"(__us - __probe) div {SECOND}L"))
        .drop("__probe")
    )


def probe_then_drain(
    txns: DataFrame,
    *,
    key: str = "account_id",
    customer: str = "customer_id",
    ts: str = "transaction_ts",
    amount: str = "amount",
    seconds: int = PROBE_SECONDS,
    probe_max: float = PROBE_MAX,
    factor: float = PROBE_FACTOR,
    floor: float = TYPICAL_FLOOR,
) -> DataFrame:
    """A tiny debit, then a far larger debit on the same account within minutes."""
    debit = F.col("debit_credit") == "DEBIT"
    base = with_typical(txns, customer, amount, floor=floor)
    return _after_probe(
        base,
        debit & (F.col(amount) <= probe_max),
        debit & (F.col(amount) >= factor * F.col("typical")),
        key=key,
        ts=ts,
        seconds=seconds,
    )


def takeovers(
    txns: DataFrame,
    *,
    key: str = "account_id",
    customer: str = "customer_id",
    ts: str = "transaction_ts",
    amount: str = "amount",
    seconds: int = TAKEOVER_SECONDS,
    probe_max: float = TAKEOVER_MAX,
    factor: float = TAKEOVER_FACTOR,
    floor: float = TYPICAL_FLOOR,
    hours: tuple[int, int] = TAKEOVER_HOURS,
) -> DataFrame:
    """A token credit in the small hours, then a drain of the account within minutes."""
    small_hours = (F.hour(ts) >= hours[0]) & (F.hour(ts) < hours[1])
    base = with_typical(txns, customer, amount, floor=floor)
    return _after_probe(
        base,
        (F.col("debit_credit") == "CREDIT") & (F.col(amount) <= probe_max) & small_hours,
        (F.col("debit_credit") == "DEBIT") & (F.col(amount) >= factor * F.col("typical")),
        key=key,
        ts=ts,
        seconds=seconds,
    )


def _ring_steps(sliced: DataFrame, keys: Sequence[str], card: str, order: Sequence[str], span: int) -> DataFrame:
    """Each charge as two steps: ``__delta`` is +1 at its own time and -1 when it no longer counts."""
    again = F.lead("__us").over(W.partitionBy(*keys, card).orderBy("__us", *order))
    leaves = F.least(F.col("__us") + F.lit(span + 1), again)
    return (
        sliced.withColumn("__leaves", leaves)
        .withColumn(
            "__step",
            F.explode(
                F.array(
                    F.struct(F.col("__us").alias("at"), F.lit(1).alias("delta")),
                    F.struct(F.col("__leaves").alias("at"), F.lit(-1).alias("delta")),
                )
            ),
        )
        .withColumns({"__at": F.col("__step.at"), "__delta": F.col("__step.delta")})
    )


def _in_company(sliced: DataFrame, keys: Sequence[str], span: int) -> DataFrame:
    """Rows with another row of their group within the look-back, before or after them."""
    by_time = W.partitionBy(*keys).orderBy("__us")
    now = F.col("__us")
    gaps = {"__since": now - F.lag(now).over(by_time), "__until": F.lead(now).over(by_time) - now}
    return (
        sliced.withColumns(gaps)
        .filter((F.col("__since") <= span) | (F.col("__until") <= span))
        .drop(*gaps)
    )


def _count_by_group(sliced: DataFrame, keys: Sequence[str], steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ring sizes with one running sum per group: all its windows share one exchange."""
    running = W.partitionBy(*keys).orderBy("__at").rangeBetween(W.unboundedPreceding, W.currentRow)
    return steps(sliced).withColumn("ring_cards", F.sum("__delta").over(running))


def _count_by_stretch(
    sliced: DataFrame, keys: Sequence[str], steps: Callable[[DataFrame], DataFrame], span: int
) -> DataFrame:
    """The same sizes with a running sum per stretch of time, which starts from the sum of all stretches before."""
    stretch = F.expr(f"__at div {max(1, span // STRETCHES_PER_LOOKBACK)}L")
    dealt = steps(sliced).withColumn("__stretch", stretch)
    before = W.partitionBy(*keys).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys, "__stretch")
        .agg(F.sum("__delta").alias("__sum"))
        .withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
        .drop("__sum")
    )
    running = W.partitionBy(*keys, "__stretch").orderBy("__at").rangeBetween(W.unboundedPreceding, W.currentRow)
    return dealt.join(starts, [*keys, "__stretch"]).withColumn(
        "ring_cards", F.col("__start") + F.sum("__delta").over(running)
    )


def collusion_rings(
    txns: DataFrame,
    *,
    merchant: str = "merchant_id",
    amount: str = "amount",
    card: str = "card_id",
    ts: str = "transaction_ts",
    order: Sequence[str] = ("transaction_id",),
    seconds: int = RING_SECONDS,
    cards: int = RING_CARDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Charges of one amount at one merchant by several cards; adds ``ring_cards``.

    ``ring_cards`` is the exact number of distinct cards in the closed look-back. A card
    counts from its charge until the look-back ends or it charges again, so the number is
    a running sum of +1 and -1: constant state, no set of cards and no pairs of rows.

    Rows move once, by merchant, amount and slice, and those with no other row near them
    are left out before anything else is done. Groups in a hash bucket of more than
    ``hot_rows`` rows go another way to the same numbers: their sum runs within short
    stretches of time and starts from the sum of all stretches before, which are few and
    added up map-side, so that one popular price is not one task.
    """
    span = seconds * SECOND
    keys = [merchant, amount, "__slice"]
    sliced = time_slices(_known(txns, merchant, amount, card), ts, seconds).withColumn(
        "__bucket", F.pmod(F.xxhash64(*keys), F.lit(HEAT_BUCKETS))
    )
    sizes = sliced.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    hot = F.broadcast(sizes.filter(F.col("__n") > hot_rows).select("__bucket"))  # at most one row per bucket
    steps = partial(_ring_steps, keys=keys, card=card, order=order, span=span)
    calm = sliced.join(hot, "__bucket", "left_anti")
    if cards > 1:  # a charge alone is a ring of one
        calm = _in_company(calm, keys, span)
    sized = _count_by_group(calm, keys, steps).unionByName(
        _count_by_stretch(sliced.join(hot, "__bucket", "left_semi"), keys, steps, span), allowMissingColumns=True
    )
    found = sized.filter((F.col("__delta") == 1) & (F.col("ring_cards") >= cards))
    return _own(found).select(*txns.columns, "ring_cards")
