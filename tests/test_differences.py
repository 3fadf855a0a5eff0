"""Two deliveries compared through their fingerprint trees."""

import pytest
from conftest import rows

from ledgerloom.sources import differences
from ledgerloom.sources.differences import differing_keys, keep_delivery, unequal_buckets
from ledgerloom.sources.zones import Zones

SCHEMA = "k long, j string, v double, w string"


def kept(spark, zones, name, data, **shape):
    return keep_delivery(zones, f"bronze.{name}", spark.createDataFrame(data, SCHEMA), ["k", "j"], **{"buckets": 64, "fan": 8, **shape})


def base():
    return [(n, "abc"[n % 3], n / 7, None if n % 5 else "x") for n in range(600)] + [(None, None, 1.0, "n"), (7, None, 2.0, None)]


def test_only_changed_keys_are_listed_and_only_their_buckets_are_opened(spark, scratch, monkeypatch):
    zones = Zones(spark, scratch)
    data = base()
    later = [r for r in data if r[0] != 11] + [(9_000, "new", 0.0, None)]
    later = [(*r[:3], "y") if r[0] == 33 else r for r in later]
    later = [(None, None, 1.0, "changed") if r[0] is None else r for r in later]
    before, after = kept(spark, zones, "a", data), kept(spark, zones, "b", list(reversed(later)))
    opened = []
    real = differences.KeptDelivery.folders
    monkeypatch.setattr(differences.KeptDelivery, "folders", lambda self, b: opened.append(list(b)) or real(self, b))
    found = rows(differing_keys(before, after))
    assert sorted(found, key=str) == sorted(
        [(11, "c", "removed", 1, 0), (33, "a", "changed", 1, 1), (9_000, "new", "added", 0, 1), (None, None, "changed", 1, 1)], key=str
    )
    assert opened[0] == unequal_buckets(before, after) and 1 <= len(opened[0]) <= 4
    read = {path.rpartition("/")[0].rpartition("=")[2] for path in real(before, opened[0]).inputFiles()}
    assert read <= {str(b) for b in opened[0]}


def test_equal_deliveries_open_nothing(spark, scratch):
    zones = Zones(spark, scratch)
    one, two = kept(spark, zones, "a", base()), kept(spark, zones, "b", base()[::-1])
    assert unequal_buckets(one, two) == [] and differing_keys(one, two).count() == 0


def test_repeated_rows_and_hot_keys(spark, scratch):
    zones = Zones(spark, scratch)
    hot = [(1, "h", 0.5, None)] * 3000
    one, two = kept(spark, zones, "a", base() + hot), kept(spark, zones, "b", base() + hot[:-2])
    # the base has key (1, b); the hot key is another one
    assert rows(differing_keys(one, two)) == [(1, "h", "changed", 3000, 2998)]
    swapped = kept(spark, zones, "c", base() + hot[:-2] + [(1, "h", 0.25, None)] * 2)
    assert rows(differing_keys(one, swapped)) == [(1, "h", "changed", 3000, 3000)]


def test_values_that_move_between_columns_and_empty_deliveries(spark, scratch):
    zones = Zones(spark, scratch)
    nothing = kept(spark, zones, "none", [])
    one, two = kept(spark, zones, "a", [(1, "a", None, "2.0")]), kept(spark, zones, "b", [(1, "a", 2.0, None)])
    assert rows(differing_keys(one, two)) == [(1, "a", "changed", 1, 1)]
    assert differing_keys(nothing, nothing).count() == 0
    assert rows(differing_keys(nothing, one)) == [(1, "a", "added", 0, 1)]
    assert rows(differing_keys(one, nothing)) == [(1, "a", "removed", 1, 0)]
    with pytest.raises(ValueError):
        unequal_buckets(one, kept(spark, zones, "d", [], buckets=32))
