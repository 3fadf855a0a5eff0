"""Releases change all tables together, or none."""

from datetime import date

import pytest

from ledgerloom import api
from ledgerloom.context import RunContext
from ledgerloom.plans import medallion
from ledgerloom.sources import releases as rel
from ledgerloom.sources.zones import Zones
from ledgerloom.workload.landing import land_extracts
from ledgerloom.workload.tables import Tables
from conftest import SMALL, rows

FIRST, SECOND = RunContext(date(2024, 1, 30)), RunContext(date(2024, 2, 10))


def state(lake):
    """The run that every published and operational table shows."""
    zones = lake.current()
    found = {rows(zones.read(f"gold.{p}"), "_gold_updated_at")[0][0].date() for p in ("customer_360", "transaction", "credit_risk")}
    found |= {zones.read(t).first()["run_ts"].date() for t in ("ops.dq_results", "ops.pipeline_runs")}
    assert len(found) == 1, "tables of two runs"
    return found.pop()


def test_a_run_that_ends_anywhere_leaves_one_release(spark, scratch, monkeypatch):
    landing, lake = f"{scratch}/landing", api.Releases(spark, f"{scratch}/lake")
    land_extracts(Tables(spark, SMALL), landing)
    with pytest.raises(FileNotFoundError):
        lake.current()
    release, counts = api.run_release(lake, FIRST, landing, enforce=False)
    assert release.number == 1 and counts["gold.transaction"] and state(lake) == FIRST.as_of
    assert spark.table("gold.customer_360").count() == counts["gold.customer_360"]

    def fail(*_, **__):
        raise RuntimeError("killed")

    class Killed(Zones):
        """Ends after the given number of products have been put in place."""

        left = 1

        def take_over(self, dataset, other):
            if Killed.left == 0:
                fail()
            Killed.left -= 1
            super().take_over(dataset, other)

    with monkeypatch.context() as patch:
        patch.setattr(rel, "Zones", Killed)
        with pytest.raises(RuntimeError, match="killed"):
            api.run_release(lake, SECOND, landing, enforce=False)
    assert state(lake) == FIRST.as_of and lake.latest() == release
    with monkeypatch.context() as patch:
        patch.setattr(medallion, "record_runs", fail)
        patch.setattr(medallion, "build_silver", lambda *_: {})
        patch.setattr(medallion, "build_gold", lambda *_, **__: {})
        patch.setattr(medallion, "publish_all", lambda *_, **__: {})
        with pytest.raises(RuntimeError, match="killed"):
            api.run_release(lake, SECOND, landing, enforce=False)
    assert state(lake) == FIRST.as_of

    readers = lake.current()
    second, _ = api.run_release(lake, SECOND, landing, enforce=False)
    assert second.number == 2 and state(lake) == SECOND.as_of
    assert rows(spark.table("gold.credit_risk"), "as_of_date")[0][0] == SECOND.as_of
    assert rows(readers.read("gold.credit_risk"), "as_of_date")[0][0] == FIRST.as_of  # opened before the second run
    assert lake.drop_old(keep=1) == [release.folder] and [r.number for r in lake.history()] == [2]
    assert state(lake) == SECOND.as_of


def test_of_two_runs_from_one_release_only_one_is_committed(spark, scratch):
    lake = rel.Releases(spark, scratch)
    one, two = lake.draft(), lake.draft()
    for zones, value in ((one, 1), (two, 2)):
        zones.write("gold.t", spark.range(value))
    since = lake.latest()
    lake.commit(one, "one", since)
    with pytest.raises(rel.ReleaseConflict):
        lake.commit(two, "two", since)
    assert lake.current().read("gold.t").count() == 1 and len(lake.history()) == 1
    lake.commit(two, "two", lake.latest())
    assert lake.current().read("gold.t").count() == 2
    with pytest.raises(ValueError):
        lake.drop_old(keep=0)
