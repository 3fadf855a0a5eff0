"""Releases: one folder per run that is never changed, and one pointer that says which run readers see.

A run builds all its tables below a draft folder. Committing writes the next numbered pointer by renaming a finished
file to a name that must not exist: of two runs that started from the same release only one can, and readers see either
the old release or the new one, never tables of both. A run that ends anywhere before the rename leaves the old pointer
and an unused folder. Readers of an older release keep their files until ``drop_old``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ledgerloom.sources.zones import Zones


class ReleaseConflict(RuntimeError):
    """Another run committed since this one began."""


@dataclass(frozen=True)
class Release:
    number: int
    folder: str
    run_id: str


class Releases:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._files = Zones(spark, self.root)

    @property
    def _pointers(self) -> str:
        return f"{self.root}/_pointers"

    def _named(self, number: int) -> str:
        return f"{self._pointers}/{number:012d}.json"

    def _names(self) -> list[str]:
        fs, folder = self._files._fs(self._pointers)
        if not fs.exists(folder):
            return []
        return sorted(n for e in fs.listStatus(folder) if (n := e.getPath().getName()).endswith(".json"))

    def history(self) -> list[Release]:
        """All committed releases, oldest first: one small file each."""
        return [self._read(name) for name in self._names()]

    def _read(self, name: str) -> Release:
        found = json.loads("".join(r[0] for r in self.spark.read.text(f"{self._pointers}/{name}").collect()))
        return Release(int(name.partition(".")[0]), found["folder"], found["run_id"])

    def latest(self) -> Release | None:
        names = self._names()
        return self._read(names[-1]) if names else None

    def current(self) -> Zones:
        """The lake as of the newest release; it keeps showing that release when others follow."""
        found = self.latest()
        if found is None:
            raise FileNotFoundError(f"no release under {self.root}")
        return Zones(self.spark, f"{self.root}/{found.folder}")

    def draft(self) -> Zones:
        return Zones(self.spark, f"{self.root}/versions/{uuid.uuid4().hex}")

    def commit(self, draft: Zones, run_id: str, since: Release | None) -> Release:
        """Make ``draft`` the release after ``since``; refused if that is not the newest any more."""
        number = (since.number if since else 0) + 1
        fs, target = self._files._fs(self._named(number))
        _, waiting = self._files._fs(f"{self._pointers}/waiting-{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        stream = fs.create(waiting, False)
        folder = draft.root[len(self.root) + 1 :]
        stream.write(bytearray(json.dumps({"folder": folder, "run_id": run_id}).encode()))
        stream.close()
        if fs.exists(target) or not fs.rename(waiting, target):
            fs.delete(waiting, False)
            raise ReleaseConflict(f"release {number} exists already; {run_id} began from {since.number if since else 'none'}")
        return Release(number, folder, run_id)

    def drop_old(self, keep: int = 2) -> list[str]:
        """Delete all but the newest ``keep`` releases; pointers go first, so that nobody finds one whose files are going."""
        if keep < 1:
            raise ValueError("the newest release is always kept")
        found, dropped = self.history(), []
        for release in found[:-keep]:
            self._files.drop_folder(self._named(release.number))
            self._files.drop_folder(f"{self.root}/{release.folder}")
            dropped.append(release.folder)
        return dropped
