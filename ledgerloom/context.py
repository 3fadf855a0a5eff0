"""The time anchor shared by every transform of one run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunContext:
    """``as_of`` is the last day with data; nothing ever reads the wall clock."""

    as_of: date

    @classmethod
    def from_window_end(cls, window_end: date) -> RunContext:
        """Anchor a run on the last day before an exclusive window end."""
        return cls(window_end - timedelta(days=1))

    @property
    def run_ts(self) -> datetime:
        return datetime(self.as_of.year, self.as_of.month, self.as_of.day)

    @property
    def job_run_id(self) -> str:
        return f"pipeline-{self.as_of.isoformat()}"

    @property
    def day(self) -> Column:
        return F.lit(self.as_of)

    @property
    def stamp(self) -> Column:
        return F.lit(self.run_ts).cast("timestamp_ntz")

    def days_back(self, days: int) -> Column:
        """A literal look-back date, so that a filter on it reaches the scan."""
        return F.lit(self.as_of - timedelta(days=days))

    def stamped(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, self.stamp)
