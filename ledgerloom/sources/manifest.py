"""Order-independent table fingerprints and per-batch manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARK = "<null>"
# A prime modulus: the plain sum keeps what XOR loses, pairs of equal rows.
SUM_MODULUS = 2_147_483_647


def _row_hash(columns: Sequence[str]) -> Column:
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in columns]
    # The first 60 bits of an MD5: the same number in any engine that has MD5.
    return F.conv(F.left(F.md5(F.concat_ws("\u0001", *texts)), F.lit(15)), 16, 10).cast("long")


def _digest(columns: Sequence[str]) -> Column:
    parts = [F.col("rows"), F.lit(",".join(columns)), F.col("__xor"), F.col("__sum")]
    return F.left(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), F.lit(32))


def _summaries(columns: Sequence[str]) -> list[Column]:
    h = _row_hash(columns)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(h).alias("__xor"),
        F.sum(F.pmod(h, F.lit(SUM_MODULUS))).alias("__sum"),
    ]


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and a ``fingerprint`` that ignores row and column order."""
    columns = sorted(df.columns)
    value = F.when(F.col("rows") == 0, F.lit("empty")).otherwise(_digest(columns))
    return df.agg(*_summaries(columns)).select("rows", value.alias("fingerprint"))


def batch_manifest(df: DataFrame, batch: str = "_batch_id") -> DataFrame:
    """Rows, columns and fingerprint of every batch in one mergeable aggregate."""
    columns = sorted(df.columns)
    return (
        df.groupBy(batch)
        .agg(*_summaries(columns))
        .select(
            F.col(batch).alias("batch"),
            "rows",
            F.lit(",".join(columns)).alias("columns"),
            _digest(columns).alias("fingerprint"),
        )
    )
