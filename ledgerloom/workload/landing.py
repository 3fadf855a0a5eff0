"""The derived extracts laid out as a landing folder, for whole-run tests and timing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.ingest import with_ingest_metadata
from ledgerloom.workload.tables import Tables

INGESTED_AT = datetime(2024, 1, 30)
#: Natural key of each extract, hashed into its provenance columns.
KEYS = {
    "s_crm/customers": ("customer_id", "_batch_id"),
    "s_core/accounts": ("account_id", "_batch_id"),
    "s_core/transactions": ("transaction_id",),
    "s_loans/loans": ("loan_id", "_batch_id"),
    "s_loans/repayments": ("repayment_id", "paid_date"),
    "s_cards/cards": ("card_id", "_batch_id"),
    "s_cards/card_transactions": ("transaction_id",),
    "s_bureau/credit_records": ("bureau_id",),
    "s_payments/payment_transactions": ("transaction_id",),
}


def extracts(t: Tables) -> dict[str, DataFrame]:
    frames = {
        "s_crm/customers": t.crm,
        "s_core/accounts": t.accounts,
        "s_core/transactions": t.core_transactions,
        "s_loans/loans": t.loans,
        "s_loans/repayments": t.repayments,
        "s_cards/cards": t.cards,
        "s_cards/card_transactions": t.card_transactions,
        "s_bureau/credit_records": t.bureau,
        "s_payments/payment_transactions": t.payment_transactions,
    }
    return {name: _delivered(name, df) for name, df in frames.items()}


def _delivered(name: str, df: DataFrame) -> DataFrame:
    source, entity = name.split("/")
    batch = F.col("_batch_id")
    return with_ingest_metadata(
        df.withColumnRenamed("_batch_id", "__batch"),
        source=source,
        entity=entity,
        batch_id=F.col("__batch"),
        ingested_at=INGESTED_AT,
        keys=[k if k != "_batch_id" else "__batch" for k in KEYS[name]],
        source_file=F.concat(F.lit(f"{name}/batch_year="), F.left("__batch", F.lit(4))),
    ).drop("__batch").select("*", F.left(batch, F.lit(4)).alias("batch_year"))


def land_extracts(t: Tables, landing: str) -> None:
    """One folder per source, entity and year, plus the label holdout."""
    for name, df in extracts(t).items():
        df.repartition("batch_year").write.mode("overwrite").partitionBy("batch_year").parquet(f"{landing}/{name}")
    t.labels.write.mode("overwrite").parquet(f"{landing}/_holdout/fraud_labels")
