"""Runs that take in only new and re-delivered batches, and rewrite only what these touch.

Landing holds one folder per batch and entity. A run

1. lands new and changed batches (``sources.batches``): one bronze folder each, logged with the other batches that hold
   records of the old or the new delivery;
2. rewrites the silver folders of these batches (of a record delivered twice the newest delivery stays), merges the CRM
   snapshot into the stored customer versions, and lets changes of residence flow into the account batches that show it;
3. rewrites the gold folders of the batches and customer buckets touched. When the anchor moves, that is every customer
   (the activity window moved) and, of the transaction product, the batches with a row whose dispute window closed or
   whose label became available in between;
4. marks the batches as applied. A run that ends earlier is taken up again by the next: every step replaces whole
   folders from what is stored before it.

The result is that of one run over all batches whose records are delivered once; of a record that several batches
hold, a run over everything keeps each delivery, and this one the newest. Nothing but names of batches and numbers of buckets reaches the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.context import RunContext
from ledgerloom.operators import conform, products
from ledgerloom.operators.merges import VersionStore, key_bucket, merge_latest
from ledgerloom.operators.snapshots import latest_per_key
from ledgerloom.plans import medallion as m
from ledgerloom.sources import batches, ingest
from ledgerloom.sources.zones import Zones

#: How each table is laid out; readers of products do not see these columns.
LAYOUT = {
    "silver.transactions": ("source_system", "_batch_id"),
    "silver.accounts": ("snapshot_batch",),
    "silver.loans": ("snapshot_batch",),
    "silver.credit_records": ("snapshot_batch",),
    "silver.repayments": ("snapshot_batch",),
    "silver.customers": ("bucket",),
    "gold.transaction": ("source_system", "batch"),
    "gold.customer_360": ("bucket",),
    "gold.credit_risk": ("bucket",),
}
RAILS: Mapping[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    m.CORE: ("s_core", conform.core_rail),
    m.CARD_TXNS: ("s_cards", conform.card_rail),
    m.PAYMENTS: ("s_payments", conform.payment_rail),
}
BY_BATCH: Mapping[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    m.LOANS: ("silver.loans", conform.silver_loans),
    m.BUREAU: ("silver.credit_records", conform.silver_credit_records),
    m.REPAYMENTS: ("silver.repayments", conform.silver_repayments),
}
ANCHOR = "ops.increment_anchor"


class LaidOut(Zones):
    """A lake whose tables are laid out in folders by batch or bucket."""

    def read(self, dataset: str, *, merge_schema: bool | None = None, layout: bool = False) -> DataFrame:
        df = super().read(dataset, merge_schema=merge_schema)
        for name in LAYOUT.get(dataset, ()):
            df = df.withColumn(name, F.col(name).cast("string"))  # folder names, whatever the session takes them for
        if dataset.startswith("bronze.") and "batch" in df.columns:
            df = df.withColumn("batch", F.col("batch").cast("string"))
        return df if layout else df.drop(*[c for c in LAYOUT.get(dataset, ()) if c in ("bucket", "batch")])


class Increment:
    """One run over one lake; ``written`` lists the folders that it replaced, by table."""

    def __init__(self, zones: LaidOut, ctx: RunContext, buckets: int = 64) -> None:
        self.zones, self.ctx, self.buckets = zones, ctx, buckets
        self.written: dict[str, set[str]] = defaultdict(set)
        self.affected: set[int] = set()
        self.versions = VersionStore(zones, "bronze.crm_versions", "customer_id", conform.TRACKED_CUSTOMER_ATTRIBUTES, buckets)

    # -- helpers -------------------------------------------------------------
    def _customers_of(self, df: DataFrame) -> None:
        found = df.select(key_bucket("customer_id", self.buckets).alias("b")).distinct().collect()
        self.affected.update(r["b"] for r in found)

    def _replace(self, dataset: str, df: DataFrame, folders: Iterable[tuple[str, ...]], customers: bool = True) -> None:
        """Put ``df`` in the place of whole folders; customers of the old and the new rows count as affected."""
        layout, folders = LAYOUT[dataset], sorted(set(folders))
        if not folders:
            return
        mine = F.struct(*layout).isin([F.struct(*[F.lit(v) for v in f]) for f in folders])
        if customers and self.zones.exists(dataset):
            self._customers_of(self.zones.read(dataset, layout=True).where(mine))
        for folder in folders:
            path = "/".join(f"{n}={v}" for n, v in zip(layout, folder))
            self.zones.drop_folder(f"{self.zones.path(dataset)}/{path}")
            self.written[dataset].add(path)
        self.zones.write(dataset, df.repartition(*layout), partition_by=layout, only_these_partitions=True)
        if customers and self.zones.exists(dataset):
            self._customers_of(self.zones.read(dataset, layout=True).where(mine))

    def _bronze(self, dataset: str, of: Sequence[str]) -> DataFrame:
        """The rows of some batches that are the newest delivery of their record."""
        rows = batches.newest_deliveries(self.zones.read(dataset), of)
        return rows.withColumn("_batch_id", F.col("batch")).drop("batch")

    # -- silver --------------------------------------------------------------
    def transactions(self, dataset: str, of: Sequence[str]) -> None:
        source, shape = RAILS[dataset]
        rows = conform.conform_transactions(shape(self._bronze(dataset, of)), self.ctx)
        self._replace("silver.transactions", rows, [(source, b) for b in of])

    def by_batch(self, dataset: str, of: Sequence[str]) -> None:
        silver, shape = BY_BATCH[dataset]
        self._replace(silver, shape(self._bronze(dataset, of)).withColumn("_silver_updated_at", self.ctx.stamp), [(b,) for b in of])

    def cards(self, of: Sequence[str]) -> None:
        """The newest row per card: of the stored state and newer batches, or of all batches if an old one changed."""
        held = self.zones.read("silver.cards") if self.zones.exists("silver.cards") else None
        newest = None if held is None else held.agg(F.max("snapshot_batch")).first()[0]
        if newest is not None and min(of) > newest:
            state = merge_latest(held, conform.silver_cards(self._bronze(m.CARDS, of), self.ctx), ["card_id"], ["snapshot_batch"])
        else:
            every = sorted(r["batch"] for r in self.zones.read(m.CARDS).select("batch").distinct().collect())
            state = conform.silver_cards(self._bronze(m.CARDS, every), self.ctx)
        waiting = m.candidates(self.zones)
        waiting.write("silver.cards", state)
        self.zones.take_over("silver.cards", waiting)
        self.written["silver.cards"].add("")

    def customers(self, of: Sequence[str]) -> DataFrame | None:
        """Merge CRM batches into the versions; returns the customers whose region of residence may be another now."""
        store, moved = self.versions, None
        newest = store.history().agg(F.max("valid_from_batch")).first()[0] if self.zones.exists(store.open) else ""
        closed = self.zones.exists(store.closed) and self.zones.read(store.closed).agg(F.max("closed_in").cast("string")).first()[0]
        applied = {e.batch for e in batches.BatchLog(self.zones).entries().values() if e.dataset == m.CRM and e.state == batches.APPLIED}
        newest = max([newest or "", closed or "", *applied])
        for batch in sorted(of):
            snapshot = latest_per_key(self._bronze(m.CRM, [batch]), ["customer_id"], ["_ingested_at", "_source_file"])
            if batch > newest:
                touched = store.apply(snapshot.drop("_batch_id"), batch)
                now = store.current(touched).where(F.col("valid_from_batch") == batch).select("customer_id", "region")
                was = store.history(touched).where(F.col("valid_to_batch") == batch).select("customer_id", F.col("region").alias("was"))
                keys = now.join(was, "customer_id", "left").where(~F.col("region").eqNullSafe(F.col("was"))).select("customer_id")
                newest = batch
            else:
                keys_of = [snapshot.select("customer_id"), self._held_in(batch)]
                touched = sorted(set().union(*[store.touched(k) for k in keys_of]))
                snapshots = latest_per_key(self.zones.read(m.CRM).withColumn("_batch_id", F.col("batch")).drop("batch"), ["customer_id", "_batch_id"], ["_ingested_at", "_source_file"])
                store.rebuild(snapshots, "_batch_id", touched)
                keys = store.current(touched).select("customer_id")
            self.affected.update(touched)
            moved = keys if moved is None else moved.unionByName(keys)
        return moved

    def _held_in(self, batch: str) -> DataFrame:
        """Customers of versions that begin or end with a batch: those its old delivery may have named."""
        held = self.versions.history()
        return held.where((F.col("valid_from_batch") == batch) | (F.col("valid_to_batch") == batch)).select("customer_id")

    def accounts(self, of: Sequence[str], moved: DataFrame | None) -> None:
        """Account batches that changed, and those that show a customer whose residence did."""
        touched = set(of)
        if moved is not None and self.zones.exists("silver.accounts"):
            shown = self.zones.read("silver.accounts").join(moved.distinct(), "customer_id", "left_semi")
            touched |= {r["snapshot_batch"] for r in shown.select("snapshot_batch").distinct().collect()}
        if touched:
            residence = self.versions.current().select("customer_id", "region", F.col("valid_from_batch").alias("_batch_id"))
            rows = conform.silver_accounts(self._bronze(m.ACCOUNTS, sorted(touched)), residence, self.ctx)
            self._replace("silver.accounts", rows, [(b,) for b in touched])

    def present_customers(self, wanted: set[int]) -> None:
        if wanted:
            rows = conform.customer_versions(self.versions.history(sorted(wanted)), self.ctx)
            rows = rows.withColumn("bucket", key_bucket("customer_id", self.buckets).cast("string"))
            self._replace("silver.customers", rows, [(str(b),) for b in wanted], customers=False)

    # -- gold ----------------------------------------------------------------
    def transaction_product(self, labels_changed: DataFrame | None, before: date | None) -> None:
        silver = self.zones.read("silver.transactions", layout=True)
        touched = {tuple(p.split("=", 1)[1] for p in f.split("/")) for f in self.written["silver.transactions"]}
        stale = []
        if labels_changed is not None:
            stale.append(silver.join(labels_changed, "transaction_id", "left_semi"))
        if before is not None and before != self.ctx.as_of:
            low, high = sorted([before, self.ctx.as_of])
            window = [RunContext(d).days_back(products.DISPUTE_WINDOW_DAYS) for d in (low, high)]
            stale.append(silver.where((F.col("transaction_date") > window[0]) & (F.col("transaction_date") <= window[1])))
            between = F.col("label_available_date").cast("date")
            fresh = self.zones.read(ingest.HOLDOUT).where((between > F.lit(low)) & (between <= F.lit(high)))
            stale.append(silver.join(fresh.select("transaction_id").distinct(), "transaction_id", "left_semi"))
        for rows in stale:
            touched |= {tuple(r) for r in rows.select("source_system", "_batch_id").distinct().collect()}
        if touched:
            wanted = F.struct("source_system", "_batch_id").isin([F.struct(*[F.lit(v) for v in t]) for t in sorted(touched)])
            rows = silver.where(wanted).withColumn("batch", F.col("_batch_id"))
            self._replace("gold.transaction", products.transaction_product(rows, self.zones.read(ingest.HOLDOUT), self.ctx), touched, customers=False)

    def customer_products(self, wanted: set[int]) -> None:
        """The customer-grain products of whole buckets; every input is cut to them before it is joined."""
        if not wanted:
            return
        mine = key_bucket("customer_id", self.buckets).isin(sorted(wanted))
        customers, accounts, loans, transactions, credit = (
            self.zones.read(f"silver.{t}").where(mine) for t in ("customers", "accounts", "loans", "transactions", "credit_records")
        )
        folders = [(str(b),) for b in wanted]
        bucketed = lambda df: df.withColumn("bucket", key_bucket("customer_id", self.buckets).cast("string"))
        whole = products.customer_360(customers, accounts, loans, transactions, credit, self.ctx)
        self._replace("gold.customer_360", bucketed(whole), folders, customers=False)
        self._replace("gold.credit_risk", bucketed(products.credit_risk(customers, loans, credit, self.ctx)), folders, customers=False)


def _labels(zones: LaidOut, landing: str) -> DataFrame | None:
    """Take in the label files; returns the ids whose labels are not as they were."""
    columns = ["transaction_id", "fraud_method", "label_available_date"]
    waiting = m.candidates(zones)
    if not ingest.ingest_labels(waiting, landing):
        return None
    new, changed = waiting.read(ingest.HOLDOUT).select(*columns), None
    if zones.exists(ingest.HOLDOUT):
        old = zones.read(ingest.HOLDOUT).select(*columns)
        differ = old.exceptAll(new).unionByName(new.exceptAll(old)).select("transaction_id").distinct()
        zones.write("ops.labels_changed", differ)
        changed = zones.read("ops.labels_changed")
    zones.take_over(ingest.HOLDOUT, waiting)
    return changed


def run_increment(zones: LaidOut, ctx: RunContext, landing: str, *, buckets: int = 64) -> dict[str, list[str]]:
    """Take in what is new under ``landing``; returns the folders replaced, by table.

    ``buckets`` is part of a lake's layout and stays the same for all its runs.
    """
    step = Increment(zones, ctx, buckets)
    entities = {f"bronze.{s}_{e}": f"{landing}/{s}/{e}" for s, es in ingest.SOURCES.items() for e in es}
    landed = m.together({d: (lambda d=d, f=f: batches.land(zones, d, f)) for d, f in entities.items()})
    for dataset, entries in landed.items():
        step.written[dataset] |= {f"batch={e.batch}" for e in entries}
    of = {d: sorted({e.batch for e in entries} | {t for e in entries for t in e.touches}) for d, entries in landed.items()}
    before = zones.read(ANCHOR).first()["as_of"] if zones.exists(ANCHOR) else None
    anchor_moved = before != ctx.as_of
    labels_changed = _labels(zones, landing)
    moved = step.customers(of[m.CRM]) if of[m.CRM] else None
    silver = {d: (lambda d=d: step.by_batch(d, of[d])) for d in BY_BATCH if of[d]}
    silver |= {m.ACCOUNTS: lambda: step.accounts(of[m.ACCOUNTS], moved)}
    silver |= {m.CARDS: lambda: step.cards(of[m.CARDS])} if of[m.CARDS] else {}
    # The rails write folders of one table, one after the other.
    silver |= {"rails": lambda: [step.transactions(d, of[d]) for d in RAILS if of[d]]}
    m.together(silver)
    every = set(range(buckets))
    step.present_customers(every if anchor_moved else set(step.affected))
    step.transaction_product(labels_changed, before)
    step.customer_products(every if anchor_moved else set(step.affected))
    if anchor_moved:
        zones.write(ANCHOR, zones.spark.createDataFrame([(ctx.as_of,)], "as_of date").coalesce(1))
    batches.BatchLog(zones).put([batches.Entry(**{**e.__dict__, "state": batches.APPLIED}) for es in landed.values() for e in es])
    return {d: sorted(f) for d, f in step.written.items() if f}
