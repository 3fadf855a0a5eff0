"""The given tables seen as the bank's source extracts.

Each extract is derived from whole tables by joins, groupings and projections, so the
work of every query below grows with the data.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.context import RunContext
from ledgerloom.functions import bands
from ledgerloom.operators import conform, products
from ledgerloom.operators.snapshots import latest_per_key
from ledgerloom.session import materialise

AS_OF = date(2024, 1, 30)
ACCOUNT_TYPES = {
    "1-URGENT": "CURRENT", "2-HIGH": "SALARY", "3-MEDIUM": "SAVINGS", "4-NOT SPECIFIED": "FIXED_DEPOSIT",
    "5-LOW": "RECURRING_DEPOSIT",
}
LOAN_PRODUCTS = {
    "1-URGENT": "BUSINESS", "2-HIGH": "HOME", "3-MEDIUM": "AUTO", "4-NOT SPECIFIED": "PERSONAL", "5-LOW": "GOLD",
}
CORE_CHANNELS = {
    "1-URGENT": "ATM", "2-HIGH": "BRANCH", "3-MEDIUM": "CHEQUE", "4-NOT SPECIFIED": "INTERNAL_TRANSFER",
    "5-LOW": "STANDING_INSTRUCTION",
}
CARD_CHANNELS = {
    "purchase": "POS", "click": "ECOM", "view": "CONTACTLESS", "signup": "INTERNATIONAL", "error": "ECOM",
}
PAYMENT_CHANNELS = {"A": "UPI", "N": "NEFT", "R": "IMPS"}
PREFERRED_CHANNELS = {"AFRICA": "MOBILE_APP", "AMERICA": "INTERNET_BANKING", "ASIA": "BRANCH"}
FRAUD_METHODS = {"purchase": "GEO_JUMP", "click": "MICRO_THEN_MACRO", "error": "CARD_NOT_PRESENT_BURST"}


def mapped(column: str, values: dict[str, str], otherwise: str | None = None) -> Column:
    chain = F
    for key, value in values.items():
        chain = chain.when(F.col(column) == key, value)
    return chain.otherwise(otherwise) if otherwise is not None else chain


def coded(prefix: str, *columns: str) -> Column:
    parts = [F.lit(prefix), F.col(columns[0]).cast("string")]
    for name in columns[1:]:
        parts += [F.lit("-"), F.col(name).cast("string")]
    return F.concat(*parts)


def month_id(column: str) -> Column:
    # Truncating and casting a date is far cheaper per row than a format pattern.
    return F.trunc(column, "MM").cast("string")


class Tables:
    """One folder of the given tables; every property is a lazy plan."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self.ctx = RunContext(AS_OF)

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- bronze --------------------------------------------------------------
    @cached_property
    def places(self) -> DataFrame:
        return self["nation"].join(self["region"], F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def crm(self) -> DataFrame:
        """The last order of each customer and month as that month's CRM snapshot."""
        orders = self["orders"].select(
            "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus",
            month_id("o_orderdate").alias("_batch_id"),
        )
        monthly = latest_per_key(orders, ["o_custkey", "_batch_id"], ["o_orderdate", "o_orderkey"])
        people = self["customer"].join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
        in_debt = F.col("c_acctbal") < 0
        return monthly.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
            coded("C", "c_custkey").alias("customer_id"),
            F.when(
                (F.col("c_mktsegment") == "MACHINERY") & (F.col("o_orderpriority") == "5-LOW"), F.lit(None)
            ).otherwise(F.col("r_name")).alias("region"),
            F.col("n_name").alias("state_code"),
            F.col("o_orderpriority").alias("city"),
            coded("P", "n_nationkey").alias("pincode"),
            F.col("c_mktsegment").alias("marketing_segment"),
            F.col("o_orderstatus").alias("kyc_status"),
            mapped("r_name", PREFERRED_CHANNELS, "ATM").alias("preferred_channel"),
            F.to_date("o_orderdate").alias("onboarded_date"),
            coded("RM", "n_nationkey").alias("relationship_manager_id"),
            F.when(~(in_debt & (F.col("c_mktsegment") == "HOUSEHOLD")), F.abs("c_acctbal") * 120).alias("annual_income"),
            F.when(
                ~in_debt, F.date_add(F.lit(date(1935, 1, 1)), ((F.col("c_custkey") * 733) % 25000).cast("int"))
            ).alias("date_of_birth"),
            "_batch_id",
        )

    @cached_property
    def months(self) -> DataFrame:
        """Line items per order and shipping month, with the order's own columns.

        Accounts and loans are two projections of this roll-up; it is written once, so that
        line items meet their orders once. Joined before it is grouped: the exchange on the
        order key serves both. Flags are folded as codes and booleans, which keeps the
        aggregate hash-based.
        """
        sites = self["supplier"].join(self["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select(
            "s_suppkey", F.col("n_regionkey").alias("site_regionkey")
        )
        lines = self["lineitem"].join(sites, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        price = F.col("l_extendedprice")
        orders = self["orders"].select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
        measures = {
            "suppkey": F.max("l_suppkey"),
            "all_closed": F.bool_and(F.col("l_linestatus") == "F"),
            "returnflag": F.max(F.ascii("l_returnflag")),
            "discount": F.max("l_discount"),
            "linenumber": F.max("l_linenumber"),
            "shipdate": F.max("l_shipdate"),
            "quantity": F.sum("l_quantity"),
            "price": F.sum(price),
            "net": F.sum(F.when(F.col("l_returnflag") == "R", -price).otherwise(price)),
            "site_regionkey": F.max(F.when(F.col("l_discount") > 0, F.col("site_regionkey"))),
        }
        return materialise(
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(*orders.columns, F.trunc("l_shipdate", "MM").alias("month"))
            .agg(*[column.alias(name) for name, column in measures.items()])
            .withColumns({"returnflag": F.char("returnflag"), "_batch_id": F.col("month").cast("string")})
        )

    @cached_property
    def accounts(self) -> DataFrame:
        regions = self["region"].select(F.col("r_regionkey").alias("site_regionkey"), F.col("r_name").alias("branch_region"))
        return self.months.join(regions, "site_regionkey", "left").select(
            coded("A", "o_orderkey").alias("account_id"),
            coded("C", "o_custkey").alias("customer_id"),
            mapped("o_orderpriority", ACCOUNT_TYPES).alias("account_type"),
            coded("B", "suppkey").alias("branch_id"),
            "branch_region",
            F.lit("INR").alias("currency"),
            F.to_date("o_orderdate").alias("open_date"),
            F.when(F.col("all_closed"), "DORMANT").otherwise("ACTIVE").alias("status"),
            F.round("net", 2).alias("balance"),
            (F.col("quantity") * 100).alias("overdraft_limit"),
            F.col("discount").alias("interest_rate"),
            "_batch_id",
        )

    @cached_property
    def loans(self) -> DataFrame:
        lateness = F.greatest(F.lit(0), F.date_diff("shipdate", "o_orderdate")) % 121
        base = self.months.withColumns(
            {
                "interest_rate": F.round(F.col("discount") * 100, 2),
                "tenor_months": (F.col("linenumber") + 1).cast("long") * 12,
            }
        )
        return base.select(
            coded("L", "o_orderkey").alias("loan_id"),
            coded("C", "o_custkey").alias("customer_id"),
            mapped("o_orderpriority", LOAN_PRODUCTS).alias("product"),
            F.col("o_totalprice").alias("principal"),
            "interest_rate",
            "tenor_months",
            bands.emi(F.col("o_totalprice"), F.col("interest_rate"), F.col("tenor_months")).alias("emi_amount"),
            F.to_date("o_orderdate").alias("disbursed_date"),
            F.round(F.greatest(F.lit(0.0), F.col("o_totalprice") - F.col("price")), 2).alias("outstanding_principal"),
            lateness.cast("long").alias("dpd"),
            F.when(F.col("all_closed"), "CLOSED").otherwise("ACTIVE").alias("status"),
            F.col("returnflag").alias("collateral_type"),
            F.round("price", 2).alias("collateral_value"),
            "_batch_id",
        )

    @cached_property
    def repayments(self) -> DataFrame:
        lines = self["lineitem"].join(self["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        due = F.date_add(F.to_date("o_orderdate"), 30)
        price = F.col("l_extendedprice")
        return lines.select(
            coded("R", "l_orderkey", "l_linenumber").alias("repayment_id"),
            coded("L", "l_orderkey").alias("loan_id"),
            coded("C", "o_custkey").alias("customer_id"),
            due.alias("due_date"),
            F.to_date("l_shipdate").alias("paid_date"),
            price.alias("amount_due"),
            F.when(F.col("l_returnflag") == "R", price - F.col("l_quantity")).otherwise(price).alias("amount_paid"),
            (F.greatest(F.lit(0), F.date_diff(F.to_date("l_shipdate"), due)) % 61).cast("long").alias("dpd_at_payment"),
            month_id("l_shipdate").alias("_batch_id"),
        )

    @cached_property
    def bureau(self) -> DataFrame:
        """Orders per customer and month as bureau records."""
        month_no = F.year("o_orderdate") * 12 + F.month("o_orderdate")
        counted = (
            self["orders"]
            .groupBy("o_custkey", month_no.alias("month_no"), month_id("o_orderdate").alias("_batch_id"))
            .agg(
                F.max("o_totalprice").alias("peak"),
                F.sum("o_totalprice").alias("exposure"),
                F.count(F.lit(1)).alias("enquiries_6m"),
                F.count_if(F.col("o_orderstatus") == "F").alias("delinquencies_24m"),
                F.count_if(F.col("o_orderstatus") == "O").alias("active_tradelines"),
            )
        )
        return counted.select(
            coded("B", "o_custkey", "_batch_id").alias("bureau_id"),
            coded("C", "o_custkey").alias("customer_id"),
            (F.floor("peak") % 601 + 300).cast("long").alias("credit_score"),
            "enquiries_6m",
            "delinquencies_24m",
            (F.col("month_no") - 23_900).cast("long").alias("credit_vintage_months"),
            F.round("exposure", 2).alias("total_exposure"),
            "active_tradelines",
            F.to_date("_batch_id").alias("as_of_date"),
            "_batch_id",
        )

    @cached_property
    def cards(self) -> DataFrame:
        """One card per user, observed once a day."""
        daily = self["events"].groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("_batch_id")).agg(
            F.count(F.lit(1)).alias("n"),
            F.max("event_type").alias("kind"),
            F.max("value").alias("peak"),
            F.min(F.to_date("ts")).alias("day"),
        )
        return daily.select(
            coded("K", "user_id").alias("card_id"),
            coded("C", "user_id").alias("customer_id"),
            F.when(F.col("kind") == "view", "CREDIT").otherwise("DEBIT").alias("card_type"),
            F.upper("kind").alias("network"),
            coded("XXXX", "user_id").alias("masked_number"),
            (F.col("peak") * 100).alias("credit_limit"),
            F.col("day").alias("issue_date"),
            F.date_add("day", 1095).alias("expiry_date"),
            F.when(F.col("n") >= 2, "ACTIVE").otherwise("BLOCKED").alias("status"),
            "_batch_id",
        )

    @cached_property
    def core_transactions(self) -> DataFrame:
        return self["orders"].select(
            coded("O", "o_orderkey").alias("transaction_id"),
            coded("C", "o_custkey").alias("customer_id"),
            coded("A", "o_orderkey").alias("account_id"),
            F.col("o_orderdate").alias("transaction_ts"),
            F.col("o_totalprice").alias("amount"),
            F.lit("INR").alias("currency"),
            F.when(F.col("o_orderstatus") == "F", "DEBIT").otherwise("CREDIT").alias("debit_credit"),
            mapped("o_orderpriority", CORE_CHANNELS).alias("channel"),
            F.col("o_orderpriority").alias("narration"),
            month_id("o_orderdate").alias("_batch_id"),
        )

    @staticmethod
    def card_shape(events: DataFrame) -> DataFrame:
        """Events as card transactions; also applied to a stream of events."""
        kind = F.col("event_type")
        return events.select(
            coded("E", "event_id").alias("transaction_id"),
            coded("C", "user_id").alias("customer_id"),
            coded("K", "user_id").alias("card_id"),
            F.col("ts").alias("transaction_ts"),
            F.col("value").alias("amount"),
            F.when(kind == "signup", "USD").otherwise("INR").alias("currency"),
            F.when(kind == "error", "CREDIT").otherwise("DEBIT").alias("debit_credit"),
            mapped("event_type", CARD_CHANNELS).alias("channel"),
            F.concat(F.lit("M"), F.regexp_extract("props", "[0-9]+", 0)).alias("merchant_id"),
            kind.alias("merchant_category"),
            F.when(kind == "signup", "SGP").otherwise("IND").alias("merchant_country"),
            F.when(kind == "signup", True).when(kind != "view", False).alias("is_international"),
            coded("D", "user_id").alias("device_id"),
            month_id("ts").alias("_batch_id"),
        )

    @cached_property
    def card_transactions(self) -> DataFrame:
        return self.card_shape(self["events"])

    @cached_property
    def payment_transactions(self) -> DataFrame:
        """One payment per line item; ids repeat, and the largest quantity has none."""
        lines = self["lineitem"].join(self["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.select(
            F.when(F.col("l_quantity") < 50, coded("P", "l_orderkey", "l_linenumber")).alias("transaction_id"),
            coded("C", "o_custkey").alias("customer_id"),
            coded("A", "l_orderkey").alias("account_id"),
            F.col("l_shipdate").alias("transaction_ts"),
            F.col("l_extendedprice").alias("amount"),
            F.lit("INR").alias("currency"),
            F.when(F.col("l_linestatus") == "F", "DEBIT").otherwise("CREDIT").alias("debit_credit"),
            mapped("l_returnflag", PAYMENT_CHANNELS).alias("channel"),
            F.col("l_returnflag").alias("narration"),
            month_id("l_shipdate").alias("_batch_id"),
        )

    @cached_property
    def labels(self) -> DataFrame:
        """Error, click and purchase events confirmed as fraud ten days later."""
        return self["events"].filter(F.col("event_type").isin(*FRAUD_METHODS)).select(
            coded("E", "event_id").alias("transaction_id"),
            F.lit(True).alias("is_fraud"),
            mapped("event_type", FRAUD_METHODS).alias("fraud_method"),
            coded("C", "user_id").alias("customer_id"),
            F.date_add(F.to_date("ts"), 10).alias("label_available_date"),
        )

    # -- silver and gold -----------------------------------------------------
    @cached_property
    def s_customers(self) -> DataFrame:
        # The extract already holds one row per customer and month.
        return conform.silver_customers(self.crm, self.ctx, collapse=False)

    @cached_property
    def s_accounts(self) -> DataFrame:
        return conform.silver_accounts(self.accounts, self.crm)

    @cached_property
    def s_loans(self) -> DataFrame:
        return conform.silver_loans(self.loans)

    @cached_property
    def s_credit(self) -> DataFrame:
        return conform.silver_credit_records(self.bureau)

    @cached_property
    def s_transactions(self) -> DataFrame:
        return conform.silver_transactions(self.core_transactions, self.card_transactions, self.payment_transactions)

    @cached_property
    def customer_360(self) -> DataFrame:
        if not {"s_customers", "s_accounts"} & vars(self).keys():
            self.crm = materialise(self.crm)  # versions and residences come from the same snapshots
        return products.customer_360(
            self.s_customers, self.s_accounts, self.s_loans, self.s_transactions, self.s_credit, self.ctx
        )

    @cached_property
    def transaction(self) -> DataFrame:
        return products.transaction_product(self.s_transactions, self.labels, self.ctx)

    @cached_property
    def credit_risk(self) -> DataFrame:
        return products.credit_risk(self.s_customers, self.s_loans, self.s_credit, self.ctx)
