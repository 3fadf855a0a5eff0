"""Use-policy verdicts over a table of requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.plans import catalog
from ledgerloom.session import fixed_rows

_RULES = "array<struct<rule: string, name: string, words: array<string>>>"
POLICY_SCHEMA = (
    f"product: string, version: string, prohibited: {_RULES}, "
    f"columns: map<string, struct<prohibited: {_RULES}, allowed: array<string>>>"
)


def _rules(uses: Sequence[str]) -> list[dict[str, object]]:
    """Rules with their words split once, here, instead of for every request."""
    names = [text.use_label(use) for use in uses]
    return [
        {"rule": use, "name": name, "words": sorted({w for w in name.split("_") if w})}
        for use, name in zip(uses, names, strict=True)
    ]


def policy_table(
    spark: SparkSession, contracts: Mapping[str, catalog.Contract] | None = None
) -> DataFrame:
    """One row per product, its columns' rules nested in a map (bounded by the contracts)."""
    contracts = catalog.CONTRACTS if contracts is None else contracts
    rows = [
        {
            "product": c.product,
            "version": c.version,
            "prohibited": _rules(c.not_allowed_use),
            "columns": {
                col.name: {
                    "prohibited": _rules(col.metadata.get("not_allowed_use", ())),
                    "allowed": [text.use_label(use) for use in col.metadata.get("allowed_use", ())],
                }
                for col in c.schema
            },
        }
        for c in contracts.values()
    ]
    return fixed_rows(spark, rows, POLICY_SCHEMA)


def _covering_rule(rules: Column, use: Column, tokens: Column) -> Column:
    """The rule a use falls under: the same name first, else one whose words it contains."""
    same = F.filter(rules, lambda r: r["name"] == use)
    contained = F.filter(
        rules, lambda r: (F.size(r["words"]) > 0) & (F.size(F.array_except(r["words"], tokens)) == 0)
    )
    return F.coalesce(F.get(same, F.lit(0)), F.get(contained, F.lit(0)))


def verdicts(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds ``allowed`` and ``reason`` to requests of ``(product, column, use)``.

    Checked in order: prohibited for the product, unknown column, prohibited for the
    column, missing from the column's allow-list. The policy has one row per product,
    so the join keeps the requests where they are.
    """
    joined = requests.join(
        policy.select(
            "product",
            F.col("version").alias("__version"),
            F.col("prohibited").alias("__prohibited"),
            F.col("columns").alias("__columns"),
        ),
        "product",
        "left",
    )
    staged = (
        joined.withColumn("__use", text.use_name(F.col("use")))
        .withColumn("__tokens", text.use_tokens(F.col("__use")))
        .withColumn("__rule", F.try_element_at("__columns", F.col("column")))
        .withColumn("__product_hit", _covering_rule(F.col("__prohibited"), F.col("__use"), F.col("__tokens")))
        .withColumn(
            "__column_hit", _covering_rule(F.col("__rule.prohibited"), F.col("__use"), F.col("__tokens"))
        )
    )
    allow_list = F.col("__rule.allowed")
    outside = (F.size(allow_list) > 0) & ~F.array_contains(allow_list, F.col("__use"))
    source = F.concat(F.col("product"), F.lit("@"), F.col("__version"))
    quoted = F.concat(F.lit("'"), F.col("use"), F.lit("'"))
    narrower = F.when(F.col("__product_hit.name") == F.col("__use"), "").otherwise(
        F.concat(F.lit(" because it is a form of '"), F.col("__product_hit.rule"), F.lit("'"))
    )
    reason = (
        F.when(F.col("__version").isNull(), F.concat(F.lit("unknown product '"), F.col("product"), F.lit("'")))
        .when(
            F.col("__product_hit").isNotNull(),
            F.concat(
                quoted, F.lit(" is prohibited for all of "), source, narrower, F.lit(" (field not_allowed_use)")
            ),
        )
        .when(
            F.col("__rule").isNull(),
            F.concat(F.lit("column '"), F.col("column"), F.lit("' is not part of "), source),
        )
        .when(
            F.col("__column_hit").isNotNull(),
            F.concat(
                quoted, F.lit(" is prohibited for column '"), F.col("column"), F.lit("' of "), source,
                F.lit(" because it is a form of '"), F.col("__column_hit.rule"), F.lit("' (column not_allowed_use)"),
            ),
        )
        .when(
            outside,
            F.concat(
                F.lit("column '"), F.col("column"), F.lit("' of "), source, F.lit(" is restricted to "),
                F.array_join(allow_list, ", "), F.lit("; "), quoted, F.lit(" is not among them"),
            ),
        )
        .otherwise("permitted")
    )
    return staged.withColumn("reason", reason).select(
        *requests.columns, (F.col("reason") == "permitted").alias("allowed"), "reason"
    )


def check_use(spark: SparkSession, product: str, column: str, use: str) -> tuple[bool, str]:
    """A single verdict, for one request at a time."""
    name = catalog.contract(product).product
    request = spark.createDataFrame([(name, column, use)], "product string, column string, use string")
    row = verdicts(request, policy_table(spark)).first()
    return row["allowed"], row["reason"]
