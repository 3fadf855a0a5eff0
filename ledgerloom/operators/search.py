"""Ranking texts by shared words, and matching business terms to metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.plans.catalog import CONTRACTS, METRICS, Metric, metrics_of
from ledgerloom.session import fixed_rows

# Weights and thresholds of the two rankings.
NAME_BONUS = 0.4
EXACT, SYNONYM, PHRASE, NAME_TOKEN = 1.0, 0.95, 0.85, 0.6
OVERLAP_WEIGHT, TOKEN_WEIGHT, TOKEN_CAP = 0.45, 0.1, 0.3
MIN_MATCH_SCORE = 0.45
AMBIGUITY_MARGIN = 0.12


def rank_documents(documents: DataFrame, key: str, body: Column, name: Column, query: str) -> DataFrame:
    """Rows of any size of table scored against a free-text query.

    Score is the share of query words found in the body, plus a bonus when the name
    holds one. The query's words are a literal, so scoring is one narrow projection
    over the scan: no explode, no join, no shuffle before the final order.
    """
    words = text.query_words(documents.sparkSession, query)
    needle = text.word_array(words)
    matched = F.array_sort(F.array_intersect(text.search_tokens(body), needle))
    named = F.arrays_overlap(text.search_tokens(name), needle)
    score = F.size("__matched") / F.lit(max(len(words), 1)) + F.when(named, NAME_BONUS).otherwise(0.0)
    everything = F.lit(not words)
    return (
        documents.withColumn("__matched", matched)
        .withColumn("__score", score)
        .filter((F.col("__score") > 0) | everything)
        .select(
            key,
            F.col("__score").alias("score"),
            F.round(F.least(F.col("__score"), F.lit(1.0)), 3).alias("match_score"),
            F.array_join("__matched", ",").alias("matched_terms"),
        )
    )


def search_products(spark: SparkSession, query: str, limit: int | None = None) -> DataFrame:
    """The catalogue ranked for a question: best score first, ties by name."""
    rows = [
        {
            "product": c.product,
            "body": " ".join(
                [
                    c.product.replace("_", " "), c.domain, c.description, *c.schema.names,
                    *[m.name for m in metrics_of(c.product)], *c.allowed_use,
                ]
            ),
        }
        for c in CONTRACTS.values()
    ]
    entries = fixed_rows(spark, rows, "product: string, body: string")
    ranked = rank_documents(entries, "product", F.col("body"), F.col("product"), query)
    ordered = ranked.orderBy(F.col("score").desc(), "product")
    return ordered if limit is None else ordered.limit(limit)


def _registry(metrics: Sequence[Metric]) -> Column:
    """The registry as one array literal: a few dozen entries, evaluated per row."""
    return F.array(
        *[
            F.struct(
                F.lit(m.name).alias("metric"),
                F.lit(m.ref).alias("ref"),
                F.lit(text.plain_term(m.name.replace("_", " "))).alias("name"),
                F.lit(m.name.split("_")[0]).alias("first"),
                text.word_array([text.plain_term(s) for s in m.synonyms]).alias("synonyms"),
                text.word_array(text.term_words(m.definition)).alias("words"),
            )
            for m in metrics
        ]
    )


def _contained(needle: Column, entry: Column) -> Column:
    return F.contains(needle, entry["name"]) | F.exists(entry["synonyms"], lambda s: F.contains(needle, s))


def _matched_on(needle: Column, words: Column, entry: Column) -> Column:
    """What a score rests on, for readers; the words of a definition in order, at most three named."""
    common = F.array_sort(F.array_intersect(words, entry["words"]))
    return (
        F.when(needle == entry["name"], "name")
        .when(F.array_contains(entry["synonyms"], needle), "synonym")
        .when(_contained(needle, entry), "phrase_contains")
        .when(F.array_contains(words, entry["first"]), "name_token")
        .otherwise(F.concat(F.lit("definition:"), F.array_join(F.slice(common, 1, 3), ",")))
    )


def _score(needle: Column, words: Column, entry: Column) -> Column:
    common = F.size(F.array_intersect(words, entry["words"]))
    overlap = OVERLAP_WEIGHT * (common / F.greatest(F.size(words), F.lit(1))) + F.least(
        F.lit(TOKEN_CAP), TOKEN_WEIGHT * common
    )
    return (
        F.when(needle == entry["name"], EXACT)
        .when(F.array_contains(entry["synonyms"], needle), SYNONYM)
        .when(_contained(needle, entry), PHRASE)
        .when(F.array_contains(words, entry["first"]), NAME_TOKEN)
        .otherwise(F.when(common > 0, F.round(overlap, 4)).otherwise(0.0))
    )


def resolve_terms(terms: DataFrame, term: str, *, product: str | None = None) -> DataFrame:
    """Adds ``candidates``, ``status`` and ``resolved_ref`` to a table of business terms.

    A term whose two best candidates are within the margin is ambiguous and resolves to
    nothing. Everything happens inside one row, so the plan stays a narrow projection.
    """
    metrics = [m for m in METRICS.values() if product is None or m.product == product]
    needle, words = F.col("__needle"), F.col("__words")
    scored = F.transform(
        _registry(metrics),
        lambda e: F.struct(
            (-_score(needle, words, e)).alias("rank"),
            e["metric"].alias("metric"),
            e["ref"].alias("ref"),
            _matched_on(needle, words, e).alias("matched_on"),
        ),
    )
    best = F.array_sort(F.filter(scored, lambda c: c["rank"] <= -MIN_MATCH_SCORE))
    top = F.col("candidates")
    close = F.get(top, F.lit(1))["rank"] - F.get(top, F.lit(0))["rank"] <= AMBIGUITY_MARGIN
    status = (
        F.when(F.size(top) == 0, "unresolved").when((F.size(top) > 1) & close, "ambiguous").otherwise("resolved")
    )
    return (
        terms.withColumn("__needle", text.normal_term(F.col(term)))
        .withColumn("__words", text.term_tokens(needle))
        .withColumn("candidates", best)
        .withColumn("status", status)
        .withColumn("resolved_ref", F.when(F.col("status") == "resolved", F.get(top, F.lit(0))["ref"]))
        .withColumn(
            "candidates",
            F.transform(
                top,
                lambda c: F.struct(
                    c["metric"].alias("metric"), c["ref"].alias("ref"), (-c["rank"]).alias("score"), c["matched_on"].alias("matched_on")
                ),
            ),
        )
        .drop("__needle", "__words")
    )
