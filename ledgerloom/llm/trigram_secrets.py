"""Secret scans with a trigram inverted index; DataFrame functions only.

From every rule's regular expression a Boolean query over lower-cased trigrams is derived: what must be in a text for
the rule to match at all. The index holds posting lists for the trigrams that the rules can ask about: rows are dealt
to blocks by a hash, about ``BLOCK_ROWS`` to a block, and a posting list names the rows of one block that contain the
trigram, so the number of blocks grows with the table and no list does. Queries intersect and unite posting lists block by block; only the candidate texts are matched against
the rule. A rule without mandatory trigrams is matched against every text.

A row is named by the hash of its text, so copies share their postings; rows whose hashes happen to collide share
candidates, which verification sorts out. Texts are shuffled once, to meet their candidate rules.

Spans are code-point positions ``[start, end)`` of leftmost non-overlapping matches of each rule; a match whose checked
group is too short is dropped after matching, as it still uses up its text. Null texts count as empty and have none.
Texts are matched whole, whatever their length. Repeated rows give a row each; matches of several rules at one start are
ordered by rule. An empty table gives an empty result. Extra columns may be called anything.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from re import _constants as tokens
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length is tested (0: the whole match), and its least number of characters.
    group: int = 0
    least: int = 1
    base: bool = False


#: The base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),  # runs are maximal, so this equals [0-9a-f]+ with 32 or more
)
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

MOST_STRINGS = 12
#: A query is a conjunction of clauses; a clause is a disjunction of trigram sets that must all be present.
Clause = tuple[tuple[str, ...], ...]


def strings_of(node: Iterable) -> set[str] | None:
    """All strings that a parsed expression matches, lower-cased, or None if they are many or unbounded."""
    found = {""}
    for op, arg in node:
        if op is tokens.LITERAL:
            more = {chr(arg).lower()}
        elif op is tokens.IN:
            if any(kind is not tokens.LITERAL for kind, _ in arg):
                return None
            more = {chr(code).lower() for _, code in arg}
        elif op is tokens.SUBPATTERN:
            more = strings_of(arg[3])
        elif op is tokens.BRANCH:
            each = [strings_of(branch) for branch in arg[1]]
            more = None if None in each else set().union(*each)
        elif op is tokens.MAX_REPEAT and arg[1] == 1:
            inner = strings_of(arg[2])
            more = None if inner is None else inner | ({""} if arg[0] == 0 else set())
        else:
            return None
        if more is None:
            return None
        found = {a + b for a in found for b in more}
        if len(found) > MOST_STRINGS:
            return None
    return found


def trigrams(text: str) -> tuple[str, ...]:
    return tuple(sorted({text[i : i + 3] for i in range(len(text) - 2)}))


def trigram_query(pattern: str) -> list[Clause]:
    """The clauses that every match of ``pattern`` satisfies; empty if nothing is mandatory."""
    clauses: list[Clause] = []

    def close(strings: set[str]) -> None:
        if all(len(s) >= 3 for s in strings):
            clauses.append(tuple(sorted({trigrams(s) for s in strings})))

    def walk(node: Iterable) -> None:
        held = {""}
        for item in node:
            more = strings_of([item])
            joined = None if more is None else {a + b for a in held for b in more}
            if joined is not None and len(joined) <= MOST_STRINGS:
                held = joined
                continue
            close(held)
            held = {""} if more is None else more
            if more is None and item[0] is tokens.SUBPATTERN:
                walk(item[1][3])
            elif more is None and item[0] is tokens.MAX_REPEAT and item[1][0] > 0:
                walk(item[1][2])
        close(held)

    walk(parser.parse(pattern))
    return clauses


#: Rows of an index block, about; copies of a text count once.
BLOCK_ROWS = 2_000


def blocks_for(rows: DataFrame) -> int:
    return 1 + rows.count() // BLOCK_ROWS


def build_index(rows: DataFrame, vocabulary: list[str], blocks: int) -> DataFrame:
    """``rows`` (row, text) to posting lists (block, trigram, rows)."""
    asked = F.array(*[F.lit(t) for t in vocabulary])
    lowered = rows.select("row", F.lower("text").alias("low"))
    held = lowered.select("row", F.explode(F.filter(asked, lambda t: F.contains(F.col("low"), t))).alias("trigram"))
    return held.groupBy(F.pmod("row", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("row").alias("rows"))


def candidates(index: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(row, rules): the names of the rules whose trigram query a row satisfies."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def all_of(terms: tuple[str, ...]) -> Column:
        return reduce(F.array_intersect, [F.coalesce(F.try_element_at("lists", F.lit(t)), none) for t in terms])

    answers = [
        F.struct(
            F.lit(rule.kind).alias("rule"),
            reduce(F.array_intersect, [reduce(F.array_union, [all_of(t) for t in clause]) for clause in query]).alias("rows"),
        )
        for rule in rules
        if (query := trigram_query(rule.pattern))
    ]
    if not answers:
        return lists.select(F.lit(0).cast("long").alias("row"), F.array(F.lit("")).alias("rules")).where("false")
    found = lists.select(F.inline(F.array(*answers))).select("rule", F.explode("rows").alias("row"))
    return found.groupBy("row").agg(F.collect_set("rule").alias("rules"))


#: Matches placed together; only the time of texts with very many matches depends on it.
GROUP = 256


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, place, end) of one rule. Between the matches lie the pieces of a split by the same pattern.

    An array that grows by one is copied each time, so matches are placed in groups of ``GROUP`` relative to the group's
    start, groups are placed after each other, and the pieces are joined once."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), F.char_length)
    steps = F.arrays_zip(pieces.alias("gap"), F.transform(whole, F.char_length).alias("size"), F.transform(tested, F.char_length).alias("tested"))
    kind = "array<struct<start:int,place:int,end:int>>"

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        end = start + step["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"))).cast(kind)
        spans = F.when(step["tested"] >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def placed(base: Column, group: Column) -> Column:
        begin = F.struct(base.alias("at"), F.array().cast(kind).alias("spans"))
        return F.aggregate(group, begin, add, lambda state: state["spans"])

    def length(group: Column) -> Column:
        return F.aggregate(group, F.lit(0), lambda at, step: at + step["gap"] + step["size"])

    def ends(groups: Column) -> Column:
        return F.aggregate(groups, F.array(F.lit(0)), lambda at, group: F.concat(at, F.array(F.element_at(at, -1) + length(group))))

    def grouped(held: Column) -> Column:
        count = F.ceil(F.size(held) / GROUP).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(held, (i - 1) * GROUP + 1, GROUP))

    def joined(groups: Column) -> Column:
        return F.flatten(F.zip_with(F.slice(ends(groups), F.lit(1), F.size(groups)), groups, placed))

    # a lambda variable is evaluated once, an expression at each use
    found = F.element_at(F.transform(F.transform(F.array(steps), grouped), joined), 1)
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: key and ``found``, its spans (start, place of the rule in ``rules``, end) in order
    of start, then rule."""
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("id"), body.alias("text"), F.xxhash64(body).alias("row"))
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    vocabulary = sorted({t for query in queries.values() for clause in query for terms in clause for t in terms})
    if blocks is None:
        blocks = blocks_for(docs)
    asked = candidates(build_index(rows, vocabulary, blocks), rules)
    met = rows.join(asked, "row", "left")
    every = [
        rule_spans(F.col("text"), rule, place)
        if not queries[rule.kind]
        else F.when(F.array_contains("rules", rule.kind), rule_spans(F.col("text"), rule, place)).otherwise(F.array())
        for place, rule in enumerate(rules)
    ]
    return met.select(F.col("id").alias(key), F.array_sort(F.concat(*every)).alias("found"))


def spelled(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: key, counts of the base kinds, digest of the base spans, and all spans."""
    found = scan(docs, key, text, rules)
    base = [place for place, rule in enumerate(rules) if rule.base]
    only = F.filter("found", lambda s: s["place"].isin(base))

    def counted(place: int) -> Column:
        return F.size(F.filter("found", lambda s: s["place"] == place)).cast("long").alias(f"n_{rules[place].kind}")

    counts = [counted(place) for place in base]
    return found.select(
        key, *counts, F.sha2(spelled(only, rules).cast("binary"), 256).alias("base_sha256"), spelled(F.col("found"), rules).alias("spans")
    )
