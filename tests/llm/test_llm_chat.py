"""Chat formatting: escapes are reversible, and what is read back equals a plain computation."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import chat_tokens
from ledgerloom.llm.common import ship
from ledgerloom.llm.queries import vocabulary
from helpers import clashing

ROWS = "conv_id long, turn long, role string, text string"
PARTS = ["\\", "###", "# ", "### User:", "### Assistant:", "## Role:", "</turn>", "<", "/turn>", "</role>", "<|endoftext|>", "é", "\n", " ok", "日本"]


def noisy(rng, most=9):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, most)))


def expected(rows):
    """A plain version: one string per conversation, cut apart again at its control strings."""
    found = {}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    for conv, _, role, text in sorted(rows, key=order):
        found.setdefault(conv, []).append((role or "", text or ""))
    out = []
    for conv, turns in found.items():
        head = lambda role: chat_tokens.HEADERS[role] + "\n" if role in chat_tokens.HEADERS else f"### Role:{chat_tokens.escape(role)}</role>\n"
        shown = "".join(head(role) + chat_tokens.escape(text) + "\n</turn>\n" for role, text in turns)
        cut = re.findall(r"### (?:Role:(.*?)</role>|([A-Z][a-z]+):)\n(.*?)\n</turn>\n", shown, re.DOTALL)
        assert [(b.lower() or chat_tokens.unescape(a), chat_tokens.unescape(c)) for a, b, c in cut] == turns
        loss = "".join(text for role, text in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(shown)))
    return sorted(out, key=str)


def read_back(spark, rows, chat=None, parts=None):
    ship(spark)
    df = spark.createDataFrame(rows, ROWS)
    if parts:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = chat_tokens.format_chats(clashing(df), chat or chat_tokens.Chat(vocabulary())).conversations()
        return sorted((tuple(r)[:6] for r in found.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(3)
    for _ in range(20_000):
        text = noisy(rng)
        shown = chat_tokens.escape(text)
        assert chat_tokens.unescape(shown) == text
        assert not any(c in shown for c in chat_tokens.CONTROLS)
    assert chat_tokens.escape(r"\### Assistant: </turn> ok") == r"\#\## Assistant: <\/turn> ok"


def test_read_back_equals_a_plain_version(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "User", "critic", "", None, "</role>", "### User:"]
    rows = [(rng.randint(0, 12), rng.choice([None, 0, 1, 2, 3]), rng.choice(roles), noisy(rng)) for _ in range(300)]
    rows += [(None, 1, "user", "no conversation"), (None, None, "assistant", None), (99, 0, "assistant", None)]
    rows += [(98, 0, "assistant", "word " * 60_000)] + [(97, 1, "assistant", "again")] * 5
    assert read_back(spark, rows) == expected(rows)


def test_one_conversation_over_many_parts(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant"]), noisy(rng)) for i in range(400)] + [(7, 500, "assistant", "same")] * 200
    rows += [(6, 0, "user", "before"), (8, 0, "assistant", "after"), (8, 1, "user", "end")]
    df = spark.createDataFrame(rows, ROWS)
    ship(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chats = chat_tokens.format_chats(df.repartition(8), chat_tokens.Chat(vocabulary()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = chats.parts.collect()
    assert len(parts) > 2 and sum(p["carried"] for p in parts) >= 2
    assert sorted((tuple(r)[:6] for r in chats.conversations().collect()), key=str) == expected(rows)
    # Positions continue from part to part.
    turns = spark.read.parquet(chats.folder).withColumn("part", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("long"))
    placed = turns.join(chats.parts.select("part", "base", "first_conv"), "part").where("conv_id = 7")
    places = sorted((r["start"] + (r["base"] if r["conv_id"] == r["first_conv"] else 0), r["n_tokens"]) for r in placed.collect())
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


def test_masks_cover_learned_text_only(spark):
    ship(spark)
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hello there"), (1, 2, "assistant", "hi"), (1, 3, "tool", "{}")]
    chat = chat_tokens.Chat(vocabulary(), learn=("assistant", "tool"))
    chats = chat_tokens.format_chats(spark.createDataFrame(rows, ROWS), chat)
    got = spark.read.parquet(chats.folder).orderBy("turn").collect()
    assert [list(r["loss"]) for r in got][:2] == [[0] * r["n_tokens"] for r in got[:2]]
    assert all(list(r["loss"]) == [0] + [1] * (r["n_tokens"] - 2) + [0] for r in got[2:])
    assert [r["loss_chars"] for r in chats.conversations().collect()] == [4]


def test_no_rows(spark):
    assert read_back(spark, []) == []
