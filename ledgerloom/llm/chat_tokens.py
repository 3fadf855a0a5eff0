"""Chat formatting at token level: conversations to token ids with a loss mask, and back.

A turn is a few segments: a header, for roles without a header of their own the role's name, the text, and an end. The
text segments are encoded each by itself; headers and ends are reserved ids above the vocabulary, spliced between them,
so that no token spans a border and no text can produce a reserved id. The loss mask of a batch comes from prefix sums:
+1 where a learned segment starts, -1 where it ends. In the formatted text a reserved id stands for a control string
(``### User:``, ``</turn>`` ...). A control string inside a text gets a backslash after its first character, and one that
already has backslashes there gets one more: no control string is left in any text, and taking one backslash away again
gives the text back, whatever it was.

Output: a folder of Parquet parts, one row per turn in order (conversation, turn, role, text hash), and a table of the
parts. Rows are dealt by range of that order, so a conversation that holds a third of all rows spreads over many parts;
positions in such a conversation continue from part to part by prefix sums over the parts' totals. A part is streamed
and appears when complete, so a task that runs again replaces it. Reading back takes one task per part, which follows
its last conversation into the next parts; SHA-256 is sequential, so that streaming pass is the only step that one
conversation cannot share among tasks, and it holds one turn at a time.

Defined results. Null text or role: empty. Null conversation ids form one conversation, first in order; null turns come
first within theirs. Ties in the turn are ordered by role and MD5 of the text; repeated rows are repeated turns. Empty
texts keep header and end. Very long texts are encoded in pieces (see ``token_files``). An empty table gives no part and
no row. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import SharedFile, filesystem, shared_folder, store, values
from ledgerloom.llm.token_files import Encoder

#: Roles with a header of their own; any other role is written out after ``OTHER``.
HEADERS = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:", "tool": "### Tool:"}
OTHER, NAME_END, END = "### Role:", "</role>", "</turn>"
CONTROLS = (*HEADERS.values(), OTHER, NAME_END, END, "<|endoftext|>")
#: Reserved ids in this order above the vocabulary, and how they look in the formatted text.
RENDERED = (*(h + "\n" for h in HEADERS.values()), OTHER, NAME_END + "\n", "\n" + END + "\n")
ROLES = list(HEADERS)

BEFORE, AFTER = "", ""
for first in sorted({c[0] for c in CONTROLS}):
    rest = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)
    BEFORE += f"|{first}(?=\\\\*(?:{rest}))"
    AFTER += f"|(?<={first})\\\\(?=\\\\*(?:{rest}))"
TO_ESCAPE, ESCAPED = re.compile(BEFORE[1:]), re.compile(AFTER[1:])


def escape(text: str) -> str:
    return TO_ESCAPE.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub("", text)


@dataclass(frozen=True)
class Chat:
    vocabulary: str
    #: Roles whose texts are learned.
    learn: tuple[str, ...] = ("assistant",)


class Template:
    """Encoder, reserved ids and id width of one vocabulary."""

    loaded: dict[str, Template] = {}

    @classmethod
    def of(cls, path: str) -> Template:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str) -> None:
        self.encoder = Encoder.of(path)
        self.base = self.encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if self.base + len(RENDERED) <= 1 << 16 else "<u4"
        self.mark = {text: np.array([self.base + i], self.dtype).tobytes() for i, text in enumerate(RENDERED)}
        self.other, self.name_end, self.end = (self.base + RENDERED.index(t) for t in RENDERED[-3:])

    def ids(self, text: str) -> bytes:
        found = self.encoder.encode(escape(text))
        return found if self.encoder.dtype == self.dtype else np.frombuffer(found, self.encoder.dtype).astype(self.dtype).tobytes()

    def segments(self, role: str, text: str, learn: frozenset[str]) -> list[tuple[bytes, int]]:
        """Ids of each segment of a turn, with 1 for those that are learned."""
        head = HEADERS.get(role)
        body = [(self.ids(text), int(role in learn)), (self.mark[RENDERED[-1]], 0)]
        if head:
            return [(self.mark[head + "\n"], 0), *body]
        return [(self.mark[OTHER], 0), (self.ids(role), 0), (self.mark[NAME_END + "\n"], 0), *body]

    def text(self, ids: np.ndarray) -> str:
        return self.encoder.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def turn(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """(role, text, learned text, formatted length) of one turn, from its ids and mask alone."""
        head, start, shown, role = int(ids[0]), 1, 0, None
        if head == self.other:
            start = int(np.flatnonzero(ids == self.name_end)[0]) + 1
            name = self.text(ids[1 : start - 1])
            role, shown = unescape(name), len(name) + len(RENDERED[-2])
        else:
            role = ROLES[head - self.base]
        if ids[-1] != self.end or (ids[start:-1] >= self.base).any():
            raise ValueError("a turn must end with its end id and hold no reserved id in its text")
        body = self.text(ids[start:-1])
        learned = ids[np.flatnonzero(mask)]
        return role, unescape(body), unescape(self.text(learned)), len(RENDERED[head - self.base]) + shown + len(body) + len(RENDERED[-1])


@dataclass(frozen=True)
class ChatSet:
    folder: str
    parts: DataFrame
    chat: Chat

    def conversations(self) -> DataFrame:
        return read_conversations(self)


TURN = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("loss", pa.binary())]
)
PART = "part long, path string, turns long, tokens long, first_conv long, last_conv long, tail long"


def _path(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.parquet"


def format_chats(rows: DataFrame, chat: Chat, folder: str | None = None) -> ChatSet:
    """Write every row of ``rows`` (conv_id, turn, role, text); ``start`` of a turn counts from its part's first turn of the conversation."""
    folder = folder or shared_folder(rows.sparkSession, "chats")
    picked = rows.select(
        rows["conv_id"].cast("long").alias("conv_id"),
        rows["turn"].cast("long").alias("turn"),
        F.coalesce(rows["role"], F.lit("")).alias("role"),
        F.coalesce(rows["text"], F.lit("")).alias("text"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.md5("text")]
    # Equal rows are interchangeable; their place of origin only spreads them.
    dealt = picked.withColumn("origin", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("origin"))
    dealt = dealt.sortWithinPartitions(*order).drop("origin")
    learn = frozenset(chat.learn)

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, part, file, writer = Template.of(chat.vocabulary), TaskContext.get().partitionId(), None, None
        width = np.dtype(template.dtype).itemsize
        turns = tokens = tail = 0
        first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            convs = values(batch, "conv_id")
            if file is None:
                file, first, last = SharedFile(folder, f"part-{part:06d}.parquet"), convs[0], convs[0]
                writer = pq.ParquetWriter(file.stream, TURN, compression="zstd")
            pieces, edges = [], [0]
            for role, text in zip(values(batch, "role"), values(batch, "text")):
                pieces += template.segments(role, text, learn)
                edges.append(len(pieces))
            ends = np.cumsum([0, *(len(p) // width for p, _ in pieces)])
            marked = np.array([m for _, m in pieces], np.int64)
            steps = np.zeros(ends[-1] + 1, np.int64)
            np.add.at(steps, ends[:-1], marked)
            np.add.at(steps, ends[1:], -marked)
            mask, ids, bounds = np.cumsum(steps).astype(np.uint8).tobytes(), b"".join(p for p, _ in pieces), ends[edges]
            lengths, starts = np.diff(bounds).tolist(), []
            for conv, length in zip(convs, lengths):
                tail = tail if conv == last else 0
                last = conv
                starts.append(tail)
                tail += length
            cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            writer.write_batch(
                pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([ids[a * width : b * width] for a, b in cut], pa.binary()),
                        pa.array([mask[a:b] for a, b in cut], pa.binary()),
                    ],
                    schema=TURN,
                )
            )
            turns, tokens = turns + batch.num_rows, tokens + int(bounds[-1])
        if file is not None:
            writer.close()
            file.close()
            row = [part, _path(folder, part), turns, tokens, first, last, tail]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [f.split()[0] for f in PART.split(", ")])

    return ChatSet(folder, with_bases(store(dealt.mapInArrow(written, PART), "chat-parts")), chat)


def with_bases(parts: DataFrame) -> DataFrame:
    """Adds ``carried`` (the part begins inside a conversation) and ``base`` (that conversation's tokens in earlier parts)."""
    ends = parts.select(F.col("last_conv").alias("conv"), "part", F.lit(1).alias("kind"), "tail")
    asked = parts.select(F.col("first_conv").alias("conv"), "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tail"))
    so_far = Window.partitionBy("conv").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    both = ends.unionByName(asked).select("part", "kind", F.sum("tail").over(so_far).alias("base"))
    bases = both.where("kind = 0").select("part", F.coalesce("base", F.lit(0)).alias("base"))
    return store(parts.join(bases, "part").withColumn("carried", F.col("base") > 0), "chat-bases", 0)


class Digest:
    """Running figures of one conversation."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.chars, self.shown, self.tokens = conv, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, template: Template, ids: bytes, mask: bytes) -> None:
        found = np.frombuffer(ids, template.dtype)
        role, text, learned, shown = template.turn(found, np.frombuffer(mask, np.uint8))
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(learned.encode())
        self.turns, self.chars, self.shown, self.tokens = self.turns + 1, self.chars + len(learned), self.shown + shown, self.tokens + len(found)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.chars, self.loss.hexdigest(), self.shown, self.tokens


RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
KINDS = {"long": pa.int64(), "string": pa.string()}


def read_conversations(chats: ChatSet) -> DataFrame:
    """One row per conversation, from the parts alone."""
    folder, vocabulary = chats.folder, chats.chat.vocabulary
    count, last = chats.parts.agg(F.count(F.lit(1)), F.max("part")).first()
    names, kinds = zip(*(f.split() for f in RESULT.split(", ")))

    def turns(part: int) -> Iterator[tuple]:
        where, name = filesystem(_path(folder, part))
        with where.open_input_file(name) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(256, columns=["conv_id", "ids", "loss"]):
                yield from zip(*(values(batch, c) for c in ("conv_id", "ids", "loss")))

    def exists(part: int) -> bool:
        where, name = filesystem(_path(folder, part))
        return where.get_file_info(name).is_file

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template.of(vocabulary)
        for batch in batches:
            for part in batch.to_pylist():
                done, now, skipping = [], None, part["carried"]
                for conv, ids, mask in turns(part["part"]):
                    if skipping and conv == part["first_conv"]:
                        continue
                    skipping = False
                    if now is None or conv != now.conv:
                        done += [now.row()] if now else []
                        now = Digest(conv)
                    now.add(template, ids, mask)
                    if len(done) >= 2_000:
                        yield packed(done)
                        done = []
                following = part["part"] + 1
                while now is not None and following <= last:  # the last conversation may go on
                    if exists(following):
                        ended = False
                        for conv, ids, mask in turns(following):
                            if conv != now.conv:
                                ended = True
                                break
                            now.add(template, ids, mask)
                        if ended:
                            break
                    following += 1
                yield packed(done + ([now.row()] if now else []))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), KINDS[k]) for c, k in zip(columns, kinds)], list(names))

    return chats.parts.select("part", "carried", "first_conv").repartition(max(1, count)).mapInArrow(read, RESULT)
