"""Token ids as flat binary files.

A data set is a folder of ``part-N.bin`` (unsigned 16- or 32-bit ids, little-endian, documents one after the other),
``part-N.off`` (unsigned 64-bit offsets: one more than documents, counted in ids from the start of the part) and
``part-N.doc`` (signed 64-bit document ids), with a table ``bases`` of the first document and first id of each part.
Parts are ranges of the document id; their bases are prefix sums of the counts that the writing tasks return, so any
document is found by one range look-up and read through a memory map. The width of an id follows from the vocabulary.

Texts are moved once, by range of the id (ties by text hash). A task streams its rows into its own part; the part
appears under its name when complete, so a task that runs again replaces it. The manifest that the tasks return is a
written table with one row per part; nothing else is gathered.

Encoding: a text is cut where a white-space character follows a non-space, or where a letter meets punctuation or
white space. The tokenizer's own pre-tokenisation always cuts there too, so encoding the pieces with the library and
remembering them gives the ids of the whole text, at bounded memory for very long texts. A text with other than ASCII
white space, or with the text of an added token, is encoded as a whole. Null texts count as empty and give the end id
only. Null document ids come first, as the smallest 64-bit number on disk.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import SharedFile, filesystem, shared_folder, store, values

NULL_ID = -(1 << 63)
LETTER = r"A-Za-zÀ-ÖØ-öø-ÿ"
PIECE = re.compile(
    rf"""[ \t-\r]*[{LETTER}]+(?=[ \t-\r!-/:-@\[-`{{-~]|\Z)|[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"""
)
#: White space that a tokenizer may see and the cut above does not.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
REMEMBER = 1_500_000


class Encoder(dict):
    """Remembers the ids of pieces as bytes."""

    loaded: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process and vocabulary."""
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def __missing__(self, piece: str) -> bytes:
        ids = self.whole(piece)
        if len(piece) <= 40:
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if ODD_SPACE.search(text) or any(a in text for a in self.added):
            return self.whole(text)
        if len(self) > REMEMBER:
            self.clear()
        return b"".join(map(self.__getitem__, PIECE.findall(text)))


@dataclass(frozen=True)
class TokenSet:
    folder: str
    bases: DataFrame

    def documents(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files in one task per part."""
        return read_documents(self.bases)


def write_tokens(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 2, folder: str | None = None
) -> TokenSet:
    """Write the ids of all rows of ``docs`` (integer key) in ascending order of the key."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    picked = docs.select(docs[key].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    dealt = picked.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.xxhash64("text")
    )

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, files = Encoder.of(vocabulary), TaskContext.get().partitionId(), None
        end, total, count = np.array([end_id], encoder.dtype).tobytes(), 0, 0
        width = len(end)
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = [SharedFile(folder, f"part-{part:06d}.{kind}") for kind in ("bin", "off", "doc")]
                files[1].write(np.zeros(1, "<u8").tobytes())
            bodies = [encoder.encode(t) + end for t in values(batch, "text")]
            lengths = np.fromiter(map(len, bodies), np.uint64, len(bodies)) // width
            offsets = total + np.cumsum(lengths, dtype=np.uint64)
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for file, data in zip(files, (b"".join(bodies), offsets.astype("<u8").tobytes(), ids.astype("<i8").tobytes())):
                file.write(data)
            total, count = int(offsets[-1]), count + len(bodies)
        if files is not None:
            for file in files:
                file.close()
            row = [part, f"{folder}/part-{part:06d}", count, total, encoder.dtype]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "path", "docs", "ids", "dtype"])

    manifest = store(dealt.mapInArrow(written, "part long, path string, docs long, ids long, dtype string"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    bases = manifest.select(
        "*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"first_{c.rstrip('s')}") for c in ("docs", "ids")]
    )
    bases = store(bases, "token-bases", 0)
    return TokenSet(folder, bases)


def mapped(path: str, dtype: str) -> np.ndarray:
    """A whole file as an array: a memory map where the store is a mounted folder, else one read."""
    where, name = filesystem(path)
    if where.type_name == "local":
        return np.memmap(name, dtype, "r")
    with where.open_input_file(name) as file:
        return np.frombuffer(file.read(), dtype)


def read_documents(bases: DataFrame, block: int = 4096) -> DataFrame:
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids = mapped(part["path"] + ".bin", part["dtype"])
                offsets, docs = mapped(part["path"] + ".off", "<u8"), mapped(part["path"] + ".doc", "<i8")
                for at in range(0, len(docs), block):
                    edges = offsets[at : at + block + 1].astype(np.int64)
                    spans = zip(edges[:-1].tolist(), edges[1:].tolist())
                    crc = [zlib.crc32(np.asarray(ids[a:b]).astype("<u4").tobytes()) for a, b in spans]
                    keys = np.asarray(docs[at : at + block])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, pa.int64(), mask=keys == NULL_ID),
                            pa.array(edges[:-1] + part["first_id"]),
                            pa.array(np.diff(edges)),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = bases.select("part", "path", "dtype", "first_id").repartition(max(1, bases.count()))  # a task per part
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
