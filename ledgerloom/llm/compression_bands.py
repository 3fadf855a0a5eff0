"""Quality rules by compression bands.

The zstandard ratio (compressed bytes / bytes) of ordinary prose lies in a band that depends on the length: short
texts hardly compress, long ones reach a plateau. Text below the band repeats itself, text above it is noise. The
band is tested on the whole document and on fixed chunks, so that a repetitive or random stretch inside a long
document shows too.

Everything happens within the row: one narrow stage, no shuffle. A null text counts as empty; an empty text has no
ratio, passes the bands and fails the base rule (too few words). Repeated rows are judged alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ledgerloom.llm.common import WHITE, raw

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS = 50
WINDOW = 3


@dataclass(frozen=True)
class Bands:
    """``limits``: (from this many bytes on, least ratio, greatest ratio); below the first entry nothing is judged."""

    limits: tuple[tuple[int, float, float], ...] = (
        (128, 0.38, 1.10),
        (256, 0.35, 0.95),
        (512, 0.30, 0.90),
        (1024, 0.27, 0.85),
        (2048, 0.25, 0.80),
        (4096, 0.22, 0.76),
        (16384, 0.20, 0.74),
    )
    chunk_bytes: int = 4096
    #: The document is rejected if more than this share of its chunk bytes lies outside the band.
    max_bad_share: float = 0.3
    level: int = 3

    def outside(self, size: int, ratio: float) -> int:
        """-1 below the band (repetitive), 1 above it (incompressible), 0 inside."""
        least, greatest = 0.0, float("inf")
        for start, low, high in self.limits:
            if size >= start:
                least, greatest = low, high
        return -1 if ratio < least else 1 if ratio > greatest else 0

    def judge(self, text: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float | None, int, float, bool]:
        """(ratio, side of the whole-document band, share of chunk bytes outside theirs, accepted)."""
        if not text:
            return None, 0, 0.0, True
        ratio = len(squeeze.compress(text)) / len(text)
        side, bad = self.outside(len(text), ratio), 0
        if len(text) > self.chunk_bytes:
            for at in range(0, len(text), self.chunk_bytes):
                piece = text[at : at + self.chunk_bytes]
                if self.outside(len(piece), len(squeeze.compress(piece)) / len(piece)):
                    bad += len(piece)
        share = bad / len(text)
        return ratio, side, share, not side and share <= self.max_bad_share


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n < WINDOW + 1:
        return 0
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    size = len(number)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # three ids no longer fit one integer: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
    if len(times) == len(windows):
        return 0
    again = times[where] > 1
    covered = np.zeros(n, bool)
    for shift in range(WINDOW):
        covered[shift : n - WINDOW + 1 + shift] |= again
    return int(covered.sum())


def figures(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.split()
    inked = text.translate(None, WHITE)
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
    return (
        len(words),
        len(inked.translate(None, CONTINUATION)),
        len(inked) - len(inked.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words


OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, side int, bad_chunk_share double"
)


def quality_figures(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per row of ``docs``: the key, base figures, ratio, band side, chunk share and the verdict ``kept``."""
    names = [key, *[part.split()[0] for part in OUT.split(", ")]]

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for body in raw(batch, "text"):
                body = body or b""
                base = figures(body)
                failed = base_failed(base[0], base[4])
                ratio, side, share, accepted = bands.judge(body, squeeze)
                rows.append((*base, failed, accepted and not failed, ratio, side, share))
            columns = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int32(), pa.float64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    picked = docs.select(docs[key], docs[text].alias("text"))
    return picked.mapInArrow(judged, f"`{key}` {docs.schema[key].dataType.simpleString()}, {OUT}")


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` with the verdict ``kept``, all columns unchanged."""
    at = docs.columns.index(text)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            mask = []
            for body in batch.column(at).cast(pa.large_binary()).to_pylist():
                body = body or b""
                words = body.split()
                good = not base_failed(len(words), repeated_words(words)) and bands.judge(body, squeeze)[3]
                mask.append(good)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


