import re

import pytest
import zstandard
from helpers import clashing, documents, edge_rows, prose

from ledgerloom.llm.compression_bands import Bands, figures, keep_good, quality_figures


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "a b c", "a b c a b c", "x x x x", "a b\na b\n\n\na b\r\n", "ö#|é <b>\x0b&", "a b \x85c d", "no no no yes no no no", prose(3, 400) + "\n" + prose(3, 30)],
)
def test_base_figures(text):
    assert figures(text.encode()) == brute(text)


def test_bands_reject_repetition_and_noise():
    squeeze, bands = zstandard.ZstdCompressor(level=3), Bands()
    import base64, random

    good = prose(5, 2000).encode()
    noise = base64.b85encode(random.Random(1).randbytes(9000))
    assert bands.judge(good, squeeze)[3]
    assert bands.judge(b"buy now " * 400, squeeze)[1] == -1
    assert bands.judge(noise, squeeze)[1] == 1
    # a third of a long document repeats: the whole is inside its band, the chunks are not
    ratio, side, share, kept = bands.judge(good + b"buy now " * 900, squeeze)
    assert not kept and share > 0.3


def test_edge_rows(spark):
    docs = clashing(documents(spark, edge_rows()))
    found = quality_figures(docs).collect()
    assert len(found) == len(edge_rows())
    by = sorted((r.n_words, r.kept, r.base_failed, r.ratio is None) for r in found if r.doc_id in (2, 3, 4, 6))
    assert by == [(0, False, True, False), (0, False, True, True), (0, False, True, True), (1, False, True, False)]
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "1", "5", "7", "None"]


def test_empty_table(spark):
    empty = documents(spark, []).limit(0)
    assert quality_figures(empty).count() == 0 and keep_good(empty).count() == 0
