"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import spelling_variants as sv
from ledgerloom.llm.common import ship
from helpers import clashing, documents, edge_rows


def edits(u, v):
    """Levenshtein distance, plainly."""
    row = list(range(len(v) + 1))
    for i, x in enumerate(u, 1):
        last, row = row, [i]
        for j, y in enumerate(v, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows, s):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if s.damage and h % s.damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= s.least_chars and n >= s.least_count}
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and v != w and edits(w, v) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= s.ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, rows, s):
    ship(spark)
    got = sv.spelling_variants(clashing(documents(spark, rows)), s)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


def noisy_texts(seed, count, alphabet="abé", long=9):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, long))) for _ in range(60)]
    out = []
    for doc in range(count):
        words = []
        for _ in range(60):
            w = pool[min(int(rng.expovariate(0.2)), 59)]
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((doc, " ".join(words)))
    return out


def test_scan_finds_every_pair_once():
    rng = random.Random(1)
    for _ in range(200):
        rows = sorted({(rng.randint(0, 2), "".join(rng.choice("abÿ") for _ in range(rng.randint(1, 6)))) for _ in range(rng.randint(1, 40))})
        keys, words = np.array([k for k, _ in rows]), np.array([w for _, w in rows], object)
        i, j = sv.one_edit(keys, words, np.array([len(w) for w in words]))
        got = list(zip(i.tolist(), j.tolist()))
        assert len(set(got)) == len(got)
        assert set(got) == {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if keys[a] == keys[b] and edits(words[a], words[b]) == 1}


@pytest.mark.parametrize("most", [20_000, 30, 3])
def test_equals_brute_force(spark, most):
    rows = noisy_texts(2, 40)
    s = sv.Spelling(damage=5, most=most, held=50)
    assert found(spark, rows, s) == brute(rows, s)


def test_roots_follow_forms_to_the_last(spark):
    chain = ["abcdefgh", "bbcdefgh", "bccdefgh", "bcddefgh", "bcdeefgh"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(2 * 3**k))
    got = found(spark, [(1, text)], sv.Spelling(ratio=3))
    assert got == brute([(1, text)], sv.Spelling(ratio=3))
    assert {r[2] for r in got} == {chain[-1]} and got[0][1] == chain[1]


def test_edge_rows(spark):
    rows = [(r[0], r[1] and r[1][:2_000]) for r in edge_rows()]
    rows += [(None, "Forsythia forsythia FORSYTHIA forsythiÀ forsythià forsythià"), (11, "x" * 120 + " " + "x" * 121)] * 2
    rows += [(12, "größere grössere GRÖSSERE " * 30), (13, "größere1größere"), (14, "×÷" * 5)] * 2
    s = sv.Spelling(damage=31)
    assert found(spark, rows, s) == brute(rows, s)


def test_very_long_runs(spark):
    text = "y" + "x" * 20_000 + " " + "y" + "x" * 20_001
    got = found(spark, [(1, text), (2, text)], sv.Spelling())
    assert [(len(r[0]), r[3], r[4]) for r in got] == [(20_001, 2, 1), (20_002, 2, 1)]


def test_hot_prefix_is_cut_until_lists_are_small(spark):
    """A third of all words share a half: their list is cut within its open part, and nothing is lost."""
    ship(spark)
    rng = random.Random(6)
    words = {"commonhead" + "".join(rng.choice("abcdef") for _ in range(6)) for _ in range(400)}
    words |= {"".join(rng.choice("abcdef") for _ in range(6)) + "commontail" for _ in range(200)}
    df = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    s = sv.Spelling(most=25)
    sizes = []
    pairs = []
    for members in sv.lists(df, s):
        sizes += [r["count"] for r in members.groupBy("list").count().collect()]
        pairs += [(r["word"], r["near"]) for r in sv.near_words(members).collect()]
    assert max(sizes) <= 25 and len(pairs) == len(set(pairs))
    assert set(pairs) == {(u, v) for u in words for v in words if abs(len(u) - len(v)) <= 1 and u != v and edits(u, v) == 1}


def test_no_rows(spark):
    assert found(spark, [], sv.Spelling()) == []
    assert found(spark, [(1, None), (2, ""), (3, "short words only")], sv.Spelling()) == []
