"""Hard negatives through the inverted multi-index against brute force."""

import math
import random

import numpy as np
import pytest

from ledgerloom.llm import multi_index_negatives as mn
from ledgerloom.llm.common import ship
from helpers import clashing

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, m=mn.Miner()):
    rows = [(i, x, y) for i, x, y in rows if y is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    sizes = [len(x) for _, x, _ in rows]
    if not rows:
        return []
    dims = max(set(sizes), key=lambda n: (sizes.count(n), n))
    rows = [(i, [math.floor(m.scale * float(np.float32(c))) for c in x], y) for i, x, y in rows if len(x) == dims]
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    anchors = {(i, tuple(x), y) for i, x, y in rows if i is not None and i % m.anchor_every == 0}
    for a, q, label in anchors:
        all_scores = [(sum(p * c for p, c in zip(q, x)), i, y) for i, x, y in rows if i != a]
        for ps, pid, _ in sorted((s for s in all_scores if s[2] == label), key=order)[: m.positives]:
            fits = sorted((s for s in all_scores if s[2] != label and m.low * ps <= 100 * s[0] <= m.high * ps), key=order)
            out += [(a, pid, k, nid, ps, ns) for k, (ns, nid, _) in enumerate(fits[: m.negatives], 1)]
    return sorted(out, key=str)


def mined(spark, rows, miner=mn.Miner()):
    ship(spark)
    found = mn.hard_negatives(clashing(spark.createDataFrame(rows, ROWS)).drop("label_"), miner)
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(n, dims=8, labels=4, seed=1, clusters=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (clusters, dims))
    return [(i, [float(c) for c in centres[rng.integers(clusters)] + rng.normal(0, 0.1, dims)], int(rng.integers(labels))) for i in range(n)]


SMALL = mn.Miner(cell=8, block=32, probe=40, sample=200, anchor_every=10)


def test_multi_sequence_gives_every_pair_in_falling_order():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 8)).astype(float), rng.integers(0, 6, rng.integers(1, 8)).astype(float)
        got = list(mn.multi_sequence(a, b))
        assert {(i, j) for _, i, j in got} == {(i, j) for i in range(len(a)) for j in range(len(b))} and len(got) == len(a) * len(b)
        assert [s for s, _, _ in got] == sorted((s for s, _, _ in got), reverse=True)
        assert all(s == a[i] + b[j] for s, i, j in got)


@pytest.mark.parametrize("miner", [SMALL, mn.Miner(anchor_every=10), mn.Miner(cell=8, block=32, probe=1, sample=50, anchor_every=10)])
def test_equals_brute_force(spark, miner):
    rows = vectors(600)
    assert mined(spark, rows, miner) == brute(rows, miner)


def test_only_some_cells_are_opened(spark):
    """Well separated clusters: the certificate holds before all cells are visited."""
    ship(spark)
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 4
    rows = [(i, [float(c) for c in centres[i % 8] + rng.normal(0, 0.05, 8)], i % 3) for i in range(800)]
    every = mn.participants(spark.createDataFrame(rows, ROWS), 256)
    index = mn.build_index(every, 800, 8, SMALL)
    q = np.floor(np.array(rows[0][1]) * 256).astype(np.int64)
    opened, given, over = mn.visited(index, q, None, 0, 3.0 * 256 * 4 * 256, 1e18)
    assert over and 0 < sum(index.sizes[c] for cells in opened.values() for c in set(cells)) < 300
    assert mined(spark, rows, SMALL) == brute(rows, SMALL)


def test_edge_rows(spark):
    rng = random.Random(5)
    rows = vectors(300, seed=7)
    rows += [(i, rows[0][1], rng.randint(0, 3)) for i in range(1000, 1400)]  # a large group of equal vectors
    rows += [(20, rows[20][1], rows[20][2])] * 3 + [(30, rows[31][1], 2)]  # repeated rows, an id with two vectors
    rows += [(None, rows[5][1], 1), (50, None, 1), (60, rows[6][1], None), (70, [None] * 8, 1), (80, [float("nan")] * 8, 1)]
    rows += [(90, [float("inf")] + [0.0] * 7, 1), (110, [1.0, 2.0], 1), (120, [0.0] * 8, 0), (130, [-c for c in rows[3][1]], 9)]
    assert mined(spark, rows, SMALL) == brute(rows, SMALL)


def test_huge_components_and_odd_lengths(spark):
    rows = [(i, [1e7 * (-1) ** (i // 3), *[1e3 * ((i * 37 + k * 11) % 19 - 9) for k in range(4)]], i % 2) for i in range(60)]
    assert mined(spark, rows, SMALL) == brute(rows, SMALL)
    rows = [(i, [2e5 * ((i * 37 + k * 11) % 19 - 9) for k in range(5)], i % 2) for i in range(60)]
    assert mined(spark, rows, SMALL) == brute(rows, SMALL)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5, 0.5], 1)], [(0, [0.5, 0.5], 1)], [(0, [], 1)], [(0, [0.1], 1), (1, [0.2], 1), (2, [0.1], 0)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == brute(rows)
