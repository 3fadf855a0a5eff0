import random

import numpy as np
from helpers import documents, prose

import corpus_pipeline
from ledgerloom.llm import shingle_join, simhash_ring
from ledgerloom.llm.shingle_join import Likeness, classes, folded, sketch


def sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    held, root = [(k, sets(t)) for k, t in rows], {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(held):
        for b, y in held[:i]:
            if 5 * len(x & y) >= 4 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in root}


def texts():
    """Pairs on both sides of 0.8, a crowd around one text, and a common passage."""
    rng, rows = random.Random(9), []

    def changed(words, edits):
        words = list(words)
        for at in rng.sample(range(len(words)), edits):
            words[at] = f"w{rng.randrange(10**9)}"
        return " ".join(words)

    for n in range(60):
        base = prose(700 + n, 200).split()
        rows += [" ".join(base), changed(base, rng.randint(2, 8))]
    base = prose(600, 200).split()
    rows += [changed(base, rng.randint(0, 7)) for _ in range(50)]
    rows += [prose(800 + n, 20) + " " + prose(599, 60) for n in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_prefix():
    for size in range(1, 300):
        least = next(n for n in range(size + 1) if 5 * n >= 4 * size)
        assert Likeness().prefix(size) == size - least + 1


def test_classes_are_those_of_all_pairs(spark):
    rows = texts()
    want = brute(rows)
    assert 40 < len(set(want.values())) < len(rows) - 20
    docs = documents(spark, rows)
    for bucket in (500, 4):  # pairs of every key; the way of crowded keys
        assert {r.doc_id: r.component_id for r in classes(docs, like=Likeness(bucket=bucket)).collect()} == want


def test_the_stage_keeps_one_of_each_class(spark):
    rows = texts()
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(rows).values()))
    assert shingle_join.classes(documents(spark, [])).count() == 0


def test_sketches_never_refuse_a_linked_pair():
    rng, like = np.random.default_rng(3), Likeness()
    refused = 0
    for size in (1, 5, 31, 33, 200, 255, 257, 3000):
        for part in (0.0, 0.3, 0.7, 0.79, 0.8, 0.85, 0.99, 1.0):
            pool = np.unique(rng.integers(-(2**63), 2**63 - 1, 3 * size + 3))
            rng.shuffle(pool)
            shared = round(2 * size * part / (1 + part))
            x, y = pool[:size], pool[size - shared : 2 * size - shared + size // 9]
            common = len(np.intersect1d(x, y))
            found = like.may_be_alike(sketch(x, 2), sketch(y, 2), len(x), len(y))
            if 5 * common >= 4 * (len(x) + len(y) - common):
                assert found is not None and found <= len(x) + len(y) - 2 * common
            refused += found is None
    assert refused > 20
    wide = sketch(pool[:500], 16)
    assert folded(wide, len(wide) // 8) == int.from_bytes(sketch(pool[:500], 2), "little")
    assert sketch(pool[:0], 2) == bytes(8)


def test_groups_of_another_method_are_checked(spark):
    rows = texts()
    want, docs = brute(rows), documents(spark, rows)
    for groups in ("0L", "doc_id % 3", "doc_id"):  # much too wide, wrong, and of no use
        told = docs.selectExpr("doc_id", f"CAST({groups} AS BIGINT) AS component_id")
        assert {r.doc_id: r.component_id for r in classes(docs, groups=told).collect()} == want


def test_the_stage_asks_the_ring_first(spark, monkeypatch):
    asked, ring = [], simhash_ring.classes
    monkeypatch.setattr(simhash_ring, "classes", lambda *given: asked.append(given) or ring(*given))
    told = " ".join([prose(61, 41)] * 40)  # alike for the ring only: repeats weigh in a fingerprint and not in a set
    words = prose(62, 200).split()  # alike for the check only
    rows = [(1, told), (2, f"{told} {prose(63, 30)}"), (3, " ".join(words)), (4, " ".join([*words[:190], *prose(64, 10).split()]))]
    docs = documents(spark, rows)
    assert {r.doc_id: r.component_id for r in ring(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and len(asked) == 1


def test_the_stage_leaves_no_pair_out_on_odd_rows(spark):
    """Short texts, blanks, cases, nulls, repeated ids and rows, and pairs on, just above and just below the limit."""
    lower = str.maketrans("ABCSTUWX", "abcstuwx")
    rng, rows = random.Random(17), []
    for n in range(40):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 4, 5, 6, 9, 13, 40]))]
        for _ in range(rng.randint(1, 4)):
            other = list(words)
            if other and rng.random() < 0.6:
                other[rng.choice([0, -1])] = f"x{rng.randrange(3)}"
            text = rng.choice([" ", "\t", " \n", "\r\n "]).join(other)
            rows.append((rng.choice([None, n, n, 100 + rng.randrange(60)]), rng.choice([text, text, text.upper(), f" {text}\n"])))
    rows += [(200, None), (None, None), (201, ""), rows[0], rows[0], (202, "a b c"), (203, "A B C"), (204, "É é"), (205, "é é")]
    same = " ".join(f"s{i}" for i in range(40))  # 36 shingles; 4 of 5 shared is 32 of 40
    rows += [(300, same), (301, same + "".join(f" t{i}" for i in range(9))), (302, " ".join(f"u{i}" for i in range(10)) + " " + same)]
    held = []
    for _, text in rows:
        words = (text or "").translate(lower).split()
        held.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, x in enumerate(held):
        for j, y in enumerate(held[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(find(i), []).append((key is None, key or 0))
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(min(keys) for keys in least.values())
    assert {301, 302} & {r.doc_id for r in kept} == {302}  # 36 of 45 shared is a link, 36 of 46 is none
