import hashlib
import random

from helpers import clashing, documents, edge_rows

from ledgerloom.llm.super_kmers import Kmers, WordHash, remove_repeats, super_kmers, window_leasts


def brute(rows, k):
    first = {}
    for key, text in rows:
        words = (text or "").split()
        if key is not None:
            for i in range(len(words) - k + 1):
                w = tuple(words[i : i + k])
                first[w] = min(key, first.get(w, key))
    out = []
    for key, text in rows:
        words = (text or "").split()
        gone = set()
        if key is not None:
            for i in range(len(words) - k + 1):
                if first[tuple(words[i : i + k])] < key:
                    gone |= set(range(i, i + k))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


def case(seed, n=60):
    rng = random.Random(seed)
    passage = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(40)]
    rows = []
    for key in range(n):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
        if rng.random() < 0.6:
            a = rng.randrange(30)
            words += passage[a : a + rng.randrange(5, 20)]
        words += [str(rng.randrange(1000)) for _ in range(rng.randrange(20))]
        rows.append((rng.choice((key, key, None if rng.random() < 0.1 else key)), " ".join(words)))
    return rows + rows[:6] + [(3, rows[9][1])]


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_runs_partition_the_windows():
    shape = Kmers(k=7, m=3)
    docs = [t.encode().split() for _, t in case(1)]
    owner, start, windows, least = super_kmers(docs, shape, WordHash())
    seen = sorted((o, i) for o, s, w in zip(owner.tolist(), start.tolist(), windows.tolist()) for i in range(s, s + w))
    assert seen == sorted((d, i) for d, w in enumerate(docs) for i in range(len(w) - 6))


def test_window_leasts():
    packed = [b"a b c d e", b"x a b c d", b"b c d e f"]
    assert [x.tolist() for x in window_leasts(packed, [5, 3, 9], 4)] == [[3, 5], [3, 3], [5, 9]]


def test_against_brute_force(spark):
    for seed, shape in ((1, Kmers(k=7, m=3)), (2, Kmers(k=5, m=2, crowd_strings=0)), (3, Kmers(k=6, m=6, bitmap_bits=8, block_words=50))):
        rows = case(seed)
        docs = documents(spark, rows).repartition(3)
        assert got(remove_repeats(docs, shape=shape)) == brute(rows, shape.k)


def test_edge_rows(spark):
    docs = clashing(documents(spark, edge_rows()))
    assert got(remove_repeats(docs)) == brute([r[:2] for r in edge_rows()], 50)
    assert remove_repeats(documents(spark, [])).count() == 0
