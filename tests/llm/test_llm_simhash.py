import random

import xxhash
from helpers import clashing, documents, edge_rows, prose

from ledgerloom.llm.components import components
from ledgerloom.llm.simhash_ring import Ring, classes, drop_near_copies, fingerprint, near_links, signed


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_fingerprint():
    for text in ["", "A", "a B", "x y z", prose(1, 50), prose(2, 333) + " ÄÖ ß"]:
        assert fingerprint(text.encode(), 3) == [brute_print(text)]
        several = fingerprint(text.encode(), 3, 4)
        assert several[0] == brute_print(text) and len(set(several)) == (4 if text else 1)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(25):  # chains of one- and two-bit steps, and a crowd around one print
        word = rng.getrandbits(64)
        for _ in range(12):
            prints.add(word)
            for _ in range(rng.choice((1, 2, 3))):
                word ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << i) ^ (1 << (i * 7) % 64) for i in range(64)}
    ids = sorted(map(signed, prints))
    table = spark.createDataFrame([(k, i) for i in ids for k in (0, 1) if k == 0 or i % 3], "k int, fp long")
    for distance in (1, 2):
        near = [(a, b) for a in ids for b in ids if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
        for bucket in (512, 1):  # the joined way, and the way for crowded keys
            links = near_links(table, Ring(distance=distance, bucket=bucket)).collect()
            got = [(r.a, r.b) for r in links if r.k == 0]
            assert {(r.a, r.b) for r in links if r.k} <= {(a, b) for a, b in near if a % 3 and b % 3}
            assert roots(ids, got) == roots(ids, near)
            if bucket == 512:
                assert sorted(got) == sorted(near)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, b) for b in range(101, 140)] + [(200, 200)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(220)]
    rng.shuffle(links)
    found = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    groups = lambda of: {frozenset(k for k in of if of[k] == v) for v in of.values()}
    assert groups(found) == {g for g in groups(want) if len(g) > 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(spark):
    docs = clashing(documents(spark, edge_rows()))
    found = {(r.doc_id, r.fp): r.component_id for r in classes(docs).collect()}
    assert classes(docs).count() == len(edge_rows())
    (copy,) = map(signed, fingerprint(prose(1, 120).encode(), 3))
    assert found[(7, copy)] == found[(1, copy)] == found[(None, copy)] == 1
    assert found[(3, 0)] == found[(4, 0)] == found[(2, 0)] == 2 and found[(None, 0)] == 2
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, len(r.text or "")) for r in kept.collect()) == sorted(
        [(1, len(prose(1, 120))), (1, len(prose(2, 80))), (2, 0), (5, len(prose(99, 30_000))), (6, 3)]
    )
    lone = documents(spark, [(None, "a b c d"), (None, "a b c d")])
    assert [r.component_id for r in classes(lone).collect()] == [None, None] and drop_near_copies(lone).count() == 1


def test_more_prints_find_more_near_copies(spark):
    rng = random.Random(11)
    rows = []
    for n in range(60):
        words = prose(300 + n, 250).split()
        rows.append((2 * n, " ".join(words)))
        words[rng.randrange(250)] = "changed"
        rows.append((2 * n + 1, " ".join(words)))
    docs = documents(spark, rows)
    found = [sum(r.component_id == r.doc_id - r.doc_id % 2 for r in classes(docs, ring=Ring(prints=n)).collect() if r.doc_id % 2) for n in (1, 8)]
    assert found[0] < found[1] and found[1] >= 54
    assert all(r.component_id // 2 == r.doc_id // 2 for r in classes(docs, ring=Ring(prints=8)).collect())


def test_empty_table(spark):
    empty = documents(spark, [])
    assert classes(empty).count() == 0 and drop_near_copies(empty).count() == 0
