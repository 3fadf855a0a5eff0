import random

from helpers import clashing, documents, edge_rows, prose

from ledgerloom.llm.edit_contamination import Finder, Search, drop_contaminated, matches, myers, normal, pieces


def least_distance(item, text):
    """Of the item against all stretches of the text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_pieces_cover_the_item():
    assert "".join(p for _, p in pieces("abcdefghijk", 3)) == "abcdefghijk" and len(pieces("abcdefghijk", 3)) == 4


def test_myers():
    rng = random.Random(2)
    for _ in range(150):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        want = least_distance(item, text)
        found = myers(item, text, len(item))
        assert found is None and want > len(item) or found[0] == want


def edited(text, edits, rng):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        rng.choice((lambda: out.insert(at, "q"), lambda: out.pop(at), lambda: out.__setitem__(at, "z")))()
    return "".join(out)


def test_finds_exactly_what_brute_force_finds():
    rng, search = random.Random(4), Search()
    items = [(i, normal(prose(100 + i, rng.randint(10, 30)))) for i in range(12)]
    finder = Finder(items, search)
    for n in range(40):
        key, body = items[n % 12]
        budget = int(search.error_rate * len(body))
        text = normal(prose(500 + n, 20) + " " + edited(body, budget + rng.choice((-2, 0, 1, 4)), rng) + " " + prose(900 + n, 20))
        want = {k: d for k, b in items if (d := least_distance(b, text)) <= int(search.error_rate * len(b))}
        assert {items[i][0]: d for i, d, _ in finder.find(text)} == want


def test_edge_rows(spark):
    item = prose(1, 40)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "the")], "item_id long, text string")
    docs = clashing(documents(spark, [*edge_rows(), (8, prose(50, 30) + "\n" + item.upper() + " " + prose(51, 30))]))
    found = matches(docs, bench)
    # the edge rows with prose(1, 120) hold its first 40 words
    assert sorted((str(r.doc_id), str(r.item_id)) for r in found.collect()) == sorted(
        (d, i) for d in ("1", "1", "7", "8", "None") for i in ("1", "None")
    )
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5


def test_blocks_and_empty_tables(spark):
    items = [(i, prose(100 + i, 30)) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [(i, prose(i, 9) + " " + body) for i, body in items] + [(50, prose(50, 99))])
    small = Search(block_chars=400)
    assert sorted((r.doc_id, r.item_id) for r in matches(docs, bench, search=small).collect()) == [(i, i) for i in range(9)]
    assert [r.doc_id for r in drop_contaminated(docs, bench, search=small).collect()] == [50]
    assert matches(documents(spark, []), bench).count() == 0
    assert matches(docs, bench.limit(0)).count() == 0 and drop_contaminated(docs, bench.limit(0)).count() == 10


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "What is the capital of France?"), (2, "no"), (3, ""), (4, None), (5, "C++")]
    rows = [(1, "Tell me: what  is the capital of FRANCE? Paris."), (2, "nothing known, noon"), (3, "say no."), (4, "in c++ code"), (5, None), (6, "whatis the capital of france?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in matches(documents(spark, rows), bench).collect())
    assert got == [(1, 1, 0), (3, 2, 0), (4, 5, 0)]
    assert sorted(r["doc_id"] for r in drop_contaminated(documents(spark, rows), bench).collect()) == [2, 5, 6]
