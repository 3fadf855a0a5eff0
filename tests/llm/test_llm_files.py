import hashlib
import zlib

import numpy as np
import public_tokenizers
from helpers import clashing, documents, edge_rows, prose
from tokenizers import Tokenizer

from ledgerloom.llm import arc_convert, mixing, token_files
from ledgerloom.llm.queries import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_give_the_ids_of_the_whole_text(spark):
    plain = Tokenizer.from_file(PATH)
    encoder = token_files.Encoder(PATH)
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    texts += ["", " ", "a  b", "\n\n x\ty ", "don't 'tis we'll''s", "ab    cd", "x \n y", "<|endoftext|>a <|endoftext|>", "tab\x1c!\x1c x", "naïve—café ½ 12a b34", "éa, 中文 字!", "a\x85b", "é's éa'll (é)"]
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), encoder.dtype).tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids, text


def test_token_files_hold_every_document(spark):
    plain = Tokenizer.from_file(PATH)
    rows = edge_rows()
    found = token_files.write_tokens(clashing(documents(spark, rows)).repartition(3), PATH).documents().orderBy("start").collect()
    lists = {}
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [2]
        lists.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    for key, want in lists.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in found if r.doc_id == key) == sorted(want)
    assert token_files.write_tokens(documents(spark, []), PATH).documents().count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    same, other = "<p>" + prose(1, 400), "ü" + prose(2, 400)
    rows = [
        (1, "http://a/x y", same), (2, None, same), (3, "http://b", same), (3, "http://c", same),
        (4, "http://d", other), (None, "http://e", other), (5, "", None), (6, "http://f", ""), (7, "http://g", "short"),
        (8, "http://g", "short"), (9, "http://h", "\r\n\r\nab\n" * 300), (None, None, None),
    ]
    found = arc_convert.archive_pages(clashing(pages(spark, rows)).repartition(4)).collect()
    assert len(found) == len(rows)
    want = sorted((str(k), len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest()) for k, _, t in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in found) == want
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in found if r.payload_bytes >= 1000)
    assert kinds == [("1", "revisit", 3), ("2", "revisit", 3), ("3", "response", None), ("3", "revisit", 3), ("4", "response", None), ("9", "response", None), ("None", "revisit", 4)]
    assert all(r.record_type == "response" for r in found if r.payload_bytes < 1000)
    assert arc_convert.archive_pages(pages(spark, [])).count() == 0


def test_arc_versions_and_faults():
    import io

    import pytest

    for version in (1, 2):
        content = arc_convert.http(5, b"body\n\n") + b"body\n\n"
        line = {"URL": "http://a", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/html"}
        data = arc_convert.arc_head("f.arc", version, "20010203040506") + arc_convert.arc_line(line, version, len(content)) + content + b"\n"
        (record,) = arc_convert.read_arc(io.BytesIO(data))
        assert (record.url, record.ip, record.date, record.payload) == ("http://a", "1.2.3.4", "20010203040506", b"body\n\n")
        for broken in (data[:-12], data.replace(b"1.2.3.4 ", b""), arc_convert.arc_head("f", version, "x").replace(f"{version} 0 ".encode(), b"9 0 ")):
            with pytest.raises(arc_convert.ArcError):
                list(arc_convert.read_arc(io.BytesIO(broken)))
    assert arc_convert.iso("20010203040506") == "2001-02-03T04:05:06Z"


def water(sizes, weights, factor=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out = set(), {}
    while True:
        rest = factor * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        out = {s: most * sizes[s] for s in full} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        above = {s for s in free if out[s] > most * sizes[s]}
        if not above:
            return out
        full |= above


def test_mix_meets_its_targets(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, targets, longest = {}, {}, {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        longest[r.source] = max(r.size, longest.get(r.source, 0))
        assert r.taken in (0, r.size, 2 * r.size)
    want = water(sizes, (3, 1, 2))
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))


def test_budgets_are_nested(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    small, large = ({r.doc_id: r.taken for r in mixing.mixed(docs, mix=mixing.Mix(factor=f)).collect()} for f in (0.5, 1.25))
    assert all(small[k] <= large[k] for k in small)


def test_mix_edges(spark):
    docs = clashing(documents(spark, edge_rows()))
    found = mixing.mixed(docs).collect()
    assert len(found) == len(edge_rows())
    assert all(r.size == 0 and r.taken == 0 for r in found if r.doc_id in (2, 3, 4))
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in taken.collect()) == sum(r.taken for r in found)
    blank = documents(spark, [(1, None, "en", "a"), (2, "", "en", None)])
    assert [r.taken for r in mixing.mixed(blank).collect()] == [0, 0]
    assert mixing.mixed(documents(spark, [])).count() == 0 and mixing.take_mix(documents(spark, [])).count() == 0
