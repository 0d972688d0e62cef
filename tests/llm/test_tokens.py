import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearword.llm import packing, simple8b, token_store
from nearword.llm.storage import Scratch
from nearword.llm.tokenizing import Encoder


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([8, 64, 2048]))
def test_simple8b_round_trip(values, block):
    values = np.array(values, np.uint64)
    words, first = simple8b.encode(values, block)
    assert (simple8b.decode(words) == values).all()
    for b in range(len(first) - 1):
        assert (simple8b.decode(words[first[b] : first[b + 1]]) == values[b * block : (b + 1) * block]).all()
    if len(values) and values.max() == 0:
        assert len(words) <= len(values) // 60 + 60


TEXTS = ["", None, " ", "  a b ", "a\n b", " x  y", "it's 's don't  'll", "x" * 3000, "日本 語<|endoftext|> é", "a \n", " lead", "tab\tb c  d", "　 x", "naïve café. The end.\nNew line"]


def whole_text_ids(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(vocabulary_path):
    encoder = Encoder(vocabulary_path)
    for _ in range(2):  # the second time from memory
        for end in (None, 0):
            ids, first = encoder.encode(pa.array(TEXTS * 2), end)
            for k, text in enumerate(TEXTS * 2):
                assert ids[first[k] : first[k + 1]].tolist() == whole_text_ids(vocabulary_path, text) + ([0] if end is not None else [])
    assert encoder.encode(pa.array([], pa.string()), 0)[1].tolist() == [0]


def little_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected_ids(docs, path):
    return [(r["doc_id"], whole_text_ids(path, r["text"]) + [0]) for r in docs.select("doc_id", "text").collect()]


def test_token_files(edge_docs, no_docs, vocabulary_path, spark):
    manifest = token_store.write(edge_docs, Scratch(spark, "t").child("f"), vocabulary_path, file_tokens=2000, slice_bytes=4096)
    assert manifest.count() > 1
    rows = sorted(token_store.read(manifest).collect(), key=lambda r: r["start"])
    expected = expected_ids(edge_docs, vocabulary_path)
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])])[:-1].tolist()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((i, len(x), little_crc(x)) for i, x in expected)
    ids = [-(10**9) if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)
    reader = token_store.Reader(manifest.orderBy("part", "seq").first()["file"])
    own = dict(expected)
    for k, i in enumerate(reader.doc_ids.tolist()):
        if i in own:
            assert reader.ids(k).tolist() == own[i]
    assert token_store.read(token_store.write(no_docs, Scratch(spark, "t").child("f"), vocabulary_path)).collect() == []


def test_token_reader_refuses_other_files(spark):
    from nearword.llm.storage import open_output

    uri = Scratch(spark, "t").child("x")
    out = open_output(uri)
    out.write(b"NWTOK8B\x01" + bytes(64))
    out.close()
    with pytest.raises(ValueError):
        token_store.Reader(uri)


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(edge_docs, no_docs, vocabulary_path):
    rows = packing.pack(edge_docs, vocabulary_path).collect()
    n = check_packing(rows, 2048)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // 2048) + 1
    expected = Counter()
    for i, ids in expected_ids(edge_docs, vocabulary_path):
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected[i, p, a, b - a, little_crc(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    assert packing.pack(no_docs, vocabulary_path).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_places_everything(lengths):
    counts = Counter(lengths)
    first = packing.best_fit(counts, 30)
    for bins in (first, packing.local_search(first, 30)):
        held = Counter()
        for kind, n in bins.items():
            assert sum(kind) <= 30 and n > 0
            for x in kind:
                held[x] += n
        assert held == counts
    table = packing.places(packing.plan(counts, 30))
    assert len(table["key"]) <= len(lengths)


def test_local_search_saves_bins():
    """Best fit decreasing takes a bin more than is needed here; exchanges find it."""
    counts = {11: 1, 10: 1, 8: 1, 7: 1, 6: 3, 5: 1, 3: 1, 2: 1, 4: 2}
    first = packing.best_fit(counts, 20)
    best = packing.local_search(first, 20)
    squares = lambda bins: sum(sum(k) ** 2 * n for k, n in bins.items())
    assert sum(best.values()) <= sum(first.values()) and squares(best) >= squares(first)
    rng = np.random.default_rng(0)
    many = Counter(rng.integers(500, 1100, 3000).tolist())
    before = packing.best_fit(many, 2048)
    assert sum(packing.local_search(before, 2048).values()) < sum(before.values())


def test_exchanges_between_bins_of_many_pieces():
    """Two of a bin's pieces go for one of another's in bins of any number of pieces."""
    assert packing._two((5, 3, 3, 1)) == [(4, (1, 3)), (6, (1, 5)), (6, (3, 3)), (8, (3, 5))]
    small = (2,) * 90 + (1,) * 10  # 190 of 200
    made = packing._exchange(small, (13,), 200)
    assert made is not None and sorted(made[0] + made[1]) == sorted(small + (13,)) and sum(made[0]) == 200
    counts = Counter({1: 500, 2: 700, 3: 90, 17: 60, 101: 30, 99: 41, 64: 33})
    bins = packing.plan(counts, 128)
    assert sum(bins.values()) <= -(-sum(n * x for x, n in counts.items()) // 128) + 8
    assert sum(packing.local_search(packing.best_fit(counts, 128), 128).values()) <= sum(packing.best_fit(counts, 128).values())
