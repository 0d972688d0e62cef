import zlib
from collections import Counter

import numpy as np
import pytest
from llm_brute import words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearword.llm import mixing, sharding
from nearword.llm.storage import Scratch

SF = "/root/testdata/sf0.01"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(own):
    aims = mixing.targets(own)
    assert all(0 <= a <= 2 * s + 1e-6 for a, s in zip(aims, own, strict=True))
    assert sum(aims) == pytest.approx(1.5 * sum(own))
    free = [a / mixing.WEIGHTS[i % 3] for i, (a, s) in enumerate(zip(aims, own, strict=True)) if a < 2 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * (1 + max(free))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5))
def test_splitting_tree(counts, shards, seed):
    parts = mixing.split(np.array(counts), shards, np.random.default_rng(seed))
    assert parts.shape == (shards, len(counts)) and (parts >= 0).all()
    assert parts.sum(axis=0).tolist() == counts
    assert np.ptp(parts.sum(axis=1)) <= max(1, int(np.log2(shards)) + 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=60), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 5))
def test_draws_fill_the_quotas(words, shards, seed):
    """Each source's draws go to the shards in runs, and a shard has its share of all words but for half a draw of each source at either end."""
    found = mixing.filled([np.array(w) for w in words], shards, seed)
    total = [0] * shards
    for draws, own in zip(found, words, strict=True):
        assert list(draws) == sorted(draws) and 0 <= min(draws) and max(draws) < shards
        for shard, n in zip(draws, own, strict=True):
            total[shard] += max(n, 1)
    slack = sum(max(max(w), 1) for w in words) + len(words) + int(np.log2(shards)) + 2
    assert max(abs(t - sum(total) / shards) for t in total) <= slack


def plain_targets(own, total=1.5, most=2.0):
    """The level at which min(most * size, weight * level) adds up to the total, by bisection."""
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        reached = sum(min(most * s, (3, 1, 2)[i % 3] * level) for i, s in enumerate(own))
        low, high = (level, high) if reached < total * sum(own) else (low, level)
    return [min(most * s, (3, 1, 2)[i % 3] * high) for i, s in enumerate(own)]


def test_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.decide(docs).collect()
    text = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == len(text) and all(r["size"] == len(words(text[r["doc_id"]]["text"])) for r in rows)
    by = {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["draws"]) == len(r["orders"]) == r["copies"]
        by.setdefault(text[r["doc_id"]]["source"], []).append(r)
    aims = plain_targets([sum(r["size"] for r in by[s]) for s in sorted(by)])
    for source, aim in zip(sorted(by), aims, strict=True):
        assert {r["source_size"] for r in by[source]} == {sum(r["size"] for r in by[source])}
        assert by[source][0]["target"] == pytest.approx(aim)
        assert sum(r["taken"] for r in by[source]) == pytest.approx(aim, rel=0.03)
    assert sorted(map(str, mixing.decide(docs.repartition(7)).collect())) == sorted(map(str, rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_order"]
    found = mixed.collect()
    assert Counter((r["doc_id"], r["mix_shard"], r["mix_order"]) for r in found) == Counter((r["doc_id"], *x) for r in rows for x in zip(r["draws"], r["orders"], strict=True))
    assert set(r["mix_shard"] for r in found) == set(range(mixing.SHARDS))
    assert len({(r["doc_id"], r["mix_order"]) for r in found}) == len(found)
    shards = mixing.in_order(mixed).select("mix_shard", "mix_order", F.spark_partition_id()).collect()
    assert len(shards) == len(found) and all(a[2] != b[2] or a[:2] <= b[:2] for a, b in zip(shards, shards[1:]))


def test_another_tree_gives_other_shards(spark):
    """What is taken doesn't depend on the shards; where it goes does, and with documents of one length shards have almost the same words."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * 40), f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    rows = {n: mixing.decide(docs, shards=n).collect() for n in (1, 8)}
    assert [sorted((r["doc_id"], r["taken"]) for r in rows[n]) for n in (1, 8)][0] == sorted((r["doc_id"], r["taken"]) for r in rows[8])
    assert all(set(r["draws"]) <= {0} for r in rows[1])
    size = Counter()
    for r in rows[8]:
        size.update({s: r["size"] for s in set(r["draws"])} if len(set(r["draws"])) == len(r["draws"]) else {r["draws"][0]: 2 * r["size"]})
    assert set(size) == set(range(8)) and max(size.values()) < 1.02 * min(size.values())
    assert sorted(map(str, mixing.decide(docs, shards=8, seed=5).collect())) != sorted(map(str, rows[8]))


def test_mixture_edges(edge_docs, no_docs):
    rows = mixing.decide(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2 and len(r["draws"]) == r["copies"] and None not in r["draws"] for r in rows)
    assert {r["source"] for r in rows} == {"s0", "s1", "s2", None}
    mixed = mixing.in_order(mixing.mix(edge_docs))
    assert mixed.columns == [*edge_docs.columns, "mix_shard", "mix_order"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == sum((Counter({r["doc_id"]: r["copies"]}) for r in rows if r["copies"]), Counter())
    assert mixing.decide(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


def check_shards(rows, docs, shards):
    sizes = Counter()
    slots = {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    return [sizes[s] for s in range(shards)]


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    maps = sharding.build(docs, Scratch(spark, "map").path, 16)
    before = sharding.place(docs, maps.load(1)).collect()
    sizes = check_shards(before, docs.collect(), 16)
    assert max(sizes) < 1.02 * min(sizes)
    assert sharding.edit(docs, maps, 17) == 2 == maps.latest()
    after = sharding.place(docs, maps.load(2)).collect()
    sizes = check_shards(after, docs.collect(), 17)
    assert max(sizes) < 1.05 * min(sizes)
    was = {r["doc_id"]: (r["shard"], r["virtual_slot"]) for r in before}
    moved = [r for r in after if was[r["doc_id"]][0] != r["shard"]]
    assert all(was[r["doc_id"]][1] == r["virtual_slot"] for r in after)
    assert {r["shard"] for r in moved} == {16}
    assert sharding.edit(docs, maps, 4) == 3
    assert len(check_shards(sharding.place(docs, maps.load(3)).collect(), docs.collect(), 4)) == 4
    assert len(check_shards(sharding.place(docs, maps.load(1)).collect(), docs.collect(), 16)) == 16  # old versions stay
    with pytest.raises(Exception, match="(?i)exist"):
        maps.save([], 2)


def test_a_grown_table_under_an_old_map(spark):
    """Places are gapless and no two rows share one, whatever was added, and a hot id spreads over shards."""
    docs = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(400)], "doc_id long, text string")
    maps = sharding.build(docs, Scratch(spark, "map").path, 4)
    grown = docs.union(spark.createDataFrame([(400 + i, "new") for i in range(300)] + [(7, f"text {i}") for i in range(400)] + [(None, "a"), (None, None)], docs.schema))
    rows = sharding.place(grown, maps.load(1)).collect()
    check_shards(rows, grown.collect(), 4)
    hot = Counter(r["shard"] for r in rows if r["doc_id"] == 7)
    assert len(hot) == 4 and max(hot.values()) < 200
    was = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.place(docs, maps.load(1)).collect()}
    assert all(was.get((r["doc_id"], r["text_crc32"]), r["shard"]) == r["shard"] for r in rows)


def test_shard_edges(spark, edge_docs, no_docs):
    maps = sharding.build(edge_docs, Scratch(spark, "map").path, 3)
    check_shards(sharding.place(edge_docs, maps.load(1)).collect(), edge_docs.collect(), 3)
    empty = sharding.build(no_docs, Scratch(spark, "map").path, 3)
    assert sharding.place(no_docs, empty.load(1)).collect() == []
    assert sharding.SlotMap(spark, Scratch(spark, "map").path).latest() is None
    with pytest.raises(ValueError):
        sharding.edit(no_docs, sharding.SlotMap(spark, Scratch(spark, "map").path), 3)
