import hashlib
import random
import re
from collections import Counter

import pytest
from llm_brute import shingles
from pyspark.sql import functions as F

from nearword.llm import components, exact_dedup, fingerprints, idfilter, near_dup
from nearword.llm.storage import Scratch


def new_index(spark, buckets=4):
    return exact_dedup.DigestIndex(spark, Scratch(spark, "index").path, buckets)


def exact_expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
    out = []
    for text, members in groups.items():
        best = max(members, key=lambda r: (len(r["text"] or ""), r["doc_id"] is not None, -(r["doc_id"] or 0)))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(r["doc_id"], best["doc_id"], len(members), r["doc_id"] == best["doc_id"] and len(r["text"] or "") == len(best["text"] or ""), sha) for r in members]
    return Counter(out)


def test_exact_dedup(spark, edge_docs, no_docs):
    found = exact_dedup.ingest(edge_docs, new_index(spark), "one").drop("new_group")
    assert Counter(tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == exact_expected(edge_docs.collect())
    assert exact_dedup.ingest(no_docs, new_index(spark), "one").collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_remembers_batches(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "ab", "c", "d", None, " "])], "doc_id long, text string")
    index = new_index(spark)
    assert {r["doc_id"] for r in exact_dedup.ingest(docs.where("doc_id < 3"), index, "one").where("kept").collect()} == {0, 2}
    again = exact_dedup.ingest(docs, exact_dedup.DigestIndex(spark, index.path, 4), "two")  # opened anew
    assert {r["doc_id"] for r in again.where("kept").collect()} == {3, 5}
    assert {r["doc_id"] for r in again.where("NOT new_group").collect()} == {0, 1, 2}
    index = exact_dedup.DigestIndex(spark, index.path, 4)
    assert {r["doc_id"] for r in exact_dedup.ingest(docs, index, "two").where("kept").collect()} == {3, 5}  # a retried batch
    assert index.table().count() == 4


def test_index_after_many_batches(spark):
    """Batch by batch it says what all at once would; its base is read without Exchange or Sort, and only the tail is sorted."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choices("abc", k=r.randint(1, 6)))) for i in range(400)]
    index, let_in = new_index(spark), set()
    for batch in range(5):
        part = rows[batch::5]
        found = {x["doc_id"]: x["kept"] for x in exact_dedup.ingest(spark.createDataFrame(part, "doc_id long, text string"), index, str(batch)).collect()}
        groups = {}
        for i, t in part:
            groups.setdefault(t.replace(" ", ""), []).append((-len(t), i))
        assert {i for i, kept in found.items() if kept} == {min(g)[1] for t, g in groups.items() if t not in let_in}
        let_in |= set(groups)
    assert index.table().count() == len(let_in)
    before = index.version
    index.compact()
    assert index.version == before + 1 and {bytes(x["digest"]).hex() for x in index.table().collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in let_in}
    groups = Scratch(spark, "g").cut(exact_dedup.groups_of(exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))), "groups")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(groups.select("digest").join(index.parts()[0].hint("merge"), "digest", "left_anti"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan  # of the batch's side
    reopened = exact_dedup.DigestIndex(spark, index.path, 4)
    assert reopened.version == index.version and reopened.table().count() == len(let_in)
    tables = spark.catalog.listTables()
    index.close()
    reopened.close()
    assert len(spark.catalog.listTables()) < len(tables)
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{index.path}/base-{index.version + 1:06d}")  # a base that was never finished
    assert exact_dedup.DigestIndex(spark, index.path, 4).version == index.version


def test_hot_groups(spark):
    """Groups of more rows than others are joined apart and have the same answers."""
    rows = [(i, "hot  text" if i % 3 else f"t{i // 6}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, exact_dedup.HOT_GROUPS = exact_dedup.HOT_GROUPS, 16
    try:
        found = exact_dedup.ingest(docs, new_index(spark), "one").drop("new_group")
        assert Counter(tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == exact_expected(docs.collect())
    finally:
        exact_dedup.HOT_GROUPS = before


def test_exact_rows(spark, edge_docs):
    kept = exact_dedup.kept_rows(edge_docs, new_index(spark), "one")
    assert kept.columns == edge_docs.columns
    normal = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert len(normal) == len(set(normal)) and set(normal) == {re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in edge_docs.collect()}


def components_of(rows, n):
    sets = {r["doc_id"]: shingles(r["text"], n) for r in rows if r["doc_id"] is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rule", [near_dup.Rule(n=2), fingerprints.RULE])
def test_near_dup_equals_all_pairs(spark, edge_docs, no_docs, rule):
    found = near_dup.near_duplicates(edge_docs, rule).collect()
    assert len(found) == edge_docs.count()
    expected = components_of(edge_docs.collect(), rule.n)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == expected
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in found)
    assert near_dup.near_duplicates(no_docs, rule).collect() == []


def test_family_of_near_copies(spark):
    """Copies with edits of their own: links go through some pairs only, and some copies have none."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = r.choices(vocabulary, k=150)
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(r.choice([0, 3, 6, 9, 12, 20])):
            text[r.randrange(150)] = r.choice(vocabulary)
        rows.append((i * 3, " ".join(text)))
    rows += [(1000 + i, " ".join(r.choices(vocabulary, k=80))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = components_of(docs.collect(), 2)
    assert 1 < len({c for _, c in expected.values()}) < 199
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.near_duplicates(docs, near_dup.Rule(n=2)).collect()} == expected
    before, near_dup.CHUNK_ROWS = near_dup.CHUNK_ROWS, 8
    try:  # large buckets in many chunks, without sketches
        kept = near_dup.kept_rows(docs, near_dup.Rule(n=2, sketched=False))
        assert {x["doc_id"] for x in kept.collect()} == {c for _, c in expected.values()}
    finally:
        near_dup.CHUNK_ROWS = before


def test_bands_recall(spark):
    """Pairs about the threshold, against brute force: no false link, and all but few that are there."""
    r = random.Random(12)
    rows = []
    for i in range(300):
        base = [f"v{r.randrange(5000)}" for _ in range(r.randint(30, 120))]
        rows.append((2 * i, " ".join(base)))
        other = list(base)
        for _ in range(r.randint(1, 4)):
            other[r.randrange(len(other))] = "new"
        rows.append((2 * i + 1, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, 5) for i, t in rows}
    true = {2 * i + 1 for i in range(300) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1])}
    found = {x["doc_id"]: x["component_id"] for x in fingerprints.linked(docs).collect()}
    assert all(c == i - 1 and i in true for i, c in found.items()) and 40 < len(true) < 290
    assert len(found) >= 0.9 * len(true)


def test_id_filter(spark):
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 3)] + [(None,)], "x long")
    rows = spark.createDataFrame([(i, "t") for i in range(3000)] + [(None, "n")], "doc_id int, __other string")
    maybe, rest = (x.collect() for x in idfilter.parted(rows, "doc_id", ids, "x"))
    assert len(maybe) + len(rest) == 3001 and {r["doc_id"] for r in maybe} >= {*range(0, 3000, 3), None} and len(maybe) < 1100
    assert idfilter.parted(rows, "doc_id", ids.limit(0), "x")[0].count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (5, 30), (30, 31)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc"))
    assert {x["node"]: x["label"] for x in found.collect()} == {1: 1, 2: 1, 3: 1, **dict.fromkeys([5, 6, 7, 8, 9, 30, 31], 5)}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).collect() == []


def test_signature_estimates(spark):
    """Minima and maxima agree in proportion to the Jaccard similarity."""
    import pyarrow as pa

    from nearword.llm import textbytes

    r = random.Random(2)
    common, a, b = ([f"{p}{i}" for i in range(k)] for p, k in (("c", 600), ("a", 200), ("b", 200)))
    r.shuffle(common)
    hashes, first = textbytes.distinct_shingles(pa.array([" ".join(common + a), " ".join(common + b)]), 1)
    values = near_dup.signatures(hashes, first, 1000)
    assert abs((values[0] == values[1]).mean() - 0.6) < 0.05


def test_fingerprints(spark, edge_docs, no_docs):
    found = fingerprints.compared(edge_docs).collect()
    rows = edge_docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    expected = []
    for r, following in zip(order, order[1:] + order[:1], strict=True):
        text, other = r["text"] or "", following["text"] or ""
        changed = text[: len(text) - len(text) // 4] + other[: len(text) // 4]
        expected.append((r["doc_id"], len(text), hashlib.sha256(changed.encode()).hexdigest()))
        mine = next(x for x in found if (x["doc_id"], x["n_chars"], x["edited_sha256"]) == expected[-1])
        for other_text, value in ((changed, mine["near_edited"]), (other, mine["near_next"])):
            a, b = shingles(text, 5), shingles(other_text, 5)
            true = len(a & b) / len(a | b) if a or b else 1.0
            assert abs(value - true) < 0.2
    assert Counter((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in found) == Counter(expected)
    linked = components_of(rows, 5)
    assert all(x["component_id"] == (None if x["doc_id"] is None else linked[x["doc_id"]][1]) for x in found)
    prints = {}
    for x in fingerprints.fingerprinted(edge_docs).join(edge_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        prints.setdefault(x["text"], set()).add(x["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert fingerprints.compared(no_docs).collect() == []
    alone = fingerprints.compared(edge_docs.where("doc_id = 0")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_every_text_of_a_repeated_id_finds_its_copies(spark):
    r = random.Random(6)
    texts = [" ".join(r.choices([f"w{i}" for i in range(3000)], k=200)) for _ in range(5)]
    rows = [(1, t) for t in texts] + [(1, ""), (1, None)] + [(10 + i, t + " end") for i, t in enumerate(texts)] + [(99, "apart from all others")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(docs, near_dup.Rule(n=2)).where("n_shingles > 0").collect()}
    assert found == {1: 1, **{10 + i: 1 for i in range(5)}, 99: 99}
    detailed = near_dup.detailed(docs.where("doc_id = 1").coalesce(1), near_dup.Rule(n=2)).collect()
    assert len(detailed) == 5 and all(x["rep"] == 1 and x["m"] > 0 for x in detailed)
