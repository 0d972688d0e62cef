import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import duckdb
import pytest
from llm_brute import shingles

import __spark_entry__ as contract
from nearword.llm import mixing, queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    ours = sorted(map(str, (tuple(r) for r in found.select(columns).collect())))
    assert ours == sorted(map(str, connection.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op2_quality"}))
def test_every_row_has_its_answer(spark, name):
    found = queries.QUERIES[name](spark, SF)
    key = "page_id" if name == "op1_warc" else "doc_id"
    table = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert {r[0] for r in found.select(key).collect()} == {r[0] for r in table.select(key).collect()}


def test_stages(spark):
    """Each stage against a plain reading of what its predecessor kept."""
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        after.append(docs.collect())
        assert name == "packing" or docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, distinct, apart, mixed, packed = after
    assert {r["doc_id"] for r in good} >= {i for i, q in labels.items() if q == 1}

    groups = {}
    for r in good:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append(r)
    assert {r["doc_id"] for r in distinct} == {min(g, key=lambda r: (-len(r["text"]), r["doc_id"]))["doc_id"] for g in groups.values()}

    sets = {r["doc_id"]: shingles(r["text"], 5) for r in distinct}
    label = {i: i for i in sets}
    for _ in sets:
        before = dict(label)
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert {r["doc_id"] for r in apart} == set(label.values())

    taken = {r["doc_id"]: r["copies"] for r in mixing.decide(spark.createDataFrame(apart)).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({i: n for i, n in taken.items() if n})
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)
    rows = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()]
    assert Counter(rows) == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_stages_on_edges(spark, edge_docs, no_docs):
    """The stages in a chain over nulls, long texts, repeated rows and clashing columns, and over no rows at all."""
    columns = edge_docs.columns
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).persist()
            rows = docs.collect()
            assert name == "packing" or docs.columns == columns
            if name == "exact dedup":
                normal = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in rows]
                assert len(normal) == len(set(normal))
            if name == "near dedup" and rows:
                assert sum((r["text"] or "").split() == (edge_docs.first()["text"] or "").split() for r in rows) == 1
        assert all(r["length"] > 0 for r in rows)


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports and has its queries when these folders and the pipeline are gone."""
    shutil.copytree(ROOT / "nearword", tmp_path / "nearword", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 30 and set(s) <= set(q) and not any(n[:2] == 'op' for n in q)"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert run.returncode == 0, run.stderr
    assert "pipeline" in contract.queries()
