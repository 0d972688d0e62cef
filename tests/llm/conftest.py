import random

import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    base = prose(120)
    texts = [base, base, base.replace(" ", "  "), base + " end", None, "", " \t\n", "one", "One two", "a\x0bb\x0cc", prose(60_000), "日本語 テキスト é", "x" * 50_000, base.upper(), "a  b ", prose(30)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, None, None, None), (None, None, None, "s1", 2), (-7, prose(40), "fr", "s2", 3)]
    rows = [(*x, "clash", i, True, 0.5, "k", 3) for i, x in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size long, kept boolean, key double, digest string, copies int").persist()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture
def vocabulary_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")
