import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from nearword.llm import labelled, quality, toxicity
from nearword.llm.storage import Scratch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist(), spark.read.parquet(f"{SF}/labels.parquet").persist()


def plain_tokens(text):
    """Runs of letters and digits, and runs of other signs, of UTF-8 bytes."""
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (text or "").encode())


def plain_shape(token):
    if not re.match(rb"[0-9A-Za-z\x80-\xff]", token):
        return token
    digits, upper = len(re.findall(rb"[0-9]", token)), len(re.findall(rb"[A-Z]", token))
    if digits:
        return 5 if digits == len(token) else 4
    return 1 if not upper else 2 if upper == 1 else 3 if 2 * upper > len(token) else 6


def plain_weights(texts, target_texts):
    """Log importance weights by dictionaries instead of hash buckets: few texts, so collisions are rare."""

    def grams(text):
        tokens = plain_tokens(text)
        shapes = [plain_shape(t) for t in tokens]
        for i, t in enumerate(tokens):
            last = tokens[i - 1] if i else None
            yield "one", t
            yield "two", last, t
            yield ("same",) if t == last else ("shapes", shapes[i - 1] if i else None, shapes[i])

    raw, target = (Counter(g for t in some for g in grams(t)) for some in (texts, target_texts))
    n_raw, n_target = raw.total(), target.total()
    prior = quality.PRIOR * n_target
    ratio = {g: math.log((target[g] + prior * n / n_raw) / (n_target + prior)) - math.log(n / n_raw) for g, n in raw.items()}
    return [quality.TOKENS * sum(ratio[g] for g in grams(t)) / max(1, len(plain_tokens(t))) for t in texts]


def test_weights_against_plain_models():
    r = random.Random(0)
    good, bad = [f"a{i}" for i in range(5)], [f"B{i}!!" for i in range(4)]
    texts = [" ".join(r.choices(good, k=60)) for _ in range(20)] + [" ".join(r.choices(bad, k=60)) for _ in range(10)] + ["", "a1", "a1 a1 B2!!", None]
    array = pa.array(texts)
    count = lambda x: np.bincount(quality.grams(x)[0], minlength=quality.BUCKETS)
    found = quality.weights(array, quality.log_ratios(count(array), count(array[:12]))) / quality.UNIT
    expected = plain_weights(texts, texts[:12])
    assert np.corrcoef(found, expected)[0, 1] > 0.999 and np.abs(found - expected).max() < 0.5


def test_quality_takes_the_top_k(tables):
    """The Gumbel top-k by sorting all keys, and what the draw does beside a plain threshold."""
    docs, labels = tables
    model = quality.fit(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    ids = np.array([r["doc_id"] for r in rows])
    weight = quality.weights(pa.array([r["text"] for r in rows]), model.ratio)
    key = quality.keys(weight, ids)
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in set(ids.tolist()) and r["quality"] in (0, 1)}
    share = sum(known.values()) / len(known)
    k = math.ceil(len(rows) * (share + quality.MARGIN * math.sqrt(share * (1 - share) / len(known))))
    order = sorted(range(len(rows)), key=lambda i: (-key[i], ids[i]))
    found = {r["doc_id"] for r in quality.sampled(docs, labels).collect()}
    assert found == {int(ids[i]) for i in order[:k]}
    assert found == {r["doc_id"] for r in quality.selected(docs, labels).collect()}
    seen = Counter((q, i in found) for i, q in known.items())
    assert seen[1, True] >= 0.99 * (seen[1, True] + seen[1, False]) and seen[0, False] >= 0.7 * (seen[0, True] + seen[0, False])
    plain = set(ids[np.argsort(-weight, kind="stable")[:k]].tolist())
    assert 0 < len(found ^ plain) < 0.1 * len(rows)
    other = set(ids[np.argsort(-quality.keys(weight, ids, 99), kind="stable")[:k]].tolist())
    assert found != other
    half = {r["doc_id"] for r in quality.sampled(docs, labels, 0.5).collect()}
    assert len(half) == math.ceil(0.5 * len(rows))


def test_draw_follows_weights():
    """Of many ids, those with a larger weight are drawn more often, by as much as Gumbel top-k says for small k."""
    n, k = 30_000, 300
    weight = np.repeat(np.array([0, 1, 2]) * quality.UNIT, n // 3)
    drawn = np.zeros(3)
    for seed in range(20):
        key = quality.keys(weight, np.arange(n), seed)
        drawn += np.bincount(np.argsort(-key)[:k] // (n // 3), minlength=3)
    assert np.allclose(drawn / drawn.sum(), np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum(), atol=0.02)


def test_quality_edges(spark, edge_docs, no_docs, tables):
    labels = tables[1]
    kept = quality.selected(edge_docs, labels)
    assert kept.columns == edge_docs.columns and kept.count() <= edge_docs.count()
    none = labels.limit(0)
    assert quality.selected(edge_docs, none).count() == edge_docs.count()
    assert quality.sampled(no_docs, labels).collect() == []
    odd = spark.createDataFrame([(0, 1, None), (10, None, 5), (None, 1, 1), (7, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.sampled(edge_docs, odd).count() <= edge_docs.count()
    assert len(toxicity.scored(edge_docs, odd).collect()) == edge_docs.count()


@pytest.mark.parametrize("values", [[5, 3, 3, 3, -1, -(2**63), 2**63 - 1], list(range(-50, 900)), [7] * 9])
def test_kth_largest(spark, values):
    rows = Scratch(spark, "k").cut(spark.createDataFrame([(v,) for v in values], "x long"), "x")
    ordered = sorted(values, reverse=True)
    for k in {1, 2, len(values) // 2, len(values)}:
        value, need = quality.kth_largest(rows, "x", k)
        assert value == ordered[k - 1] and need == k - sum(v > value for v in values)


def test_gumbel_samples_by_weight():
    """One of two is drawn in proportion to their weights."""
    ids = np.arange(40_000)
    noise = quality.noise(ids)
    first = noise[::2] + np.log(3) > noise[1::2]
    assert abs(first.mean() - 0.75) < 0.01


def test_toxicity_on_held_out_labels(tables):
    docs, labels = tables
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    good, bad = ([s for s, t in held if t == x] for x in (0, 1))
    auc = np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad])
    assert auc > 0.85


def test_toxicity_ignores_held_out_labels(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", (1 - labels["toxic"]).cast("int"))
    mixed = labels.where(~toxicity.held_out()).union(flipped.where(toxicity.held_out()))
    few = docs.where("doc_id < 200")
    assert [r["score"] for r in toxicity.scored(docs, labels).join(few.select("doc_id"), "doc_id").orderBy("doc_id").collect()] == [r["score"] for r in toxicity.scored(docs, mixed).join(few.select("doc_id"), "doc_id").orderBy("doc_id").collect()]


def test_misspellings_and_long_texts():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeimnorst"), 6)) for _ in range(300)]
    clean = [" ".join(rng.choice(words, 80)) for _ in range(200)]
    insults = ["blockhead", "blockheads", "blockheaded"]
    toxic = [" ".join([*rng.choice(words, 40), rng.choice(insults), *rng.choice(words, 40)]) for _ in range(200)]
    model = toxicity.fit(pa.array(clean + toxic), np.array([0] * 200 + [1] * 200))
    unseen = [" ".join([*rng.choice(words, 3000), w, *rng.choice(words, 3000)]) for w in ("Blockheadz", "blockheadish", "BLOCKHEAD!!")]
    assert (toxicity.scores(pa.array(unseen), model) > 0.5).all()
    assert (toxicity.scores(pa.array([*clean[:50], " ".join(rng.choice(words, 6000)), "", None]), model) < 0.5).all()
    flat = toxicity.fit(pa.array(clean), np.zeros(200))
    assert np.unique(toxicity.scores(pa.array(["a b", "", None]), flat)).size == 1


def test_one_long_labelled_text_leaves_the_sample(spark):
    """Labelled texts over the byte bounds, whatever their hash, neither empty the samples nor leave all documents in; labels without a text take no place."""
    r = np.random.default_rng(1)
    words = np.array(["".join(r.choice(list("aeimnorst"), 6)) for _ in range(300)])
    rows = [(i, ("Then " + " ".join(r.choice(words, 60)) + ". ") if i % 2 else " ".join(r.choice(list("#$%&7Q"), 3)[0] * 3 for _ in range(60))) for i in range(120)]
    rows += [(1000 + i, "%% 77 $$ " * (2 << 20)) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [(i, i % 2, 1 - i % 2) for i in range(120)] + [(1000, 0, 1), (1001, 0, 1)] + [(5000 + i, i % 2, i % 2) for i in range(4 * quality.SAMPLE)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels).share < 0.7
    taken = {x["doc_id"] for x in quality.sampled(docs, labels).collect()}
    assert taken >= set(range(1, 120, 2)) and len(taken) < 85
    table, _ = toxicity.sample(docs, labels, toxicity.Settings())
    assert Counter(table.column("toxic").to_pylist()) == Counter(t for i, _, t in known[:120] if zlib.crc32(str(i).encode()) % 4 != 2)
    assert quality.labelled_share(docs, labels.where("quality = 1")) is None


def test_places_go_to_the_smallest_hashes(spark):
    """With many more rows than places, and with fewer ids than places, as sorting all would say."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(5, "other"), (5, "third"), (None, "n"), (7, None)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i >= 2990)) for i in range(3000)] + [(9000, 1)], "doc_id long, toxic int")
    order = {r[0]: r[1] for r in spark.range(3000).select("id", F.shiftrightunsigned(F.xxhash64("id", F.lit(5)), 1)).collect()}
    for most in (20, 5000):
        found = labelled.chosen(docs, known, "toxic", most, 5)
        zeros = [r["doc_id"] for r in found if r["toxic"] == 0]
        expected = sorted(range(2990), key=lambda i: (order[i], i))
        assert zeros[: min(most, 2990)] == expected[:most] and len(zeros) == min(most, 2992)
        assert [r["doc_id"] for r in found if r["toxic"] == 1] == sorted(range(2990, 3000), key=lambda i: order[i])


def test_fitting_texts():
    both = np.array([0, 1, 0, 1, 0, 1])
    place = np.array([1, 1, 2, 2, 3, 3])
    assert toxicity.fitting(np.array([1, 900, 1, 1, 1, 1]), both, place, 1000).tolist() == [0, 1, 2, 3, 4, 5]
    assert toxicity.fitting(np.array([1, 2000, 1, 1, 1, 998]), both, place, 1000).tolist() == [0, 2, 3, 4]
    assert toxicity.fitting(np.array([9, 995, 9, 995, 1, 995]), both, place, 1000).tolist() == [1, 4]
    with pytest.raises(ValueError, match="fits"):
        toxicity.fitting(np.array([9, 2000]), both[:2], place[:2], 1000)


def test_passages_and_pooling():
    first = np.array([0, 4, 4, 5, 7])
    at, to, begins = toxicity.passages(first, 3)
    assert list(zip(at.tolist(), to.tolist(), strict=True)) == [(0, 3), (1, 4), (4, 5), (5, 7)] and begins.tolist() == [0, 2, 2, 3, 4]
    values = toxicity.means(np.array([3.0, 0, 0, 3, 1, 2, 4]), at, to)
    assert values.tolist() == [1, 1, 1, 3]
    one = toxicity.pooled(values, begins, -9.0, 4.0)
    assert one[1] == -9 and one[3] == pytest.approx(3) and one[0] == pytest.approx(1 + math.log(2) / 4)
    assert toxicity.joined([one, one], 4.0) == pytest.approx(one + math.log(2) / 4)


def test_score_against_plain_sums():
    """A text's log-odds written plainly: words as bags of n-grams, passages as means, a smooth maximum."""
    settings = toxicity.Settings()
    rng = np.random.default_rng(3)
    model = toxicity.Model(settings, rng.normal(0, 1, settings.buckets).astype(np.float32), -1.5, 1.0, 0.0)

    def word(w):
        data = np.frombuffer(b" " + w + b" ", np.uint8)
        bags = [model.weight[keys[a[0] : b[0]]] for keys, a, b in toxicity.word_grams(data, np.array([0]), np.array([len(w)]), settings)]
        assert sum(map(len, bags)) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in settings.grams)
        return float(np.concatenate(bags).mean())

    for text in ("You silly-billy, 2 go away NOW and never come back", "x", "é è"):
        scores = [word(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())]
        values = []
        for width in settings.windows:
            values += [sum(scores[i : i + width]) / len(scores[i : i + width]) - 1.5 for i in range(max(1, len(scores) - width + 1))]
        expected = math.log(sum(math.exp(settings.sharpness * v) for v in values)) / settings.sharpness
        assert toxicity.log_odds(pa.array([text]), model)[0] == pytest.approx(expected, rel=1e-4)


def test_training_recovers_what_makes_texts_toxic():
    """Against a plain bag-of-words reference: the share of held-out texts that a list of the true words would get right."""
    r = random.Random(5)
    words = ["".join(r.choices("aeimnorst", k=6)) for _ in range(400)]
    insults = ["blockhead", "dunderpate", "numbskull", "halfwit"]
    make = lambda bad: " ".join(r.choices(words, k=r.randint(20, 300)) + [r.choice(insults)] * bad)
    texts, labels = [make(i % 4 == 0) for i in range(400)], np.array([int(i % 4 == 0) for i in range(400)])
    model = toxicity.fit(pa.array(texts[:300]), labels[:300])
    scores = toxicity.scores(pa.array(texts[300:]), model)
    truth = np.array([any(w in t for w in insults) for t in texts[300:]])
    assert ((scores >= 0.5) == truth).mean() >= 0.98
    spread = toxicity.Settings(seed=77)
    again = toxicity.scores(pa.array(texts[300:]), toxicity.fit(pa.array(texts[:300]), labels[:300], spread))
    assert ((again >= 0.5) == truth).mean() >= 0.98


def test_calibration_is_stable():
    odds = np.concatenate([np.linspace(-40, -5, 90), np.linspace(-8, 30, 10)])
    labels = np.repeat([0.0, 1.0], [90, 10])
    model = toxicity._calibrated(toxicity.Model(toxicity.Settings(), np.zeros(1), 0.0, 1.0, 0.0), odds, labels)
    p = toxicity.probability(odds * model.scale + model.shift)
    assert abs(p.sum() - 10) < 0.5 and p[:80].max() < 0.1 and p[-5:].min() > 0.9
