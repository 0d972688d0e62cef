"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of its character n-grams, hashed to rows of an embedding matrix, and of itself; its vector
is the average of theirs. A passage averages the vectors of some words in a row, of as many as each of
``windows`` says, or of the whole text if it has fewer; a linear softmax over the two classes scores it. Embeddings and softmax
are trained together by gradient descent. A document is as toxic as its passages make it: their log-odds
are pooled by a smooth maximum, so that one insult in 20,000 words weighs as in 20. Training and scoring
pool alike, and the loss is the document's. Misspellings that no label has shown share n-grams, and so
vectors, with words that some have.

Scoring folds the softmax into the matrix, which leaves one number per n-gram: a pass over a text's bytes
adds these numbers up. The model is fitted on the driver from at most ``Settings.sample`` labelled rows of
each class, those with the smallest hashes of their id, and at most ``Settings.sample_bytes`` of text; where
they don't fit, long texts go first. Log-odds become probabilities by a logistic fit on texts that the
model which scored them was not trained on: each of ``Settings.folds`` parts by a model of the others.

Defined cases: null, empty and blank texts have the score of a document without evidence. Labels other than
0 and 1, and null ids, are not learnt from. Without labels of both classes every score is the share of
label 1. Repeated rows are scored alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearword.llm import labelled, textbytes

log = logging.getLogger(__name__)

#: A-Z, a-z, 0-9 and all bytes of longer characters make words.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = textbytes.fold_case()
_FOLD[~_LETTERS] = 0x20


#: The part of the epochs over which the maximum gets as sharp as it is in scoring; before, all passages learn.
ANNEAL = 0.75


@dataclass(frozen=True)
class Settings:
    """``grams``: lengths of n-grams in bytes, the spaces around a word included. ``windows``: words of a passage. ``sharpness``: of the smooth maximum over passages."""

    sample: int = 1200
    sample_bytes: int = 10 << 20
    buckets: int = 1 << 18
    dimensions: int = 4
    grams: tuple[int, ...] = (3, 4, 5)
    windows: tuple[int, ...] = (1, 5)
    epochs: int = 20
    rate: float = 0.1
    decay: float = 1e-4
    sharpness: float = 4.0
    folds: int = 2
    seed: int = 5


@dataclass
class Model:
    """``weight``: each bucket's share of the log-odds; ``bias``: that of a passage of none."""

    settings: Settings
    weight: np.ndarray
    bias: float
    scale: float
    shift: float


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: (bucket of the n-gram at each byte of the padded text, first, last): a word's n-grams are first to last. ``data``: folded, a space at either end."""
    up, down = textbytes.powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(textbytes.BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    mask = np.uint64(settings.buckets - 1)
    for n in settings.grams:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        keys = (total[n:] - total[:m]) * down[:m]
        keys = textbytes.mix64(keys + np.uint64(n)) & mask
        yield keys.astype(np.int64), starts, np.maximum(ends + 2 - n + 1, starts)
    whole = textbytes.mix64((total[ends + 1] - total[starts + 1]) * down[starts + 1] ^ np.uint64(0xA5A5)) & mask
    yield whole.astype(np.int64), np.arange(len(starts)), np.arange(len(starts)) + 1


def _prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes with a space at either end, word starts and ends before that shift, first): a word's bytes are [start + 1, end + 1) there."""
    data, offsets = textbytes.string_buffers(texts)
    starts, ends, first = textbytes.word_bounds(data, offsets, _LETTERS)
    padded = np.full(len(data) + 2, 0x20, np.uint8)
    padded[1:-1] = _FOLD[data]
    return padded, starts, ends, first


def word_scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(each word's share of the log-odds, first)."""
    data, starts, ends, first = _prepared(texts)
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    if len(starts):
        for keys, a, b in word_grams(data, starts, ends, model.settings):
            reach = np.concatenate([[0.0], np.cumsum(model.weight[keys], dtype=np.float64)])
            a, b = np.minimum(a, len(keys)), np.minimum(b, len(keys))
            total += reach[b] - reach[a]
            count += b - a
    return total / np.maximum(count, 1), first


def passages(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, first): each text's runs of ``window`` words; the whole text if it has fewer."""
    words = np.diff(first)
    counts = np.where(words > 0, np.maximum(words - window + 1, 1), 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    return at, np.minimum(at + window, np.repeat(first[1:], counts)), begins


def means(values: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The mean of ``values`` from each ``at`` to before ``to``."""
    reach = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (reach[to] - reach[at]) / (to - at)


def pooled(values: np.ndarray, first: np.ndarray, empty: float, sharpness: float) -> np.ndarray:
    """log(sum(exp(sharpness * value))) / sharpness of each text's values."""
    out = np.full(len(first) - 1, empty)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        begins = first[:-1][full]
        top = np.maximum.reduceat(values, begins)
        shifted = np.exp(sharpness * (values - np.repeat(top, np.diff(first)[full])))
        out[full] = top + np.log(np.add.reduceat(shifted, begins)) / sharpness
    return out


def joined(pools: list[np.ndarray], sharpness: float) -> np.ndarray:
    """The smooth maximum over all passages from that over each kind's; those without any passage stay as they are."""
    out = pools[0]
    for pool in pools[1:]:
        out = np.logaddexp(sharpness * out, sharpness * pool) / sharpness
    return out


def log_odds(texts: pa.Array, model: Model) -> np.ndarray:
    words, first = word_scores(texts, model)
    pools = []
    for window in model.settings.windows:
        at, to, begins = passages(first, window)
        pools.append(pooled(means(words, at, to) + model.bias, begins, model.bias, model.settings.sharpness))
    return joined(pools, model.settings.sharpness)


def probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(texts: pa.Array, labels: np.ndarray, settings: Settings = Settings(), prior: float | None = None) -> Model:
    """Train on whole texts and calibrate. ``prior``: the share of label 1 that scores assume, else the sample's."""
    labels = np.asarray(labels).astype(np.float64)
    share = float(labels.mean()) if len(labels) else 0.0
    prior = share if prior is None else prior
    if not 0 < share < 1:
        base = np.clip(prior, 1e-6, 1 - 1e-6)
        return Model(settings, np.zeros(settings.buckets, np.float32), 0.0, 0.0, float(np.log(base / (1 - base))))
    model = trained(texts, labels, settings)
    rank = np.empty(len(labels), np.int64)  # dealt out class by class, so that every part has both where there are enough
    rank[np.argsort(labels, kind="stable")] = np.arange(len(labels))
    odds, unseen = np.zeros(len(labels)), np.zeros(len(labels), bool)
    for fold in range(settings.folds):
        out = rank % settings.folds == fold
        if out.any() and len(np.unique(labels[~out])) == 2:
            other = trained(texts.filter(pa.array(~out)), labels[~out], settings)
            odds[out], unseen[out] = _all_odds(texts.filter(pa.array(out)), other), True
    if not unseen.all():
        odds = _all_odds(texts, model)  # too few texts to leave some out
    model = _calibrated(model, odds, labels)
    model.shift += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return model


def _all_odds(texts: pa.Array, model: Model) -> np.ndarray:
    return np.concatenate([log_odds(part.column("text"), model) for part in textbytes.slices(pa.record_batch({"text": texts}), "text")])


def trained(texts: pa.Array, labels: np.ndarray, settings: Settings) -> Model:
    """Embeddings and softmax by gradient descent with moment estimates, folded into one number per n-gram. Not yet calibrated."""
    word_of, first, grams, gram_first = _bags(texts, settings)
    rng = np.random.default_rng(settings.seed)
    used, grams = np.unique(grams, return_inverse=True)
    grams = grams.astype(np.int32)
    d = settings.dimensions
    embedding = rng.normal(0, 0.1, (d, len(used))).astype(np.float32)
    sides = rng.choice([-0.5, 0.5], d).astype(np.float32)
    softmax = np.stack([-sides, sides])
    bias = np.array([0.5, -0.5], np.float32) * np.float32(np.mean(np.log1p(2 * np.diff(first))))  # texts start undecided
    sizes = np.diff(gram_first)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    by_gram = np.argsort(grams, kind="stable").astype(np.int32)
    gram_begin = np.searchsorted(grams[by_gram], np.arange(len(used)))
    word_sorted = owner[by_gram]
    del owner, by_gram
    kinds = []  # of passages: first word, word after the last, length, text, first passage of each text
    for window in settings.windows:
        at, to, begins = passages(first, window)
        doc_of = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(begins))
        kinds.append((at.astype(np.int32), to.astype(np.int32), (to - at).astype(np.float32), doc_of, begins))
    share = labels.mean()
    balance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (embedding, softmax, bias)]
    for epoch in range(settings.epochs):
        sharp = 1 + (settings.sharpness - 1) * min(1.0, epoch / (ANNEAL * settings.epochs))
        vectors = np.stack([np.add.reduceat(row[grams], gram_first[:-1]) for row in embedding]) / sizes.astype(np.float32)
        between, base = softmax[1] - softmax[0], bias[1] - bias[0]  # of two classes, the difference says all
        in_place = (between @ vectors)[word_of]
        values = [means(in_place, at, to) + base for at, to, *_ in kinds]
        pool = joined([pooled(v, kind[4], float(base), sharp) for v, kind in zip(values, kinds, strict=True)], sharp)
        error = (probability(pool) - labels) * balance
        change = np.zeros(len(word_of) + 1)
        for v, (at, to, length, doc_of, _) in zip(values, kinds, strict=True):
            weight = np.exp(sharp * (v - pool[doc_of])) * error[doc_of] / length
            change += np.bincount(at, weight, len(change)) - np.bincount(to, weight, len(change))
        slope = np.bincount(word_of, np.cumsum(change)[:-1], len(sizes)).astype(np.float32)
        spread = slope / sizes.astype(np.float32)
        to_embedding = between[:, None] * np.add.reduceat(spread[word_sorted], gram_begin)[None, :] + np.float32(settings.decay / len(used)) * embedding
        to_between, to_base = vectors @ slope, np.float32(error.sum())
        gradients = (to_embedding, np.stack([-to_between, to_between]), np.array([-to_base, to_base], np.float32))
        step = settings.rate * (1 - epoch / settings.epochs)
        moved = []
        for value, g, s in zip((embedding, softmax, bias), gradients, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            moved.append(value - step * (s[0] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(s[1] / (1 - 0.99 ** (epoch + 1))) + 1e-8))
        embedding, softmax, bias = moved
    weight = np.zeros(settings.buckets, np.float32)
    weight[used] = (softmax[1] - softmax[0]) @ embedding
    return Model(settings, weight, float(bias[1] - bias[0]), 1.0, 0.0)


def _bags(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word of each place, first, n-grams, first): texts as lists of distinct words' numbers, words as lists of buckets."""
    words, keys, counts, places, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in textbytes.slices(pa.record_batch({"text": texts}), "text"):
        data, starts, ends, first = _prepared(part.column("text"))
        hashes = textbytes.range_hashes(data, starts + 1, ends + 1, folded=False)
        found, at = np.unique(hashes, return_index=True)
        fresh = ~np.isin(found, np.concatenate(words))
        words.append(found[fresh])
        at = at[fresh]
        buckets, owners = [], []
        for key, lo, hi in word_grams(data, starts[at], ends[at], settings):
            lo, hi = np.minimum(lo, len(key)), np.minimum(hi, len(key))
            n = hi - lo
            buckets.append(key[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int32))
            owners.append(np.repeat(np.arange(len(at)), n))
        owner = np.concatenate(owners)
        keys.append(np.concatenate(buckets)[np.argsort(owner, kind="stable")])
        counts.append(np.bincount(owner, minlength=len(at)))
        places.append(hashes)
        docs.append(np.diff(first))
    words = np.concatenate(words)
    order = np.argsort(words)
    word_of = order[np.searchsorted(words[order], np.concatenate(places))].astype(np.int32)
    return word_of, np.cumsum(np.concatenate(docs)), np.concatenate(keys), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def _calibrated(model: Model, odds: np.ndarray, labels: np.ndarray) -> Model:
    """Scale and shift so that log-odds give probabilities: a logistic fit of two numbers, by Newton steps that are halved until the loss falls."""
    middle, spread = float(odds.mean()), float(odds.std()) or 1.0
    x = np.stack([(odds - middle) / spread, np.ones_like(odds)], axis=1)
    hold = 1e-3 * np.array([1.0, 0.0])

    def loss(theta: np.ndarray) -> float:
        z = x @ theta
        return float(np.sum(np.logaddexp(0, z) - labels * z) + 0.5 * np.sum(hold * theta**2))

    share = labels.mean()
    theta = np.array([0.0, np.log(share / (1 - share))])
    for _ in range(50):
        p = probability(x @ theta)
        slope = x.T @ (p - labels) + hold * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold) + 1e-9 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and not loss(theta - size * step) < loss(theta):
            size /= 2
        if size <= 1e-6:
            break
        theta = theta - size * step
    model.scale = float(max(theta[0] / spread, 1e-3))
    model.shift = float(theta[1] - model.scale * middle)
    return model


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    return probability(log_odds(texts, model) * model.scale + model.shift)


def held_out():
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fitting(sizes: np.ndarray, labels: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Which texts are within ``most`` bytes, as indices: all if they fit together.

    The shortest of each class comes first, then texts of at most a 64th of the bytes, the classes in turn by
    place, then longer ones by length; what doesn't fit is passed over, and what comes after it is still tried.
    """
    long = sizes > most // 64
    order = np.lexsort([labels, places, np.where(long, sizes, 0), long])
    first = [int(of[np.argmin(sizes[of])]) for of in (np.flatnonzero(labels == x) for x in (0, 1)) if len(of)]
    left, out = most, []
    for i in dict.fromkeys([*first, *order.tolist()]):
        if sizes[i] <= left:
            left -= int(sizes[i])
            out.append(i)
    missing = {int(x) for x in np.unique(labels)} - {int(labels[i]) for i in out}
    if missing:
        raise ValueError(f"no labelled text with toxic = {missing} fits in {most} bytes beside the shortest of the other class")
    return np.array(sorted(out), np.int64)


def sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[pa.Table, float]:
    """The labelled rows that a model is fitted on, text and toxic, and the share of label 1 among all that may be learnt from."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    rows = labelled.chosen(docs, known, "toxic", settings.sample, settings.seed)
    if len({r["toxic"] for r in rows}) < 2:
        log.warning("labelled texts are not of both classes: every document gets the share of label 1, %s", share)
    within = fitting(*(np.array([r[c] for r in rows], np.int64) for c in ("n", "toxic", "place")), settings.sample_bytes)
    few = docs.sparkSession.createDataFrame([(rows[i]["doc_id"], rows[i]["h"], rows[i]["toxic"]) for i in within], "doc_id long, h long, toxic int")
    return labelled.texts_of(docs, few).orderBy("doc_id", "toxic", "text").select("text", "toxic").toArrow(), float(share)


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    rows, share = sample(docs, labels, settings)
    model = fit(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy(), settings, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                score = scores(part.column("text"), model)
                columns = [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
