"""Language-model scores under a vocabulary that grows, against counts by hand."""

from __future__ import annotations

import math
import random
from collections import Counter

import fixtures as fx
import numpy as np
import pyarrow as pa
import pytest

from quillrank.llm import _blocks as B
from quillrank.llm import pseudo_likelihood as P

QUICK = {"steps": 60, "rounds": 2}


def _keys(words):
    """The key of each word, one word at a time."""
    out = {}
    for w in set(words):
        t = B.Texts(pa.table({"doc_id": pa.array([1], pa.int64()), "text": pa.array([w], pa.string())}))
        (out[w],) = P.word_keys(t.data, np.array([0]), np.array([t.size])).tolist()
    return out


def _by_hand(data, train, fitted):
    """(id, tokens, score) of each row, from the counts of train and the fitted network."""
    counts = Counter(w for _, x in train for w in fx.words(x))
    keys = _keys({w for _, x in [*data, *train] for w in fx.words(x)})
    n_heads = min(len(counts), int(8 * sum(counts.values()) ** 0.2))
    signed = {w: k - (k >> 63 << 64) for w, k in keys.items()}
    heads = sorted(counts, key=lambda w: (-counts[w], signed[w]))[:n_heads]
    bins = lambda n: 1 + math.floor(8 * math.log2(n)) if n else 0
    rest = [w for w in counts if w not in heads]
    total = sum(counts[w] for w in rest)

    def name(w):
        if w in heads:
            return 1 + heads.index(w)
        above = sum(counts[x] for x in rest if bins(counts[x]) > bins(counts[w]))
        level = min(3, math.floor(above * 4 / max(1, total))) if counts[w] else 3
        return 1 + n_heads + (keys[w] % 16) * 4 + level

    own = Counter()
    for w in counts:
        own[name(w)] += counts[w] + 0.5
    for ending in range(16):
        own[1 + n_heads + ending * 4 + 3] += 0.5
    cached = {w: name(w) for w in keys}
    out = []
    for i, x in data:
        w = fx.words(x)
        c = [0, *(cached[v] for v in w), 0]
        a = np.array(c, np.int64)
        score = fitted.predictor.logp(a[:-2], a[1:-1], a[2:]).sum() + sum(math.log((counts[v] + 0.5) / own[cached[v]]) for v in w)
        out.append((i, len(w), float(score)))
    return out


def _agrees(rows, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 2))
    rows, want = sorted(map(tuple, rows), key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    for r, (i, n, score) in zip(rows, want, strict=True):
        assert r[:2] == (i, n) and math.isclose(r[2], score, rel_tol=1e-5, abs_tol=1e-3)
        if n:
            assert math.isclose(r[3], r[2] / n) and math.isclose(r[4], math.exp(-r[3]))
        else:
            assert r[2:] == (0.0, None, None)


@pytest.mark.parametrize("block_bytes", [1 << 23, 4000])
def test_scores_by_hand(spark, block_bytes):
    data = [(r[0], r[1]) for r in fx.rows()]
    fitted = P.fit(fx.frame(spark).repartition(3), block_bytes=block_bytes, **QUICK)
    assert (fitted.classed.count() > 10) == (block_bytes == 4000)
    rows = P.scores(fitted)
    assert rows.columns == ["doc_id", "n_tokens", "pseudo_log_likelihood", "per_token", "perplexity"]
    _agrees(rows.collect(), _by_hand(data, data, fitted))


def test_other_documents_and_unknown_words(spark):
    train = [(i, f"the cat sat on the mat {'and the dog' * (i % 3)}") for i in range(40)]
    data = [(1, "the cat sat"), (2, "zq1 zq2 the zq3"), (2, None), (None, "dog dog"), (3, "")]
    schema = "doc_id long, text string"
    fitted = P.fit(spark.createDataFrame(data, schema), spark.createDataFrame(train, schema), **QUICK)
    rows = P.scores(fitted).collect()
    _agrees(rows, _by_hand(data, train, fitted))
    score = {r.doc_id: r.per_token for r in rows if r.per_token}
    assert score[1] > score[2]


def test_own_occurrences_are_those_of_the_corpus(spark):
    fitted = P.fit(fx.frame(spark), block_bytes=4000, **QUICK)
    words = [w for r in fx.rows() for w in fx.words(r[1])]
    assert math.isclose(fitted.vocabulary.own.sum(), len(words) + 0.5 * (len(set(words)) + P.ENDINGS))
    assert fitted.vocabulary.heads.size == int(8 * len(words) ** 0.2)


def test_the_vocabulary_grows(spark):
    r = random.Random(2)
    sizes = []
    for n in (20, 2000):
        docs = spark.createDataFrame([(i, fx.sentence(r, 50, 10**5)) for i in range(n)], "doc_id long, text string")
        sizes.append(P.fit(docs, **QUICK).vocabulary.classes)
    assert sizes[1] > 1.5 * sizes[0]


def test_both_sides_count(spark):
    """The middle word follows from the pair around it, and from neither side alone."""
    r = random.Random(4)
    middle = {("a", "c"): "x", ("a", "d"): "y", ("b", "c"): "y", ("b", "d"): "x"}
    pairs = [r.choice(list(middle)) for _ in range(400)]
    train = spark.createDataFrame([(i, f"{p} {middle[p, q]} {q}") for i, (p, q) in enumerate(pairs)], "doc_id long, text string")
    data = spark.createDataFrame([(i, f"{p} {v} {q}") for i, ((p, q), v) in enumerate((k, v) for k in middle for v in "xy")], "doc_id long, text string")
    score = {x.doc_id: x.pseudo_log_likelihood for x in P.pseudo_likelihood(data, train).collect()}
    for i, ((p, q), v) in enumerate((k, v) for k in middle for v in "xy"):
        other = score[i + 1 if v == "x" else i - 1]
        assert (score[i] > other + 2) == (middle[p, q] == v)


def test_the_network_learns_the_counts():
    r = np.random.default_rng(0)
    k = 6
    counts = r.integers(0, 9, k**3)
    counts[1 * k * k + 2 * k + 3] = 400
    cells = np.flatnonzero(counts)
    n = P.ContextNetwork(k)
    for _ in range(3):
        for part in (cells[cells < 3 * k * k], cells[cells >= 3 * k * k]):
            n.learn(part, counts[part], 300, P._rates(1800, 0.03))
    grid = counts.reshape(k * k, k)
    share = grid / np.maximum(1, grid.sum(axis=1, keepdims=True))
    best = -(grid / grid.sum() * np.log(np.maximum(share, 1e-12))).sum()
    pair, middle = np.divmod(np.arange(k**3), k)
    found = n.frozen().logp(*np.divmod(pair, k)[:1], middle, pair % k)
    assert np.allclose(np.exp(found).reshape(k * k, k).sum(axis=1), 1, atol=1e-4)
    assert -(counts / counts.sum() * found).sum() < best * 1.15


def test_empty(spark):
    empty = fx.frame(spark, [])
    assert P.pseudo_likelihood(empty).count() == 0
    assert P.pseudo_likelihood(empty, fx.frame(spark), **QUICK).count() == 0
    rows = P.pseudo_likelihood(fx.frame(spark), empty).collect()
    assert len(rows) == len(fx.rows()) and all(math.isfinite(r.pseudo_log_likelihood) for r in rows)
    nothing = spark.createDataFrame([(1, None), (None, " \n")], "doc_id long, text string")
    assert [(r.n_tokens, r.per_token) for r in P.pseudo_likelihood(nothing).collect()] == [(0, None)] * 2
