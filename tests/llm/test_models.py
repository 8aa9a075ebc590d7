"""Language identification, language-model scores and their parts."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import fixtures as fx
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.llm import language_id as L
from quillrank.llm import masked_lm as M

SYLLABLES = {"aa": ["lo", "mi", "ta", "ne", "ra"], "bb": ["sch", "ung", "ver", "ge", "ßt"], "cc": ["の", "に", "は", "日", "本"]}


def _text(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randrange(1, 4))) for _ in range(n))


def _corpus(spark, n=300):
    r = random.Random(3)
    data = [(i, _text(r, lang := r.choice(list(SYLLABLES)), r.randrange(3, 60)), lang) for i in range(n)]
    data += [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "123 !!", "cc"), (n + 3, _text(r, "aa", 9), None), (None, _text(r, "bb", 9), "cc"), (n + 4, _text(r, "bb", 30_000), "bb")]
    return spark.createDataFrame(data, "doc_id long, text string, lang string"), data


def test_held_out_rule(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", L.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_languages(spark):
    docs, data = _corpus(spark)
    model = L.fit(docs.where(~L.held_out()), rows_per_class=60)
    assert model.classes == ["aa", "bb", "cc"] and 0 < (model.w != 0).mean() < 0.2
    rows = L.predict(docs, model).collect()
    assert len(rows) == len(data) and rows[0].__fields__ == ["doc_id", "text", "lang", "lang_pred", "score"]
    for r in rows:
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert 0 <= r.score <= 1
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_labels_and_ids_are_not_inputs(spark):
    docs, _ = _corpus(spark)
    model = L.fit(docs.where(~L.held_out()))
    moved = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    a, b = (sorted((r.text or "", r.lang_pred, r.score) for r in L.predict(d, model).collect()) for d in (docs, moved))
    assert a == b


def test_the_sample_is_bounded(spark, monkeypatch):
    """rows_per_class rows of each label, however often a row or an id repeats."""
    r, learned = random.Random(5), Counter()
    data = [(i, _text(r, lang, 12), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    data += [data[0]] * 300 + [(7, _text(r, "cc", 9), "cc") for _ in range(90)] + [(200, "one row", "dd")] * 400
    learn = L.Ftrl.learn
    monkeypatch.setattr(L.Ftrl, "learn", lambda self, at, x, k: (learned.update([k]), learn(self, at, x, k)))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = L.fit(docs, rows_per_class=20, epochs=1)
    assert model.classes == ["aa", "bb", "cc", "dd"] and sum(learned.values()) == 48
    assert learned[3] <= 1 and all(10 <= learned[k] <= 20 for k in range(3))


def test_columns_of_the_new_names_give_way(spark):
    docs, _ = _corpus(spark)
    model = L.fit(docs, rows_per_class=30, epochs=1)
    rows = L.predict(docs.select("doc_id", F.lit("x").alias("lang_pred"), "text", F.lit("y").alias("score")), model).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "lang_pred", "score"] and {x.lang_pred for x in rows} <= {"aa", "bb", "cc", "und"}


def test_no_labels_and_empty(spark):
    docs, _ = _corpus(spark)
    model = L.fit(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in L.predict(docs, model).collect()} == {"und"}
    assert L.predict(fx.frame(spark, []), model).count() == 0


def test_feature_counts_stay_in_their_text():
    together = L.feature_counts(["ab", "", "c d"], 12)
    assert (together == np.concatenate([L.feature_counts([x], 12) for x in ("ab", "", "c d")])).all()


def test_calibration_finds_the_temperature():
    r = np.random.default_rng(1)
    scores = r.normal(0, 2, (4000, 3))
    truth = np.array([r.choice(3, p=p) for p in L.softmax(scores)])
    assert L.calibrate(scores * 5, truth) == pytest.approx(5, rel=0.1)


def test_elastic_net_makes_zeros():
    f = L.Ftrl(10, 2, l1=0.5)
    for _ in range(50):
        f.learn(np.array([0, 1]), np.array([1.0, 0.001]), 0)
        f.learn(np.array([2]), np.array([1.0]), 1)
    w = f.rows(slice(None))
    assert w[0, 0] > 0 > w[0, 1] and w[2, 1] > 0 and (w[1] == 0).all() and (w[5] == 0).all()


def test_network_gradients_and_training():
    r = np.random.default_rng(0)
    counts = r.integers(0, 9, (5, 5, 5))
    counts[1, 2, 3] = 400
    n = M.WindowNetwork(5, hidden=16)
    losses = n.train(counts, steps=400)
    share = counts / counts.sum(axis=2, keepdims=True)
    best = -(counts / counts.sum() * np.log(np.maximum(share, 1e-12))).sum()
    assert losses[-1] < 0.9 * losses[0] and losses[-1] < best * 1.15
    table = n.table()
    assert np.allclose(np.exp(table).sum(axis=2), 1, atol=1e-4) and table[1, 2].argmax() == 3


def test_masked_scores_by_hand(spark):
    docs = fx.frame(spark)
    model = M.fit(docs)
    buckets = {}
    for r in M.score(docs, model).collect():
        buckets.setdefault(r.doc_id, []).append(r)
    import pyarrow as pa

    for row in fx.rows():
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": pa.array([row[1]], pa.string())})
        _, _, b = M._buckets(batch)
        c = [M.EDGE, *model.classes[b].tolist(), M.EDGE]
        total = sum(float(model.table[c[i], c[i + 2], c[i + 1]]) + float(model.share[b[i]]) for i in range(len(b)))
        assert len(b) == len(fx.words(row[1]))
        got = [r for r in buckets[row[0]] if r.n_tokens == len(b) and math.isclose(r.pseudo_log_likelihood, total, rel_tol=1e-6, abs_tol=1e-6)]
        assert got and (got[0].per_token is None) == (len(b) == 0)


def test_bucket_counts_cover_the_corpus(spark):
    docs = fx.frame(spark).select("text")
    counts = M._summed(docs.repartition(5), lambda batch: np.bincount(M._buckets(batch)[2], minlength=1 << M.BITS), 1 << M.BITS)
    assert counts.sum() == sum(len(fx.words(r[1])) for r in fx.rows())


def test_likely_words_score_better(spark):
    r = random.Random(5)
    data = [(i, "the cat sat on the mat and the dog " * 3) for i in range(50)] + [(100, "mat the the on dog cat sat and the"), (101, " ".join(f"zq{r.randrange(10**6)}" for _ in range(9)))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    score = {x.doc_id: x.per_token for x in M.score(docs, M.fit(docs.where("doc_id < 50"))).collect()}
    assert score[0] > score[100] > score[101]
    empty = docs.where("doc_id < 0")
    assert M.score(empty, M.fit(empty)).count() == 0
