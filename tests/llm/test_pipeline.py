"""The pipeline, stage by stage, against a brute-force version."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_cleaning import base, inside, revealed
from test_duplicates import _brute_components
from test_models import _text

from quillrank.llm import language_id

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(12)
    texts = [(_text(r, lang := r.choice(["aa", "bb", "cc"]), r.randrange(8, 80)), lang) for _ in range(90)]
    texts += [texts[0]] * 3 + [(texts[i][0] + " " + _text(r, texts[i][1], 2), texts[i][1]) for i in range(10)]
    leak = _text(r, "aa", 40)
    texts += [(f"{_text(r, 'aa', 30)} {leak} {_text(r, 'aa', 12)}", "aa"), (f"{_text(r, 'bb', 30)} {leak[:60]}X{leak[61:]}", "bb")]
    texts += [(f"{_text(r, 'aa', 20)} Mirata wrote from mi.ta@lo.example {_text(r, 'aa', 12)}", "aa") for _ in range(3)]
    texts += [("12 34 !!", None), ("", "aa"), (None, "bb")]
    data = [(i, x, lang, "s", len(x or "")) for i, (x, lang) in enumerate(texts)] + [(None, texts[5][0], "aa", "s", 1)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(data, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), data, leak


def _cleaned(x, spans, terms):
    out, at = [], 0
    for a, k, b in sorted([*spans, *terms]):
        if a >= at:
            out += [x[at:a], "" if k == 4 and terms[a, k, b] else f"<{['EMAIL', 'IP', 'CARD', 'PHONE', 'TERM'][k]}>"]
        at = max(at, b)
    return "".join([*out, x[at:]])


def test_stages(spark, corpus):
    folder, data, leak = corpus
    frame = spark.createDataFrame(data, COLUMNS)
    model = language_id.fit(frame.where(~language_id.held_out()))
    label, score = model.predict([r[1] for r in data])
    want = [r for r, a, b in zip(data, label, score, strict=True) if a != "und" and b >= corpus_pipeline.LEAST_SCORE]
    assert len(want) >= len(data) - 6

    def run(k, rows):
        out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, COLUMNS), folder)
        assert out.columns == frame.columns
        return sorted(map(tuple, out.collect()), key=repr)

    assert run(0, data) == sorted(want, key=repr)
    least = {i: c for i, _, c in _brute_components(want)}
    one = [r for r in want if least[r[0]] in (r[0], None)]
    assert len(one) < len(want) - 8 and run(1, want) == sorted(one, key=repr)
    clean = [r for r in one if inside(leak.lower(), r[1].lower()) > int(0.08 * len(leak))]
    assert len(clean) == len(one) - 2 and run(2, one) == sorted(clean, key=repr)
    terms = revealed([(r[0], r[1]) for r in clean])
    private = [(r[0], _cleaned(r[1], base(r[1]), t), *r[2:]) for r, t in zip(clean, terms, strict=True)]
    assert private != clean and run(3, clean) == sorted(private, key=repr)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = []
    for r in private:
        ids = library.encode(r[1], add_bos=True, add_eos=True)
        last.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    found = sorted((tuple(r)[:4] for r in corpus_pipeline.run(spark, folder).collect()), key=repr)
    assert found == sorted(last, key=repr)


def test_personal_data_looks_at_whole_documents(spark, corpus):
    """A name far from the address goes at all its places, before and after; words that are common stay."""
    r = random.Random(5)
    far = "common words everywhere " * 12
    texts = [f"Zanzibar {far} kim@mail.example {far} Zanzibar {_text(r, 'aa', 6)}" for _ in range(4)]
    texts += [f"{far} {_text(r, 'bb', 30)}" for _ in range(300)]
    docs = spark.createDataFrame([(i, x, "aa", "s", 1) for i, x in enumerate(texts)], COLUMNS)
    found = {x.doc_id: x.text for x in corpus_pipeline.personal_data(spark, docs, corpus[0]).collect()}
    assert len(found) == len(texts)
    for i in range(4):
        assert "Zanzibar" not in found[i] and found[i].count("common") == 24 and found[i].count("<EMAIL>") == 1
    assert all(found[i] == texts[i] for i in range(4, len(texts)))


def test_stages_on_empty_tables(spark, corpus):
    folder, _, _ = corpus
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_rows_that_share_an_id(spark, corpus):
    """Unlinked texts under one id stay; of linked texts and of equal rows one stays."""
    r = random.Random(21)
    a, b, c = (_text(r, "aa", 40) for _ in range(3))
    data = [(7, a), (7, b), (7, b), (9, a + " lo"), (5, c), (12, c), (12, None), (12, None), (None, a), (13, "")]
    docs = spark.createDataFrame([(i, x, "aa", "s", 1) for i, x in data], COLUMNS)
    found = corpus_pipeline.duplicates(spark, docs, corpus[0])
    assert found.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in found.collect()), key=repr) == sorted([(7, a), (7, b), (5, c), (12, None), (None, a), (13, "")], key=repr)


def test_columns_named_like_the_stages_own(spark, corpus):
    folder, data, _ = corpus
    names = ["__key", "__n", "__lang", "__score"]
    docs = spark.createDataFrame([(*r, *(f"{n}{i}" for n in names)) for i, r in enumerate(data)], COLUMNS + "".join(f", {n} string" for n in names))
    plain = spark.createDataFrame(data, COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:2]:
        rows = stage(spark, docs, folder)
        assert rows.columns == docs.columns
        rows = rows.collect()
        assert all(len({r[n].removeprefix(n) for n in names}) == 1 for r in rows)
        assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(map(tuple, stage(spark, plain, folder).collect()), key=repr)
