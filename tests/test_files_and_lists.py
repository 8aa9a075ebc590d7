"""Files, streams, codecs and permutations."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrank.functions.models import MODELS
from quillrank.functions.permute import BucketPermutation, ModularPermutation
from quillrank.functions.tokens import first_token, term_bucket, tokens
from quillrank.operators.elias_fano import EliasFano, decode_lists, decoded_tf, encode_lists, moved, next_at_least, running_tf, size_report
from quillrank.plans.retrieval import retrieve
from quillrank.sources import files
from quillrank.sources.index import Index
from quillrank.streaming.queries import answer_stream

LISTS = [[], [0], [932, 2438, 16307, 17803, 18523], list(range(1, 100000, 100)), [0, *range(127, 255)], [5, 5, 5, 9]]


@pytest.mark.parametrize("values", LISTS)
def test_elias_fano_fixed_lists(values):
    code = EliasFano(values)
    assert EliasFano.from_bytes(code.to_bytes()).decode().tolist() == values


def test_elias_fano_random_list():
    values = np.sort(np.random.default_rng(3).choice(np.arange(1, 10_000_000), 100_000, replace=False))
    code = EliasFano(values)
    assert (code.decode() == values).all() and code.nbytes < 100_000 * 9 / 8 + 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=80), st.integers(0, 10**6), st.integers(0, 90))
def test_cursor_moves(values, target, n):
    values = sorted(values)
    c = EliasFano(values).cursor()
    assert c.skip_to(target) == any(v >= target for v in values)
    if c.valid:
        assert c.value == min(v for v in values if v >= target) and c.skip_to(c.value)
    c.reset()
    assert [c.value for _ in values if c.next()] == values and not c.next()
    assert c.jump(n) == (1 <= n <= len(values)) and (not c.valid or c.value == values[n - 1])
    assert c.jump_to(target) == any(v >= target for v in values)
    c.reset()
    assert c.skip(n) == (1 <= n <= len(values))
    if c.valid and c.place:
        assert c.previous_value == values[c.place - 1] and c.previous() and c.value == values[n - 2]


@pytest.mark.parametrize("segment_bits", [0, 3, 7, 20])
def test_long_lists_are_coded_in_segments(spark, segment_bits):
    r = np.random.default_rng(6)
    rows = [(t, int(d), int(r.integers(1, 9))) for t, n in enumerate([1, 300, 7, 0, 150]) for d in np.sort(r.choice(5000, n, replace=False))]
    rows += [(9, 2**40 + 5, 3), (9, 2**40 + 6, 1)]
    encoded = encode_lists(spark.createDataFrame(rows, "term_id int, doc_id long, tf long"), segment_bits).collect()
    assert sorted((x.term_id, x.base) for x in encoded) == sorted({(t, d >> segment_bits << segment_bits) for t, d, _ in rows}) and sum(x.n for x in encoded) == len(rows)
    assert sorted(map(tuple, decode_lists(spark.createDataFrame(encoded, "term_id int, base long, n long, docs binary, freqs binary")).collect())) == sorted(rows)


def test_lists_as_tables(spark):
    rows = [(0, d, 1 + d % 3) for d in (2, 5, 9, 40)] + [(1, 7, 4)]
    postings = spark.createDataFrame(rows, "term_id int, doc_id long, tf long")
    assert sorted(map(tuple, decode_lists(encode_lists(postings)).collect())) == rows
    stats = postings.groupBy("term_id").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    assert decoded_tf(running_tf(postings).join(stats, "term_id")).where("tf <> tf_decoded").count() == 0
    targets = spark.createDataFrame([(0, 0), (0, 9), (0, 10), (0, 41), (1, 7)], "term_id int, target long")
    assert sorted((r.term_id, r.target, r.doc_id) for r in next_at_least(postings, targets).collect()) == [(0, 0, 2), (0, 9, 9), (0, 10, 40), (0, 41, None), (1, 7, 7)]
    assert [tuple(r)[1:] for r in moved(postings, 2).where("term_id = 0").orderBy("doc_id").collect()] == [(2, 9, None, 5), (5, 40, 2, 5), (9, None, 5, 5), (40, None, 9, 5)]
    report = size_report(postings, 41, forward_every=2).where("term_id = 0").first()
    assert (report.low_bits, report.lower_bytes, report.upper_bytes, report.pointer_bytes) == (3, 2, 2, 8)


@pytest.mark.parametrize("p", [BucketPermutation(1000), BucketPermutation(50), BucketPermutation(128), ModularPermutation(1000), ModularPermutation(1)])
def test_permutations(spark, p):
    v = spark.range(p.n).select(F.col("id").alias("v")).withColumn("m", p.apply(F.col("v"))).withColumn("b", p.invert(F.col("m"))).collect()
    assert all(r.v == r.b for r in v) and {r.m for r in v} == set(range(p.n))


def test_tokens(spark):
    row = spark.createDataFrame([("  a\tb\x0bc\x0cd\r\ne  ",), (None,), ("",)], "t string")
    assert [r[0] for r in row.select(tokens(F.col("t"))).collect()] == [["a", "b", "c", "d", "e"], [], []]
    assert [r[0] for r in row.select(first_token(F.col("t"))).collect()] == ["a", "", ""]
    b = spark.createDataFrame([("short",), ("x" * 16,)], "t string").select(term_bucket(F.col("t"), 100)).collect()
    assert 0 <= b[0][0] < 50 <= b[1][0] < 100


def test_text_files(spark, tmp_path):
    (tmp_path / "lex").write_text("alpha 1\n skipped\nbeta\nalpha again\n")
    assert sorted(map(tuple, files.read_lexicon(spark, str(tmp_path / "lex")).collect())) == [(0, "alpha"), (2, "beta")]
    (tmp_path / "labels").write_text("doc-a x\ndoc-b y\n")
    assert sorted(map(tuple, files.read_labels(spark, str(tmp_path / "labels")).collect())) == [(0, "doc-a"), (1, "doc-b")]
    (tmp_path / "log").write_text("one two\nthree\nfour\n")
    assert sorted(map(tuple, files.read_query_log(spark, str(tmp_path / "log"), 2).collect())) == [(0, "one two"), (1, "three")]


def test_inverted_streams(spark, tmp_path):
    lists = [([0, 3], [2, 1]), ([1, 2, 3], [1, 1, 7])]
    docs, freqs = files.inverted_streams(lists, 4)
    (tmp_path / "d").write_bytes(docs)
    (tmp_path / "f").write_bytes(freqs)
    found, ndocs = files.read_inverted(spark, str(tmp_path / "d"), str(tmp_path / "f"))
    assert ndocs == 4 and sorted(map(tuple, found.collect())) == [(t, d, f) for t, (ds, fs) in enumerate(lists) for d, f in zip(ds, fs, strict=True)]


def test_index_of_binary_files(spark, tmp_path):
    triples = np.array([[0, 0, 2], [0, 3, 1], [2, 1, 5]], "<u4")
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "0.edges.bin").write_bytes(triples[:2].tobytes())
    (tmp_path / "e" / "1.edges.bin").write_bytes(triples[2:].tobytes())
    found = files.read_edges(spark, str(tmp_path / "e"))
    assert sorted(map(tuple, found.collect())) == [tuple(x) for x in triples.tolist()]
    shards = files.edge_shards(spark, str(tmp_path / "e"), 1, 2)
    assert [tuple(r) for r in shards.collect()] == [(1, 1)] and files.triples_bound(files.edge_shards(spark, str(tmp_path / "e")), 1, 2) == 2
    lexicon = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "term_id int, term string")
    labels = spark.createDataFrame([(0, "x")], "doc_id long, label string")
    index = Index.from_postings(found, 5, lexicon, labels, str(tmp_path / "i"))
    c = index.collection
    assert (c.ndocs, c.nterms, c.ntokens) == (5, 2, 8)
    assert sorted((r.doc_id, r.len, r.label) for r in index.docs.collect()) == [(0, 2, "x"), (1, 5, None), (2, 0, None), (3, 1, None), (4, 0, None)]
    top = retrieve(index, spark.createDataFrame([(1, "a c")], "qid long, text string"), "tfidf", 5)
    assert {r.doc_id for r in top.collect()} == {0, 1, 3}
    files.write_lexicon(index.terms, str(tmp_path / "lexicon"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lexicon")).collect()] == ["a", "c"]


def test_save_load_run_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b", "x"), (1, "b c", "y")], "doc_id long, text string, source string")
    index = Index.build(docs, str(tmp_path / "i"))
    index.save(str(tmp_path / "j"))
    again = Index.load(spark, str(tmp_path / "j"))
    assert again.collection == index.collection
    log = spark.createDataFrame([(1, "a"), (2, "b c")], "qid long, text string")
    top = retrieve(again, log, "f2exp", 5)
    files.write_run(top, str(tmp_path / "run"), "tag")
    lines = [r.value for r in spark.read.text(str(tmp_path / "run")).collect()]
    assert sorted(x.split()[:4] for x in lines) == [["1", "Q0", "0", "1"], ["2", "Q0", "0", "2"], ["2", "Q0", "1", "1"]]
    only = again.only(log.select(F.explode(tokens(F.col("text"))).alias("term")).where("term = 'b'"))
    assert only.postings.count() == 2 and only.collection == index.collection
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    answer_stream(stream, again, MODELS["f2exp"], 5, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("qid", "doc_id", "rank", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, top.collect()))
