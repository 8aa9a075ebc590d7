"""Scores, strategies and bounds, on a hand-computed corpus and on random ones."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillrank.functions.models import MODELS
from quillrank.operators import bounds, cursors, pruning, reports, variable_blocks
from quillrank.operators.scoring import accumulate, bind_queries, complete_top_k, impacts, kth_scores, labelled, matches, merged_top_k, parse_queries, top_k, weigh_queries
from quillrank.plans.retrieval import STRATEGIES, retrieve
from quillrank.sources.index import Index

TEXTS = ["a b a c", "b c d", "a a a a e e", "c c d f g h i j", "e", "k l m n o p"]
LOG = [(1, "a c"), (2, "-e zzz"), (3, "d d b")]
#: Hand-computed answers: model -> query -> (document, score).
GOLDEN = {
    "bm25": {1: [(2, 0.391820), (0, 0.337489), (1, 0.000001), (3, 0.000001)], 2: [(2, 0.328666), (4, 0.275802)], 3: [(1, 0.792636), (3, 0.478187), (0, 0.258775)]},
    "f2exp": {1: [(0, 1.040843), (2, 0.714286), (3, 0.512821), (1, 0.465116)], 2: [(2, 0.555556), (4, 0.540541)], 3: [(1, 1.395349), (3, 0.689655), (0, 0.434783)]},
    "lmdir": {1: [(0, 0.003325), (2, 0.002645), (1, 0.000398)], 2: [(4, 0.002927), (2, 0.002645)], 3: [(1, 0.013155), (3, 0.001584), (0, 0.000788)]},
    "pl2": {1: [(3, 1.991915), (1, 1.640998), (0, 1.548947)], 2: [(2, 2.453627), (4, 2.279725)], 3: [(1, 7.084383), (3, 3.890409), (0, 2.247148)]},
    "spl": {1: [(0, 3.158610), (2, 2.231923), (3, 1.705925), (1, 1.464908)], 2: [(2, 1.939301), (4, 1.853339)], 3: [(1, 5.273436), (3, 2.880207), (0, 1.671439)]},
    "numterms": {1: [(1, 1.0)], 2: [(4, 2.0)], 3: []},
}


def _index(spark, texts, path):
    docs = spark.createDataFrame([(i, t, f"label-of-a-document-number-{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return Index.build(docs, str(path))


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    return _index(spark, TEXTS, tmp_path_factory.mktemp("golden"))


def _log(spark, rows):
    return spark.createDataFrame(rows, "qid long, text string")


def _rows(top):
    out = defaultdict(list)
    for r in top.orderBy("qid", "rank").collect():
        out[r.qid].append((r.doc_id, r.score))
    return out


@pytest.mark.parametrize("model", list(GOLDEN))
def test_golden_scores(spark, golden, model):
    found = _rows(retrieve(golden, _log(spark, LOG), model, 10))
    for qid, want in GOLDEN[model].items():
        assert [d for d, _ in found[qid]] == [d for d, _ in want]
        assert [s for _, s in found[qid]] == pytest.approx([s for _, s in want], abs=1.1e-6)


def test_collection_and_statistics(golden):
    c = golden.collection
    assert (c.ndocs, c.nterms, c.ntokens, round(c.avg_doclen, 4)) == (6, 16, 28, 4.6667)
    terms = {r.term: (r.df, r.cf) for r in golden.terms.collect()}
    assert {t: terms[t] for t in "abcde"} == {"a": (2, 6), "b": (2, 2), "c": (3, 4), "d": (2, 2), "e": (2, 3)}
    assert sorted(r.term_id for r in golden.terms.collect()) == list(range(16))


def test_documents_without_tokens_count(spark, tmp_path):
    index = _index(spark, ["a b", "", None, " \t\x0b "], tmp_path)
    assert (index.collection.ndocs, index.collection.avg_doclen) == (4, 0.5)
    assert sorted((r.doc_id, r.len) for r in index.docs.collect()) == [(0, 2), (1, 0), (2, 0), (3, 0)]


def test_empty_collection(spark, tmp_path):
    index = _index(spark, [], tmp_path)
    assert retrieve(index, _log(spark, LOG), "bm25", 10).count() == 0


def test_query_parsing(spark, golden):
    parsed = parse_queries(_log(spark, [(1, " a  -b\t- c\x0bd "), (2, None)]))
    assert [(r.pos, r.term, r.negated) for r in parsed.orderBy("pos").collect()] == [(0, "a", False), (1, "b", True), (2, "", True), (3, "c", False), (4, "d", False)]
    weighed = {r.term: (r.qtf, r.qlen) for r in weigh_queries(parse_queries(_log(spark, LOG))).where("qid = 3").collect()}
    assert weighed == {"d": (2, 3), "b": (1, 3)}


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(60)], k=r.randrange(1, 40))) for _ in range(300)]
    log = [(q, " ".join(r.choices(words, k=r.randrange(1, 8)))) for q in range(12)]
    return _index(spark, texts, tmp_path_factory.mktemp("crowd")), _log(spark, log).cache()


@pytest.mark.parametrize("model", ["bm25", "f2exp", "lmdir", "pl2", "spl", "tfidf"])
@pytest.mark.parametrize("k", [1, 10])
def test_strategies_agree(spark, crowd, model, k):
    index, log = crowd
    want = _rows(retrieve(index, log, model, k))
    for strategy in STRATEGIES[1:]:
        assert _rows(retrieve(index, log, model, k, strategy)) == want, strategy


def test_deep_results_agree(crowd):
    index, log = crowd
    assert _rows(retrieve(index, log, "bm25", 1000, "maxscore")) == _rows(retrieve(index, log, "bm25", 1000))


def test_bounds_hold(crowd):
    index, _ = crowd
    rule = bounds.BlockRule(radix=2, coarse_below=40, middle_below=100, rare_below=20)
    impact = impacts(index, MODELS["bm25"]).cache()
    terms = bounds.term_bounds(impact)
    assert impact.join(terms, "term_id").where("impact > bound").count() == 0
    blocks = bounds.looked_up(bounds.quantised(bounds.classed_blocks(impact, index, rule), terms), index, rule)
    assert blocks.where("read_bound < bound or qbound < 0 or qbound > 255").count() == 0
    posted = bounds.posting_blocks(impact, 3)
    inside = impact.join(posted, "term_id").where("doc_id between first_doc and last_doc")
    assert inside.count() == impact.count() and inside.where("impact > bound").count() == 0


def test_posting_block_ranges_are_no_more_than_postings(spark, tmp_path, monkeypatch):
    """Words of two far documents: their blocks span all ranges of documents between, which need no rows."""
    index = _index(spark, [f"w{i % 200} all" + " all" * (i % 7) for i in range(400)], tmp_path / "index")
    log = _log(spark, [(i, f"w{i} all w{i + 1}") for i in range(20)])
    given, kept = [], pruning.surviving_blocks
    monkeypatch.setattr(pruning, "surviving_blocks", lambda *a: given.append(a[3]) or kept(*a))
    want = _rows(retrieve(index, log, "bm25", 3))
    assert _rows(retrieve(index, log, "bm25", 3, "posting_blocks")) == want
    own = impacts(index, MODELS["bm25"], bind_queries(parse_queries(log), index)).withColumn("block", F.shiftright("doc_id", 3))
    assert given[0].count() == own.select("term_id", "block").distinct().count()
    assert own.join(given[0], ["term_id", "block"]).where("impact <= bound").count() == own.count()


def test_build_leaves_the_index_only(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    _index(spark, TEXTS, tmp_path / "index")
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["docs", "postings", "terms"] and spark.conf.get(name, None) == before


def test_variable_blocks_partition_lists(crowd):
    index, _ = crowd
    impact = impacts(index, MODELS["bm25"]).cache()
    blocks = variable_blocks.variable_blocks(impact, fixed=1.0)
    assert blocks.agg(F.sum("size")).first()[0] == impact.count()
    inside = impact.join(blocks, "term_id").where("doc_id between first_doc and last_doc")
    assert inside.count() == impact.count() and inside.where("impact > bound + 1e-12").count() == 0


def test_variable_partition_is_near_the_best():
    r = random.Random(2)
    for _ in range(20):
        x = [r.choice([0.1, 1.0, r.random()]) for _ in range(40)]
        best = [0.0] + [1e9] * 40
        for b in range(1, 41):
            best[b] = min(best[a] + 0.5 + max(x[a:b]) * (b - a) - sum(x[a:b]) for a in range(b))
        import numpy as np

        cost, a = 0.0, 0
        for b in variable_blocks.partition(np.array(x), 0.5):
            cost, a = cost + 0.5 + max(x[a:b]) * (b - a) - sum(x[a:b]), b
        assert a == 40 and cost <= best[40] * 1.75 + 1e-9


def test_essential_lists(spark, crowd):
    index, log = crowd
    bound = bind_queries(parse_queries(log), index)
    limits = bounds.held_term_bounds(index, MODELS["bm25"])
    top = retrieve(index, log, "bm25", 10)
    split = pruning.split_lists(bound, limits, kth_scores(top, 10)).collect()
    assert all(r.essential == (r.threshold is None or r.upto >= r.threshold - pruning.SLACK) for r in split)


def test_merged_top_k_flags_deep_shards(crowd):
    index, log = crowd
    bound = bind_queries(parse_queries(log), index)
    scores = accumulate(matches(index, bound, MODELS["bm25"]), MODELS["bm25"], index)
    want, merged = _rows(top_k(scores, 10)), merged_top_k(scores, 10, 3, 10)
    assert _rows(merged) == want and merged.where("deep").count() == 0
    shallow = merged_top_k(scores, 10, 3, 4)
    deep = {r.qid for r in shallow.where("deep").collect()}
    assert all(v == want[q] for q, v in _rows(shallow).items() if q not in deep)


@pytest.mark.parametrize(("k", "local_k"), [(10, 1), (10, 3), (1000, 2)])
def test_second_round_completes_merged_top_k(crowd, k, local_k):
    index, log = crowd
    scores = accumulate(matches(index, bind_queries(parse_queries(log), index), MODELS["bm25"]), MODELS["bm25"], index)
    want = _rows(top_k(scores, k))
    assert _rows(merged_top_k(scores, k, 3, local_k)) != want
    assert _rows(complete_top_k(scores, k, 3, local_k)) == want


def test_cursor_strategies_give_the_same_checksum(crowd):
    index, log = crowd
    found = matches(index, bind_queries(parse_queries(log), index), MODELS["bm25"])
    rows = defaultdict(dict)
    for r in cursors.counters(found, 5).collect():
        rows[r.qid][r.strategy] = r
    for by in rows.values():
        assert by["exhaustive"].checksum == pytest.approx(by["maxscore"].checksum, abs=1e-5)
        assert by["maxscore"].postings <= by["exhaustive"].postings


def test_labels_and_reports(spark, golden):
    top = retrieve(golden, _log(spark, LOG), "bm25", 2)
    assert {len(r.label) for r in labelled(top, golden).collect()} == {26}
    th = kth_scores(top, 2)
    assert reports.checksum(th).first()[0] == pytest.approx(sum(round(r.threshold, 3) for r in th.collect()), abs=1e-9)
    values = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert [tuple(r) for r in reports.percentiles(values, "v").orderBy("percent").collect()] == [(25, 2.0), (50, 5.0), (90, 9.0), (95, 9.0), (99, 9.0)]
    assert [tuple(r) for r in reports.df_histogram(golden.terms).orderBy("log2_df").collect()] == [(0, 11, 16), (1, 5, 5)]
