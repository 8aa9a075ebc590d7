"""Registered queries of the retrieval engine over a folder's documents (the corpus) and benchmark (the query log)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank import oracle
from quillrank.functions.models import MODELS
from quillrank.functions.permute import BucketPermutation, ModularPermutation
from quillrank.operators import bounds, cursors, elias_fano, pruning, reports, scoring, variable_blocks
from quillrank.plans.retrieval import retrieve
from quillrank.sources import files
from quillrank.sources.index import Index, index_of, shared_dir, small
from quillrank.streaming.queries import answer_stream

BM25, LMDIR = MODELS["bm25"], MODELS["lmdir"]
#: Small limits, so that every class of lists occurs in small collections.
RULE = bounds.BlockRule(radix=3, coarse_below=20, middle_below=100, rare_below=10)
QUERIES: dict = {}


def _registered(f):
    QUERIES[f.__name__] = f
    return f


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")


def _bound(spark: SparkSession, sf_dir: str) -> tuple[Index, DataFrame]:
    index = index_of(spark, sf_dir)
    return index, scoring.bind_queries(scoring.parse_queries(_log(spark, sf_dir)), index)


def _top(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return retrieve(index_of(spark, sf_dir), _log(spark, sf_dir), "bm25", k)


def _thresholds(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return scoring.kth_scores(_top(spark, sf_dir, k), k)


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---------------------------------------------------------------- index
@_registered
def postings(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return index.postings.join(index.terms, "term_id").select("term_id", "term", "doc_id", "tf")


@_registered
def term_stats(spark, sf_dir):
    return index_of(spark, sf_dir).terms


@_registered
def doc_stats(spark, sf_dir):
    return index_of(spark, sf_dir).docs


@_registered
def collection_stats(spark, sf_dir):
    return index_of(spark, sf_dir).collection_row()


@_registered
def index_reload(spark, sf_dir):
    """Saves the index, loads it again and counts its lists and postings."""
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    index_of(spark, sf_dir).save(path)
    index = Index.load(spark, path)
    return index.postings.agg(F.count_distinct("term_id").alias("lists"), F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"))


@_registered
def vocab_filter(spark, sf_dir):
    index = index_of(spark, sf_dir)
    own = index.only(scoring.parse_queries(_log(spark, sf_dir)).select("term"))
    return own.postings.join(small(own.terms), "term_id").select("term", "doc_id", "tf")


# ---------------------------------------------------------------- queries
@_registered
def query_terms(spark, sf_dir):
    index = index_of(spark, sf_dir)
    known = index.terms.select("term", F.lit(True).alias("known"))
    parsed = scoring.parse_queries(_log(spark, sf_dir))
    return small(parsed).join(known, "term", "left").select("qid", "pos", "term", "negated", F.coalesce("known", F.lit(False)).alias("known"))


@_registered
def query_unknown_terms(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return scoring.weigh_queries(scoring.parse_queries(_log(spark, sf_dir))).join(index.terms, "term", "left_anti").select("qid", "term", "qtf", "qlen")


@_registered
def negated_query_hits(spark, sf_dir):
    """Every token with a minus sign: the same answers as without."""
    log = _log(spark, sf_dir).select("qid", F.regexp_replace("text", r"(?<=^|[ \n])(?=[^ \n])", "-").alias("text"))
    return retrieve(index_of(spark, sf_dir), log, "bm25", 10)


def _topk(model: str, strategy: str, k: int):
    return lambda spark, sf_dir: retrieve(index_of(spark, sf_dir), _log(spark, sf_dir), model, k, strategy)


for _model in MODELS:
    QUERIES[f"topk_{_model}"] = _topk(_model, "exhaustive", 10)
QUERIES["topk_bm25_k1000"] = _topk("bm25", "exhaustive", 1000)
for _model, _strategy in [
    *((m, "maxscore") for m in ("bm25", "f2exp", "lmdir", "pl2", "spl")),
    *((m, "lazy") for m in ("bm25", "lmdir", "pl2")),
    *((m, "document_blocks") for m in ("bm25", "f2exp", "lmdir", "pl2", "spl")),
    ("bm25", "posting_blocks"),
    ("bm25", "variable_blocks"),
]:
    QUERIES[f"topk_{_model}_{_strategy}"] = _topk(_model, _strategy, 10)
QUERIES["topk_bm25_k1000_maxscore"] = _topk("bm25", "maxscore", 1000)


@_registered
def weighted_topk(spark, sf_dir):
    """Every query's terms with a weight: twice the score of longer terms."""
    weights = scoring.parse_queries(_log(spark, sf_dir)).where("length(term) > 5").select("qid", "term", F.lit(2.0).alias("weight")).distinct()
    return retrieve(index_of(spark, sf_dir), _log(spark, sf_dir), "bm25", 10, weights=weights)


@_registered
def impact_table(spark, sf_dir):
    index, bound = _bound(spark, sf_dir)
    return scoring.impacts(index, BM25, bound).select("term_id", "doc_id", *_six("impact"))


@_registered
def impact_table_complete(spark, sf_dir):
    """impact_table of all lists, those of no query as well."""
    return scoring.impacts(index_of(spark, sf_dir), BM25).select("term_id", "doc_id", *_six("impact"))


@_registered
def merged_topk(spark, sf_dir):
    """The first round, with the flag of queries that need the second."""
    index, bound = _bound(spark, sf_dir)
    return scoring.merged_top_k(scoring.accumulate(scoring.matches(index, bound, BM25), BM25, index), 10, 4, 3)


@_registered
def merged_topk_complete(spark, sf_dir):
    """merged_topk with its second round: the rows of topk_bm25."""
    index, bound = _bound(spark, sf_dir)
    return scoring.complete_top_k(scoring.accumulate(scoring.matches(index, bound, BM25), BM25, index), 10, 4, 3)


@_registered
def labelled_hits(spark, sf_dir):
    return scoring.labelled(_top(spark, sf_dir), index_of(spark, sf_dir))


@_registered
def trec_run(spark, sf_dir):
    return files.run_lines(_top(spark, sf_dir), "bm25")


@_registered
def stream_topk_bm25(spark, sf_dir):
    """The query log as a stream of files, answered batch by batch."""
    schema = spark.read.parquet(f"{sf_dir}/benchmark.parquet").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/benchmark*").select(F.col("item_id").alias("qid"), "text")
    out = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    answer_stream(arriving, index_of(spark, sf_dir), BM25, 10, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("qid", "doc_id", "rank", "score")


# ---------------------------------------------------------------- bounds
@_registered
def term_max_impact(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return bounds.term_bounds(scoring.impacts(index, BM25)).select("term_id", *_six("bound"))


@_registered
def block_max_docid(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return bounds.classed_blocks(scoring.impacts(index, BM25), index, RULE).select("term_id", "block", *_six("bound"))


@_registered
def block_max_posting(spark, sf_dir):
    index = index_of(spark, sf_dir)
    blocks = bounds.posting_blocks(scoring.impacts(index, LMDIR), 3, LMDIR.document_part(index.collection))
    return blocks.select("term_id", "block", "first_doc", "last_doc", *_six("bound", "doc_bound"))


@_registered
def quantized_bounds(spark, sf_dir):
    index = index_of(spark, sf_dir)
    impact = scoring.impacts(index, BM25)
    blocks = bounds.quantised(bounds.classed_blocks(impact, index, RULE), bounds.term_bounds(impact))
    return bounds.looked_up(blocks, index, RULE).select("term_id", "block", F.col("qbound").cast("int").alias("qbound"), *_six("read_bound"))


@_registered
def doc_bounds_lmdir(spark, sf_dir):
    return bounds.document_bounds(index_of(spark, sf_dir), LMDIR, 3).select("block", *_six("bound"))


@_registered
def block_fraction_histogram(spark, sf_dir):
    index = index_of(spark, sf_dir)
    impact = scoring.impacts(index, BM25)
    return bounds.bound_histogram(bounds.classed_blocks(impact, index, RULE), bounds.term_bounds(impact))


@_registered
def vbmw_partition(spark, sf_dir):
    index, bound = _bound(spark, sf_dir)
    return variable_blocks.variable_blocks(scoring.impacts(index, BM25, bound))


@_registered
def essential_lists(spark, sf_dir):
    index, bound = _bound(spark, sf_dir)
    return pruning.split_lists(bound, bounds.held_term_bounds(index, BM25), _thresholds(spark, sf_dir)).select("qid", "term_id", "df", *_six("upto"), "essential")


# ---------------------------------------------------------------- reports
@_registered
def df_classes(spark, sf_dir):
    return reports.df_classes(index_of(spark, sf_dir).terms, (10, 50, 100))


@_registered
def df_log2_histogram(spark, sf_dir):
    return reports.df_histogram(index_of(spark, sf_dir).terms)


@_registered
def score_checksum(spark, sf_dir):
    return reports.checksum(_thresholds(spark, sf_dir))


@_registered
def query_length_buckets(spark, sf_dir):
    lengths = scoring.weigh_queries(scoring.parse_queries(_log(spark, sf_dir))).select("qid", "qlen").distinct()
    return reports.by_query_length(_thresholds(spark, sf_dir), lengths, "threshold")


@_registered
def threshold_percentiles(spark, sf_dir):
    return reports.percentiles(_thresholds(spark, sf_dir), "threshold")


@_registered
def threshold_spread(spark, sf_dir):
    return reports.spread(_thresholds(spark, sf_dir), F.col("threshold")).select(*_six("mean", "least", "largest", "variance"))


@_registered
def cursor_counters(spark, sf_dir):
    index, bound = _bound(spark, sf_dir)
    return cursors.counters(scoring.matches(index, bound, BM25), 10)


# ---------------------------------------------------------------- lists
@_registered
def tf_delta_codec(spark, sf_dir):
    index = index_of(spark, sf_dir)
    running = elias_fano.running_tf(index.postings).join(index.terms.select("term_id", "df", "cf"), "term_id")
    return elias_fano.decoded_tf(running).select("term_id", "doc_id", "at", "tf_decoded")


@_registered
def ef_size_report(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return elias_fano.size_report(index.postings, index.collection.ndocs, forward_every=256)


@_registered
def ef_roundtrip(spark, sf_dir):
    index, bound = _bound(spark, sf_dir)
    own = index.postings.join(small(bound.select("term_id").distinct()), "term_id", "left_semi")
    return elias_fano.decode_lists(elias_fano.encode_lists(own))


@_registered
def ef_roundtrip_complete(spark, sf_dir):
    """ef_roundtrip of all lists."""
    return elias_fano.decode_lists(elias_fano.encode_lists(index_of(spark, sf_dir).postings))


@_registered
def next_geq(spark, sf_dir):
    index, bound = _bound(spark, sf_dir)
    targets = bound.select("term_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 97, 500, 950)))).alias("target"))
    return elias_fano.next_at_least(index.postings, targets)


@_registered
def posting_moves(spark, sf_dir):
    index, bound = _bound(spark, sf_dir)
    return elias_fano.moved(index.postings.join(small(bound.select("term_id").distinct()), "term_id", "left_semi"), 3)


@_registered
def posting_moves_complete(spark, sf_dir):
    """posting_moves of all lists."""
    return elias_fano.moved(index_of(spark, sf_dir).postings, 3)


def _permuted(spark, sf_dir, kind):
    """All order keys, moved and moved back within 0..largest."""
    v = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("v")).distinct()
    p = kind(v.agg(F.max("v")).first()[0] + 1)
    return v.withColumn("moved", p.apply(F.col("v"))).withColumn("back", p.invert(F.col("moved")))


@_registered
def hash_bucket(spark, sf_dir):
    return _permuted(spark, sf_dir, BucketPermutation)


@_registered
def hash_modulo(spark, sf_dir):
    return _permuted(spark, sf_dir, ModularPermutation)


ORACLE_SQL: dict[str, str] = {k: v for k, v in oracle.statements().items() if k in QUERIES}
