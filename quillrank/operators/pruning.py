"""Top-k by score bounds: the same answers as the exhaustive plan, from fewer postings.

A threshold of each query is seeded by exact scores of a few documents: the k-th best of any subset is not above the
k-th best of all.  Ties are broken by document id, so a candidate is left out only if its bound is below the threshold by
more than rounding can hide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.models import RankingModel
from quillrank.operators import bounds
from quillrank.operators.scoring import accumulate, impacts, kth_scores, matches, top_k
from quillrank.sources.index import BROADCAST_ROWS, Index, small

SLACK = 2e-6


def held(pairs: DataFrame) -> DataFrame:
    """Pairs that filter postings, computed once; broadcast if there are few, so that postings are filtered before any shuffle."""
    pairs = pairs.cache()
    return F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs


def own_bound(index: Index, model: RankingModel) -> float:
    """The largest own part that any document has."""
    own = model.document_part(index.collection)
    return 0.0 if own is None else index.docs.agg(F.max(own)).first()[0] or 0.0


def split_lists(bound: DataFrame, term_bounds: DataFrame, thresholds: DataFrame, own: float = 0.0) -> DataFrame:
    """bound queries with `upto`, the sum of list bounds in order of falling df, and `essential`.

    Lists whose running sum stays below the threshold cannot lift a document to it by themselves.
    """
    order = Window.partitionBy("qid").orderBy(F.col("df").desc(), "term_id").rowsBetween(Window.unboundedPreceding, 0)
    listed = bound.join(term_bounds, "term_id").withColumn("upto", F.sum(F.col("qtf") * F.col("bound")).over(order))
    joined = listed.join(thresholds, "qid", "left")
    reach = F.col("upto") + F.col("qlen") * F.lit(own)
    return joined.withColumn("essential", F.coalesce(reach >= F.col("threshold") - SLACK, F.lit(True)))


def seeds(index: Index, bound: DataFrame, model: RankingModel, k: int, hint=small) -> DataFrame:
    """(qid, threshold): the k-th exact score among the documents of each query's rarest lists that hold k postings."""
    order = Window.partitionBy("qid").orderBy("df", "term_id").rowsBetween(Window.unboundedPreceding, -1)
    rare = bound.withColumn("before", F.coalesce(F.sum("df").over(order), F.lit(0))).where(F.col("before") < 2 * k)
    some = index.postings.join(hint(rare.select("qid", "term_id")), "term_id").select("qid", "doc_id").distinct()
    found = matches(index, bound, model, hint).join(held(some), ["qid", "doc_id"], "left_semi")
    return held(kth_scores(top_k(accumulate(found, model, index), k), k))


def maxscore(index: Index, bound: DataFrame, model: RankingModel, k: int, hint=small) -> DataFrame:
    """Candidates come from the essential lists only; the others complete their scores."""
    limits = bounds.held_term_bounds(index, model)
    split = split_lists(bound, limits, seeds(index, bound, model, k, hint), own_bound(index, model))
    candidates = index.postings.join(hint(split.where("essential").select("qid", "term_id")), "term_id").select("qid", "doc_id").distinct()
    found = matches(index, bound, model, hint).join(held(candidates), ["qid", "doc_id"], "left_semi")
    return top_k(accumulate(found, model, index), k)


def surviving_blocks(index: Index, bound: DataFrame, model: RankingModel, blocks: DataFrame, thresholds: DataFrame, radix: int, hint=small) -> DataFrame:
    """(qid, block) whose summed bounds reach the threshold."""
    sums = blocks.join(hint(bound.select("qid", "term_id", "qtf", "qlen")), "term_id").groupBy("qid", "block").agg(F.sum(F.col("qtf") * F.col("bound")).alias("reach"), F.first("qlen").alias("qlen"))
    own: Column = F.lit(0.0)
    if model.document_part(index.collection) is not None:
        sums = sums.join(bounds.document_bounds(index, model, radix).withColumnRenamed("bound", "own"), "block")
        own = F.col("qlen") * F.col("own")
    return sums.join(thresholds, "qid", "left").where(F.coalesce(F.col("reach") + own >= F.col("threshold") - SLACK, F.lit(True))).select("qid", "block")


def blockwise(index: Index, bound: DataFrame, model: RankingModel, k: int, radix: int = 3, layout: str = "document", variable: DataFrame | None = None, hint=small) -> DataFrame:
    """Scores only documents in ranges whose block bounds reach the threshold; layout: document, posting or variable blocks.

    Document blocks are kept with the index; the others are made of the queries' own lists, whose places take a sort.
    """
    if layout == "document":
        blocks = bounds.held_blocks(index, model, radix)
    elif layout == "posting":
        blocks = bounds.posting_ranges(impacts(index, model, bound, hint), radix)
    else:
        blocks = bounds.aligned(variable, radix)
    alive = surviving_blocks(index, bound, model, blocks, seeds(index, bound, model, k, hint), radix, hint)
    found = matches(index, bound, model, hint).withColumn("block", F.shiftright("doc_id", radix)).join(held(alive), ["qid", "block"], "left_semi")
    return top_k(accumulate(found, model, index), k)


def lazy(index: Index, bound: DataFrame, model: RankingModel, k: int, radix: int = 3, hint=small) -> DataFrame:
    """Ranges of documents first, then, inside each range that is left, candidates from its own essential lists only."""
    blocks = bounds.held_blocks(index, model, radix)
    thresholds = seeds(index, bound, model, k, hint)
    alive = held(surviving_blocks(index, bound, model, blocks, thresholds, radix, hint))
    inside = blocks.join(hint(bound), "term_id").join(alive, ["qid", "block"], "left_semi")
    order = Window.partitionBy("qid", "block").orderBy(F.col("df").desc(), "term_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum(F.col("qtf") * F.col("bound")).over(order)).join(thresholds, "qid", "left")
    reach = F.col("upto") + F.col("qlen") * F.lit(own_bound(index, model))
    essential = inside.where(F.coalesce(reach >= F.col("threshold") - SLACK, F.lit(True))).select("qid", "block", "term_id")
    found = matches(index, bound, model, hint)
    block = F.shiftright("doc_id", radix).alias("block")
    candidates = found.select("qid", "doc_id", "term_id", block).join(held(essential), ["qid", "block", "term_id"], "left_semi").select("qid", "doc_id").distinct()
    return top_k(accumulate(found.join(held(candidates), ["qid", "doc_id"], "left_semi"), model, index), k)
