"""Bag-of-words scoring: query logs, impacts, accumulation and top-k, all as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.models import RankingModel
from quillrank.functions.tokens import bare, is_negated, tokens
from quillrank.sources.index import Index, small

DIGITS = 6


def parse_queries(queries: DataFrame, id_col: str = "qid", text_col: str = "text") -> DataFrame:
    """(qid, pos, term, negated): every token in order; a leading minus is taken off and does not change the score."""
    token = F.col("token")
    parsed = queries.select(F.col(id_col).cast("long").alias("qid"), F.posexplode(tokens(F.col(text_col))).alias("pos", "token"))
    return parsed.select("qid", "pos", bare(token).alias("term"), is_negated(token).alias("negated"))


def weigh_queries(parsed: DataFrame) -> DataFrame:
    """(qid, term, qtf, qlen): a term counts as often as it occurs; qlen counts unknown tokens as well."""
    per_term = parsed.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return per_term.withColumn("qlen", F.sum("qtf").over(Window.partitionBy("qid")))  # a query's own terms


def bind_queries(parsed: DataFrame, index: Index, weights: DataFrame | None = None) -> DataFrame:
    """(qid, term_id, df, cf, qtf, qlen) of the known terms; unknown ones drop out.

    weights(qid, term, weight): a term's part of the score is multiplied by its weight, by 1 without one.  Weights must not be negative.
    """
    weighed = weigh_queries(parsed)
    if weights is not None:
        weighed = weighed.join(weights, ["qid", "term"], "left").withColumn("qtf", F.col("qtf") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    vocabulary = weighed.select("term").distinct()
    known = index.terms.join(small(vocabulary), "term", "left_semi")
    return weighed.join(known, "term").select("qid", "term_id", "df", "cf", "qtf", "qlen")


def with_factors(terms: DataFrame, model: RankingModel, index: Index) -> DataFrame:
    return terms.select("*", *(e.alias(n) for n, e in model.term_factors(index.collection).items()))


def impacts(index: Index, model: RankingModel, terms: DataFrame | None = None, hint=small) -> DataFrame:
    """(term_id, doc_id, tf, len, impact) of all postings, or those of the given (term_id, df, cf)."""
    own = with_factors((index.terms if terms is None else terms).select("term_id", "df", "cf").distinct(), model, index)
    return index.postings.join(own if terms is None else hint(own), "term_id").select("term_id", "doc_id", "tf", "len", model.impact(index.collection).alias("impact"))


def matches(index: Index, bound: DataFrame, model: RankingModel, hint=small) -> DataFrame:
    """(qid, doc_id, term_id, len, qlen, part): one row per query term and posting.

    hint broadcasts the query side if it is small; a caller that knows its size gives its own.
    """
    side = hint(with_factors(bound, model, index))
    return index.postings.join(side, "term_id").select("qid", "doc_id", "term_id", "len", "qlen", (F.col("qtf") * model.impact(index.collection)).alias("part"))


def accumulate(found: DataFrame, model: RankingModel, index: Index) -> DataFrame:
    """(qid, doc_id, raw): posting parts and the document's own part; only positive scores stay."""
    own = model.document_part(index.collection)
    total = F.sum("part")
    if own is not None:
        sums = found.groupBy("qid", "doc_id").agg(total.alias("parts"), F.first("len").alias("len"), F.first("qlen").alias("qlen"))
        sums = sums.select("qid", "doc_id", (F.col("parts") + F.col("qlen") * own).alias("raw"))
    else:
        sums = found.groupBy("qid", "doc_id").agg(total.alias("raw"))
    return sums.where("raw > 0")


def rounded(raw: Column | str = "raw") -> Column:
    return F.round(F.col(raw) if isinstance(raw, str) else raw, DIGITS)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, rank, score): by rounded score, then the smaller document id; never padded."""
    ranked = scores.select("qid", "doc_id", rounded().alias("score"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id"))
    return ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("qid", "doc_id", "rank", "score")


def kth_scores(top: DataFrame, k: int) -> DataFrame:
    """(qid, threshold) of queries that have k results."""
    return top.where(F.col("rank") == k).select("qid", F.col("score").alias("threshold"))


def merged_top_k(scores: DataFrame, k: int, shards: int, local_k: int) -> DataFrame:
    """Top-k merged from each shard's own top local_k, with a flag where a shard may hold more of the answer.

    A document belongs to shard doc_id mod shards.  The flag `deep` is set for queries of whose answer some shard gave
    all of its local_k < k rows: there a second round with the threshold is due (complete_top_k).
    """
    shard = F.pmod(F.col("doc_id"), F.lit(shards)).alias("shard")
    ranked = scores.select("qid", "doc_id", rounded().alias("score"), shard)
    order = [F.col("score").desc(), F.col("doc_id")]
    local = ranked.withColumn("local_rank", F.row_number().over(Window.partitionBy("qid", "shard").orderBy(*order)).cast("long")).where(F.col("local_rank") <= local_k)
    merged = local.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long")).where(F.col("rank") <= k)
    deepest = F.max("local_rank").over(Window.partitionBy("qid"))
    return merged.withColumn("deep", (deepest == local_k) & F.lit(local_k < k)).select("qid", "doc_id", "rank", "score", "local_rank", "deep")


def complete_top_k(scores: DataFrame, k: int, shards: int, local_k: int) -> DataFrame:
    """Top-k from shards in two rounds, equal to top_k: after merged_top_k every shard gives, for the deep queries only, all
    rows that reach the merged k-th score (all its rows where fewer than k were merged).

    A row that the first round loses comes after its shard's local_k rows, which are then in the answer: the query is deep.
    """
    first = merged_top_k(scores, k, shards, local_k)
    due = first.where("deep").groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("threshold"))
    second = scores.join(small(due), "qid").where(F.col("threshold").isNull() | (rounded() >= F.col("threshold")))
    return first.where("not deep").select("qid", "doc_id", "rank", "score").unionByName(top_k(second, k))


def labelled(top: DataFrame, index: Index) -> DataFrame:
    """Hits with the document's label, cut at 26 characters."""
    return small(top).join(index.docs.select("doc_id", F.substring("label", 1, 26).alias("label")), "doc_id", "left").select("qid", "rank", "doc_id", "score", "label")
