"""Upper bounds of scores: per term, per block of a posting list, quantised, and per range of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.models import RankingModel
from quillrank.operators.scoring import impacts
from quillrank.sources.index import Index


@dataclass(frozen=True)
class BlockRule:
    """Blocks of 2**radix; terms of few postings have coarser document blocks, one more bit below each of the two limits."""

    radix: int = 3
    coarse_below: int = 1 << 17
    middle_below: int = 1 << 18
    rare_below: int = 1 << 15

    def shift(self, df: str = "df") -> Column:
        one = lambda limit: F.when(F.col(df) < limit, F.lit(1)).otherwise(F.lit(0))
        return F.lit(self.radix) + one(self.middle_below) + one(self.coarse_below)


def term_bounds(impact: DataFrame) -> DataFrame:
    """(term_id, bound): the largest impact, 0 at least."""
    return impact.groupBy("term_id").agg(F.greatest(F.lit(0.0), F.max("impact")).alias("bound"))


def document_blocks(impact: DataFrame, radix: int) -> DataFrame:
    """(term_id, block, bound): blocks of 2**radix consecutive document ids."""
    return impact.groupBy("term_id", F.shiftright("doc_id", radix).alias("block")).agg(F.greatest(F.lit(0.0), F.max("impact")).alias("bound"))


def classed_blocks(impact: DataFrame, index: Index, rule: BlockRule) -> DataFrame:
    """(term_id, block, bound) with the coarser blocks of terms of few postings."""
    with_df = impact.join(index.terms.select("term_id", "df"), "term_id")
    block = F.floor(F.col("doc_id") / F.pow(F.lit(2.0), rule.shift())).alias("block")
    return with_df.groupBy("term_id", block).agg(F.greatest(F.lit(0.0), F.max("impact")).alias("bound"))


def posting_blocks(impact: DataFrame, radix: int, own: Column | None = None) -> DataFrame:
    """(term_id, block, first_doc, last_doc, bound): blocks of 2**radix consecutive postings of a list.

    own: a document's part of the score; then doc_bound is its largest value in the block.
    """
    place = F.row_number().over(Window.partitionBy("term_id").orderBy("doc_id")) - 1
    rows = impact.withColumn("block", F.shiftright(place.cast("long"), radix))
    more = [] if own is None else [F.max(own).alias("doc_bound")]
    return rows.groupBy("term_id", "block").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.greatest(F.lit(0.0), F.max("impact")).alias("bound"), *more)


def quantised(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """blocks with qbound in 0..255, a multiple of the term's unit that is never below the bound, and the unit."""
    joined = blocks.join(terms.withColumnRenamed("bound", "term_bound"), "term_id").withColumn("unit", F.col("term_bound") / 255.0)
    steps = F.when(F.col("unit") > 0, F.ceil(F.col("bound") / F.col("unit"))).otherwise(F.lit(0))
    return joined.withColumn("qbound", F.greatest(F.lit(0), F.least(F.lit(255), steps)).cast("short"))


def looked_up(blocks: DataFrame, index: Index, rule: BlockRule) -> DataFrame:
    """The bound that a query reads: the exact one for rare terms, else the quantised one (0 stays 0)."""
    upper = F.when(F.col("qbound") == 0, F.lit(0.0)).otherwise(F.col("unit") * F.col("qbound") + F.lit(1e-4))
    joined = blocks.join(index.terms.select("term_id", "df"), "term_id")
    return joined.withColumn("read_bound", F.when(F.col("df") < rule.rare_below, F.col("bound")).otherwise(upper))


def document_bounds(index: Index, model: RankingModel, radix: int) -> DataFrame:
    """(block, bound): the largest own part of the documents in each range of 2**radix ids."""
    own = model.document_part(index.collection)
    part = F.lit(0.0) if own is None else own
    return index.docs.groupBy(F.shiftright("doc_id", radix).alias("block")).agg(F.max(part).alias("bound"))


def bound_histogram(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(bucket, n, share): block bounds as percent of their term's bound, in buckets of two percent."""
    joined = blocks.join(terms.withColumnRenamed("bound", "term_bound"), "term_id").where("term_bound > 0")
    percent = F.floor(F.lit(100.0) * F.col("bound") / F.col("term_bound") + 0.5)
    counted = joined.groupBy((F.floor(percent / 2) * 2).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))  # at most 51 rows


def held_term_bounds(index: Index, model: RankingModel) -> DataFrame:
    """term_bounds of the whole index, made once for a model and kept with the index."""
    return index.derived(f"term bounds {model!r}", lambda: term_bounds(impacts(index, model)))


def held_blocks(index: Index, model: RankingModel, radix: int) -> DataFrame:
    """document_blocks of the whole index, made once for a model and kept with the index."""
    return index.derived(f"document blocks {radix} {model!r}", lambda: document_blocks(impacts(index, model), radix))


def posting_ranges(impact: DataFrame, radix: int) -> DataFrame:
    """(term_id, block, bound): posting_blocks as bounds of the ranges of 2**radix document ids that hold a posting.

    A document scores by its own postings only, so the ranges between a block's documents need no row; rare lists span far more
    of them than they have postings.
    """
    place = F.row_number().over(Window.partitionBy("term_id").orderBy("doc_id")) - 1
    rows = impact.select("term_id", "impact", F.shiftright("doc_id", radix).alias("range"), F.shiftright(place.cast("long"), radix).alias("block"))
    blocks = rows.groupBy("term_id", "block").agg(F.collect_set("range").alias("ranges"), F.greatest(F.lit(0.0), F.max("impact")).alias("bound"))  # 2**radix at most
    return blocks.select("term_id", F.explode("ranges").alias("block"), "bound").groupBy("term_id", "block").agg(F.max("bound").alias("bound"))


def aligned(blocks: DataFrame, radix: int) -> DataFrame:
    """Blocks of lists, given by their first and last document, as bounds of ranges of 2**radix document ids."""
    spread = blocks.select("term_id", F.explode(F.sequence(F.shiftright("first_doc", radix), F.shiftright("last_doc", radix))).alias("block"), "bound")
    return spread.groupBy("term_id", "block").agg(F.max("bound").alias("bound"))
