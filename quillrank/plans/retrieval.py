"""Retrieval plans: model, strategy and depth are arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.models import MODELS, RankingModel
from quillrank.operators import pruning, variable_blocks
from quillrank.operators.scoring import accumulate, bind_queries, impacts, matches, parse_queries, top_k
from quillrank.sources.index import BROADCAST_ROWS, Index

STRATEGIES = ("exhaustive", "maxscore", "lazy", "document_blocks", "posting_blocks", "variable_blocks")


def retrieve(index: Index, queries: DataFrame, model: RankingModel | str = "bm25", k: int = 10, strategy: str = "exhaustive", radix: int = 3, weights: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, rank, score) for all of queries(qid, text), as one plan; every strategy gives the same rows."""
    model = MODELS[model] if isinstance(model, str) else model
    bound = bind_queries(parse_queries(queries), index, weights)
    if strategy == "exhaustive":
        return top_k(accumulate(matches(index, bound, model), model, index), k)
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    # the pruned plans read the query side several times: it is counted once
    bound = bound.cache()
    hint = F.broadcast if bound.count() <= BROADCAST_ROWS else lambda df: df
    if strategy == "maxscore":
        return pruning.maxscore(index, bound, model, k, hint)
    if strategy == "lazy":
        return pruning.lazy(index, bound, model, k, radix, hint)
    layout = strategy.removesuffix("_blocks")
    variable = variable_blocks.variable_blocks(impacts(index, model, bound, hint)) if layout == "variable" else None
    return pruning.blockwise(index, bound, model, k, radix, layout, variable, hint)
