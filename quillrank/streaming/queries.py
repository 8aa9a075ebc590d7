"""Queries that arrive as a stream, answered from a loaded index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillrank.functions.models import RankingModel
from quillrank.operators.scoring import accumulate, bind_queries, matches, parse_queries, top_k
from quillrank.sources.index import Index


def answer_stream(queries: DataFrame, index: Index, model: RankingModel, k: int, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Answers each micro-batch of (qid, text) as one job; a batch's answers are one folder, so replays do not repeat them."""

    def answer(batch: DataFrame, number: int) -> None:
        bound = bind_queries(parse_queries(batch), index)
        top = top_k(accumulate(matches(index, bound, model), model, index), k)
        top.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
