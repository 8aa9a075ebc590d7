"""Readers and writers of the file formats around an index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions.tokens import first_token

RUN_LINE = "qid Q0 doc rank score tag"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of a text file, numbered from 0 in order of the file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("row"))
    part = F.shiftright("row", 33)
    sizes = lines.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per partition
    return lines.withColumn("part", part).join(F.broadcast(before), "part").select((F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("line"), "value")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, term): a line's number and first token.  Lines that begin with a space keep their number but are skipped; of equal terms the first counts."""
    rows = read_lines(spark, path).where(~F.startswith("value", F.lit(" "))).select(F.col("line").alias("term_id"), first_token(F.col("value")).alias("term"))
    return rows.where("term <> ''").groupBy("term").agg(F.min("term_id").alias("term_id")).select("term_id", "term")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, label): a line's number and first token."""
    return read_lines(spark, path).select(F.col("line").alias("doc_id"), first_token(F.col("value")).alias("label"))


def read_query_log(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """(qid, text): the first `most` lines."""
    return read_lines(spark, path).where(F.col("line") < most).select(F.col("line").alias("qid"), F.col("value").alias("text"))


def run_lines(top: DataFrame, tag: str, doc: str = "doc_id", shift: int = 0) -> DataFrame:
    """(line): `qid Q0 doc rank score tag` of each hit."""
    score = F.format_string("%.6f", F.col("score"))
    return top.select(F.concat_ws(" ", (F.col("qid") + shift).cast("string"), F.lit("Q0"), F.col(doc).cast("string"), F.col("rank").cast("string"), score, F.lit(tag)).alias("line"))


def write_run(top: DataFrame, path: str, tag: str, doc: str = "doc_id") -> None:
    """A run file in order of queries and ranks."""
    ordered = top.repartitionByRange("qid").sortWithinPartitions("qid", "rank")
    run_lines(ordered, tag, doc).write.mode("overwrite").text(path)


def postings_of_streams(docs: DataFrame, freqs: DataFrame) -> tuple[DataFrame, int]:
    """((term_id, doc_id, tf), number of documents) of a pair of streams of unsigned 32-bit integers, each the one row of a `content`.

    The docs stream begins with (1, ndocs); then both give for every term its number of postings and that many values.
    The streams have no index, so one task walks each; the postings leave it list by list.
    """

    def lists(raw: bytes, skip: int):
        a, at, term = np.frombuffer(raw, "<u4"), skip, 0
        while at < a.size:
            n = int(a[at])
            yield term, a[at + 1 : at + 1 + n].astype(np.int64)
            at, term = at + 1 + n, term + 1

    def walk(skip: int, name: str):
        def run(batches):
            for rows in batches:
                for raw in rows["content"]:
                    for term, values in lists(raw, skip):
                        yield pd.DataFrame({"term_id": np.full(values.size, term, np.int32), "place": np.arange(values.size), name: values})

        return run

    one, ndocs = np.frombuffer(bytes(docs.select(F.substring("content", 1, 8)).first()[0]), "<u4").tolist()
    if one != 1:
        raise ValueError("the stream of documents does not begin with 1 and their number")
    ids = docs.mapInPandas(walk(2, "doc_id"), "term_id int, place long, doc_id long")
    counts = freqs.mapInPandas(walk(0, "tf"), "term_id int, place long, tf long")
    return ids.join(counts, ["term_id", "place"]).select("term_id", "doc_id", "tf"), ndocs


def read_inverted(spark: SparkSession, docs_path: str, freqs_path: str) -> tuple[DataFrame, int]:
    """postings_of_streams of two files."""
    stream = lambda path: spark.read.format("binaryFile").load(path).select("content")
    return postings_of_streams(stream(docs_path), stream(freqs_path))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, doc_id, tf) of files of packed triples (term, document, weight) of unsigned 32-bit integers."""

    def run(batches):
        for rows in batches:
            for raw in rows["content"]:
                a = np.frombuffer(raw, "<u4").reshape(-1, 3).astype(np.int64)
                yield pd.DataFrame({"term_id": a[:, 0].astype(np.int32), "doc_id": a[:, 1], "tf": a[:, 2]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "term_id int, doc_id long, tf long")


def edge_shards(spark: SparkSession, folder: str, rank: int = 0, ranks: int = 1) -> DataFrame:
    """(shard, triples) of the files <shard>.edges.bin that a rank owns: every ranks-th from its own number on; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.edges.bin").load(folder).select("path", "length")
    shard = F.regexp_extract("path", r"([0-9]+)\.edges\.bin$", 1).cast("int")
    return files.select(shard.alias("shard"), F.floor(F.col("length") / 12).alias("triples")).where((F.col("shard") >= rank) & ((F.col("shard") - rank) % ranks == 0))


def triples_bound(shards: DataFrame, terms: int, ndocs: int) -> int:
    """No more triples than the shards hold, or than every needed term in every document."""
    return min(shards.agg(F.coalesce(F.sum("triples"), F.lit(0))).first()[0], terms * ndocs)


def write_lexicon(terms: DataFrame, path: str) -> None:
    """The terms as lines, in order of their ids."""
    terms.repartitionByRange("term_id").sortWithinPartitions("term_id").select("term").write.mode("overwrite").text(path)


def inverted_streams(lists: list[tuple[list[int], list[int]]], ndocs: int) -> tuple[bytes, bytes]:
    """The two streams of lists of (doc ids, frequencies)."""
    docs, freqs = [np.array([1, ndocs], "<u4")], []
    for d, f in lists:
        docs += [np.array([len(d)], "<u4"), np.array(d, "<u4")]
        freqs += [np.array([len(f)], "<u4"), np.array(f, "<u4")]
    return b"".join(x.tobytes() for x in docs), b"".join(x.tobytes() for x in freqs)
