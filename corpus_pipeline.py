"""From raw documents to token-ready ones: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  Rows
with a null id pass the duplicate stage (they have no links); null texts end at the language stage, as they have no letter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm import decontaminate, disclosure, language_id, ngram_join, prefix_bpe
from quillrank.llm._blocks import written

#: Documents whose language is less probable than this are rejected.
LEAST_SCORE = 0.5
#: How probable it may be that any word of its documents goes with an entity by chance.
CHANCE = 0.05


def _free(docs: DataFrame, name: str) -> str:
    """name, with a mark for every column of docs that has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is sure of; it learns from two thirds of the labelled ones."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    lang, score = _free(docs, "__lang"), _free(docs, "__score")
    found = language_id.predict(docs, model, label=lang, score=score)
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*(found[c] for c in docs.columns))


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents.

    A document is an id with a text: rows that share an id are told apart by their texts, of equal rows one stays.
    """
    key, n = _free(docs, "__key"), _free(docs, "__n")
    rows = docs.where("doc_id is not null").withColumn(key, F.xxhash64("doc_id", "text"))
    found = ngram_join.jaccard_components(rows, id_col=key).select(F.col("doc_id").alias(key), F.col("component_id").alias(n))
    first = F.min(F.struct("doc_id", key)).alias("first")
    kept = found.join(rows.select(key, "doc_id").distinct(), key).groupBy(n).agg(first).select(f"first.{key}")
    one = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    rows = rows.join(kept, key, "left_semi").withColumn(n, F.row_number().over(one)).where(F.col(n) == 1)
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it taken out of the texts.

    Words near an entity are terms by their share of its information, those of the whole document if chance does not explain them either.
    """
    return disclosure.sanitise(docs, chance=CHANCE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian unsigned 32-bit integers)."""
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [("language ID", language), ("n-gram Jaccard join", duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("SentencePiece encoding and decoding", tokens)]

#: SQL expresses neither the trained stage nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
