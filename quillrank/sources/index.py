"""The inverted index as tables: built from documents, written, loaded."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions.models import Collection
from quillrank.functions.tokens import tokens

#: Query sides of at most so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where the session names none."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/quillrank-shared").rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a job's shuffles go when it ends: for steps that are each written and read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that a step wrote for itself."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is checked to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def count_postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, len) of docs(doc_id, text).

    The texts are dealt by id, which is the only shuffle: a document's words then stand together and are counted where they are.
    """
    words = docs.repartition("doc_id").select("doc_id", tokens(F.col("text")).alias("words"))
    words = words.select("doc_id", F.size("words").alias("len"), F.explode("words").alias("term"))
    return words.groupBy("term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))


def with_dense_ids(df: DataFrame, key: str, name: str, path: str) -> DataFrame:
    """df, with distinct values of key, and their ranks from 0.

    Ranges of keys are numbered apart and shifted by what is before them.  They are written to path first: computed again, the
    ranges could be cut at other keys.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, key).sortWithinPartitions(key)
    row = F.monotonically_increasing_id()
    ranged.select("*", F.shiftright(row, 33).alias("__part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")).write.mode("overwrite").parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row per range
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__at")).cast("int")).drop("__part", "__at", "__before")


@dataclass
class Index:
    """postings(term_id, doc_id, tf, len), terms(term_id, term, df, cf), docs(doc_id, degree, len, label), and their totals."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    collection: Collection
    path: str | None = None
    held: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def derived(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that depends on the index alone, made at its first use and written beside the index."""
        if name not in self.held:
            table = make()
            if self.path:
                path = f"{self.path}/derived-{uuid.uuid4().hex}"
                table.write.parquet(path)
                table = self.spark.read.parquet(path)
            self.held[name] = table
        return self.held[name]

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    @staticmethod
    def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = "source") -> Index:
        """Writes the index tables to path (a folder that all executors share) and loads them.

        Every document counts for the totals, also those without a token; ids are unique.  Postings are written in ranges of term
        and document ids, sorted, so that a scan for a few terms skips row groups and a long list is in several files; a
        document's length stands in its postings, which spares queries the join with the documents.
        """
        spark = docs.sparkSession
        raw = f"{path}/raw"
        label = F.col(label_col) if label_col else F.lit(None)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), label.cast("string").alias("label"), F.col(text_col).alias("text"))
        with shuffles_freed(spark):
            count_postings(rows).write.mode("overwrite").parquet(raw)
            found = spark.read.parquet(raw)
            Index._write_docs(rows.select("doc_id", "label"), found, path)
            terms = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
            with_dense_ids(terms, "term", "term_id", f"{path}/ranges").select("term_id", "term", "df", "cf").write.mode("overwrite").parquet(f"{path}/terms")
            named = found.join(small(spark.read.parquet(f"{path}/terms").select("term", "term_id")), "term")
            named.select("term_id", "doc_id", "tf", "len").write.mode("overwrite").parquet(f"{path}/named")  # the ranges are sampled first: the join runs once
            dropped(spark, raw, f"{path}/ranges")
            Index._write_postings(spark.read.parquet(f"{path}/named"), path)
            dropped(spark, f"{path}/named")
        return Index.load(spark, path)

    @staticmethod
    def from_postings(postings: DataFrame, ndocs: int, lexicon: DataFrame, labels: DataFrame | None, path: str) -> Index:
        """An index of ready postings(term_id, doc_id, tf) over documents 0..ndocs-1, with lexicon(term_id, term) and labels(doc_id, label).

        Statistics count all postings; terms that the lexicon lacks cannot be asked for and get no list.
        """
        spark = postings.sparkSession
        terms = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))
        terms.join(lexicon, "term_id").select(F.col("term_id").cast("int").alias("term_id"), "term", "df", "cf").write.mode("overwrite").parquet(f"{path}/terms")
        docs = spark.range(ndocs).select(F.col("id").alias("doc_id"))
        docs = docs.join(labels.select("doc_id", "label"), "doc_id", "left") if labels is not None else docs.withColumn("label", F.lit(None).cast("string"))
        Index._write_docs(docs, postings, path)
        own = postings.join(spark.read.parquet(f"{path}/terms").select("term_id"), "term_id", "left_semi")
        Index._write_postings(own.join(spark.read.parquet(f"{path}/docs").select("doc_id", "len"), "doc_id"), path)
        return Index.load(spark, path)

    @staticmethod
    def _write_docs(docs: DataFrame, found: DataFrame, path: str) -> None:
        sizes = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("tf").cast("long").alias("len"))
        rows = docs.join(sizes, "doc_id", "left")
        rows.select("doc_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("len", F.lit(0)).alias("len"), "label").write.mode("overwrite").parquet(f"{path}/docs")

    @staticmethod
    def _write_postings(found: DataFrame, path: str) -> None:
        posted = found.select(F.col("term_id").cast("int").alias("term_id"), "doc_id", F.col("tf").cast("long").alias("tf"), F.col("len").cast("int").alias("len"))
        posted.repartitionByRange("term_id", "doc_id").sortWithinPartitions("term_id", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        postings, terms, docs = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "docs"))
        n = docs.agg(F.count(F.lit(1)).alias("ndocs"), F.coalesce(F.sum("len"), F.lit(0)).alias("ntokens")).first()
        return Index(postings, terms, docs, Collection(n.ndocs, terms.count(), n.ntokens, n.ntokens / n.ndocs if n.ndocs else 0.0), path)

    def save(self, path: str) -> None:
        """Copies the tables, the postings sorted by ranges of terms and documents."""
        self.postings.repartitionByRange("term_id", "doc_id").sortWithinPartitions("term_id", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")

    def only(self, vocabulary: DataFrame) -> Index:
        """The index with the posting lists of some terms; statistics stay those of the whole collection."""
        ids = self.terms.join(small(vocabulary.select("term").distinct()), "term", "left_semi")
        return Index(self.postings.join(small(ids.select("term_id")), "term_id", "left_semi"), ids, self.docs, self.collection)

    def collection_row(self) -> DataFrame:
        c = self.collection
        return self.spark.createDataFrame([(c.ndocs, c.nterms, c.ntokens, c.avg_doclen)], "ndocs long, nterms long, ntokens long, avg_doclen double")


_HELD: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder's documents, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HELD:
        name = hashlib.sha1("/".join(key).encode()).hexdigest()[:12]
        _HELD[key] = Index.build(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/index-{name}-{uuid.uuid4().hex[:6]}")
    return _HELD[key]
