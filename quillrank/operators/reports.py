"""Reports on indexes, query logs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def df_classes(terms: DataFrame, limits: tuple[int, ...] = (1 << 15, 1 << 17, 1 << 18), unit: int = 64) -> DataFrame:
    """One row: how many lists reach each limit (`at_least_<limit>`), and the lists' total of units of postings."""
    return terms.agg(*(F.count_if(F.col("df") >= x).alias(f"at_least_{x}") for x in limits), F.coalesce(F.sum(F.ceil(F.col("df") / float(unit))), F.lit(0)).cast("long").alias("units"))


def df_histogram(terms: DataFrame) -> DataFrame:
    """(log2_df, n, n_from_top): lists by floor(log2(df)), and how many are at least that long."""
    counted = terms.groupBy(F.floor(F.log2(F.col("df").cast("double"))).alias("log2_df")).agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy(F.lit(0)).orderBy(F.col("log2_df").desc()).rowsBetween(Window.unboundedPreceding, 0)  # 64 rows at most
    return counted.withColumn("n_from_top", F.sum("n").over(top))


def checksum(thresholds: DataFrame) -> DataFrame:
    """One row: the sum of the k-th scores, each rounded to three digits; queries without k results add nothing."""
    return thresholds.agg(F.round(F.coalesce(F.sum(F.round("threshold", 3)), F.lit(0.0)), 3).alias("checksum"), F.count(F.lit(1)).alias("full_queries"))


def by_query_length(values: DataFrame, lengths: DataFrame, value: str, most: int = 8) -> DataFrame:
    """(bucket, n, mean) of a value per query, by min(number of tokens, most); unknown tokens count."""
    joined = values.join(lengths, "qid").withColumn("bucket", F.least(F.col("qlen"), F.lit(most)))
    return joined.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def percentiles(values: DataFrame, value: str, percents: tuple[int, ...] = (25, 50, 90, 95, 99)) -> DataFrame:
    """(percent, value): the element at place n * percent div 100, from 0, of the values in order."""
    order = Window.partitionBy(F.lit(0)).orderBy(value)  # a value per query of the log
    ranked = values.select(F.col(value).alias("value"), (F.row_number().over(order) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    wanted = ranked.select("value", "place", F.explode(F.array(*(F.struct(F.lit(p).alias("percent"), F.floor(F.col("n") * p / 100.0).cast("long").alias("want")) for p in percents))).alias("w"))
    return wanted.where(F.col("place") == F.col("w.want")).select("w.percent", "value")


def spread(values: DataFrame, value: Column) -> DataFrame:
    """One row: mean, least, largest and sample variance."""
    return values.agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest"), F.var_samp(value).alias("variance"))
