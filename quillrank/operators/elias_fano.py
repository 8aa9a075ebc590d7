"""Elias-Fano lists of rising numbers: sizes as columns, and a numpy codec with a cursor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def low_bits(universe: Column, size: Column) -> Column:
    """floor(log2(universe / size)), 0 for dense lists."""
    return F.when(universe > size, F.floor(F.log2(universe.cast("double") / size))).otherwise(F.lit(0)).cast("long")


def size_report(postings: DataFrame, universe: int, skip_every: int = 0, forward_every: int = 0) -> DataFrame:
    """(term_id, n, last, low_bits, lower_bytes, upper_bytes, pointer_bytes, total_bytes) of each list of doc ids."""
    lists = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    bits = low_bits(F.lit(universe), F.col("n"))
    out = lists.withColumn("low_bits", bits)
    out = out.withColumn("lower_bytes", F.ceil(F.col("low_bits") * F.col("n") / 8.0).cast("long"))
    upper = F.floor(F.col("last") / F.pow(F.lit(2.0), F.col("low_bits"))).cast("long") + F.col("n")
    out = out.withColumn("upper_bytes", F.ceil(upper / 8.0).cast("long"))
    pointers = (F.floor((upper - F.col("n")) / skip_every) if skip_every else F.lit(0)) + (F.floor(F.col("n") / forward_every) if forward_every else F.lit(0))
    out = out.withColumn("pointer_bytes", (pointers * 4).cast("long"))
    return out.withColumn("total_bytes", F.col("lower_bytes") + F.col("upper_bytes") + F.col("pointer_bytes"))


def running_tf(postings: DataFrame) -> DataFrame:
    """postings with `at`, the list's sum of tf - 1 before each posting: a rising list that an Elias-Fano code can hold."""
    order = Window.partitionBy("term_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return postings.withColumn("at", F.coalesce(F.sum(F.col("tf") - 1).over(order), F.lit(0)))


def decoded_tf(running: DataFrame) -> DataFrame:
    """tf again, from differences of `at`; the last of a list needs the list's total (cf)."""
    order = Window.partitionBy("term_id").orderBy("doc_id")
    following = F.coalesce(F.lead("at").over(order), F.col("cf") - F.col("df"))
    return running.withColumn("tf_decoded", F.lit(1) + following - F.col("at"))


class EliasFano:
    """A rising list of non-negative integers: low bits packed, high parts in unary."""

    def __init__(self, values, universe: int | None = None):
        v = np.asarray(values, dtype=np.int64)
        if v.size and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("values must rise from 0 on")
        self.size = int(v.size)
        top = universe if universe is not None else int(v[-1]) if v.size else 0
        self.low = max(0, (top // v.size).bit_length() - 1) if v.size and top > v.size else 0
        bits = ((v[:, None] >> np.arange(self.low)) & 1).astype(np.uint8).ravel()
        self.lower = np.packbits(bits, bitorder="little")
        high = v >> self.low
        upper = np.zeros(int(high[-1]) + self.size if v.size else 0, np.uint8)
        upper[high + np.arange(self.size)] = 1
        self.upper = np.packbits(upper, bitorder="little")

    @property
    def nbytes(self) -> int:
        return self.lower.size + self.upper.size

    def to_bytes(self) -> bytes:
        head = np.array([self.size, self.low, self.lower.size], "<i8").tobytes()
        return head + self.lower.tobytes() + self.upper.tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> EliasFano:
        out = EliasFano([])
        out.size, out.low, n = np.frombuffer(raw, "<i8", 3).tolist()
        out.lower, out.upper = np.frombuffer(raw, np.uint8, n, 24), np.frombuffer(raw, np.uint8, -1, 24 + n)
        return out

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The places of the given set bits of the upper part."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))
        return ones[ranks]

    def decode(self) -> np.ndarray:
        if not self.size:
            return np.zeros(0, np.int64)
        high = self.select(np.arange(self.size)) - np.arange(self.size)
        bits = np.unpackbits(self.lower, bitorder="little", count=self.size * self.low).reshape(self.size, self.low)
        return (high << self.low) | (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1)

    def cursor(self) -> Cursor:
        return Cursor(self.decode())


class Cursor:
    """A place in a decoded list; starts before the first value.  Moves return whether a value is there."""

    def __init__(self, values: np.ndarray):
        self.values, self.place = values, -1

    @property
    def valid(self) -> bool:
        return 0 <= self.place < self.values.size

    @property
    def value(self) -> int:
        return int(self.values[self.place])

    @property
    def previous_value(self) -> int:
        return int(self.values[self.place - 1])

    def reset(self) -> None:
        self.place = -1

    def _to(self, place: int) -> bool:
        self.place = int(min(max(place, -1), self.values.size))
        return self.valid

    def next(self) -> bool:
        return self._to(self.place + 1)

    def previous(self) -> bool:
        return self._to(self.place - 1)

    def skip(self, n: int) -> bool:
        return self._to(self.place + n)

    def jump(self, n: int) -> bool:
        """To the n-th value, from 1; 0 is before the first."""
        return self._to(n - 1)

    def skip_to(self, v: int) -> bool:
        """To the first value from here on that is v at least; stays if the present one is."""
        at = max(self.place, 0)
        return self._to(at + int(np.searchsorted(self.values[at:], v)))

    def jump_to(self, v: int) -> bool:
        return self._to(int(np.searchsorted(self.values, v)))


def encode_lists(postings: DataFrame, segment_bits: int = 20) -> DataFrame:
    """(term_id, base, n, docs, freqs): doc ids, less base, and running tf as Elias-Fano bytes.

    A list is coded in segments of 2**segment_bits doc ids, so that the longest list is no single task's.  A partition's lists
    come sorted and are coded one after another.
    """

    def coded(term: np.ndarray, base: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (base[1:] != base[:-1])))
        ends = np.append(first[1:], term.size)
        sums = np.append(0, np.cumsum(tf - 1))
        docs = [EliasFano(doc[a:b] - base[a]).to_bytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        freqs = [EliasFano(sums[a : b + 1] - sums[a]).to_bytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(term[first], pa.int32()), base[first], ends - first, pa.array(docs, pa.binary()), pa.array(freqs, pa.binary())], ["term_id", "base", "n", "docs", "freqs"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            held = [np.concatenate([h, np.asarray(c, np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            term, base = held[:2]
            before = np.flatnonzero((term != term[-1:]) | (base != base[-1:]))  # the last list may go on
            cut = int(before[-1]) + 1 if before.size else 0
            if cut:
                yield coded(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if held[0].size:
            yield coded(*held)

    base = F.shiftleft(F.shiftright("doc_id", segment_bits), segment_bits).alias("base")
    rows = postings.select("term_id", base, "doc_id", "tf").repartition("term_id", "base").sortWithinPartitions("term_id", "doc_id")
    return rows.mapInArrow(run, "term_id int, base long, n long, docs binary, freqs binary")


def decode_lists(encoded: DataFrame) -> DataFrame:
    """(term_id, doc_id, tf) of encode_lists."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            docs = [base + EliasFano.from_bytes(x).decode() for base, x in zip(rows["base"], rows["docs"], strict=True)]
            tf = [1 + np.diff(EliasFano.from_bytes(x).decode()) for x in rows["freqs"]]
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows["term_id"], [d.size for d in docs]), pa.int32()), np.concatenate(docs), np.concatenate(tf)], ["term_id", "doc_id", "tf"])

    return encoded.mapInArrow(run, "term_id int, doc_id long, tf long")


def next_at_least(postings: DataFrame, targets: DataFrame) -> DataFrame:
    """(term_id, target, doc_id): the first posting of the list at or after each target, null past the end."""
    t = targets.select("term_id", "target").distinct()
    found = t.join(postings, "term_id").where("doc_id >= target").groupBy("term_id", "target").agg(F.min("doc_id").alias("doc_id"))
    return t.join(found, ["term_id", "target"], "left")


def moved(postings: DataFrame, n: int) -> DataFrame:
    """postings with the ids n postings on (`skipped`), one before (`previous`), and the list's n-th (`jumped`)."""
    order = Window.partitionBy("term_id").orderBy("doc_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return postings.select("term_id", "doc_id", F.lead("doc_id", n).over(order).alias("skipped"), F.lag("doc_id").over(order).alias("previous"), F.nth_value("doc_id", n).over(whole).alias("jumped"))
