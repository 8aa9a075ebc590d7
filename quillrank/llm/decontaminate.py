"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

A benchmark item of m characters occurs in a document if some part of the document is within `budget(m)` edits of it.
Every such part shares at least m - q + 1 - q * budget q-grams with the item, and their diagonals (place in the document
less place in the item) span at most the budget.  So shared q-grams are counted in overlapping diagonal bands, twice the
budget wide and one budget apart; regions that reach the bound are kept and aligned, in a band, with free ends in the document.
Items too short for the bound are sought verbatim.  Case is ignored; places are code points of the document.  Of the regions
that pass, those are returned that overlap none that is nearer to the item (or as near, and earlier): an item can have several.

Documents are processed row by row, without a shuffle.  The benchmark is a fixed set that travels with the tasks; beyond
`part_bytes` it is taken in several parts, one pass each.

Nulls: a null or empty text matches nothing, a null or empty item is no item.  A row with a null id keeps a null id.
Items that share an id are separate items of one id.  Empty tables give empty results; other columns are kept or ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
_K = [U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]


def _lower(x: str) -> str:
    y = x.lower()
    return y if len(y) == len(x) else "".join(c.lower() if len(c.lower()) == 1 else c for c in x)


def _codes(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(code: np.ndarray) -> np.ndarray:
    """A hash of the eight characters from each place."""
    h = code.astype(np.uint64)
    for step, k in zip((1, 2, 4), _K, strict=True):
        if h.size <= step:
            return np.zeros(0, np.uint64)
        h = (h[:-step] * k) ^ (h[step:] + (h[:-step] >> U(29)))
    h *= _K[0]
    return h ^ (h >> U(31))


class Benchmark:
    q = 8

    def __init__(self, ids: list[int], texts: list[str], rate: float = 0.08):
        self.ids, self.texts = ids, [_lower(x) for x in texts]
        self.codes = [_codes(x) for x in self.texts]
        size = np.array([c.size for c in self.codes], np.int64)
        self.budget = np.floor(rate * size).astype(np.int64)
        self.least = size - self.q + 1 - self.q * self.budget
        self.verbatim = [i for i in range(len(ids)) if self.least[i] < 1 and size[i]]
        long = [i for i in range(len(ids)) if self.least[i] >= 1]
        grams = [gram_hashes(self.codes[i]) for i in long]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.array(long, np.int64), [g.size for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(g.size) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], item[order], place[order]
        self.distinct, self.first, self.many = np.unique(self.h, return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.h >> U(42)] = True

    def _hits(self, code: np.ndarray):
        """(place in the document, place in the index) of each shared q-gram."""
        h = gram_hashes(code)
        at = np.flatnonzero(self.maybe[h >> U(42)])
        if not at.size:
            return at, at
        k = np.searchsorted(self.distinct, h[at])
        k[k == self.distinct.size] = 0
        ok = self.distinct[k] == h[at]
        at, k = at[ok], k[ok]
        n = self.many[k]
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), np.repeat(self.first[k], n) + run

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item's place in the benchmark, start, end, distance) of all places of each item that occurs, its nearest first."""
        if not text:
            return []
        low, out = _lower(text), []
        for i in self.verbatim:
            out += [(i, a, a + len(self.texts[i]), 0) for a in _occurrences(low, self.texts[i])]
        if not self.h.size or len(low) < self.q:
            return out
        code = _codes(low)
        at, k = self._hits(code)
        if not at.size:
            return out
        item = self.item[k]
        use = np.bincount(item, minlength=len(self.ids))[item] >= self.least[item]
        at, k, item = at[use], k[use], item[use]
        for i in np.unique(item).tolist():
            own = item == i
            out += [(i, *x) for x in self._align(code, low, i, at[own], at[own] - self.place[k[own]])]
        return sorted(out, key=lambda x: (x[0], x[3], x[1]))

    def _align(self, code, low, i: int, at: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int, int]]:
        """The places of item i, from its q-grams at places of the document and their diagonals."""
        e, m = int(self.budget[i]), len(self.texts[i])
        found = [(0, a, a + m) for a in _occurrences(low, self.texts[i])]
        if found:  # a region that overlaps none of them has no q-gram in them
            begin = np.array([a for _, a, _ in found])
            k = np.searchsorted(begin, at, side="right") - 1
            outside = (k < 0) | (at + self.q > begin[k] + m)
            diagonal = diagonal[outside]
        if diagonal.size >= self.least[i]:
            step = max(1, e)
            base = -(-diagonal.min() // step) * step if diagonal.min() > 0 else diagonal.min() // step * step - step
            band = (diagonal - base) // step
            n = np.bincount(band - band.min() + 1)
            n = n + np.append(n[1:], 0)  # band b and the one after it: two steps wide, one step apart
            for b in np.flatnonzero(n >= self.least[i]).tolist():
                lo = int(base + (b + int(band.min()) - 1) * step)
                got = banded(self.codes[i], code, lo - e, lo + 2 * step + e)
                if got and got[2] <= e:
                    found.append((got[2], got[0], got[1]))
        out: list[tuple[int, int, int]] = []
        for d, a, b in sorted(found):
            if all(b <= x or y <= a for x, y, _ in out):
                out.append((a, b, d))
        return out


def _occurrences(text: str, part: str) -> list[int]:
    """Where part occurs, from left to right without overlaps."""
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + len(part))
    return out


def _last_row(item: np.ndarray, text: np.ndarray, lo: int, hi: int, free: bool) -> np.ndarray:
    """Edit distances of the whole item to parts of the text that end on each diagonal lo..hi; free: they start on any diagonal, else at 0."""
    width = hi - lo + 1
    far = item.size + width + 1
    k = np.arange(width)
    row = np.zeros(width, np.int64) if free else np.abs(k + lo) + np.where(k + lo < 0, far, 0)
    row[(k + lo < 0) | (k + lo > text.size)] = far
    for i in range(item.size):
        j = k + lo + i  # the character of the text that the diagonal meets in this row
        ok = (j >= 0) & (j < text.size)
        miss = np.ones(width, np.int64)
        miss[ok] = text[j[ok]] != item[i]
        new = row + miss
        new[~ok] = far
        up = np.append(row[1:], far) + 1
        new = np.minimum(new, up)
        new[(j + 1 < 0) | (j + 1 > text.size)] = far
        row = np.minimum.accumulate(new - k) + k
        row[(j + 1 < 0) | (j + 1 > text.size)] = far
    return row


def banded(item: np.ndarray, text: np.ndarray, lo: int, hi: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the part of the text nearest to the item, on diagonals lo..hi."""
    row = _last_row(item, text, lo, hi, True)
    k = int(row.argmin())
    end = k + lo + item.size
    if end < 0 or end > text.size:
        return None
    # back from the end: the same alignment of the reversed strings, held at that end
    width = hi - lo
    back = _last_row(item[::-1], text[:end][::-1], -width, width, False)
    s = int(back.argmin())
    return end - (s - width + item.size), end, int(row[k])


def benchmarks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", rate: float = 0.08, part_bytes: int = 8 << 20) -> list[Benchmark]:
    """The items, in parts of at most about part_bytes of text."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-total // part_bytes)
    out = []
    for p in range(parts):
        own = sorted((r.id if r.id is not None else -1, r.text) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).collect())
        out.append(Benchmark([i for i, _ in own], [x for _, x in own], rate))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, start, end, distance) of every place at which a benchmark item occurs in a document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "item_id", "start", "end", "distance"]
    schema = ", ".join(f"`{n}` long" for n in names)

    def run(part: Benchmark):
        def scan(batches):
            for batch in batches:
                out = [(i, part.ids[m], a, b, d) for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m, a, b, d in part.find(x)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

        return rows.mapInArrow(scan, schema)

    found = [run(p) for p in benchmarks(items, **options)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, unchanged, in which no benchmark item occurs."""
    names = docs.columns

    def run(part: Benchmark):
        def scan(batches):
            for batch in batches:
                yield batch.filter(pa.array([not part.find(x) for x in batch.column(names.index(text_col)).to_pylist()], pa.bool_()))

        return scan

    for p in benchmarks(items, **options):
        docs = docs.mapInArrow(run(p), docs.schema)
    return docs
