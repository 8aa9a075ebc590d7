"""Masked pseudo-likelihood scores from a bidirectional window network: the network, and a model of fixed size.

The model of fixed size scores rows without a shuffle, such as those of a stream; `pseudo_likelihood` has the one whose
vocabulary grows with the corpus.

Every token is predicted from the tokens on both of its sides while itself hidden; the log-probabilities of a
document's tokens, each given its two sides, add up to its score.

1. Words are hashed to buckets (by their last byte and a hash); the executors count the buckets over the whole corpus.
   The most frequent buckets are classes of their own, the others form classes by last byte and frequency.
2. The executors count, over the whole corpus, how often each class stands between each pair of classes.  Partial counts
   are summed by slices of the key space; tables have a fixed number of cells, whatever the corpus.
3. On the driver a network (embeddings of the left and the right class, a hidden layer, a softmax over classes) is trained
   in numpy on these counts, with Adam, to predict the middle class.
4. P(token | sides) = P(class | sides) by the network, times the share of the token's bucket in its class.

Returned per row: id, n_tokens, pseudo_log_likelihood (sum of natural logarithms), per_token (their mean) and perplexity.
Nulls: a null text or one without words has 0 tokens, sum 0, and null per_token and perplexity; null or repeated ids are
kept as they are.  Empty tables give empty results; other columns are ignored.  Case counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B

COUNTS = "slice int, cells binary, counts binary"
_COUNTS = pa.schema([("slice", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
BITS, HEADS, ENDINGS, LEVELS = 20, 32, 16, 4
EDGE = 0
CLASSES = 1 + HEADS + ENDINGS * LEVELS


def _buckets(batch: pa.RecordBatch):
    t = B.Texts(pa.table({"doc_id": pa.nulls(batch.num_rows, pa.int64()), "text": batch.column("text")}))
    s, e, doc = B.word_spans(t.data, t.off, t.size)
    if not s.size:
        return t, doc, np.zeros(0, np.int64)
    (h,) = B.word_hashes(t.data, s, e)
    ending = (t.data[e - 1].astype(np.int64) * 151 >> 3) % ENDINGS
    return t, doc, (ending << (BITS - 4)) | (h >> B.U(64 - BITS + 4)).astype(np.int64)


def _sides(doc: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before and after each token; EDGE at the ends of a document."""
    left, right = np.full(cls.size, EDGE), np.full(cls.size, EDGE)
    same = doc[1:] == doc[:-1]
    left[1:][same] = cls[:-1][same]
    right[:-1][same] = cls[1:][same]
    return left, right


def _summed(rows: DataFrame, count, cells: int, slices: int = 64) -> np.ndarray:
    """The sum over all rows of count(batch), an array of `cells` counts; the driver gets its non-zero cells once."""

    def partial(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            total += count(batch)
        at = np.flatnonzero(total)
        cuts = np.searchsorted(at, np.arange(slices + 1) * -(-cells // slices))
        out = [(s, B.pack_sorted(at[a:b].astype(np.uint64)), B.pack(total[at[a:b]].astype(np.uint64))) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _COUNTS, strict=True)], schema=_COUNTS)

    def merge(table: pa.Table) -> pa.Table:
        at = np.concatenate([B.unpack_sorted(x) for x in table["cells"].to_pylist()])
        cell, inverse = np.unique(at, return_inverse=True)
        n = np.zeros(cell.size, np.int64)
        np.add.at(n, inverse, np.concatenate([B.unpack(x) for x in table["counts"].to_pylist()]).astype(np.int64))
        return pa.table([[table["slice"][0].as_py()], [B.pack_sorted(cell)], [B.pack(n.astype(np.uint64))]], _COUNTS)

    out = np.zeros(cells, np.int64)
    for r in rows.mapInArrow(partial, COUNTS).groupBy("slice").applyInArrow(merge, COUNTS).collect():  # `slices` rows
        out[B.unpack_sorted(r["cells"]).astype(np.int64)] = B.unpack(r["counts"]).astype(np.int64)
    return out


def token_classes(buckets: np.ndarray) -> np.ndarray:
    """The class of each bucket: the most frequent ones alone, the others by ending and level of frequency."""
    order = np.argsort(-buckets, kind="stable")
    ending = np.arange(buckets.size) >> (BITS - 4)
    rest = order[HEADS:]
    mass = np.cumsum(buckets[rest])
    level = np.empty(buckets.size, np.int64)
    level[rest] = np.minimum(LEVELS - 1, mass * LEVELS // max(1, int(mass[-1])))
    out = 1 + HEADS + ending * LEVELS + np.where(np.isin(np.arange(buckets.size), order[:HEADS]), 0, level)
    out[order[:HEADS]] = 1 + np.arange(min(HEADS, order.size))
    return out.astype(np.uint8)


class WindowNetwork:
    """softmax(V tanh(L[left] + R[right] + b) + c), trained on counts of (left, middle, right)."""

    def __init__(self, classes: int, hidden: int = 48, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, 0.3, (classes, hidden)), r.normal(0, 0.3, (classes, hidden)), np.zeros(hidden), r.normal(0, 0.3, (hidden, classes)), np.zeros(classes)]

    def forward(self, left: np.ndarray, right: np.ndarray):
        a, b, c, v, d = self.p
        h = np.tanh(a[left] + b[right] + c)
        s = h @ v + d
        s -= s.max(axis=1, keepdims=True)
        return h, s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    def train(self, counts: np.ndarray, steps: int = 200, rate: float = 0.05) -> list[float]:
        """counts[left, right, middle]; returns the losses."""
        k = counts.shape[0]
        n = counts.reshape(k * k, k) / max(1, counts.sum())
        left, right = np.divmod(np.arange(k * k), k)
        weight = n.sum(axis=1, keepdims=True)
        m, q, losses = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], []
        for t in range(1, steps + 1):
            h, logp = self.forward(left, right)
            losses.append(float(-(n * logp).sum()))
            g = weight * np.exp(logp) - n
            gh = (g @ self.p[3].T) * (1 - h * h)
            grid = gh.reshape(k, k, -1)
            ga, gb = grid.sum(axis=1), grid.sum(axis=0)
            for i, d in enumerate((ga, gb, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * d
                q[i] = 0.999 * q[i] + 0.001 * d * d
                self.p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(q[i] / (1 - 0.999**t)) + 1e-10)
        return losses

    def table(self) -> np.ndarray:
        """log P(middle | left, right) for all classes."""
        k = self.p[0].shape[0]
        left, right = np.divmod(np.arange(k * k), k)
        return self.forward(left, right)[1].reshape(k, k, k).astype(np.float32)


class MaskedModel:
    """What scoring needs: the class and the share of each bucket, and the network's table (both of fixed size)."""

    def __init__(self, classes: np.ndarray, share: np.ndarray, table: np.ndarray):
        self.classes, self.share, self.table = classes, share, table


def fit(docs: DataFrame, text_col: str = "text") -> MaskedModel:
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    buckets = _summed(rows, lambda batch: np.bincount(_buckets(batch)[2], minlength=1 << BITS), 1 << BITS)
    spark = docs.sparkSession
    classes = token_classes(buckets)
    shared = spark.sparkContext.broadcast(classes)

    def contexts(batch):
        _, doc, b = _buckets(batch)
        c = shared.value[b].astype(np.int64)
        left, right = _sides(doc, c)
        return np.bincount((left * CLASSES + right) * CLASSES + c, minlength=CLASSES**3)

    counts = _summed(rows, contexts, CLASSES**3).reshape(CLASSES, CLASSES, CLASSES)
    network = WindowNetwork(CLASSES)
    network.train(counts)
    own = np.bincount(classes, weights=buckets + 0.5, minlength=CLASSES)
    return MaskedModel(classes, np.log((buckets + 0.5) / own[classes]).astype(np.float32), network.table())


def score(docs: DataFrame, model: MaskedModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            t, doc, b = _buckets(batch)
            c = m.classes[b].astype(np.int64)
            left, right = _sides(doc, c)
            n = np.bincount(doc, minlength=batch.num_rows)
            total = np.bincount(doc, weights=m.table[left, right, c].astype(np.float64) + m.share[b], minlength=batch.num_rows)
            mean = total / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(total + 0.0), pa.array(mean, mask=n == 0), pa.array(np.exp(-mean), mask=n == 0)], ["doc_id", "n_tokens", "pseudo_log_likelihood", "per_token", "perplexity"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, pseudo_log_likelihood double, per_token double, perplexity double")
