"""Masked pseudo-likelihood scores with a vocabulary that grows with the corpus.

Every token is predicted from the words on both of its sides while itself hidden; the log-probabilities of a
document's tokens, each given its two sides, add up to its score.

1. Texts are cut into blocks of some megabytes, each written once as its distinct words (64-bit keys of whole words) with
   counts, and the sequence of its tokens.  Blocks send their words by slices of the key space (see _blocks); a slice answers with
   the counts over the whole corpus.  So the vocabulary is a distributed table, which nothing holds as a whole.
2. The most frequent words, about 8 * tokens ** 0.2 of them, are classes of their own, which the network predicts as words; the others
   form classes by last byte and by quarters of the mass of counts.
3. The executors count, over the whole corpus, how often each class stands between each pair of classes: cells of (pair, class),
   added up by Spark and packed in parts that hold whole pairs.
4. On the driver a network (embeddings of the left and the right class, a hidden layer, a softmax over the classes) is trained in
   numpy on these counts, part after part, by Adam on pairs drawn by their frequency, each with the whole distribution of its middle.
5. P(token | sides) = P(class | sides) by the network, times the share of the token's word in its class by the corpus counts.
   Half an occurrence is added to every word, and to the class of rare words one more word that stands for all unknown ones.

The network and the frequent words travel with the tasks: some hundred kilobytes, which grow with tokens ** 0.4.

Returned per row: id, n_tokens, pseudo_log_likelihood (sum of natural logarithms), per_token (their mean) and perplexity.
Nulls: a null text or one without words has 0 tokens, sum 0, and null per_token and perplexity; null or repeated ids are
kept as they are.  Empty tables give empty results; other columns are ignored.  Case counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from .masked_lm import WindowNetwork, _sides

ENDINGS, LEVELS = 16, 4
_LAST = B.U(ENDINGS - 1)
BLOCKS = "trains boolean, scored boolean, block long, n_types long, n_tokens long, ids array<long>, sizes binary, words binary, counts binary, sequence binary"
_BLOCKS = pa.schema([("trains", pa.bool_()), ("scored", pa.bool_()), ("block", pa.int64()), ("n_types", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("sizes", "words", "counts", "sequence"))])
LISTS = "slice int, block long, trains boolean, words binary, counts binary"
_LISTS = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("trains", pa.bool_()), ("words", pa.binary()), ("counts", pa.binary())])
TOTALS = "block long, slice int, answer binary, top binary, bins binary"
_TOTALS = pa.schema([("block", pa.int64()), ("slice", pa.int32()), ("answer", pa.binary()), ("top", pa.binary()), ("bins", pa.binary())])
CLASSED = "trains boolean, scored boolean, ids array<long>, sizes binary, shares binary, classes binary"
_CLASSED = pa.schema([("trains", pa.bool_()), ("scored", pa.bool_()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("shares", pa.binary()), ("classes", pa.binary())])
SCORES = "doc_id long, n_tokens long, pseudo_log_likelihood double, per_token double, perplexity double"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- words
def word_keys(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The key of each word: its hash, with the group of its last byte in the last bits."""
    (h,) = B.word_hashes(data, s, e)
    ending = (data[e - 1].astype(np.uint64) * B.U(151) >> B.U(3)) & _LAST
    return (h & ~_LAST) | ending


def count_bins(counts: np.ndarray) -> np.ndarray:
    """Bins of counts, eight to a doubling; 0 for a count of 0."""
    return np.where(counts > 0, 1 + np.floor(8 * np.log2(np.maximum(counts, 1))), 0).astype(np.int64)


def _pieces(batch: pa.RecordBatch, most: int):
    """Rows of a batch in runs of about `most` bytes of text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)) // most
    cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def _blocks(docs: DataFrame, id_col: str, text_col: str, trains: bool, scored: bool, block_bytes: int) -> DataFrame:
    def block(held: list, number: int) -> pa.RecordBatch:
        t = B.Texts(pa.Table.from_batches(held))
        s, e, doc = B.word_spans(t.data, t.off, t.size)
        words, sequence, counts = np.unique(word_keys(t.data, s, e), return_inverse=True, return_counts=True)
        sizes = np.bincount(doc, minlength=t.ids.size)
        B.tidy()
        return _batch([(trains, scored, number, words.size, s.size, t.id_column(), B.pack(sizes), B.pack_sorted(words), B.pack(counts), B.pack(sequence))], _BLOCKS)

    def run(batches):
        number, held, size = (2 * TaskContext.get().partitionId() + trains) << 32, [], 0
        for batch in batches:
            for piece in _pieces(batch, block_bytes):
                held.append(piece)
                size += piece.nbytes
                if size >= block_bytes:
                    yield block(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(held, number)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, BLOCKS)


def _lists(slices: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = B.unpack_sorted(r["words"]), B.unpack(r["counts"])
                cuts = B.slice_cuts(words, 64, slices)
                rows = [(s, r["block"], r["trains"], B.pack_sorted(words[a:b]), B.pack(counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
                if rows:
                    yield _batch(rows, _LISTS)

    return run


def _totals(heads: int):
    """For groupBy(slice): the corpus count of each entry; in a row without a block, the slice's most frequent words and its
    words by ending and bin of count: (ending, bin, occurrences, words)."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [B.unpack_sorted(r["words"]) for r in rows]
        counts = np.concatenate([B.unpack(r["counts"]) * B.U(r["trains"]) for r in rows])
        words, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.zeros(words.size, np.uint64)
        np.add.at(total, place, counts)
        parts = np.split(total[place], np.cumsum([x.size for x in lists])[:-1])
        slice_ = rows[0]["slice"]
        out = [(r["block"], slice_, B.pack(x), None, None) for r, x in zip(rows, parts, strict=True)]
        seen = np.flatnonzero(total)
        best = seen[np.lexsort((words[seen].astype(np.int64), ~total[seen]))[:heads]]
        kind, inverse = np.unique((words[seen] & _LAST).astype(np.int64) << 32 | count_bins(total[seen]), return_inverse=True)
        mass = np.zeros(kind.size, np.uint64)
        np.add.at(mass, inverse, total[seen])
        bins = np.concatenate([kind >> 32, kind & 0xFFFFFFFF, mass.astype(np.int64), np.bincount(inverse, minlength=kind.size)])
        out.append((None, slice_, None, np.concatenate([words[best], total[best]]).tobytes(), bins.tobytes()))
        return pa.Table.from_batches([_batch(out, _TOTALS)])

    return merge


def _unpacked(column: str, names: list[str]):
    """Rows of int64 from the equally long arrays that a binary column holds one after another."""

    def run(batches):
        for batch in batches:
            for x in batch.column(column).to_pylist():
                yield pa.RecordBatch.from_arrays(list(np.frombuffer(x, np.int64).reshape(len(names), -1)), names)

    return run


@dataclass
class Vocabulary:
    """Which words are classes, and how counts make classes of the others."""

    heads: np.ndarray  # keys, the most frequent first
    levels: np.ndarray  # the level of each bin of counts
    own: np.ndarray  # of each class the occurrences, with what is added to them

    @property
    def classes(self) -> int:
        return self.own.size

    @staticmethod
    def of(heads: list[tuple[int, int]], bins: list[tuple[int, int, int, int]]) -> Vocabulary:
        """heads: (key, count); bins: (ending, bin, occurrences, words) of all words, the heads among them."""
        keys, counts = (np.array(x, np.uint64) for x in zip(*heads, strict=True)) if heads else (np.zeros(0, np.uint64),) * 2
        top = max([b for _, b, _, _ in bins], default=0) + 1
        mass, words = np.zeros((ENDINGS, top)), np.zeros((ENDINGS, top))
        for ending, b, m, n in bins:
            mass[ending, b] += m
            words[ending, b] += n
        at = (keys & _LAST).astype(np.int64), count_bins(counts)
        np.add.at(mass, at, -counts.astype(float))
        np.add.at(words, at, -1.0)
        above = mass.sum(axis=0)[::-1].cumsum()[::-1] - mass.sum(axis=0)
        levels = np.minimum(LEVELS - 1, above * LEVELS // max(1.0, mass.sum())).astype(np.int64)
        levels[0] = LEVELS - 1
        rest = np.zeros((ENDINGS, LEVELS))
        np.add.at(rest.T, levels, (mass + 0.5 * words).T)
        rest[:, LEVELS - 1] += 0.5
        return Vocabulary(keys, levels, np.concatenate([[0.0], counts + 0.5, rest.ravel()]))

    def class_of(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        bins = np.minimum(count_bins(counts), self.levels.size - 1)
        out = 1 + self.heads.size + (keys & _LAST).astype(np.int64) * LEVELS + self.levels[bins]
        order = np.argsort(self.heads)
        if order.size:
            at = np.minimum(np.searchsorted(self.heads[order], keys), order.size - 1)
            found = self.heads[order][at] == keys
            out[found] = 1 + order[at[found]]
        return out

    def share_of(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log P(word | its class)."""
        return np.log(counts.astype(float) + 0.5) - np.log(self.own[classes])


# ---------------------------------------------------------------- the network
class ContextNetwork(WindowNetwork):
    """The window network, trained on cells (pair = left * classes + right, middle) with counts, on pairs drawn by their frequency."""

    def __init__(self, classes: int, hidden: int = 48, seed: int = 5):
        super().__init__(classes, hidden, seed)
        self.p = [x.astype(np.float32) for x in self.p]
        self.classes, self.random, self.t = classes, np.random.default_rng(seed), 0
        self.m, self.q = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p]

    def learn(self, cells: np.ndarray, counts: np.ndarray, steps: int, rates, batch: int = 4096) -> None:
        """cells: sorted pair * classes + middle.  rates: the learning rate of each further step."""
        k = self.classes
        pair, middle = np.divmod(cells, k)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        size = np.diff(np.append(first, cells.size))
        weight = np.add.reduceat(counts, first).astype(float)
        sums, pair = np.cumsum(weight), pair[first]
        for _ in range(steps):
            drawn = np.searchsorted(sums, self.random.random(batch) * sums[-1], "right")
            pick, n = np.unique(np.minimum(drawn, sums.size - 1), return_counts=True)
            row = np.repeat(np.arange(pick.size), size[pick])
            at = np.arange(row.size) + np.repeat(first[pick] - (np.cumsum(size[pick]) - size[pick]), size[pick])
            target = np.zeros((pick.size, k), np.float32)
            target[row, middle[at]] = counts[at] / weight[pick[row]]
            self._step(*np.divmod(pair[pick], k), target, (n[:, None] / batch).astype(np.float32), next(rates))

    def _step(self, left, right, target, weight, rate: float) -> None:
        h, logp = self.forward(left, right)
        g = (np.exp(logp) - target) * weight
        gh = (g @ self.p[3].T) * (1 - h * h)
        grads = [np.zeros_like(self.p[0]), np.zeros_like(self.p[1]), gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
        np.add.at(grads[0], left, gh)
        np.add.at(grads[1], right, gh)
        self.t += 1
        for p, m, q, d in zip(self.p, self.m, self.q, grads, strict=True):
            m += 0.1 * (d - m)
            q += 0.001 * (d * d - q)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(q / (1 - 0.999**self.t)) + 1e-8)

    def frozen(self) -> Predictor:
        k = self.classes
        norm = np.zeros(k * k)
        for a in range(0, k * k, 4096):
            left, right = np.divmod(np.arange(a, min(a + 4096, k * k)), k)
            s = np.tanh(self.p[0][left] + self.p[1][right] + self.p[2]) @ self.p[3] + self.p[4]
            top = s.max(axis=1)
            norm[a : a + left.size] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return Predictor(*(x.astype(np.float32) for x in self.p), norm.astype(np.float32))


@dataclass
class Predictor:
    """The trained network, with the logarithm of the softmax's sum for each pair."""

    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    norm: np.ndarray

    def logp(self, left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
        """log P(middle | left, right) of each triple of classes; equal triples are computed once."""
        k = self.out_bias.size
        cell, inverse = np.unique((left * k + right) * k + middle, return_inverse=True)
        pair, m = np.divmod(cell, k)
        a, b = np.divmod(pair, k)
        out = np.empty(cell.size, np.float64)
        v = np.ascontiguousarray(self.out.T)
        for i in range(0, cell.size, 16384):
            j = slice(i, i + 16384)
            out[j] = np.einsum("ij,ij->i", np.tanh(self.left[a[j]] + self.right[b[j]] + self.bias), v[m[j]])
        return (out + self.out_bias[m] - self.norm[pair])[inverse]


# ---------------------------------------------------------------- passes
def _classed(shared):
    """For blocks with the answers to them: the tokens' classes, and per document the sum of log P(word | class)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v, rows = shared.value, []
        got = sorted(zip(right["slice"].to_pylist(), right["answer"].to_pylist(), strict=True))
        total = np.concatenate([np.zeros(0, np.uint64), *(B.unpack(x) for _, x in got)])
        for i, r in enumerate(left.drop_columns(["ids"]).to_pylist()):  # one block
            classes = v.class_of(B.unpack_sorted(r["words"]), total)
            share, sequence, sizes = v.share_of(total, classes), B.unpack(r["sequence"]).astype(np.int64), B.unpack(r["sizes"]).astype(np.int64)
            sums = np.bincount(np.repeat(np.arange(sizes.size), sizes), share[sequence], minlength=sizes.size)
            rows.append((r["trains"], r["scored"], left["ids"][i], r["sizes"], B.zip_bytes(sums), B.pack(classes[sequence])))
        B.tidy()
        return pa.Table.from_batches([_batch(rows, _CLASSED)])

    return run


def _tokens(row: dict) -> tuple[np.ndarray, ...]:
    """(document, class before, class, class after) of each token of a block."""
    sizes = B.unpack(row["sizes"]).astype(np.int64)
    doc, classes = np.repeat(np.arange(sizes.size), sizes), B.unpack(row["classes"]).astype(np.int64)
    left, right = _sides(doc, classes)
    return doc, left, classes, right


def _contexts(k: int, most: int = 2_000_000):
    """Cells of blocks, added up over a task's blocks while they are about `most` at least."""

    def merged(held: list) -> list[np.ndarray]:
        cell, inverse = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        n = np.zeros(cell.size, np.int64)
        np.add.at(n, inverse, np.concatenate([x for _, x in held]))
        return [cell, n]

    def sent(cell: np.ndarray, n: np.ndarray):
        B.tidy()
        return pa.RecordBatch.from_arrays([*np.divmod(cell, k), n], ["pair", "middle", "n"])

    def run(batches):
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                _, left, middle, right = _tokens(batch.slice(i, 1).to_pylist()[0])
                held.append(np.unique((left * k + right) * k + middle, return_counts=True))
                if sum(c.size for c, _ in held) >= most:
                    held = [merged(held)]
                    if held[0][0].size >= most // 2:
                        yield sent(*held.pop())
        if held:
            yield sent(*merged(held))

    return run


def _part(k: int):
    """The cells of a partition, sorted, as one row."""

    def run(batches):
        held = [[np.asarray(batch.column(c), np.int64) for c in ("pair", "middle", "n")] for batch in batches]
        if held:
            pair, middle, n = (np.concatenate(x) for x in zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (B.pack_sorted((pair * k + middle).astype(np.uint64)), B.pack(n))] + [pa.array([int(n.sum())])], ["cells", "counts", "mass"])

    return run


def _rates(steps: int, rate: float):
    t = 0
    while True:
        yield rate * max(0.05, 1 - t / steps)
        t += 1


def _trained(classed: DataFrame, k: int, steps: int, rounds: int, rate: float) -> Predictor:
    cells = classed.where("trains").select("sizes", "classes").mapInArrow(_contexts(k), "pair long, middle long, n long").groupBy("pair", "middle").agg(F.sum("n").alias("n"))
    parts = max(1, k**3 >> 22)
    parts = B.written(cells.repartition(parts, "pair").sortWithinPartitions("pair", "middle").mapInArrow(_part(k), "cells binary, counts binary, mass long"), "contexts")
    total = parts.agg(F.sum("mass")).first()[0] or 0
    network, rates = ContextNetwork(k), _rates(steps, rate)
    for _ in range(rounds if total else 0):
        for r in parts.toLocalIterator():  # one part at a time
            network.learn(B.unpack_sorted(r["cells"]).astype(np.int64), B.unpack(r["counts"]).astype(np.int64), max(1, round(steps * r["mass"] / total / rounds)), rates)
    return network.frozen()


@dataclass
class Fitted:
    """Blocks with classes, and what was learned from those that train."""

    classed: DataFrame
    vocabulary: Vocabulary
    predictor: Predictor


def fit(docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, steps: int = 600, rounds: int = 3, rate: float = 0.03, head_rate: float = 8.0) -> Fitted:
    """Learns from train (None: from docs) and prepares docs for scores().

    head_rate: words that are classes of their own, for each tokens ** 0.2; steps: of the network's training, in so many rounds over the parts.
    """
    spark = docs.sparkSession
    total = B.text_bytes(docs, text_col) + (0 if train is None else B.text_bytes(train, text_col))
    size = max(block_bytes, int(block_bytes * math.sqrt(total / 2**36)))  # see n_blocks
    blocks = _blocks(docs, id_col, text_col, train is None, True, size)
    if train is not None:
        blocks = blocks.unionByName(_blocks(train, id_col, text_col, True, False, size))
    blocks = B.written(blocks, "blocks")
    n = blocks.agg(F.sum("n_types").alias("types"), F.sum(F.when(F.col("trains"), F.col("n_tokens"))).alias("tokens")).first()
    heads = int(head_rate * (n.tokens or 0) ** 0.2)
    lists = blocks.select("block", "trains", "words", "counts").mapInArrow(_lists(B.n_slices(n.types or 0)), LISTS)
    totals = B.written(lists.groupBy("slice").applyInArrow(_totals(heads), TOTALS), "totals")
    told = totals.where("block is null")
    top = told.select("top").mapInArrow(_unpacked("top", ["word", "n"]), "word long, n long").orderBy(F.col("n").desc(), F.col("word")).limit(heads)
    bins = told.select("bins").mapInArrow(_unpacked("bins", ["ending", "bin", "mass", "words"]), "ending long, bin long, mass long, words long").groupBy("ending", "bin").agg(F.sum("mass"), F.sum("words"))
    vocabulary = Vocabulary.of([(r.word % 2**64, r.n) for r in top.collect()], [tuple(r) for r in bins.collect()])
    shared = spark.sparkContext.broadcast(vocabulary)
    answers = totals.where("block is not null").select("block", "slice", "answer")
    own = blocks.drop("n_types", "n_tokens", "counts")
    classed = B.written(own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_classed(shared), CLASSED), "classed")
    return Fitted(classed, vocabulary, _trained(classed, vocabulary.classes, steps, rounds, rate))


def scores(fitted: Fitted) -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood, per_token, perplexity of every row of the documents given to fit()."""
    classed = fitted.classed
    shared = classed.sparkSession.sparkContext.broadcast(fitted.predictor)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.select(["sizes", "shares", "classes"]).slice(i, 1).to_pylist()[0]
                doc, left, middle, right = _tokens(r)
                own = B.unzip_bytes(r["shares"], np.float64)
                n = np.bincount(doc, minlength=own.size)
                total = own + np.bincount(doc, shared.value.logp(left, middle, right), minlength=own.size)
                mean = total / np.maximum(n, 1)
                none = n == 0
                B.tidy()
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(n, pa.int64()), pa.array(total + 0.0), pa.array(mean, mask=none), pa.array(np.exp(-mean), mask=none)], ["doc_id", "n_tokens", "pseudo_log_likelihood", "per_token", "perplexity"])

    return classed.where("scored").select("ids", "sizes", "shares", "classes").mapInArrow(run, SCORES)


def pseudo_likelihood(docs: DataFrame, train: DataFrame | None = None, **options) -> DataFrame:
    """scores() of docs under a model of train, or of docs themselves."""
    return scores(fit(docs, train, **options))
