"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text, padded with spaces; weights are log(1 + count) * idf, of
length 1.  Document frequencies are counted over every training document, by the executors.  The regression is trained on
the driver with follow-the-regularised-leader (per coordinate) under an elastic-net penalty, on at most `rows_per_class`
training documents of each label (those with the smallest hash of id and text, equal ones once; the bound is a parameter of
the fit alone), of which a fifth is kept back to fit the temperature that calibrates the probabilities.  Prediction is row by row, without a shuffle.

Nulls: a null text or one without letters is `und` with score 0; a row with a null id is never learned from, and is
not held out; a null label is not learned from.  Without any labelled row all predictions are `und`.  Ties go to the label that is
first in order.  Empty tables give empty results; other columns are kept or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._blocks import tidy

UNKNOWN = "und"
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def feature_counts(texts: list[str], bits: int) -> np.ndarray:
    """(texts, 2**bits) counts of hashed n-grams."""
    padded = [f"  {x.lower()}  " for x in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) for x in padded])
    doc = np.repeat(np.arange(len(texts), dtype=np.int64) << bits, size)
    ends = np.cumsum(size)
    use = np.ones(code.size, bool)
    use[ends - 1] = use[ends - 2] = False
    at = np.flatnonzero(use)
    doc = doc[at]
    out = np.zeros(len(texts) << bits, np.int64)
    h = np.full(at.size, 0x165667B1, np.uint32)
    for n in range(3):
        h = (h ^ code[at + n]) * _K[n]
        h ^= h >> np.uint32(15)
        v = h * _K[(n + 1) % 3]
        out += np.bincount(doc + (v >> np.uint32(32 - bits)), minlength=out.size)
    return out.reshape(len(texts), -1)


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _pieces(texts: list[str], most: int = 400_000):
    """Runs of texts of about `most` characters, at most 64 texts each."""
    a, held = 0, 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= most or i - a >= 63:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


class Ftrl:
    """Multinomial logistic regression, trained by per-coordinate follow-the-regularised-leader."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def rows(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.rows(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class LanguageModel:
    def __init__(self, classes: list[str], idf: np.ndarray, w: np.ndarray, temperature: float, bits: int):
        self.classes, self.idf, self.w, self.temperature, self.bits = classes, idf, w, temperature, bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        texts = [x or "" for x in texts]
        label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.classes:
            for a, b in _pieces(texts):
                x = weights(feature_counts(texts[a:b], self.bits), self.idf)
                p = softmax((x @ self.w).astype(np.float64) / self.temperature)
                best = p.argmax(axis=1)
                for i, k in enumerate(best.tolist(), a):
                    if any(map(str.isalpha, texts[i])):
                        label[i], score[i] = self.classes[k], float(p[i - a, k])
        return label, score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", bits: int = 14, rows_per_class: int = 1000, epochs: int = 4) -> LanguageModel:
    """A model of the rows of docs with a label; every such row counts for the document frequencies."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null")

    def frequencies(batches):
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n += len(texts)
            for a, b in _pieces(texts):
                total += (feature_counts(texts[a:b], bits) > 0).sum(axis=0)
        tidy()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], n), pa.int64())], ["feature", "n"])

    df = {r.feature: r.n for r in rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # 2**bits + 1 rows at most
    n = df.pop(-1, 0)
    counts = np.zeros(1 << bits)
    counts[list(df)] = list(df.values())
    idf = (np.log((1 + n) / (1 + counts)) + 1).astype(np.float32)

    key = F.xxhash64("id", "text")
    per_class = {r.label: r.n for r in rows.groupBy("label").agg(F.approx_count_distinct(key).alias("n")).collect()}  # a row per language
    classes = sorted(per_class)
    if not classes:
        return LanguageModel([], idf, np.zeros((1 << bits, 0), np.float32), 1.0, bits)
    keep = F.lit(False)
    for c in classes:
        keep = keep | ((F.col("label") == c) & (F.col("share") < 1.5 * rows_per_class / per_class[c]))
    some = rows.select("text", "label", key.alias("key"), (F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("share")).where(keep).dropDuplicates(["label", "key"])
    place = F.row_number().over(Window.partitionBy("label").orderBy("share", "key"))
    some = some.withColumn("place", place).where(F.col("place") <= rows_per_class).repartition(rows.sparkSession.sparkContext.defaultParallelism, "key")

    def sample(batches):
        for batch in batches:
            texts, label, key = [x or "" for x in batch.column("text").to_pylist()], batch.column("label").to_pylist(), batch.column("key").to_pylist()
            for a, b in _pieces(texts):
                x = weights(feature_counts(texts[a:b], bits), idf)
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([pa.array(key[a:b], pa.int64()), pa.array(label[a:b], pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(x, at, strict=True)], pa.list_(pa.float32()))], ["key", "label", "at", "x"])

    table = some.select("text", "label", "key").mapInArrow(sample, "key long, label string, at array<int>, x array<float>").toArrow()
    data = sorted(zip(table["key"].to_pylist(), table["label"].to_pylist(), (np.asarray(v.values) for v in table["at"]), (np.asarray(v.values) for v in table["x"]), strict=True), key=lambda r: r[:2])
    train, kept = [r for i, r in enumerate(data) if i % 5], data[::5]
    model, order = Ftrl(1 << bits, len(classes)), np.random.default_rng(7)
    place = {c: i for i, c in enumerate(classes)}
    for _ in range(epochs):
        for i in order.permutation(len(train or data)):
            _, label, at, x = (train or data)[i]
            model.learn(at, x, place[label])
    w = model.rows(slice(None))
    scores, truth = np.array([x @ w[at] for _, _, at, x in kept]), np.array([place[label] for _, label, _, _ in kept])
    out = LanguageModel(classes, idf, w.astype(np.float32), calibrate(scores, truth), bits)
    del table, data, train, kept, model
    tidy()
    return out


def calibrate(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        p = softmax(scores / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(truth.size), truth], 1e-15)).mean()) + 1e-3 * t * t

    a, b, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        if loss(c) < loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns; columns of docs that have their names give way."""
    docs = docs.drop(label, score)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for batch in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):
            a, b = model.predict(batch.column(names.index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.string()), pa.array(b, pa.float64())], [*names, label, score])
            tidy()

    return docs.mapInArrow(run, f"{schema}, `{label}` string, `{score}` double")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id, as text, leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1
