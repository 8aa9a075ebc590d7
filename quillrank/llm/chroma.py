"""Chroma fingerprints of audio columns, and identification of recordings by aligned fingerprints.

Audio is a binary column of unsigned 8-bit mono PCM, or of RIFF/WAVE (8- or 16-bit; channels are averaged).  Frames of the
signal give the energy of the twelve pitch classes; difference filters over the chroma image, evaluated on its
integral image, give two bits each (Gray code), sixteen filters a packed 32-bit integer per frame.

Recordings are compared with a library, a stated set of query recordings.  Equal fingerprints are one class.  Every
integer of a class, of the shortest recordings as well, votes for all library classes that hold it, at the offsets of all
its places; each pair's best offset in the histogram is aligned and scored by its share of differing bits over the overlap.
Blocks of recordings meet blocks of the library, so pairs are made in numpy and only the best link of a recording, and the
links that connect, leave a block; recordings linked through a chain of alignments get one component.  Recordings without
one equal integer are not compared.

Nulls: null or empty audio has no fingerprint and matches nothing; a null id is never a query, class or match, and keeps
a null id.  Rows that share an id are separate recordings with one id.  Short recordings are padded to one
fingerprint.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._blocks import ROWS, U, mix, tidy, written
from ._components import components

RATE, FRAME, HOP, SPAN = 4000, 512, 64, 16
#: (kind, first pitch class, pitch classes, frames) of each filter, by rule: kinds 0 to 3 at four heights each.
FILTERS = [(kind, (3 * i + kind) % (13 - h), h, w) for kind, w in ((0, 4), (1, 8), (2, 16), (3, 12)) for i, h in enumerate((2, 4, 6, 12))]
STEP = 0.12


def samples(audio: bytes) -> np.ndarray:
    """The signal in -1..1."""
    if audio[:4] != b"RIFF" or audio[8:12] != b"WAVE":
        return (np.frombuffer(audio, np.uint8).astype(np.float32) - 128) / 128
    at, bits, channels = 12, 8, 1
    while at + 8 <= len(audio):
        name, size = audio[at : at + 4], struct.unpack("<I", audio[at + 4 : at + 8])[0]
        if name == b"fmt ":
            channels, bits = struct.unpack("<H", audio[at + 10 : at + 12])[0], struct.unpack("<H", audio[at + 22 : at + 24])[0]
        if name == b"data":
            body = audio[at + 8 : at + 8 + size]
            x = samples(body) if bits == 8 else np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768
            return x[: x.size // channels * channels].reshape(-1, channels).mean(axis=1)
        at += 8 + size + size % 2
    return np.zeros(0, np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)
_HZ = np.fft.rfftfreq(FRAME, 1 / RATE)
_PITCH = np.zeros((_HZ.size, 12), np.float32)
for _i in np.flatnonzero((_HZ >= 65) & (_HZ <= 1900)):
    _PITCH[_i, int(np.round(12 * np.log2(_HZ[_i] / 440.0))) % 12] = 1


def chroma(signals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(frames of all signals x 12, frames of each signal): pitch-class energies of length 1."""
    n = np.array([max(SPAN, 1 + -(-max(0, x.size - FRAME) // HOP)) for x in signals])
    flat = np.zeros(int(((n - 1) * HOP + FRAME).sum()), np.float32)
    start, begins = 0, []
    for x, k in zip(signals, n.tolist(), strict=True):
        flat[start : start + x.size] = x
        begins.append(start + np.arange(k) * HOP)
        start += (k - 1) * HOP + FRAME
    begins = np.concatenate(begins)
    view = np.lib.stride_tricks.sliding_window_view(flat, FRAME)
    out = np.empty((begins.size, 12), np.float32)
    for a in range(0, begins.size, 2048):
        z = np.fft.rfft(view[begins[a : a + 2048]] * _WINDOW)
        out[a : a + 2048] = (z.real**2 + z.imag**2).astype(np.float32) @ _PITCH
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9), n


def fingerprints(signals: list[np.ndarray]) -> list[np.ndarray]:
    """The packed integers of each signal, frames - SPAN + 1 of them."""
    if not signals:
        return []
    image, n = chroma(signals)
    total = np.zeros((image.shape[0] + 1, 13))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    ends = np.cumsum(n)
    first = np.concatenate([np.arange(e - k, e - SPAN + 1) for e, k in zip(ends.tolist(), n.tolist(), strict=True)])

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        a, b = first + t0, first + t1
        return total[b, y1] - total[a, y1] - total[b, y0] + total[a, y0]

    out = np.zeros(first.size, np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, w, y, y + h)
        if kind == 0:  # above against below
            part = area(0, w, y, y + h // 2)
        elif kind == 1:  # before against after
            part = area(0, w // 2, y, y + h)
        elif kind == 2:  # the two diagonals
            part = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        else:  # the middle third of the time against the rest
            part = area(w // 3, 2 * w // 3, y, y + h)
        rest = whole - part
        value = np.log1p(part) - np.log1p(rest) + (np.log(2.0) * 0.5 if kind == 3 else 0.0)
        level = np.searchsorted([-STEP, 0.0, STEP], value).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return np.split(out, np.cumsum(n - SPAN + 1)[:-1])


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """(overlap, share of differing bits) with b's place = a's place + offset."""
    lo, hi = max(0, -offset), min(a.size, b.size - offset)
    if hi <= lo:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()) / (32 * (hi - lo))


def with_fingerprints(recordings: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, fp): n integers, packed little-endian; equal fingerprints have equal signatures."""

    def run(batches):
        for batch in batches:
            ids, audio = batch.column("doc_id"), batch.column("audio").to_pylist()
            a = 0
            while a < len(audio):
                b, size = a, 0
                while b < len(audio) and (b == a or size + len(audio[b] or b"") < 1 << 20):
                    size += len(audio[b] or b"")
                    b += 1
                signals = [samples(x or b"") for x in audio[a:b]]
                found = iter(fingerprints([x for x in signals if x.size]))
                fp = [next(found) if x.size else np.zeros(0, np.uint32) for x in signals]
                sig = [[int((mix((x.astype(np.uint64) + U(1)) * row * (np.arange(x.size, dtype=np.uint64) * U(2) + U(1)))).sum(dtype=np.uint64).astype(np.int64)) for x in fp] for row in ROWS[:2]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([x.size for x in fp], pa.int64()), *(pa.array(s, pa.int64()) for s in sig), pa.array([x.astype("<u4").tobytes() for x in fp], pa.binary())], ["doc_id", "n", "sig_a", "sig_b", "fp"]
                )
                a = b

    return recordings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(audio_col).cast("binary").alias("audio")).mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long, fp binary")


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] numbers, of all i."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def _pieces(n: np.ndarray, most: int):
    """Ranges of n with sums up to most, or one entry above it."""
    sums, a = np.cumsum(n), 0
    while a < n.size:
        b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(integers of all recordings, where each recording begins, how many it has)."""
    fps = [np.frombuffer(x, "<u4") for x in table["fp"].to_pylist()]
    n = np.array([x.size for x in fps], np.int64)
    return np.concatenate([np.zeros(0, np.uint32), *fps]), np.cumsum(n) - n, n


def votes(x: tuple, y: tuple, own: np.ndarray, other: np.ndarray, most: int = 2_000_000):
    """Offset histograms of all recordings x and y (integers, begins, counts) with an equal integer: (recording of x, of y,
    offset, votes) in parts, sorted, all of a recording of x in one part.  own, other: whom each recording is not compared with."""
    order = np.argsort(y[0], kind="stable")
    row = np.repeat(np.arange(y[2].size), y[2])[order]
    place = _spread(np.zeros(y[2].size, np.int64), y[2])[order]
    lo, hi = (np.searchsorted(y[0][order], x[0], side) for side in ("left", "right"))
    at = np.flatnonzero(hi > lo)
    n, lo = (hi - lo)[at], lo[at]
    c, p = np.repeat(np.arange(x[2].size), x[2])[at], _spread(np.zeros(x[2].size, np.int64), x[2])[at]
    width = int(x[2].max(initial=0) + y[2].max(initial=0))
    held = np.zeros((4, 0), np.int64)
    for a, b in _pieces(n, most):
        found = _spread(lo[a:b], n[a:b])
        i, j, offset = np.repeat(c[a:b], n[a:b]), row[found], place[found] - np.repeat(p[a:b], n[a:b])
        new = own[i] != other[j]
        i, j = np.append(held[0], i[new]), np.append(held[1], j[new])
        offset, v = np.append(held[2], offset[new]), np.append(held[3], np.ones(int(new.sum()), np.int64))
        pair, inverse = np.unique(i * y[2].size + j, return_inverse=True)
        key, inverse = np.unique(inverse * (2 * width) + offset + width, return_inverse=True)
        sums = np.bincount(inverse, v).astype(np.int64)
        pair = pair[key // (2 * width)]
        held = np.stack([pair // y[2].size, pair % y[2].size, key % (2 * width) - width, sums])
        done = held[0] < c[b] if b < c.size else np.ones(key.size, bool)
        if done.any():
            yield held[:, done]
        held = held[:, ~done]


def aligned(x: tuple, y: tuple, found: np.ndarray, most: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The best offset of each pair in a part of votes(): (recording of x, of y, offset, votes, overlap), bit errors; those that pass."""
    found = found[:, np.lexsort((-found[2], np.abs(found[2]), -found[3], found[1], found[0]))]
    found = found[:, np.append(True, (found[:2, 1:] != found[:2, :-1]).any(axis=0))]
    i, j, offset = found[:3]
    lo = np.maximum(0, -offset)
    n = np.minimum(x[2][i], y[2][j] - offset) - lo
    ok = n >= np.minimum(least, np.minimum(x[2][i], y[2][j]))
    found, n, lo = found[:, ok], n[ok], lo[ok]
    i, j, offset = found[:3]
    error = np.zeros(n.size)
    for a, b in _pieces(n, 4_000_000):
        k = n[a:b]
        bits = np.bitwise_count(x[0][_spread(x[1][i[a:b]] + lo[a:b], k)] ^ y[0][_spread(y[1][j[a:b]] + lo[a:b] + offset[a:b], k)])
        error[a:b] = np.add.reduceat(bits.astype(np.int64), np.cumsum(k) - k) / (32 * k)
    ok = error <= most
    return np.vstack([found[:, ok], n[ok]]), error[ok]


LINKS = "own_class long, match_class long, library_id long, offset long, votes long, overlap long, bit_error double, n_links long"
_LINKS = ["own_class", "match_class", "library_id", "offset", "votes", "overlap", "bit_error", "n_links"]


def _compared(most: float, least: int):
    """For a block of recordings with a block of the library: the best link of each recording, with the number of its links, and of
    the other links (without a number) those that join what is not yet connected."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = _unpacked(left), _unpacked(right)
        own, other = (t["class_id"].to_numpy() for t in (left, right))
        node, lead, library = left["doc_id"].to_numpy(), right["doc_id"].to_numpy(), right["query_id"].to_numpy()
        label, out = np.arange(y[2].size), []
        for part in votes(x, y, own, other):
            found, error = aligned(x, y, part, most, least)
            order = np.lexsort((found[2], library[found[1]], -found[4], error, found[0]))
            found, error = found[:, order], error[order]
            i, j = found[:2]
            if not i.size:
                continue
            first = np.append(True, i[1:] != i[:-1])
            n = np.where(first, np.bincount(i)[i], 0)
            _, keep = np.unique(i * y[2].size + label[j], return_index=True)  # of each recording one link to each group, the best
            keep = np.sort(keep)
            for a, b in zip(keep[:-1].tolist(), keep[1:].tolist(), strict=True):
                if i[a] == i[b] and label[j[a]] != label[j[b]]:
                    label[label == label[j[b]]] = label[j[a]]
            out.append(pa.table([node[i[keep]], lead[j[keep]], library[j[keep]], *found[2:, keep], error[keep], n[keep]], _LINKS))
        tidy()
        empty = [np.zeros(0, np.float64 if k == "bit_error" else np.int64) for k in _LINKS]
        return pa.concat_tables(out or [pa.table(empty, _LINKS)])

    return run


def links(reps: DataFrame, most: float, least: int) -> DataFrame:
    """LINKS of reps (class_id, doc_id, query_id, fp): every block of recordings meets every block of the library."""
    size = F.length("fp") / 4
    total, library = (int(n or 0) for n in reps.agg(F.sum(size), F.sum(F.when(F.col("query_id").isNotNull(), size))).first())
    rows, columns = max(24, -(-total // 8_000_000)), max(1, -(-library // 8_000_000))
    left = reps.select(F.pmod(F.xxhash64("class_id"), F.lit(rows)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"), "class_id", "doc_id", "fp")
    right = reps.where("query_id is not null").select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), F.pmod(F.xxhash64("class_id"), F.lit(columns)).cast("int").alias("j"), "class_id", "doc_id", "query_id", "fp")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_compared(most, least), LINKS)


def identify(recordings: DataFrame, is_query: Column, id_col: str = "doc_id", audio_col: str = "audio", most_errors: float = 0.2, least_overlap: int = 16) -> DataFrame:
    """Per row: doc_id, n_fingerprints, class_id, is_query, match_id, offset, votes, overlap, bit_error, n_links, component_id.

    class_id is the smallest id of equal fingerprints; match_id the other library class (its smallest query id) that the
    recording aligns with best: fewest bit errors, then the longest overlap, then the smallest id; null where none does.
    offset: frames to add to the recording's place.  n_links: the other library classes it aligns with.
    """
    keyed = recordings.select(F.when(is_query, F.lit(True)).otherwise(F.lit(False)).alias("__q"), F.col(id_col).cast("long").alias("__id"), F.col(audio_col).alias("__audio"))
    table = written(with_fingerprints(keyed, "__id", "__audio"), "fingerprints")
    name = ["n", "sig_a", "sig_b"]
    query = keyed.where("__q and __id is not null").select(F.col("__id").alias("doc_id")).distinct()
    rows = table.select("doc_id", *name).join(query.withColumn("is_query", F.lit(True)), "doc_id", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False)))
    classes = rows.where("n > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("class_id"), F.min(F.when(F.col("is_query"), F.col("doc_id"))).alias("query_id"))
    classes = written(classes, "classes")
    reps = table.join(classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", *name]).dropDuplicates(["doc_id", *name]).select(F.xxhash64("doc_id", *name).alias("class_id"), "doc_id", "query_id", "fp")
    reps = written(reps, "recordings")
    found = written(links(reps, most_errors, least_overlap), "aligned")
    component = components(found.select(F.col("own_class").alias("u"), F.col("match_class").alias("v")))
    one = F.struct(F.col("library_id").alias("match_id"), "offset", "votes", "overlap", "bit_error")
    top = found.groupBy("own_class").agg(F.min_by(one, F.struct("bit_error", -F.col("overlap"), "library_id", "offset")).alias("m"), F.sum("n_links").alias("n_links"))
    out = rows.join(classes, name, "left").join(top, F.col("class_id") == F.col("own_class"), "left").join(component, F.col("class_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_fingerprints"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), "is_query", "m.match_id", "m.offset", "m.votes", "m.overlap", "m.bit_error", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"))
