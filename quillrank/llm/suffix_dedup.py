"""Removal of byte strings that occur in an earlier document, by a distributed merge sort of suffixes.

Two equal strings of `length` bytes have the same smallest gram (by hash) at the same place, so it is enough to sort
the suffixes that start at such grams: *anchors*, about 2 in (length - gram + 2) positions.

1. Blocks exchange sketches of the anchors' grams (see _blocks); an anchor whose gram is in one document only is done.
2. Each block sorts its remaining suffixes, `length` bytes deep, and sends every slice of the gram space one run: front
   coded (bytes shared with the suffix before, then the rest), with the bytes left of the anchor and the smallest
   document.  Equal contexts in a block travel once.
3. A slice combines its runs with a loser tree that carries, for every waiting suffix, the prefix length it is known to
   share with the last winner: unequal lengths decide without a look at the text, equal ones compare from there on.
   The merged order and its common prefixes give, for each of the places an anchor can have in a string, the classes
   of equal right sides; with equal left sides they are equal strings.  The answer to each entry is the first and the last of
   its places at which an earlier document holds the string: strings in between overlap both.
4. Blocks mark the bytes that those strings cover.

Only bytes are compared; the results are exact but for the left sides, which are compared by 64-bit hash within
suffixes that already share at least `gram` bytes.

Nulls: a null text is empty; a row with a null id comes after all documents and keeps a null id.  Rows that share an id
are one document.  Texts shorter than the length keep every byte.  Empty tables give empty results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks as B

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
RUNS = "slice int, block int, shared binary, rest binary, room binary, lefts binary, doc binary"
_RUNS = pa.schema([("slice", pa.int32()), ("block", pa.int32()), *((k, pa.binary()) for k in ("shared", "rest", "room", "lefts", "doc"))])
EXACT = 100


def _slide(x: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum, maximum) over each run of width values."""
    have = 1
    while have * 2 <= width:
        x = of(x[:-have], x[have:])
        have *= 2
    return of(x[: x.size - (width - have)], x[width - have :]) if have < width else x


def _anchors(t: B.Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, document, gram hash) of grams that are the smallest of some string of `length` bytes."""
    if t.size < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    n = t.size - gram + 1
    key = (_gram_hashes(t, slice(0, n), gram) >> B.U(33)).astype(np.int32)
    least = _slide(key, length - gram + 1, np.minimum)
    # a string that crosses documents chooses none
    crossing = np.zeros(least.size + 1, np.int32)
    np.add.at(crossing, np.clip(t.off[1:-1] - length + 1, 0, least.size), 1)
    np.add.at(crossing, np.clip(t.off[1:-1], 0, least.size), -1)
    least[np.cumsum(crossing[:-1], dtype=np.int32) > 0] = -1
    pad = np.full(length - gram, -1, np.int32)
    best = _slide(np.concatenate([pad, least, pad]), length - gram + 1, np.maximum)
    place = np.flatnonzero(best[:n] == key)
    return place, np.searchsorted(t.off, place, side="right") - 1, _gram_hashes(t, place, gram)


def _gram_hashes(t: B.Texts, where, gram: int) -> np.ndarray:
    at, h = B.loads(t.data), B.U(0)
    for j in range(0, gram - 7, 8):
        h = (at[j:][where] ^ h) * B._M3
        h ^= h >> B.U(32)
    return B.mix(h)


class _Candidates:
    """A block's anchors with repeated grams: contexts, sorted and made distinct."""

    def __init__(self, t: B.Texts, length: int, gram: int, bits: int, depth: int, slices: int, got: pa.Table):
        place, doc, h = _anchors(t, length, gram)
        k = B.estimates(h, bits, depth, got) >= 2
        self.place, doc, h = place[k], doc[k], h[k]
        reach = length - gram
        data = np.concatenate([np.zeros(reach, np.uint8), t.data[: t.size], np.zeros(length, np.uint8)])
        span = data[self.place[:, None] + np.arange(reach + length)[None, :]]
        self.left = np.minimum(self.place - t.off[doc], reach).astype(np.uint8)
        self.right = np.minimum(t.off[doc + 1] - self.place, length).astype(np.uint8)
        column = np.arange(reach + length)[None, :]
        span[(column < reach - self.left[:, None].astype(np.int64)) | (column >= reach + self.right[:, None].astype(np.int64))] = 0
        self.ids = t.ids[doc]
        # slices by the gram, then suffixes in order, then left sides: equal contexts stand together
        # (mixed again: anchors are the grams with small hashes)
        self.slice = ((B.mix(h, B._M3, B._M4) >> B.U(32)) * B.U(slices)) >> B.U(32)
        wide = np.zeros((span.shape[0], (length + 7) // 8 * 8), np.uint8)
        wide[:, :length] = span[:, reach:]
        suffix = wide.view(">u8").astype(np.uint64)
        side = np.zeros(span.shape[0], np.uint64)
        for j in range(reach - 1, -1, -1):
            side = side * B.ROWS[0] + span[:, j] + B.U(1)
        side = B.mix(side ^ (self.left.astype(np.uint64) << B.U(8)) ^ self.right.astype(np.uint64))
        keys = [side, *(suffix[:, j] for j in range(suffix.shape[1] - 1, -1, -1)), self.slice]
        order = np.lexsort(keys) if self.place.size else np.zeros(0, np.int64)
        new = np.zeros(order.size, bool)
        for x in keys:
            v = x[order]
            new[1:] |= v[1:] != v[:-1]
        new[:1] = True
        self.order, self.group, self.first = order, np.cumsum(new) - 1, np.flatnonzero(new)
        self.least = np.minimum.reduceat(self.ids[order], self.first) if order.size else self.ids
        self.span, self.reach = span, reach

    def runs(self, block: int, slices: int) -> pa.Table:
        one = self.order[self.first]
        cuts = np.searchsorted(self.slice[one], np.arange(slices + 1).astype(np.uint64))
        out: list[list] = [[] for _ in _RUNS.names]
        for s in range(slices):
            a, b = cuts[s], cuts[s + 1]
            if b == a:
                continue
            rows = self.span[one[a:b]]
            right = rows[:, self.reach :]
            shared = np.zeros(b - a, np.uint8)
            same = np.cumprod(right[1:] == right[:-1], axis=1, dtype=np.uint8)
            shared[1:] = same.sum(axis=1)
            rest = right[np.arange(right.shape[1])[None, :] >= shared[:, None]]
            room = np.stack([self.left[one[a:b]], self.right[one[a:b]]])
            for c, v in zip(out, (s, block, B.zip_bytes(shared), B.zip_bytes(rest), B.zip_bytes(room), B.zip_bytes(rows[:, : self.reach].T), B.pack(self.least[a:b].astype(np.uint64))), strict=True):
                c.append(v)
        return pa.table(out, _RUNS)


def front_decoded(shared: np.ndarray, rest: bytes, length: int) -> list[bytes]:
    """The suffixes of a front-coded run."""
    out, last, at = [], b"", 0
    for n in shared.tolist():
        last = last[:n] + rest[at : (at := at + length - n)]
        out.append(last)
    return out


def merge_runs(runs: list[list[bytes]], length: int) -> tuple[list[int], list[int]]:
    """A stable merge of sorted runs of equally long strings: the run of each next string, and its common prefix with the string before.

    A loser tree.  lcp[r] is what the head of run r shares with the last winner that passed the node where it waits.
    Of two heads, the one that shares more with the last winner is the smaller; only if both share the same are bytes
    compared, from that length on, and the loser keeps what it shares with the one that beat it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [iter(r) for r in runs] + [iter(()) for _ in range(k - len(runs))]
    text: list = [next(h, None) for h in heads]
    lcp, tree = [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), the loser's lcp set against the winner."""
        x, y = text[a], text[b]
        if x is None or y is None:
            return (b, a) if x is None and (y is not None or b < a) else (a, b)
        p, q = lcp[a], lcp[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        diff = int.from_bytes(x[p:]) ^ int.from_bytes(y[p:])
        if not diff:
            n, first = length, a < b
        else:
            n = length - (diff.bit_length() + 7) // 8
            first = x[n] < y[n]
        if first:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, tree[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win, order, common = build(1), [], []
    while text[win] is not None:
        order.append(win)
        common.append(lcp[win])
        last = text[win]
        new = text[win] = next(heads[win], None)
        if new is not None:
            diff = int.from_bytes(last) ^ int.from_bytes(new)
            lcp[win] = length - (diff.bit_length() + 7) // 8
        node = (win + k) >> 1
        while node:
            b = tree[node]
            y = text[b]
            if y is not None:
                p, q = lcp[win], lcp[b]
                if text[win] is None or q > p:
                    tree[node], win = win, b
                elif p == q:
                    win, tree[node] = play(win, b)
            node >>= 1
    return order, common


def _places(length: int, gram: int):
    """For groupBy(slice): merges the runs, answers each entry with 64 * (last place + 1) + first place of the anchor in repeated strings; 63 if in none."""
    reach = length - gram

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["block"])
        shared = [B.unzip_bytes(x["shared"]) for x in rows]
        runs = [front_decoded(n, B._D.decompress(x["rest"]), length) for n, x in zip(shared, rows, strict=True)]
        sizes = np.array([n.size for n in shared])
        order, common = merge_runs(runs, length)
        del runs
        run, common = np.array(order), np.array(common)
        # the i-th string of a run stands at the run's start plus i
        place = np.empty(run.size, np.int64)
        by_run = np.argsort(run, kind="stable")
        place[by_run] = np.arange(run.size)
        room = np.concatenate([B.unzip_bytes(x["room"]).reshape(2, -1) for x in rows], axis=1)[:, place]
        lefts = np.concatenate([B.unzip_bytes(x["lefts"]).reshape(reach, -1) for x in rows], axis=1)[:, place]
        doc = np.concatenate([B.unpack(x["doc"]).astype(np.int64) for x in rows])[place]
        low, high = np.full(run.size, 63, np.uint64), np.zeros(run.size, np.uint64)
        side = np.zeros(run.size, np.uint64)
        for o in range(reach + 1):  # the string starts o bytes left of the anchor
            if o:
                side = side * B.ROWS[1] + lefts[reach - o] + B.U(1)
            k = np.flatnonzero((room[0] >= o) & (room[1] >= length - o))
            if not k.size:
                continue
            right = np.cumsum(common < length - o)[k].astype(np.uint64)
            key = B.mix(B.mix(side[k]) ^ (right * B.ROWS[2]), B._M3, B._M4) if o else right
            by = np.argsort(key, kind="stable")
            v = key[by]
            new = np.append(True, v[1:] != v[:-1])
            least = np.minimum.reduceat(doc[k][by], np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = k[by[least < doc[k][by]]]
            low[hit] = np.minimum(low[hit], B.U(o))
            high[hit] = B.U(o + 1)
        back = np.empty(run.size, np.uint64)
        back[place] = high * B.U(64) + low
        cut = np.split(back, np.cumsum(sizes)[:-1])
        return pa.table([[x["block"] for x in rows], [EXACT] * len(rows), [x["slice"] for x in rows], [B.pack(c) for c in cut]], B._ANSWERS)

    return merge


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 16, block_bytes: int = 2 << 20, depth: int = 2, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, the remaining bytes."""
    if not (8 <= gram < length <= 200 and gram % 8 == 0 and length - gram < 50):
        raise ValueError("gram must be a multiple of 8, at most 49 below length; length at most 200")
    reach = length - gram
    total = B.text_bytes(docs, text_col)
    blocks, anchors = B.n_blocks(total, block_bytes), max(1, 2 * total // (reach + 2))
    bits, slices = max(16, (16 * anchors).bit_length()), B.n_slices(anchors, 600_000)
    dealt = B.dealt(docs, id_col, text_col, blocks)

    def sketch(key, table):
        _, doc, h = _anchors(t := B.Texts(table), length, gram)
        # a gram counts once for a document
        pair = B.mix(h ^ B.mix(t.ids[doc].astype(np.uint64) * B.ROWS[1]))
        _, one = np.unique(pair, return_index=True)
        return B.sketch_rows(key[0].as_py(), h[one], bits, depth, slices, 2)

    def suffixes(key, table, got):
        return _Candidates(B.Texts(table), length, gram, bits, depth, slices, got).runs(key[0].as_py(), slices)

    def remove(key, table, got):
        t = B.Texts(table)
        c = _Candidates(t, length, gram, bits, depth, slices, got)
        bit = B.answers(got, EXACT)
        cover = np.zeros(t.size + 1, np.int32)
        if c.order.size:
            place, left, right = c.place[c.order], c.left[c.order].astype(np.int64), c.right[c.order].astype(np.int64)
            low, high = (x[c.group].astype(np.int64) for x in np.divmod(bit, 64)[::-1])
            later = c.ids[c.order] > c.least[c.group]  # an earlier document of this block has the whole context
            low = np.where(later, np.minimum(low, length - right), low)
            high = np.where(later, np.maximum(high, left + 1), high)
            hit = low < high  # strings that start high - 1 to low bytes left of the anchor: each meets the next
            np.add.at(cover, place[hit] - high[hit] + 1, 1)
            np.add.at(cover, place[hit] - low[hit] + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        return _kept(t, gone, with_text)

    cells = dealt.groupBy("block").applyInArrow(sketch, B.CELLS)
    counts = cells.groupBy("slice").applyInArrow(B.merge_sketches(2), B.ANSWERS)
    runs = dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(suffixes, RUNS)
    places = runs.groupBy("slice").applyInArrow(_places(length, gram), B.ANSWERS)
    out = dealt.groupBy("block").cogroup(counts.unionByName(places).groupBy("block")).applyInArrow(remove, SCHEMA)
    return out if with_text else out.drop("kept")


def _kept(t: B.Texts, gone: np.ndarray, with_text: bool) -> pa.Table:
    n = t.ids.size
    size = np.diff(t.off)
    ends = np.concatenate([[0], np.cumsum(~gone)])[t.off]
    body = t.data[: t.size][~gone].tobytes()
    texts = [body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    edge = np.zeros(t.size + 1, bool)
    edge[t.off] = True
    begins = gone.copy()
    begins[1:] &= ~gone[:-1] | edge[1:-1]
    doc = np.searchsorted(t.off, np.flatnonzero(begins), side="right") - 1
    return pa.table(
        [t.id_column(), size, size - np.diff(ends), np.bincount(doc, minlength=n), [hashlib.sha256(x).hexdigest() for x in texts], pa.array(texts if with_text else [None] * n, pa.binary())], _SCHEMA
    )
