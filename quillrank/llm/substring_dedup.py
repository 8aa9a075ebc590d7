"""Removal of word windows that occur in an earlier document, with a Count-min prefilter.

1. Each block sketches its windows (a Count-min sketch kept sparse and cut by slices of the cell space).  The slices
   merge the sketches and answer every block with the merged counts of its own cells.  An estimate is the least count
   over the sketch rows, so it is never too small: a window estimated once occurs once.
2. Only windows estimated repeated travel, as 128-bit fingerprints with the smallest document of their block.  Slices of
   the fingerprint space group them exactly and answer one bit: does an earlier document elsewhere hold this window?
3. Each block marks the words that such windows cover.

Words are cut and hashed over the UTF-8 bytes in numpy.  The corpus is shuffled once (all passes reuse that exchange).

Nulls: a null text has no words; a row with a null id comes after all documents and has a null id in the result.  Rows
that share an id are one document's rows: none is earlier than another.  Texts of fewer words than the window keep all.
Empty tables give empty results.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks as B

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
KEYS = "slice int, block int, hi binary, lo binary, doc binary"
_KEYS = pa.schema([("slice", pa.int32()), ("block", pa.int32()), ("hi", pa.binary()), ("lo", pa.binary()), ("doc", pa.binary())])
#: Kinds of answers: sketch rows have their number, the exact pass this one.
EXACT = 100


def _windows(t: B.Texts, width: int):
    s, e, doc = B.word_spans(t.data, t.off, t.size)
    a, b = B.word_hashes(t.data, s, e, 2) if s.size else (np.zeros(0, np.uint64),) * 2
    at, hi = B.window_hashes(a, doc, width, 0x9E3779B97F4A7C15)
    _, lo = B.window_hashes(b, doc, width, 0xC2B2AE3D27D4EB4F)
    return s, e, doc, at, hi, lo


def _repeated_keys(ids, doc, at, hi, lo, seen):
    """Of the windows estimated repeated: their places, the distinct keys in order with the smallest document, each one's key."""
    k = np.flatnonzero(seen >= 2)
    order = k[np.lexsort((lo[k], hi[k]))]
    h, w, d = hi[order], lo[order], ids[doc[at[order]]]
    new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])) if order.size else np.zeros(0, bool)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(d, first) if order.size else d
    return order, h[first], w[first], least, np.cumsum(new) - 1, d


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, block_bytes: int = 4 << 20, depth: int = 2, cells_per_window: int = 8, with_text: bool = True
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, the kept words joined by one space."""
    total = B.text_bytes(docs, text_col)
    blocks, windows = B.n_blocks(total, block_bytes), max(1, total // 6)
    bits, slices = max(16, (cells_per_window * windows).bit_length()), B.n_slices(windows)
    dealt = B.dealt(docs, id_col, text_col, blocks)

    def sketch(key, table):
        t = B.Texts(table)
        return B.sketch_rows(key[0].as_py(), _windows(t, width)[4], bits, depth, slices, 2)

    def repeated(key, table, got):
        t = B.Texts(table)
        _, _, doc, at, hi, lo = _windows(t, width)
        _, h, w, least, _, _ = _repeated_keys(t.ids, doc, at, hi, lo, B.estimates(hi, bits, depth, got))
        cuts = B.slice_cuts(h, 64, slices)
        out = [(s, key[0].as_py(), B.pack_sorted(h[a:b]), B.zip_bytes(w[a:b]), B.pack(least[a:b].astype(np.uint64))) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.table([list(x) for x in zip(*out, strict=True)] if out else [[]] * 5, _KEYS)

    def group(table):
        rows = table.to_pylist()
        parts = [(B.unpack_sorted(x["hi"]), B.unzip_bytes(x["lo"], np.uint64), B.unpack(x["doc"]).astype(np.int64)) for x in rows]
        h, w, d = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((w, h))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1]))
        least = np.minimum.reduceat(d[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        flag = np.empty(h.size, np.uint64)
        flag[order] = least < d[order]
        cut = np.split(flag, np.cumsum([p[0].size for p in parts])[:-1])
        return pa.table([[x["block"] for x in rows], [EXACT] * len(rows), [x["slice"] for x in rows], [B.pack(f) for f in cut]], B._ANSWERS)

    def remove(key, table, got):
        t = B.Texts(table)
        s, e, doc, at, hi, lo = _windows(t, width)
        order, _, _, least, group_of, d = _repeated_keys(t.ids, doc, at, hi, lo, B.estimates(hi, bits, depth, got))
        earlier = B.answers(got, EXACT).astype(bool)
        hit = at[order[earlier[group_of] | (d > least[group_of])]] if order.size else order
        cover = np.zeros(s.size + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + width, -1)
        return _kept(t, s, e, doc, np.cumsum(cover[:-1]) == 0, with_text)

    cells = dealt.groupBy("block").applyInArrow(sketch, B.CELLS)
    counts = cells.groupBy("slice").applyInArrow(B.merge_sketches(2), B.ANSWERS)
    keys = dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(repeated, KEYS)
    flags = keys.groupBy("slice").applyInArrow(group, B.ANSWERS)
    out = dealt.groupBy("block").cogroup(counts.unionByName(flags).groupBy("block")).applyInArrow(remove, SCHEMA)
    return out if with_text else out.drop("kept")


def _kept(t: B.Texts, s, e, doc, keep, with_text: bool) -> pa.Table:
    """The kept words of each document, one space between them, made as one byte mask over the block."""
    n = t.ids.size
    words = np.bincount(doc, minlength=n)
    kept = np.bincount(doc[keep], minlength=n)
    ks, ke, kd = s[keep], e[keep], doc[keep]
    mark = np.zeros(t.size + 1, np.int32)
    mark[ks] += 1
    mark[ke] -= 1
    use = np.cumsum(mark[:-1]) > 0
    data = t.data[: t.size].copy()
    inner = np.flatnonzero(kd[1:] == kd[:-1]) if kd.size else np.zeros(0, np.int64)
    gap = ke[inner]  # a space, or another white byte, follows every word that is not its document's last
    data[gap] = 32
    use[gap] = True
    ends = np.concatenate([[0], np.cumsum(use)])[t.off]
    body = data[use].tobytes()
    texts = [body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table(
        [t.id_column(), words, words - kept, [hashlib.sha256(x).hexdigest() for x in texts], pa.array([x.decode() for x in texts] if with_text else [None] * n, pa.string())],
        _SCHEMA,
    )
