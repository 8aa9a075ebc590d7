"""Blocks of documents, word and byte fingerprints, and the sparse census that the duplicate operators share.

A corpus is dealt once into *blocks* by a hash of the document id.  A block is what one Python call sees: some
megabytes of UTF-8, handled as numpy arrays over the Arrow buffers.  Facts about keys that occur in several
blocks (counts, smallest document) are found by *slices* of the key space: every block sends each slice one
compressed, sorted, pre-aggregated list, the slice merges the lists and answers with one small value per entry.
So nothing is broadcast or collected, a key sends at most one entry per block however often it occurs, and the
answers cost bits, not keys.
"""

from __future__ import annotations

import ctypes
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of rows without one: such a row is later than every document.
NO_ID = np.iinfo(np.int64).max
U = np.uint64
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_M1, _M2, _M3, _M4 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
#: Odd factors, one for each row of a sketch.
ROWS = [U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)]


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "/tmp/quillrank-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage is cut and no executor's loss hurts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Gives memory that numpy and Arrow have freed back to the system: workers stay between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# ---------------------------------------------------------------- blocks
def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]


def n_blocks(total_bytes: int, block_bytes: int) -> int:
    """Blocks grow with the square root beyond 64 GiB, so that lists from block to slice stay worth sending."""
    size = max(block_bytes, int(block_bytes * math.sqrt(total_bytes / 2**36)))
    return max(8, math.ceil(total_bytes / size))


def dealt(df: DataFrame, id_col: str, text: str, blocks: int) -> DataFrame:
    """(block, doc_id, text): rows without an id are dealt by their text."""
    key = F.coalesce(F.xxhash64(F.col(id_col)), F.xxhash64(F.col(text)))
    return df.select(
        F.pmod(key, F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    )


class Texts:
    """The texts of one block as one byte array; ids are NO_ID where null."""

    def __init__(self, table: pa.Table, column: str = "text"):
        ids = table["doc_id"]
        self.null_id = np.asarray(ids.is_null().combine_chunks()) if ids.null_count else None
        self.ids = np.asarray(ids.fill_null(int(NO_ID)).combine_chunks(), dtype=np.int64)
        col = table[column].fill_null("").combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
        wide = pa.types.is_large_string(col.type)
        bufs = col.buffers()
        off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        off = off.astype(np.int64)
        raw = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if len(col) and bufs[2] is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.data = np.zeros(raw.size + 64, np.uint8)  # room for loads beyond the end
        self.data[: raw.size] = raw
        self.size = raw.size

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null_id)


def word_spans(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than space and 9 to 13), and each one's document."""
    if not size:
        return (np.zeros(0, np.int64),) * 3
    body = data[:size]
    word = ~((body == 32) | ((body >= 9) & (body <= 13)))
    edge = np.zeros(size + 1, bool)
    edge[off] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(off, s, side="right") - 1
    return s, e, doc


def mix(h: np.ndarray, a=_M1, b=_M2) -> np.ndarray:
    h = (h ^ (h >> U(30))) * a
    h = (h ^ (h >> U(27))) * b
    return h ^ (h >> U(31))


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    return np.ndarray((data.size - 7,), "<u8", data, strides=(1,))


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """lanes independent 64-bit hashes of each word, eight bytes a step."""
    at, left = loads(data), (e - s)
    seeds = [(U(0x243F6A8885A308D3), _M1, _M2), (U(0x13198A2E03707344), _M3, _M4)][:lanes]
    x = at[s] & _MASK[np.minimum(left, 8)]
    out = [mix(x ^ (seed + left.astype(np.uint64) * ROWS[0]), a, b) for seed, a, b in seeds]
    k, j = np.flatnonzero(left > 8), 8
    while k.size:
        x = at[s[k] + j] & _MASK[np.minimum(left[k] - j, 8)]
        for h, (_, a, b) in zip(out, seeds, strict=True):
            h[k] = mix(h[k] * ROWS[1] + x, a, b)
        j += 8
        k = k[left[k] > j]
    return out


def window_hashes(words: np.ndarray, doc: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of width words within one document."""
    n = words.size
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b, inv = U(base), U(pow(base, -1, 1 << 64))
    up = np.full(n + 1, b, np.uint64)
    up[0] = 1
    np.cumprod(up, out=up)
    down = np.full(n + 1, inv, np.uint64)
    down[0] = 1
    np.cumprod(down, out=down)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    return at, mix((total[at + width] - total[at]) * down[at])


# ---------------------------------------------------------------- compact lists
_C, _D = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    a = np.ascontiguousarray(a, dtype="<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if a.size else 1
    planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + _C.compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_D.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def zip_bytes(a: np.ndarray) -> bytes:
    return _C.compress(np.ascontiguousarray(a).tobytes())


def unzip_bytes(blob: bytes, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(_D.decompress(blob), dtype)


def slice_cuts(sorted_keys: np.ndarray, bits: int, slices: int) -> np.ndarray:
    """Where each slice of the key space [0, 2**bits) begins in sorted_keys."""
    edges = np.array([(s << bits) // slices for s in range(slices)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_keys, edges), sorted_keys.size)


def n_slices(entries: int, each: int = 1_500_000) -> int:
    return max(8, math.ceil(entries / each))


# ---------------------------------------------------------------- census of cells
CELLS = "slice int, block int, row int, cells binary, counts binary"
ANSWERS = "block int, kind int, slice int, answer binary"
_CELLS = pa.schema([("slice", pa.int32()), ("block", pa.int32()), ("row", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
_ANSWERS = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("slice", pa.int32()), ("answer", pa.binary())])


def rows_of(h: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    """The cell of each hash in each of depth sketch rows of 2**bits cells."""
    return [mix(h * ROWS[r]) >> U(64 - bits) for r in range(depth)]


def sketch_rows(block: int, h: np.ndarray, bits: int, depth: int, slices: int, top: int) -> pa.Table:
    """One block's sketch of the hashes h: its non-zero cells with counts up to top, cut by slice."""
    out: dict[str, list] = {k: [] for k in _CELLS.names}
    for r, cells in enumerate(rows_of(h, bits, depth)):
        at, n = np.unique(cells, return_counts=True)
        n = np.minimum(n, top).astype(np.uint64)
        cuts = slice_cuts(at, bits, slices)
        for s in range(slices):
            a, b = cuts[s], cuts[s + 1]
            if b > a:
                for k, v in zip(_CELLS.names, (s, block, r, pack_sorted(at[a:b]), pack(n[a:b])), strict=True):
                    out[k].append(v)
    return pa.table(out, _CELLS)


def merge_sketches(top: int):
    """For groupBy(slice): adds the blocks' cells and answers each list with the sums, up to top."""

    def merge(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in _ANSWERS.names}
        rows = table.to_pylist()
        for r in sorted({x["row"] for x in rows}):
            own = [x for x in rows if x["row"] == r]
            lists = [unpack_sorted(x["cells"]) for x in own]
            cells, counts = np.concatenate(lists), np.concatenate([unpack(x["counts"]) for x in own])
            order = np.argsort(cells, kind="stable")
            new = np.append(True, cells[order][1:] != cells[order][:-1])
            sums = np.minimum(np.add.reduceat(counts[order], np.flatnonzero(new)), U(top))
            answer = np.empty(cells.size, np.uint64)
            answer[order] = sums[np.cumsum(new) - 1]
            for x, part in zip(own, np.split(answer, np.cumsum([a.size for a in lists])[:-1]), strict=True):
                for k, v in zip(_ANSWERS.names, (x["block"], r, x["slice"], pack(part)), strict=True):
                    out[k].append(v)
        return pa.table(out, _ANSWERS)

    return merge


def answers(table: pa.Table, kind: int) -> np.ndarray:
    """The answers of one kind to this block, in the order of its sorted list."""
    rows = sorted((s, a) for k, s, a in zip(table["kind"].to_pylist(), table["slice"].to_pylist(), table["answer"].to_pylist(), strict=True) if k == kind)
    return np.concatenate([unpack(a) for _, a in rows]) if rows else np.zeros(0, np.uint64)


def estimates(h: np.ndarray, bits: int, depth: int, table: pa.Table) -> np.ndarray:
    """The smallest count over the sketch rows for each hash: never below the true count (up to top)."""
    least = None
    for r, cells in enumerate(rows_of(h, bits, depth)):
        _, inverse = np.unique(cells, return_inverse=True)
        got = answers(table, r)[inverse] if h.size else np.zeros(0, np.uint64)
        least = got if least is None else np.minimum(least, got)
    return least
