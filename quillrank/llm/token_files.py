"""Token-id files of independent zstandard frames, with an index of documents and a trailing seek table.

A file is a run of zstandard frames, each with a content checksum and whole documents only; then a skippable frame
with the documents' ids and lengths; then the seek table of the public seekable format (a skippable frame with each
frame's sizes and the low half of its XXH64, and a footer), so that a reader finds and decompresses only the frames of
the documents it is asked for.  Ids are little-endian unsigned 32-bit integers; an end id closes every document.

Documents are dealt by ranges of ids, so files and the documents in them are in ascending order (rows without an id come
first, rows that share one in the order of their texts' hash).  A file is written under a name of its task's own and
renamed when it is whole: a task that is run again replaces its file by an equal one.

Texts go to the tokenizers library.  Where the loaded tokenizer is a plain byte-level one, texts of Latin characters
(below U+0250) without special tokens go to a quicker merger that is built from the loaded tokenizer's own merges and
pre-tokenizer pattern (no other vocabulary); tests hold both against each other, character by character.

Nulls: a null text is empty, its document has the end id only.  An empty table makes no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._blocks import shared_dir, text_bytes, written

#: Fixed values of the public zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 18
#: Fixed pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER = re.compile("[^\x00-\u024f]")


def _filesystem(path: str):
    """(filesystem, path) of a local path or of any store that Arrow knows."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path) if "://" not in path or path.startswith("file:") else fs.FileSystem.from_uri(path)


class TokenFileWriter:
    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.fs, self.path = _filesystem(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_bytes, self.held, self.held_bytes = frame_bytes, [], 0
        self.ids, self.sizes, self.frames, self.tokens = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        body = b"".join(self.held)
        packed = self.zip.compress(body)
        self.out.write(packed)
        self.frames.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        known = np.array([i is not None for i in self.ids], np.uint8)
        index = self.zip.compress(struct.pack("<Q", len(self.ids)) + known.tobytes() + np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.sizes, "<u8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        self.fs.move(self.part, self.path)


class TokenFile:
    """Reads whole files, or single documents through the seek table; every frame's checksum is checked."""

    def __init__(self, path: str):
        fs, path = _filesystem(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER or flags != 0x80:
            raise ValueError(f"{path}: no seek table")
        self.frames = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.tokens_before = np.concatenate([[0], np.cumsum(self.frames[:, 1] // 4)])
        magic, length = struct.unpack("<II", self._at(int(self.begin[-1]), 8))
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[-1]) + 8, length))
        (docs,) = struct.unpack_from("<Q", raw)
        self.known = np.frombuffer(raw, np.uint8, docs, 8).astype(bool)
        self.ids = np.frombuffer(raw, "<i8", docs, 8 + docs)
        self.sizes = np.frombuffer(raw, "<u8", docs, 8 + 9 * docs).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        packed, size, check = self.frames[k].tolist()
        body = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), packed), max_output_size=size)
        if len(body) != size or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return body

    def documents(self):
        """(doc_id, start in the file, ids) of all documents, a frame at a time."""
        i = 0
        for k in range(len(self.frames)):
            body, base = self.frame(k), int(self.tokens_before[k])
            while i < self.sizes.size and self.starts[i] < self.tokens_before[k + 1]:
                a = 4 * (int(self.starts[i]) - base)
                yield (int(self.ids[i]) if self.known[i] else None), int(self.starts[i]), body[a : a + 4 * int(self.sizes[i])]
                i += 1

    def read(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document of this id; only their frames are decompressed."""
        out = []
        for i in np.flatnonzero(self.known & (self.ids == doc_id)):
            k = int(np.searchsorted(self.tokens_before, self.starts[i], side="right")) - 1
            a = 4 * int(self.starts[i] - self.tokens_before[k])
            out.append(np.frombuffer(self.frame(k)[a : a + 4 * int(self.sizes[i])], "<u4"))
        return out


class TextEncoder:
    """A tokenizer of the tokenizers library, with a quicker way for plain texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = self._merger(json.loads(self.tokenizer.to_str()), self.tokenizer.get_vocab(with_added_tokens=True))

    def _merger(self, whole: dict, pieces: dict[str, int]):
        """A merger with this tokenizer's own merges.

        Only where the tokenizer is a plain byte-level one and its ids follow the order of its merges, as ranks have to;
        else none, and the library encodes all texts.
        """
        import tiktoken

        model, pre = whole["model"], whole["pre_tokenizer"] or {}
        if whole["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        hidden = [c for c in range(256) if c not in shown]
        byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}
        merges = [pieces["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        usual = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not usual or merges != sorted(set(merges)) or any(pieces.get(c, merges[0]) >= merges[0] for c in byte):
            return None
        made = set(merges)
        ranks = {bytes(byte[c] for c in p): i for p, i in pieces.items() if all(c in byte for c in p) and (len(p) == 1 or i in made)}
        return tiktoken.Encoding("own merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.quick and (text.isascii() or not OTHER.search(text)) and not any(x in text for x in self.special):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_bytes: int = 16 << 20, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes the files; returns their list: path, part, n_docs, n_tokens, start (ids in all files before)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, local = _filesystem(folder)
    fs.create_dir(local, recursive=True)
    end = np.array([end_id], "<u4").tobytes()
    files = max(8, -(-text_bytes(docs, text_col) // file_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches):
        enc, part, out = text_encoder(tokenizer_path), TaskContext.get().partitionId(), None
        path = f"{folder}/part-{part:06d}.zst"
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                out = out or TokenFileWriter(path, frame_bytes)
                for i, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    out.add(i, enc.encode(text or "") + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "part": [part], "n_docs": [len(out.ids)], "n_tokens": [out.tokens]})

    done = written(rows.mapInArrow(write, "path string, part long, n_docs long, n_tokens long"), "files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    return done.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files' bytes."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = [(i, base + at, len(ids) // 4, zlib.crc32(ids)) for i, at, ids in TokenFile(path).documents()]
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 10_000], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "start").repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
