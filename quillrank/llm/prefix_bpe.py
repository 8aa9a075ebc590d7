"""SentencePiece merge (BPE) encoding by a table of each prefix's last token, and decoding.

The encoding of every prefix of a text ends in one token.  An Aho-Corasick automaton over the vocabulary lists the tokens
that end at a place; the one that is compatible with the last token of the prefix before it is the last token there.
Two tokens are compatible if encoding their concatenation gives just them; that is tested by undoing their merges next
to the border, the latest first, and asking each time whether a merge across the border would have come earlier.  The ids
are then recovered backwards from the end of the text.

No piece has a space sign after another character, so a text is cut before each run of them and words are encoded
apart; results of short words are remembered in a bounded table of two generations.

Nulls: a null text is an empty one, and has only the begin and end ids.  Ids may be null or repeated; other columns are
kept or ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import tidy

SPACE = "▁"
INF = float("inf")


class Remembered(dict):
    """compute(key), remembered for the last `most` to 2 * `most` distinct short keys."""

    def __init__(self, compute, most: int = 120_000, longest: int = 48):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PrefixEncoder:
    def __init__(self, model_path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = m.get_piece_size()
        self.bos, self.eos, self.unk = m.bos_id(), m.eos_id(), m.unk_id()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        for i in range(n):
            if m.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:-1], 16)] = i
                special.add(i)
        self.score = [m.get_score(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("this vocabulary joins words; it needs the space sign at the front of pieces only")
        self.size = [len(p) for p in self.pieces]
        # the last merge of each token that encodes as itself, and whether its parts always come before it
        self.left, self.right = [-1] * n, [-1] * n
        self.plain = True
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if set(p) == {SPACE} and len(p) > 1:
                continue  # runs of spaces have their own rule of ties
            parts, last = self.merged(p)
            if parts != [p]:
                continue
            if last:
                a, b = (self.ids.get(x) for x in last)
                if a is None or b is None:
                    self.plain = False
                    continue
                self.left[i], self.right[i] = a, b
                whole = [self.score[x] for x in (a, b) if self.size[x] > 1]
                self.plain &= all(self.score[i] < s for s in whole)
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        if not self.plain:
            raise ValueError("this vocabulary has tokens whose parts come after them; the border test does not hold for it")
        self.joined = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.joined[a << 20 | b] = self.score[i]
        self.fits: dict = {}
        self.table = [self._bytes(i, i in special) for i in range(n)]
        self.words = Remembered(self._word)

    def _bytes(self, i: int, special: bool) -> bytes:
        if i in self.byte_ids:
            return bytes([self.byte_ids.index(i)])
        if i == self.unk:
            return " ⁇ ".encode()
        return b"" if special else self.pieces[i].replace(SPACE, " ").encode()

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging, the best score first and the leftmost of equals: the parts, and the last merge."""
        parts: list = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else len(parts)
            if b < len(parts):
                i = self.ids.get(parts[a] + parts[b])
                if i is not None:
                    heapq.heappush(heap, (-self.score[i], a, parts[a], parts[b]))

        for a in range(len(parts) - 1):
            offer(a)
        last = None
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = after[a]
            if parts[a] != x or b >= len(parts) or parts[b] != y:
                continue
            last = (x, y)
            parts[a], parts[b] = x + y, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [p for p in parts if p is not None], last

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their texts stand together."""
        key = a << 20 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 400_000:
                self.fits.clear()
            found = self.fits[key] = self._compatible(a, b)
        return found

    def _compatible(self, x: int, y: int) -> bool:
        joined, left, right, score = self.joined, self.left, self.right, self.score
        if (x << 20 | y) in joined:
            return False
        while True:
            sx = score[x] if right[x] >= 0 else INF
            sy = score[y] if left[y] >= 0 else INF
            if sx < sy:
                x = right[x]
                if joined.get(x << 20 | y, -INF) > sx:
                    return False
            elif sy < INF:  # of equals the left one is merged first, so the right one is the later
                y = left[y]
                if joined.get(x << 20 | y, -INF) >= sy:
                    return False
            else:
                return True

    def encode_span(self, span: str) -> list[int]:
        """The ids of a text with at most one space sign, at its start."""
        last: list = [None] * len(span)
        size, fits, compatible = self.size, self.fits, self.compatible
        for end, i in self.automaton.iter(span):
            if last[end] is None:
                start = end - size[i]
                if start < 0:
                    last[end] = i
                else:
                    p = last[start]
                    if p is None:
                        last[end] = i
                    else:
                        ok = fits.get(p << 20 | i)
                        if ok or ok is None and compatible(p, i):
                            last[end] = i
        out, at = [], len(span) - 1
        while at >= 0:
            i = last[at]
            if i is None:
                out.extend(self.byte_ids[b] for b in reversed(span[at].encode()))
                at -= 1
            else:
                out.append(i)
                at -= size[i]
        out.reverse()
        return out

    def _word(self, word: str) -> bytes:
        return np.array(self.encode_span(SPACE + word), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of the text, without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = (text.replace(SPACE, " ") if SPACE in text else text).split(" ")
        if "" not in words:
            return b"".join(map(self.words.__getitem__, words))
        out, spaces = [], 0
        one = np.array([self.ids[SPACE]], "<u4").tobytes()
        for w in words:
            spaces += 1
            if w:
                ids = self.words[w]
                if spaces > 1 and ids[:4] == one:
                    out += [self._spaces(spaces), ids[4:]]
                else:
                    out += [self._spaces(spaces - 1), ids]
                spaces = 0
        return b"".join([*out, self._spaces(spaces)])

    def _spaces(self, n: int) -> bytes:
        return np.array([self.ids[p] for p in self.merged(SPACE * n)[0]], "<u4").tobytes() if n else b""

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids give none, the space before the first piece goes, broken UTF-8 gives U+FFFD."""
        raw = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def encoder(model_path: str) -> PrefixEncoder:
    return PrefixEncoder(model_path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (binary) and decoded, row by row; no shuffle."""

    def run(batches):
        enc = encoder(model_path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (enc.bos, enc.eos))
        for batch in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):
            ids, back = [], []
            for text in batch.column("text").to_pylist():
                ids.append(begin + enc.encode(text or "") + end)
                back.append(enc.decode(ids[-1]))
            sha = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in back]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, sha), pa.array(ids if with_ids else [None] * len(ids), pa.binary()), pa.array(back if with_ids else [None] * len(ids), pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
            )
            del ids, back, sha, text
            tidy()

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string")
    return out if with_ids else out.drop("ids", "decoded")
