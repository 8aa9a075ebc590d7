"""Small documents with everything that can go wrong, and brute-force versions of the operators' contracts."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, slice string, node long, key string, term string, spans string"


def words(text):
    return WORD.findall(text or "")


def sentence(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}{r.choice(['', ',', '.', 'é'])}" for _ in range(n))


def texts():
    r = random.Random(4)
    base = [sentence(r, r.randrange(1, 300)) for _ in range(30)]
    shared = sentence(r, 70)
    out = list(base)
    out += base[:4] * 3
    for i in range(40):
        w = base[i % 6].split(" ")
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(50)}"
        out.append(" ".join(w))
    out += [f"{sentence(r, r.randrange(0, 90))} {shared} {sentence(r, r.randrange(0, 60))}" for _ in range(12)]
    out += [shared, shared.upper(), "", None, None, " \t\n ", "a", "a b c d", "A B c D", "a b c d e", "same " * 120, "same " * 300, "x" * 5000, "é" * 700 + "日本語 " * 90]
    out += ["a\x0bb\x0cc\r\nd  e", "\x00\x01 odd \x7f", "🙂 " * 60, sentence(r, 6000, 50)]
    r.shuffle(out)
    return out


def rows():
    """(doc_id, text, ...) with extra columns of clashing names, null and repeated ids, repeated rows."""
    out = [(3 * i + 1, t, "en", "s", 1, 7, "x", 9, "k", "t", "p") for i, t in enumerate(texts())]
    out += [out[5], out[6], (out[7][0], "another text of the same id", None, None, None, None, None, None, None, None, None)]
    out += [(None, out[0][1], None, "s", 1, 1, "x", 9, "k", "t", "p"), (None, None, None, None, None, None, None, None, None, None, None), (None, out[0][1], None, "s", 1, 1, "x", 9, "k", "t", "p")]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


LATEST = 1 << 62


def removed_units(data, width, split):
    """For each row the units (words or bytes) and which of them are covered by a run that also starts in an earlier document."""
    first: dict = {}
    for row in data:
        u, i = split(row[1]), LATEST if row[0] is None else row[0]
        for a in range(len(u) - width + 1):
            k = tuple(u[a : a + width])
            first[k] = min(i, first.get(k, i))
    out = []
    for row in data:
        u, i = split(row[1]), LATEST if row[0] is None else row[0]
        gone = [False] * len(u)
        for a in range(len(u) - width + 1):
            if first[tuple(u[a : a + width])] < i:
                gone[a : a + width] = [True] * width
        out.append((u, gone))
    return out
