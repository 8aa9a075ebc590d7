"""Personal data, benchmark leaks and recordings against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import fixtures as fx
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.llm import chroma as C
from quillrank.llm import decontaminate as Q
from quillrank.llm import disclosure as D

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
ODD = [
    "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.3.4", "4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (555) 123-4567 +12", "é🙂 mail: a.b@c.de, tel +49 30 1234567.", "1.2.3.4@foo.bar",
    "x" * 20000 + "@", "1" * 20000, "1.2." * 500, "+1 2 3" * 500, "+" + "1" * 20000, "a@b" + ".c" * 5000, "@@ .@. a@b a@b. +", "378282246310005 30569309025904 4222222222222", "+49-30-(0)-1234567-", "0000.00.0255.1 256.1.1.1", None, "",
]


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{D.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans(spark):
    data = [(i, x) for i, x in enumerate(ODD)] + [(1, ODD[4]), (None, ODD[4])]
    found = D.find_disclosures(spark.createDataFrame(data, "doc_id long, text string"), support=10**6).collect()
    want = []
    for i, x in data:
        spans = base(x or "")
        n = Counter(k for _, k, _ in spans)
        want.append((i, n[0], n[1], n[2], n[3], 0, hashlib.sha256(listed(spans).encode()).hexdigest(), listed(spans)))
    assert sorted((tuple(r)[:8] for r in found), key=repr) == sorted(want, key=repr)


def _private_corpus():
    r = random.Random(7)
    plain = [f"{fx.sentence(r, 30)} common words everywhere" for _ in range(60)]
    told = [f"{fx.sentence(r, 5)} contact Zanzibar at kim{j}@mail.example common {fx.sentence(r, 5)}" for j in range(2) for _ in range(3)]
    return [(i, x) for i, x in enumerate(plain + told + ["Zanzibar alone", None])]


def revealed(data, generalise_at=0.7, remove_at=0.9):
    """For each row the spans of terms, with whether they go: counts by hand over all rows."""
    n = len(data)
    has, near, holds = defaultdict(set), defaultdict(set), defaultdict(set)
    windows = []
    for row, (_, x) in enumerate(data):
        for w in set(re.findall(r"[^\W\d_]+", (x or "").lower())):
            holds[w].add(row)
        spans = base(x or "")
        for j, (a, k, b) in enumerate(spans):
            e = (k, x[a:b].lower())
            has[e].add(row)
            lo = max([0, *(s[2] for s in spans[:j])])
            hi = min([len(x), b + 60, *(s[0] for s in spans[j + 1 :])])
            left = max(lo, a - 60)
            for m in re.finditer(r"[^\W\d_]+", x[left:a] + "\0" * (b - a) + x[b:hi]):
                s, t = left + m.start(), left + m.end()
                cut = (s == left and left > lo) or (t == hi == b + 60)
                if not cut and t - s >= 3:
                    near[e, m[0].lower()].add(row)
                    windows.append((row, s, t, e, m[0].lower()))
    want = [{} for _ in data]
    for row, s, t, e, w in windows:
        if len(near[e, w]) >= 2 and len(has[e]) < n:
            share = np.log2(len(near[e, w]) * n / (len(has[e]) * len(holds[w]))) / np.log2(n / len(has[e]))
            if share >= generalise_at:
                want[row][s, 4, t] = want[row].get((s, 4, t), False) or share >= remove_at
    return want


def test_revealing_terms_by_hand(spark):
    data = _private_corpus()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = {r.doc_id: r for r in D.find_disclosures(docs).collect()}
    want = revealed(data)
    assert any(want)
    for (i, x), terms in zip(data, want, strict=True):
        assert found[i].spans == listed(sorted([*base(x or ""), *terms])), i
    assert "anzibar" not in found[60].sanitised and "<EMAIL>" in found[60].sanitised and "common" in found[60].sanitised
    assert found[66].spans == "" and found[66].sanitised is None


def test_terms_count_in_the_whole_document(spark):
    r = random.Random(9)
    far = "common " * 20
    told = [f"Zanzibar {far} kim@mail.example {far} Zanzibar x 李明 +49 30 1234567 {far} Zanzibar" for _ in range(3)]
    data = [(i, x) for i, x in enumerate(told + [f"common {fx.sentence(r, 20)}" for _ in range(60)])]
    found = {x.doc_id: x for x in D.find_disclosures(spark.createDataFrame(data, "doc_id long, text string"), reach=None).collect()}
    for i in range(3):
        assert not re.search("Zanzibar|李明", found[i].sanitised) and "common" in found[i].sanitised and found[i].n_term == 4


def test_sanitise_keeps_rows_and_columns(spark):
    docs = fx.frame(spark, [*fx.rows(), (9000, "write to a.b@c.de now", "en", "s", 1, 1, "x", 1, "k", "t", "p")])
    out = D.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 9000").first().text == "write to <EMAIL> now"
    same = docs.where("doc_id <> 9000 or doc_id is null").exceptAll(out)
    assert same.count() == 0
    assert D.sanitise(fx.frame(spark, [])).count() == 0 == D.find_disclosures(fx.frame(spark, [])).count()


def test_native_plans_hold_no_python(spark):
    for df in (D.find_disclosures(fx.frame(spark)), D.sanitise(fx.frame(spark))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString().replace("ArrowEval", ""))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, t in enumerate(b):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row


def inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_against_alignment():
    r = random.Random(3)
    items = [fx.sentence(r, r.randrange(12, 40)) for _ in range(12)] + ["short one", fx.sentence(r, 30)[:60]]
    bench = Q.Benchmark(list(range(len(items))), items)
    for _ in range(120):
        i = r.randrange(len(items))
        s = list(items[i].lower())
        for _ in range(r.randrange(0, int(bench.budget[i]) + 5)):
            p, what = r.randrange(len(s)), r.randrange(3)
            s[p : p + (what != 1)] = [] if what == 2 else [r.choice("qxz ")]
        text = fx.sentence(r, r.randrange(0, 60)) + r.choice(["", " "]) + "".join(s).title() + fx.sentence(r, r.randrange(0, 40))
        low = text.lower()
        for j, item in enumerate(bench.texts):
            d, found = inside(item, low), [x for x in bench.find(text) if x[0] == j]
            assert bool(found) == (d <= (bench.budget[j] if bench.least[j] >= 1 else 0))
            if found:
                _, a, b, n = found[0]
                assert n == d == edits(item, low[a:b])[-1]


def test_all_places_of_an_item():
    """Several copies in one text, each with its own number of edits, exact ones among them."""
    r = random.Random(13)
    items = [fx.sentence(r, 20), fx.sentence(r, 35), "short one"]
    bench = Q.Benchmark([0, 1, 2], items)
    for _ in range(40):
        text, want = fx.sentence(r, 10) + " ", []
        for _ in range(r.randrange(0, 5)):
            j = r.randrange(3)
            s = list(bench.texts[j])
            for _ in range(r.choice([0, 0, 1, int(bench.budget[j]) // 2]) if j < 2 else 0):
                s[r.randrange(3, len(s) - 3)] = r.choice("#@")
            want.append((j, len(text)))
            text += "".join(s) + " " + fx.sentence(r, r.randrange(5, 30)) + " "
        found = bench.find(text)
        for j in range(3):
            own = [x for x in found if x[0] == j]
            assert [x[3] for x in own] == sorted(x[3] for x in own)
            assert len(own) == sum(i == j for i, _ in want)
            for (_, a, b, d), at in zip(sorted(own, key=lambda x: x[1]), [at for i, at in want if i == j], strict=True):
                assert abs(a - at) <= bench.budget[j] and edits(items[j].lower(), text.lower()[a:b])[-1] == d


def test_leak_tables(spark):
    docs = fx.frame(spark)
    source = next(r for r in fx.rows() if r[0] and r[1] and 100 < len(r[1]) < 2000)
    items = spark.createDataFrame([(1, source[1][:150]), (2, None), (3, ""), (1, source[1][:150]), (4, "nowhere to be found " * 5)], "item_id long, text string")
    want = [r[0] for r in fx.rows() if r[1] and source[1][:150].lower() in r[1].lower()]
    found = Q.find_leaks(docs, items).collect()
    assert {r.item_id for r in found} == {1} and Counter(r.doc_id for r in found if r.distance == 0) == Counter(want * 2)
    kept = Q.without_leaks(docs, items)
    bad = {r.doc_id for r in found}
    clean = [r[:2] for r in fx.rows() if r[0] not in bad or r[0] is None and r[1] is None]
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(clean, key=repr)
    none = items.where("item_id = 2")
    assert Q.find_leaks(docs, none).count() == 0 and Q.without_leaks(docs, none).count() == docs.count()
    assert Q.find_leaks(fx.frame(spark, []), items).count() == 0
    assert Q.find_leaks(docs, items, part_bytes=100).count() == len(found)


def _tune(r, seconds, shift=0):
    t = np.arange(int(C.RATE * 0.25)) / C.RATE
    notes = [220 * 2 ** (r.randrange(0, 24) / 12) for _ in range(int(seconds * 4))]
    return np.concatenate([0.5 * np.sin(2 * np.pi * f * t) + 0.2 * np.sin(4 * np.pi * f * t) for f in notes])


def _pcm(x):
    return bytes(np.clip(np.round(x * 127 + 128), 0, 255).astype(np.uint8))


def test_filters_are_sums_over_the_image():
    r = random.Random(1)
    signal = np.asarray(_tune(r, 2), np.float32)
    image, n = C.chroma([signal])
    fp = C.fingerprints([signal])[0]
    assert fp.size == n[0] - C.SPAN + 1
    for at in (0, 7, fp.size - 1):
        packed = 0
        for kind, y, h, w in C.FILTERS:
            cut = image[at : at + w, y : y + h].astype(float)
            part = [cut[:, : h // 2], cut[: w // 2], None, cut[w // 3 : 2 * w // 3]][kind]
            a = cut[: w // 2, : h // 2].sum() + cut[w // 2 :, h // 2 :].sum() if kind == 2 else part.sum()
            value = np.log1p(a) - np.log1p(cut.sum() - a) + (np.log(2) / 2 if kind == 3 else 0)
            packed = packed << 2 | [0, 1, 3, 2][int(np.searchsorted([-C.STEP, 0, C.STEP], value))]
        assert bin(packed ^ int(fp[at])).count("1") <= 1


def test_recordings(spark):
    r, noise = random.Random(2), np.random.default_rng(1)
    tunes = [_tune(r, 12) for _ in range(5)]
    data = [(20 * i, _pcm(x)) for i, x in enumerate(tunes)]
    data += [(20 * i + 1, _pcm(x + noise.normal(0, 0.02, x.size))) for i, x in enumerate(tunes)]  # noisy
    data += [(20 * i + 2, _pcm(x[C.HOP * 40 :])) for i, x in enumerate(tunes)]  # starts later
    data += [(20 * i + 3, _pcm(x)) for i, x in enumerate(tunes)]  # copies
    data += [(201, _pcm(_tune(r, 12))), (202, None), (203, b""), (204, b"\x80" * 10), (None, _pcm(tunes[0])), (21, _pcm(tunes[1]))]
    x16 = (tunes[2] * 32767).astype("<i2").tobytes()
    wav = b"RIFF" + struct.pack("<I", 36 + len(x16)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, C.RATE, 2 * C.RATE, 2, 16) + b"data" + struct.pack("<I", len(x16)) + x16
    data.append((43 + 160, wav))
    docs = spark.createDataFrame(data, "doc_id long, audio binary")
    rows = defaultdict(list)
    for x in C.identify(docs, F.col("doc_id") % 20 == 0).collect():
        rows[x.doc_id].append(x)
    assert sum(map(len, rows.values())) == len(data)
    assert {x.class_id for x in rows[21]} == {20, 21}  # a copy of recording 20 shares an id with its noisy version
    rows[21] = [x for x in rows[21] if x.class_id == 21]
    for i in range(5):
        assert rows[20 * i + 1][0].match_id == 20 * i and rows[20 * i + 1][0].offset == 0 and rows[20 * i + 1][0].bit_error < 0.1
        assert rows[20 * i + 2][0].match_id == 20 * i and rows[20 * i + 2][0].offset == 40 and rows[20 * i + 2][0].bit_error < 0.05
        assert rows[20 * i + 3][0].class_id == 20 * i
        assert len({x.component_id for k in range(4) for x in rows[20 * i + k] if x.component_id is not None}) == 1
    assert rows[201][0].match_id is None and rows[202][0].n_fingerprints == 0 and rows[204][0].n_fingerprints == 1
    assert rows[203][-1].n_fingerprints in (0, rows[40][0].n_fingerprints) and max(x.n_fingerprints for x in rows[203]) == rows[40][0].n_fingerprints
    assert any(x.match_id == 40 for x in rows[203])
    assert C.identify(docs.where("doc_id < 0"), F.col("doc_id") % 20 == 0).count() == 0


def test_recordings_of_one_integer_are_searched(spark):
    r = random.Random(7)
    tune = _pcm(_tune(r, 12))
    at = 40 * C.HOP
    docs = spark.createDataFrame([(20, tune), (21, tune[at : at + C.FRAME + (C.SPAN - 1) * C.HOP]), (22, _pcm(_tune(r, 12)))], "doc_id long, audio binary")
    rows = {x.doc_id: x for x in C.identify(docs, F.col("doc_id") == 20).collect()}
    assert (rows[21].n_fingerprints, rows[21].match_id, rows[21].offset, rows[21].bit_error, rows[21].component_id) == (1, 20, 40, 0.0, 20)
    assert rows[22].match_id is None


def test_all_library_recordings_are_compared(spark):
    r, noise = random.Random(8), np.random.default_rng(3)
    tune, other = _tune(r, 12), _tune(r, 12)
    loud = tune + noise.normal(0, 0.02, tune.size)
    near = loud + noise.normal(0, 0.002, tune.size)
    data = [(20, _pcm(tune)), (40, _pcm(loud)), (41, _pcm(near)), (60, _pcm(np.concatenate([tune[: C.RATE * 4], other])))]
    rows = {x.doc_id: x for x in C.identify(spark.createDataFrame(data, "doc_id long, audio binary"), F.col("doc_id") % 20 == 0).collect()}
    assert rows[20].match_id == 40 and rows[40].match_id == 20 and rows[41].match_id == 40
    assert {rows[k].component_id for k in (20, 40, 41)} == {20} and rows[41].n_links == 2 and rows[60].match_id is None


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_votes_and_links_by_brute_force(most):
    r = np.random.default_rng(5)
    fps = [r.choice(np.array([1, 2, 3, 7, 2**32 - 1], np.uint32), r.integers(1, 9)) for _ in range(30)]
    ids = np.arange(30)
    lib = ids[ids % 3 == 0]
    packed = lambda k: C._unpacked(pa.table({"fp": pa.array([fps[i].tobytes() for i in k], pa.binary())}))
    x, y = packed(ids), packed(lib)
    want = Counter((i, k, q - p) for i in ids for k, j in enumerate(lib) if i != j for p, v in enumerate(fps[i]) for q, w in enumerate(fps[j]) if v == w)
    parts = list(C.votes(x, y, ids, lib, most))
    assert {tuple(t[:3]): t[3] for part in parts for t in part.T.tolist()} == want and sum(p.shape[1] for p in parts) == len(want)
    got = {}
    for part in parts:
        found, error = C.aligned(x, y, part, 0.3, 3)
        got |= {(i, j): (o, v, n, e) for (i, j, o, v, n), e in zip(found.T.tolist(), error.tolist(), strict=True)}
    best = {}
    for (i, j, o), v in want.items():
        best[i, j] = max(best.get((i, j), (0, 0, 0)), (v, -abs(o), o))
    scored = {(i, j): (o, v, *C.bit_errors(fps[i], fps[lib[j]], o)) for (i, j), (v, _, o) in best.items()}
    assert got == {k: v for k, v in scored.items() if v[3] <= 0.3 and v[2] >= min(3, fps[k[0]].size, fps[lib[k[1]]].size)}


@pytest.mark.parametrize("offset", [-3, 0, 5])
def test_bit_errors(offset):
    r = np.random.default_rng(4)
    a, b = r.integers(0, 2**32, 40, dtype=np.uint32), r.integers(0, 2**32, 30, dtype=np.uint32)
    pairs = [(i, i + offset) for i in range(40) if 0 <= i + offset < 30]
    wrong = sum(bin(int(a[i]) ^ int(b[j])).count("1") for i, j in pairs)
    assert C.bit_errors(a, b, offset) == (len(pairs), wrong / 32 / len(pairs)) and C.bit_errors(a, b, 100) == (0, 1.0)
