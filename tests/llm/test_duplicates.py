"""Windows, suffixes and n-gram sets against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import fixtures as fx
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillrank.llm import _blocks as B
from quillrank.llm._components import components
from quillrank.llm.ngram_join import _suffix_filter, jaccard_components, linked, neighbours, rarity
from quillrank.llm.substring_dedup import remove_repeated_windows
from quillrank.llm.suffix_dedup import merge_runs, remove_repeated_bytes


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 22, 3000])
def test_windows(spark, block_bytes):
    data = fx.rows()
    want = []
    for row, (u, gone) in zip(data, fx.removed_units(data, 50, fx.words), strict=True):
        kept = " ".join(x for x, g in zip(u, gone, strict=True) if not g)
        want.append((row[0], len(u), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    found = remove_repeated_windows(fx.frame(spark), block_bytes=block_bytes)
    assert _sorted(map(tuple, found.collect())) == _sorted(want)
    assert sum(w[2] for w in want) > 1000


def test_windows_with_a_poor_sketch(spark):
    """A sketch of too few cells overestimates, and loses none."""
    found = remove_repeated_windows(fx.frame(spark), cells_per_window=1, depth=1, width=7, block_bytes=5000, with_text=False)
    good = remove_repeated_windows(fx.frame(spark), width=7, with_text=False)
    assert _sorted(map(tuple, found.collect())) == _sorted(map(tuple, good.collect()))


@pytest.mark.parametrize("block_bytes", [1 << 22, 3000])
def test_bytes(spark, block_bytes):
    data = fx.rows()
    want = []
    for row, (u, gone) in zip(data, fx.removed_units(data, 50, lambda t: (t or "").encode()), strict=True):
        kept = bytes(x for x, g in zip(u, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((row[0], len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    found = remove_repeated_bytes(fx.frame(spark), block_bytes=block_bytes)
    assert _sorted((*r[:5], bytes(r[5])) for r in found.collect()) == _sorted(want)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.lists(st.lists(st.binary(min_size=9, max_size=9), max_size=12), min_size=1, max_size=7))
def test_merge_of_runs(length, runs):
    runs = [sorted(bytes(c % 3 for c in x[:length]) for x in r) for r in runs]
    order, common = merge_runs(runs, length)
    heads = [iter(r) for r in runs]
    merged = [next(heads[i]) for i in order]
    assert merged == sorted(sum(runs, []))
    for a, b, n in zip(merged, merged[1:], common[1:], strict=False):
        assert a[:n] == b[:n] and (n == length or a[n] != b[n])


def _brute_components(data, width=5, percent=75):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for row in data:
        w = fx.words((row[1] or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = {r[0]: r[0] for r in data}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and data[i][0] is not None and data[j][0] is not None and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                x, y = root(data[i][0]), root(data[j][0])
                parent[max(x, y)] = min(x, y)
    return [(r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(data, sets, strict=True)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000, "open_pairs_per_posting": 0}, {"percent": 50, "open_pairs_per_posting": 0, "star_rounds": 2}])
def test_jaccard(spark, options):
    data = fx.rows()
    found = jaccard_components(fx.frame(spark), **options)
    assert _sorted(tuple(r)[:3] for r in found.collect()) == _sorted(_brute_components(data, percent=options.get("percent", 75)))


def test_only_sizes_in_reach_meet(spark):
    """Every pair that passes the length filter is there once, whatever the order of its components; far sizes do not meet."""
    r = random.Random(14)
    for percent in (50, 75, 100):
        rows = [(t, i, r.choice([1, 3, 4, 9, 12, 16, 64, 85, 10**6]), 0, r.randrange(9)) for t in range(3) for i in range(40)]
        found = neighbours(spark.createDataFrame(rows, "token long, node long, n long, pos long, comp long").coalesce(2), percent).collect()
        pairs = [(min(a, b), max(a, b)) for a, b in ((tuple(p.x), tuple(p.y)) for p in found)]
        apart = [(a[1:], b[1:]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4]]
        want = [(a, b) for a, b in apart if 100 * min(a[1], b[1]) >= percent * max(a[1], b[1])]
        assert not Counter(want) - Counter(pairs) and not Counter(pairs) - Counter(apart) and len(pairs) < len(apart) / 2


def test_empty_tables(spark):
    empty = fx.frame(spark, [])
    for f in (remove_repeated_windows, remove_repeated_bytes, jaccard_components):
        assert f(empty).count() == 0


def test_links_and_filters():
    r = random.Random(8)
    for _ in range(300):
        a, b = (np.array(sorted(r.sample(range(40), r.randrange(1, 30))), np.uint64) for _ in "ab")
        n = len(set(a.tolist()) & set(b.tolist()))
        assert linked(a, b, a.size, b.size, 75) == (100 * n >= 75 * (a.size + b.size - n))
        distance = a.size + b.size - 2 * n
        assert _suffix_filter(a, b, 1000, 3) <= distance
    x = np.arange(1, 10**6)
    assert (np.diff(rarity(x).astype(np.int64)) >= 0).all() and rarity(np.array([10**17])).max() == 255


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {(x, root(x)) for e in edges for x in e if any(x in f and f[0] != f[1] for f in edges)}
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {tuple(x) for x in found} == want and len(found) == len(want)


def test_packed_lists():
    for a in (np.zeros(0, np.uint64), np.array([0, 1, 255, 256, 2**63], np.uint64), np.arange(1000, dtype=np.uint64) * np.uint64(77)):
        assert (B.unpack(B.pack(a)) == a).all() and (B.unpack_sorted(B.pack_sorted(a)) == a).all()
