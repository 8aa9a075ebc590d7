"""Jaccard self-join over word n-grams, by rare-first prefix filtering.

1. A census of n-gram hashes (see _blocks) tells every block in how many documents each of its n-grams occurs.  The
   order (that number, hash) is the same everywhere: rare n-grams first (above 63 documents by sixths of a doubling).  An n-gram of one document only cannot join, but
   takes its place at the front of the order.
2. Two sets can reach the threshold only if they share an n-gram of their prefixes (the first n - ceil(t n) + 1).  Only
   documents with a shared n-gram in the prefix keep postings.  Equal sets are one node.
3. Candidates come from the prefix postings: length filter, then the positional filter at the pair's first common
   n-gram, then, with both sets at hand, the suffix filter; then the pair is verified, once.
4. A posting list of many near copies would give all pairs of them.  So lists first propose stars (every member with one
   leader); what is linked needs no further proof, and only pairs between different components are proposed later,
   until none is left: first by more stars while the open pairs are many, then all that remain, members of one list meeting
   those whose size is in reach of the threshold only.  Every link between different texts is so either tested or implied
   by a chain of links.

Returned per row: id, n_shingles, component_id (the smallest id reachable by links), link_group (the smallest id of equal
sets).  Nulls: a null text or one without words has no n-grams and no links; a row with a null id has no links and a null
component.  Rows that share an id are one node.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from ._components import components

SETS = "doc_id long, n long, sig_a long, sig_b long, first_pos long, prefix array<long>, tokens binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("first_pos", pa.int64()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(t: B.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each distinct n-gram, in that order; texts of fewer words have the whole sequence as one."""
    data = _LOWER[t.data]
    s, e, doc = B.word_spans(data, t.off, t.size)
    if not s.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    (w,) = B.word_hashes(data, s, e)
    n = w.size
    words = np.bincount(doc, minlength=t.ids.size)
    begin = np.cumsum(words) - words
    hs, ds = [], []
    if n >= width:
        at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
        h = np.zeros(at.size, np.uint64)
        for j in range(width):
            h = h * B.ROWS[0] + w[at + j]
        hs.append(B.mix(h))
        ds.append(doc[at])
    for k in range(1, width):
        d = np.flatnonzero(words == k)
        h = np.full(d.size, k, np.uint64)
        for j in range(k):
            h = h * B.ROWS[1] + w[begin[d] + j]
        hs.append(B.mix(h, B._M3, B._M4))
        ds.append(d)
    h, d = np.concatenate(hs), np.concatenate(ds)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
    return d[new], h[new]


def rarity(df: np.ndarray) -> np.ndarray:
    """A number of documents in 8 bits that keeps its order: itself up to 63, then six steps for each doubling."""
    return np.where(df < 64, df, np.minimum(255, 64 + np.floor(6 * np.log2(np.maximum(df, 64) / 64.0)))).astype(np.uint64)


def _suffix_filter(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """A lower bound of the Hamming distance of two sorted arrays; stops above most."""
    if depth == 0 or not x.size or not y.size:
        return abs(x.size - y.size)
    m = y.size // 2
    k = int(np.searchsorted(x, y[m]))
    same = int(k < x.size and x[k] == y[m])
    left, right = (x[:k], y[:m]), (x[k + same :], y[m + 1 :])
    bound = abs(left[0].size - left[1].size) + abs(right[0].size - right[1].size) + 1 - same
    if bound > most:
        return bound
    d = _suffix_filter(*left, most, depth - 1)
    return d + 1 - same + _suffix_filter(*right, most - d, depth - 1)


def linked(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """Whether two sets, given by the members that any other document has, reach the threshold."""
    need = -(-percent * (n_a + n_b) // (100 + percent))
    if min(a.size, b.size) < need:
        return False
    if _suffix_filter(a, b, a.size + b.size - 2 * need, 2) > a.size + b.size - 2 * need:
        return False
    return np.intersect1d(a, b, assume_unique=True).size >= need


def _verify(percent: int):
    def run(batches):
        for t in batches:
            u, v, a, b, na, nb = (t.column(k).to_pylist() for k in ("u", "v", "a", "b", "n_u", "n_v"))
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), p, q, percent) for x, y, p, q in zip(a, b, na, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(ok, pa.bool_())], ["u", "v", "ok"])

    return run


def length_class(n: Column, percent: int) -> Column:
    """Sizes by powers of the largest ratio that the threshold allows: sets that can link are in one class or in neighbours."""
    return F.floor(F.ln(n) / F.lit(math.log(100 / percent) + 1e-9))


def neighbours(members: DataFrame, percent: int) -> DataFrame:
    """Each pair (x, y) of members of one list, of different components and of sizes in one class or in neighbouring ones, once."""
    m = members.select("token", F.struct("node", "n", "pos", "comp").alias("x"), length_class(F.col("n"), percent).alias("own"))
    y = m.select("token", F.col("x").alias("y"), F.col("own").alias("at"))
    found = m.withColumn("at", F.explode(F.array(F.col("own"), F.col("own") + 1))).join(y, ["token", "at"])
    return found.where("if(own = at, x.comp < y.comp, x.comp <> y.comp)").select("x", "y")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, block_bytes: int = 4 << 20, star_rounds: int = 6, open_pairs_per_posting: int = 100
) -> DataFrame:
    """doc_id, n_shingles, component_id, link_group for every row of docs."""
    total = B.text_bytes(docs, text_col)
    blocks, grams = B.n_blocks(total, block_bytes), max(1, total // 6)
    bits, slices = min(60, max(16, grams.bit_length() + 14)), B.n_slices(grams)
    dealt = B.dealt(docs, id_col, text_col, blocks)

    def census(key, table):
        B.tidy()
        return B.sketch_rows(key[0].as_py(), shingle_sets(B.Texts(table), width)[1], bits, 1, slices, 1 << 40)

    def sets(key, table, got):
        B.tidy()
        t = B.Texts(table)
        d, h = shingle_sets(t, width)
        df = B.estimates(h, bits, 1, got)
        n = np.bincount(d, minlength=t.ids.size)
        sig = []
        for a, b in ((B._M1, B._M2), (B._M4, B._M3)):
            run = np.concatenate([[B.U(0)], np.cumsum(B.mix(h * B.ROWS[2], a, b))])
            ends = np.cumsum(n)
            sig.append((run[ends] - run[ends - n]).astype(np.int64))
        k = np.flatnonzero(df >= 2)
        dk, key64 = d[k], (rarity(df[k]) << B.U(56)) | (h[k] >> B.U(8))
        order = np.lexsort((key64, dk))
        key64 = key64[order]
        m = np.bincount(dk, minlength=n.size)
        ends = np.cumsum(m)
        reach = (n - (percent * n + 99) // 100 + 1) - (n - m)  # prefix length less the n-grams of this document only
        seen: set = set()
        tokens = []
        for i in np.argsort(t.ids, kind="stable").tolist():
            name = (n[i], sig[0][i], sig[1][i])
            tokens.append((i, bool(n[i] > 0 and reach[i] > 0 and t.ids[i] != B.NO_ID and name not in seen)))
            seen.add(name)
        use = dict(tokens)
        lists = [key64[ends[i] - m[i] : ends[i]] if use[i] else None for i in range(n.size)]
        prefix = [None if x is None else x[: reach[i]].view(np.int64) for i, x in enumerate(lists)]
        return pa.table([t.id_column(), n, *sig, n - m, pa.array(prefix, pa.list_(pa.int64())), pa.array([None if x is None else x.tobytes() for x in lists], pa.binary())], _SETS)

    counts = dealt.groupBy("block").applyInArrow(census, B.CELLS).groupBy("slice").applyInArrow(B.merge_sketches(1 << 40), B.ANSWERS)
    table = B.written(dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(sets, SETS), "sets")

    name = ["n", "sig_a", "sig_b"]
    same = table.where("n > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("link_group"))
    reps = table.where("tokens is not null").join(same.withColumnRenamed("link_group", "doc_id"), [*name, "doc_id"], "left_semi").dropDuplicates([*name, "doc_id"])
    # one node may stand for several rows that share an id: their sets stay apart by their names
    reps = reps.select(F.xxhash64("doc_id", *name).alias("node"), "doc_id", "n", "first_pos", "prefix", "tokens")
    postings = reps.select("node", "n", "first_pos", F.posexplode("prefix").alias("k", "token")).select("token", "node", "first_pos", "n", (F.col("first_pos") + F.col("k")).alias("pos"))
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    postings = B.written(postings.join(lists.select("token"), "token", "left_semi"), "postings")
    sides = reps.select("node", "doc_id", "n", "tokens")

    def proposed(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
        """One row per pair that passes the length and positional filters.

        A pair that reaches the threshold has, at its first common n-gram, what is left of the smaller rest to reach the
        overlap it needs; that n-gram is in both prefixes, so a row that falls short can go before pairs are made.
        """
        need = F.ceil(F.lit(percent) * (F.col("n_u") + F.col("n_v")) / F.lit(100 + percent))
        left = F.least(F.col("n_u") - F.col("p_u"), F.col("n_v") - F.col("p_v"))
        pairs = pairs.where((F.lit(100) * F.least("n_u", "n_v") >= F.lit(percent) * F.greatest("n_u", "n_v")) & (left >= need)).select("u", "v").distinct()
        return pairs if tested is None else pairs.join(tested.select("u", "v"), ["u", "v"], "left_anti")

    def verified(pairs: DataFrame) -> DataFrame:
        a = sides.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("tokens").alias("a"))
        b = sides.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("tokens").alias("b"))
        return pairs.join(b, "v").join(a, "u").select("u", "v", "n_u", "n_v", "a", "b").mapInArrow(_verify(percent), "u long, v long, ok boolean")

    def with_leader(members: DataFrame, salt: int) -> DataFrame:
        """Pairs of each member with its list's leader; u is the smaller node id, so a pair has one form.

        The first leader is the member with the fewest n-grams of its own: of near copies the one from which the others were made.
        """
        first = F.xxhash64(F.lit(salt), "node") if salt else F.struct("first_pos", "node")
        lead = members.groupBy("token").agg(F.min_by(F.struct("node", "n", "pos", "comp"), first).alias("l"))
        x = members.join(lead, "token").where("node <> l.node and comp <> l.comp")
        return ordered(x.select(F.struct("node", "n", "pos").alias("x"), F.struct("l.node", "l.n", "l.pos").alias("y")))

    def ordered(pairs: DataFrame) -> DataFrame:
        swap = F.col("x.node") > F.col("y.node")
        pairs = pairs.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("u"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("v"))
        return pairs.select(F.col("u.node").alias("u"), F.col("v.node").alias("v"), F.col("u.n").alias("n_u"), F.col("v.n").alias("n_v"), F.col("u.pos").alias("p_u"), F.col("v.pos").alias("p_v"))

    members, tested, comp, rounds = postings.withColumn("comp", F.col("node")), None, None, 0
    size = postings.count()
    while size:
        if rounds:
            label = comp.withColumnRenamed("component", "comp")
            members = postings.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            by = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token")
            split = by.agg(F.count(F.lit(1)).alias("comps"), (F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("twice")).where("comps > 1")
            members = B.written(members.join(split.select("token"), "token", "left_semi"), "members")
            pairs_open = split.agg(F.coalesce(F.sum("twice"), F.lit(0))).first()[0] // 2
            if not pairs_open:
                break
            last = rounds >= star_rounds or pairs_open <= open_pairs_per_posting * size
            if last:
                pairs = proposed(ordered(neighbours(members, percent)), tested)
            else:
                pairs = proposed(with_leader(members, rounds), tested)
        else:
            last, pairs = False, proposed(with_leader(members, 0), None)
        new = B.written(verified(pairs), "verified")
        tested = new if tested is None else tested.unionByName(new)
        comp = components(tested.where("ok"))
        rounds += 1
        if last:
            break

    # from nodes to ids: equal sets, links between sets, rows that share an id
    edges = table.where("n > 0 and doc_id is not null").join(same, name).select(F.col("doc_id").alias("u"), F.col("link_group").alias("v"))
    if tested is not None:
        ids = reps.select("node", "doc_id")
        links = tested.where("ok").join(ids.select(F.col("node").alias("u"), F.col("doc_id").alias("du")), "u").join(ids.select(F.col("node").alias("v"), F.col("doc_id").alias("dv")), "v")
        edges = edges.unionByName(links.select(F.col("du").alias("u"), F.col("dv").alias("v")))
    found = components(edges)
    out = table.select("doc_id", "n", "sig_a", "sig_b").join(same, name, "left").join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("link_group", "doc_id")).alias("link_group"))
