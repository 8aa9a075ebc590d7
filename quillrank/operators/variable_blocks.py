"""Variable-sized blocks of a posting list: a cheap partition by bounded waste.

A block's waste is its size times its largest impact, less the sum of its impacts; every block also has a fixed cost.
The cheapest partition is a shortest path over cut points.  From each cut point only the edges are kept that are the longest
within a geometric ladder of wastes (steps of 1 + eps, up to (1 + 1 / eps2) fixed costs), which keeps the path's cost
within about (1 + eps)(1 + eps2) of the best and the work linear in the list, times the rungs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = "term_id int, block long, first_doc long, last_doc long, size long, bound double, cost double"


def partition(impact: np.ndarray, fixed: float, eps: float = 0.25, eps2: float = 0.4) -> list[int]:
    """End places (exclusive) of the blocks of a list of impacts."""
    n = len(impact)
    if not n:
        return []
    total = np.concatenate([[0.0], np.cumsum(impact)])
    rungs, w = [], max(fixed * eps, 1e-12)
    while w < fixed * (1 + 1 / eps2):
        rungs.append(w)
        w *= 1 + eps
    rungs.append(fixed * (1 + 1 / eps2))
    best = np.full(n + 1, np.inf)
    best[0], prev = 0.0, np.zeros(n + 1, np.int64)
    ends, tops = [0] * len(rungs), [[] for _ in rungs]  # per rung: the end, and places of falling impacts within the window
    for a in range(n):
        here = best[a]
        if here + fixed < best[a + 1]:
            best[a + 1], prev[a + 1] = here + fixed, a
        for r, limit in enumerate(rungs):
            top, b = tops[r], max(ends[r], a)
            while top and top[0] < a:
                top.pop(0)
            while b < n:
                high = max(impact[top[0]] if top else 0.0, impact[b])
                if high * (b + 1 - a) - (total[b + 1] - total[a]) > limit and b > a:
                    break
                while top and impact[top[-1]] <= impact[b]:
                    top.pop()
                top.append(b)
                b += 1
            ends[r] = b
            cost = here + fixed + max(0.0, impact[top[0]] * (b - a) - (total[b] - total[a]))
            if cost < best[b]:
                best[b], prev[b] = cost, a
    cuts, at = [], n
    while at:
        cuts.append(at)
        at = int(prev[at])
    return cuts[::-1]


def variable_blocks(impacts: DataFrame, fixed: float = 5.0) -> DataFrame:
    """BLOCKS of each term in impacts(term_id, doc_id, impact); a list is one group, so give it the query vocabulary only."""

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        x, docs = np.maximum(rows["impact"].to_numpy(), 0.0), rows["doc_id"].to_numpy()
        out, a = [], 0
        for i, b in enumerate(partition(x, fixed)):
            high = float(x[a:b].max())
            out.append((int(rows["term_id"].iloc[0]), i, int(docs[a]), int(docs[b - 1]), b - a, high, fixed + high * (b - a) - float(x[a:b].sum())))
            a = b
        return pd.DataFrame(out, columns=["term_id", "block", "first_doc", "last_doc", "size", "bound", "cost"])

    return impacts.select("term_id", "doc_id", "impact").groupBy("term_id").applyInPandas(split, BLOCKS)
