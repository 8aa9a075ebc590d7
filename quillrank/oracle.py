"""The same answers in SQL, from the documents' and queries' texts on."""

from __future__ import annotations

WHITE = r"[ \t\n\x0B\f\r]+"

BASE = rf"""
tok AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{WHITE}')) AS term FROM documents),
post0 AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE term <> '' GROUP BY ALL),
voc AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post0 GROUP BY term),
terms AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, df, cf FROM voc),
sizes AS (SELECT doc_id, count(*) AS degree, CAST(sum(tf) AS BIGINT) AS len FROM post0 GROUP BY doc_id),
docs AS (SELECT d.doc_id, coalesce(degree, 0) AS degree, coalesce(len, 0) AS len, d.source AS label FROM documents d LEFT JOIN sizes USING (doc_id)),
coll AS (SELECT count(*) AS ndocs, CAST(sum(len) AS BIGINT) AS ntokens, CAST(sum(len) AS DOUBLE) / count(*) AS avg_doclen FROM docs),
post AS (SELECT t.term_id, p.term, p.doc_id, p.tf, d.len, t.df, t.cf FROM post0 p JOIN terms t USING (term) JOIN docs d USING (doc_id)),
qtok AS (SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(text, '{WHITE}'), lambda x: x <> '')) AS token,
         generate_subscripts(list_filter(regexp_split_to_array(text, '{WHITE}'), lambda x: x <> ''), 1) - 1 AS pos FROM benchmark),
qall AS (SELECT qid, pos, CASE WHEN starts_with(token, '-') THEN substr(token, 2) ELSE token END AS term, starts_with(token, '-') AS negated FROM qtok),
qw AS (SELECT qid, term, count(*) AS qtf, CAST(sum(count(*)) OVER (PARTITION BY qid) AS BIGINT) AS qlen FROM qall GROUP BY qid, term),
q AS (SELECT qid, term_id, df, cf, qtf, qlen FROM qw JOIN terms USING (term))"""

_NL = "(CAST(len AS DOUBLE) / avg_doclen)"
_TF, _DF, _CF, _N = "CAST(tf AS DOUBLE)", "CAST(df AS DOUBLE)", "CAST(cf AS DOUBLE)", "CAST(ndocs AS DOUBLE)"
_RATE = f"({_CF} / {_N})"
_TFN = f"({_TF} * ln(1.0 + 12.0 / {_NL}) / 0.6931471806)"
_NDT = f"({_TF} * ln(1.0 + 9.0 / {_NL}))"
IMPACT = {
    "bm25": f"greatest(1e-6, log10(({_N} - {_DF} + 0.5) / ({_DF} + 0.5))) * ({_TF} * 1.9) / ({_TF} + 0.9 * (0.8 + 0.2 * {_NL}))",
    "f2exp": f"{_TF} / ({_TF} + 0.7 + 0.7 * {_NL})",
    "lmdir": f"ln(1.0 + {_TF} / (2500.0 * {_CF} / CAST(ntokens AS DOUBLE)))",
    "pl2": f"""CASE WHEN {_RATE} >= 1.0 THEN 0.0 ELSE ({_TFN} * ln({_TFN} / {_RATE}) / 0.6931471806 + ({_RATE} - {_TFN}) * 1.4426950
               + 0.5 * ln(6.28318 * {_TFN}) / 0.6931471806) / ({_TFN} + 1.0) END""",
    "spl": f"""CASE WHEN {_RATE} = 1.0 THEN ln(1.0 + {_NDT}) ELSE -ln((pow({_RATE}, {_NDT} / ({_NDT} + 1.0)) - {_RATE}) / (1.0 - {_RATE})) END""",
    "numterms": "CAST(greatest(0, least(tf + df - len, 500)) AS DOUBLE)",
    "tfidf": f"log10({_N} / {_DF}) * log10(1.0 + {_TF})",
}
OWN = {"lmdir": "qlen * ln(2500.0 / (CAST(len AS DOUBLE) + 2500.0))"}


def _scores(model: str) -> str:
    own = OWN.get(model, "0.0")
    return f"""
parts AS (SELECT q.qid, p.doc_id, p.len, q.qlen, q.qtf * {IMPACT[model].replace("df", "p.df").replace("cf", "p.cf")} AS part FROM q JOIN post p USING (term_id), coll),
scored AS (SELECT qid, doc_id, sum(part) + any_value({own}) AS raw FROM parts GROUP BY qid, doc_id),
ranked AS (SELECT qid, doc_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 6) DESC, doc_id) AS rank FROM scored WHERE raw > 0)"""


def _top(model: str, k: int) -> str:
    return f"WITH {BASE}, {_scores(model)} SELECT qid, doc_id, rank, score FROM ranked WHERE rank <= {k}"


def _impacts(model: str) -> str:
    return f"imp AS (SELECT term_id, doc_id, tf, len, df, {IMPACT[model]} AS impact FROM post, coll)"


_CLASSED = """
tb AS (SELECT term_id, greatest(0.0, max(impact)) AS term_bound FROM imp GROUP BY term_id),
blk AS (SELECT term_id, any_value(df) AS df, CAST(floor(doc_id / pow(2, 3 + CAST(df < 100 AS INT) + CAST(df < 20 AS INT))) AS BIGINT) AS block,
        greatest(0.0, max(impact)) AS bound FROM imp GROUP BY term_id, CAST(floor(doc_id / pow(2, 3 + CAST(df < 100 AS INT) + CAST(df < 20 AS INT))) AS BIGINT))"""
_THRESHOLDS = "th AS (SELECT qid, score AS threshold FROM ranked WHERE rank = 10)"
_BM25 = f"WITH {BASE}, {_scores('bm25')}, {_THRESHOLDS}"


def statements() -> dict[str, str]:
    out = {f"topk_{m}": _top(m, 10) for m in IMPACT}
    for m in IMPACT:
        for s in ("maxscore", "lazy", "document_blocks", "posting_blocks", "variable_blocks"):
            out[f"topk_{m}_{s}"] = out[f"topk_{m}"]
    out["topk_bm25_k1000"] = out["topk_bm25_k1000_maxscore"] = _top("bm25", 1000)
    out["negated_query_hits"] = out["stream_topk_bm25"] = out["topk_bm25"]
    weighted = _top("bm25", 10).replace("q.qtf *", "q.qtf * CASE WHEN length(p.term) > 5 THEN 2.0 ELSE 1.0 END *")
    out["weighted_topk"] = weighted
    base = f"WITH {BASE} "
    out["postings"] = base + "SELECT term_id, term, doc_id, tf FROM post"
    out["term_stats"] = base + "SELECT term_id, term, df, cf FROM terms"
    out["doc_stats"] = base + "SELECT doc_id, degree, len, label FROM docs"
    out["collection_stats"] = base + "SELECT ndocs, (SELECT count(*) FROM terms) AS nterms, ntokens, avg_doclen FROM coll"
    out["index_reload"] = base + "SELECT count(DISTINCT term) AS lists, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM post"
    out["vocab_filter"] = base + "SELECT term, doc_id, tf FROM post WHERE term IN (SELECT term FROM qall)"
    out["query_terms"] = base + "SELECT qid, CAST(pos AS INTEGER) AS pos, term, negated, term IN (SELECT term FROM terms) AS known FROM qall"
    out["query_unknown_terms"] = base + "SELECT qid, term, qtf, qlen FROM qw WHERE term NOT IN (SELECT term FROM terms)"
    out["impact_table"] = f"WITH {BASE}, {_impacts('bm25')} SELECT term_id, doc_id, round(impact, 6) AS impact FROM imp WHERE term_id IN (SELECT term_id FROM q)"
    out["impact_table_complete"] = f"WITH {BASE}, {_impacts('bm25')} SELECT term_id, doc_id, round(impact, 6) AS impact FROM imp"
    out["merged_topk"] = f"""WITH {BASE}, {_scores('bm25')},
        loc AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id % 4 ORDER BY score DESC, doc_id) AS local_rank FROM ranked),
        mrg AS (SELECT qid, doc_id, score, local_rank, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM loc WHERE local_rank <= 3)
        SELECT qid, doc_id, r AS rank, score, local_rank, max(local_rank) OVER (PARTITION BY qid) = 3 AS deep FROM mrg WHERE r <= 10"""
    out["merged_topk_complete"] = out["topk_bm25"]
    out["labelled_hits"] = f"WITH {BASE}, {_scores('bm25')} SELECT qid, rank, doc_id, score, substr(label, 1, 26) AS label FROM ranked JOIN docs USING (doc_id) WHERE rank <= 10"
    out["trec_run"] = f"WITH {BASE}, {_scores('bm25')} SELECT qid || ' Q0 ' || doc_id || ' ' || rank || ' ' || printf('%.6f', score) || ' bm25' AS line FROM ranked WHERE rank <= 10"
    out["term_max_impact"] = f"WITH {BASE}, {_impacts('bm25')} SELECT term_id, round(greatest(0.0, max(impact)), 6) AS bound FROM imp GROUP BY term_id"
    out["block_max_docid"] = f"WITH {BASE}, {_impacts('bm25')}, {_CLASSED} SELECT term_id, block, round(bound, 6) AS bound FROM blk"
    out["block_max_posting"] = f"""WITH {BASE}, {_impacts('lmdir')},
        placed AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY term_id ORDER BY doc_id) - 1) / 8) AS BIGINT) AS block FROM imp)
        SELECT term_id, block, min(doc_id) AS first_doc, max(doc_id) AS last_doc, round(greatest(0.0, max(impact)), 6) AS bound,
        round(max(ln(2500.0 / (CAST(len AS DOUBLE) + 2500.0))), 6) AS doc_bound FROM placed GROUP BY term_id, block"""
    out["quantized_bounds"] = f"""WITH {BASE}, {_impacts('bm25')}, {_CLASSED},
        qt AS (SELECT term_id, df, block, bound, term_bound / 255.0 AS unit,
               CAST(greatest(0, least(255, CASE WHEN term_bound > 0 THEN ceil(bound / (term_bound / 255.0)) ELSE 0 END)) AS INTEGER) AS qbound FROM blk JOIN tb USING (term_id))
        SELECT term_id, block, qbound, round(CASE WHEN df < 10 THEN bound WHEN qbound = 0 THEN 0.0 ELSE unit * qbound + 1e-4 END, 6) AS read_bound FROM qt"""
    out["doc_bounds_lmdir"] = base + "SELECT doc_id // 8 AS block, round(max(ln(2500.0 / (CAST(len AS DOUBLE) + 2500.0))), 6) AS bound FROM docs GROUP BY doc_id // 8"
    out["block_fraction_histogram"] = f"""WITH {BASE}, {_impacts('bm25')}, {_CLASSED},
        pc AS (SELECT floor(100.0 * bound / term_bound + 0.5) AS p FROM blk JOIN tb USING (term_id) WHERE term_bound > 0),
        n AS (SELECT CAST(floor(p / 2) * 2 AS BIGINT) AS bucket, count(*) AS n FROM pc GROUP BY 1)
        SELECT bucket, n, round(100.0 * n / sum(n) OVER (), 6) AS share FROM n"""
    out["essential_lists"] = f"""{_BM25}, {_impacts('bm25')},
        tb AS (SELECT term_id, greatest(0.0, max(impact)) AS bound FROM imp GROUP BY term_id),
        w AS (SELECT qid, term_id, df, sum(qtf * bound) OVER (PARTITION BY qid ORDER BY df DESC, term_id ROWS UNBOUNDED PRECEDING) AS upto FROM q JOIN tb USING (term_id))
        SELECT qid, term_id, df, round(upto, 6) AS upto, coalesce(upto >= threshold - 2e-6, true) AS essential FROM w LEFT JOIN th USING (qid)"""
    out["df_classes"] = base + """SELECT count(*) FILTER (df >= 10) AS at_least_10, count(*) FILTER (df >= 50) AS at_least_50, count(*) FILTER (df >= 100) AS at_least_100,
        CAST(sum(ceil(df / 64.0)) AS BIGINT) AS units FROM terms"""
    out["df_log2_histogram"] = base + """, h AS (SELECT CAST(floor(log2(CAST(df AS DOUBLE))) AS BIGINT) AS log2_df, count(*) AS n FROM terms GROUP BY 1)
        SELECT log2_df, n, CAST(sum(n) OVER (ORDER BY log2_df DESC) AS BIGINT) AS n_from_top FROM h"""
    out["score_checksum"] = f"{_BM25} SELECT round(coalesce(sum(round(threshold, 3)), 0.0), 3) AS checksum, count(*) AS full_queries FROM th"
    out["query_length_buckets"] = f"""{_BM25} SELECT least(qlen, 8) AS bucket, count(*) AS n, round(avg(threshold), 6) AS mean
        FROM th JOIN (SELECT DISTINCT qid, qlen FROM qw) USING (qid) GROUP BY 1"""
    out["threshold_percentiles"] = f"""{_BM25}, o AS (SELECT threshold, row_number() OVER (ORDER BY threshold) - 1 AS place, count(*) OVER () AS n FROM th)
        SELECT CAST(percent AS INTEGER) AS percent, threshold AS value FROM o, (SELECT unnest([25, 50, 90, 95, 99]) AS percent) WHERE place = n * percent // 100"""
    out["threshold_spread"] = f"{_BM25} SELECT round(avg(threshold), 6) AS mean, round(min(threshold), 6) AS least, round(max(threshold), 6) AS largest, round(var_samp(threshold), 6) AS variance FROM th"
    out["tf_delta_codec"] = base + """SELECT term_id, doc_id, CAST(coalesce(sum(tf - 1) OVER (PARTITION BY term_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at,
        tf AS tf_decoded FROM post"""
    out["ef_size_report"] = base + """, l AS (SELECT term_id, count(*) AS n, max(doc_id) AS last FROM post GROUP BY term_id),
        b AS (SELECT *, CAST(CASE WHEN ndocs > n THEN floor(log2(CAST(ndocs AS DOUBLE) / n)) ELSE 0 END AS BIGINT) AS low_bits FROM l, (SELECT ndocs FROM coll)),
        s AS (SELECT term_id, n, last, low_bits, CAST(ceil(low_bits * n / 8.0) AS BIGINT) AS lower_bytes, CAST(ceil(((last >> low_bits) + n) / 8.0) AS BIGINT) AS upper_bytes,
              (n // 256) * 4 AS pointer_bytes FROM b)
        SELECT *, lower_bytes + upper_bytes + pointer_bytes AS total_bytes FROM s"""
    out["ef_roundtrip"] = base + "SELECT term_id, doc_id, tf FROM post WHERE term_id IN (SELECT term_id FROM q)"
    out["ef_roundtrip_complete"] = base + "SELECT term_id, doc_id, tf FROM post"
    out["next_geq"] = base + """, t AS (SELECT DISTINCT term_id, unnest([0, 97, 500, 950])::BIGINT AS target FROM q)
        SELECT t.term_id, t.target, min(p.doc_id) AS doc_id FROM t LEFT JOIN post p ON p.term_id = t.term_id AND p.doc_id >= t.target GROUP BY 1, 2"""
    out["posting_moves"] = base + """SELECT term_id, doc_id, lead(doc_id, 3) OVER w AS skipped, lag(doc_id) OVER w AS previous,
        nth_value(doc_id, 3) OVER (PARTITION BY term_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS jumped
        FROM post WHERE term_id IN (SELECT term_id FROM q) WINDOW w AS (PARTITION BY term_id ORDER BY doc_id)"""
    out["posting_moves_complete"] = base + """SELECT term_id, doc_id, lead(doc_id, 3) OVER w AS skipped, lag(doc_id) OVER w AS previous,
        nth_value(doc_id, 3) OVER (PARTITION BY term_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS jumped
        FROM post WINDOW w AS (PARTITION BY term_id ORDER BY doc_id)"""
    keys = "WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders), v AS (SELECT DISTINCT o_orderkey AS v, n FROM orders, n)"
    out["hash_bucket"] = f"{keys} SELECT v, CASE WHEN v >= n // 128 * 128 THEN v ELSE v // 128 + (v % 128) * (n // 128) END AS moved, v AS back FROM v"
    out["hash_modulo"] = f"{keys} SELECT v, (v * 7919) % n AS moved, v AS back FROM v"
    return out
