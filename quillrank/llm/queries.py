"""The registered queries of this subpackage: thin contracts over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, decontaminate, disclosure, language_id, ngram_join, prefix_bpe, pseudo_likelihood, substring_dedup, suffix_dedup, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(_table(spark, sf_dir, "documents"), width=50, with_text=False)


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTF-8 bytes of every text, played as 8-bit PCM: the tables hold no audio."""
    recordings = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("audio"))
    return chroma.identify(recordings, F.col("doc_id") % 20 == 0)


def op3_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), width=5, percent=75)


def op6_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.find_disclosures(_table(spark, sf_dir, "documents"), reach=None).drop("sanitised")


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=50, with_text=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs.select("doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(files)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_chroma_fingerprints, op3_masked_pseudo_likelihood, op4_decontamination, op5_ngram_jaccard_join, op6_pii_disclosure, op7_sentencepiece_codec, op8_suffix_array_dedup, op9_language_id, op10_token_files)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
        win AS (SELECT doc_id, k, array_to_string(w[k : k + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
        hit AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
        mark AS (SELECT p.*, max(h.k) OVER (PARTITION BY p.doc_id ORDER BY p.k) >= p.k - 49 AS gone FROM pos p LEFT JOIN hit h USING (doc_id, k)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM mark WHERE NOT coalesce(gone, false) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(doc_id, other) AS (SELECT a, b FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
        least_of AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id),
        same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS link_group FROM (SELECT doc_id, list(s ORDER BY s) AS l FROM sh GROUP BY doc_id))
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, coalesce(link_group, doc_id) AS link_group
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id) LEFT JOIN same USING (doc_id)""",
    "op8_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        pos AS (SELECT doc_id, k, substr(h, 2 * k + 1, 2) AS b, CASE WHEN 2 * k + 100 <= length(h) THEN substr(h, 2 * k + 1, 100) END AS s
                FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS k FROM d)),
        hit AS (SELECT doc_id, k, b, CASE WHEN s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id THEN k END AS hit_k FROM pos),
        mark AS (SELECT doc_id, k, b, coalesce(max(hit_k) OVER (PARTITION BY doc_id ORDER BY k) >= k - 49, false) AS gone FROM hit),
        run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS begins FROM mark),
        agg AS (SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (begins) AS spans, string_agg(b, '' ORDER BY k) FILTER (NOT gone) AS t FROM run GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
        FROM d LEFT JOIN agg USING (doc_id)""",
}
