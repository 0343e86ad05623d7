"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bitpack, crf, exact, html, mixing, multihash, ngrams, packing, periodic, simhash, substring, toxicity, turns
from .common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.lm_scores(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(read_table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(read_table(spark, sf_dir, "documents"))


def op10_multihash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihash.fingerprints(read_table(spark, sf_dir, "documents"))


def op11_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.personal_data_digests(read_table(spark, sf_dir, "documents"), crf.labelled_table(spark))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damaged_report(read_table(spark, sf_dir, "conversations"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.looped_runs(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_ngrams": op3_ngrams,
    "op4_toxicity": op4_toxicity,
    "op5_exact": op5_exact,
    "op6_html": op6_html,
    "op7_packing": op7_packing,
    "op8_bitpack": op8_bitpack,
    "op9_substring": op9_substring,
    "op10_multihash": op10_multihash,
    "op11_crf": op11_crf,
    "op12_turns": op12_turns,
    "op13_runs": op13_runs,
}

SQL = {
    "op12_turns": turns.SQL,
    "op5_exact": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_substring": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(ws) - 11)) AS t(i)),
        firsts AS (SELECT g, min(doc_id) AS low FROM windows GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, p FROM (SELECT w.doc_id, unnest(range(i, i + 13)) AS p FROM windows w JOIN firsts USING (g) WHERE low < w.doc_id)),
        words AS (SELECT doc_id, p, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(p)),
        marked AS (SELECT w.doc_id, w.p, w.word, g.p IS NOT NULL AS out FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p),
        sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE out) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT out), '') AS kept FROM marked GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN sums USING (doc_id)""",
}
