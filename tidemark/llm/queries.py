"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bwt_dedup import drop_repeated_bytes
from tidemark.llm.common import clean_text, table
from tidemark.llm.decontamination import contaminated
from tidemark.llm.html_extract import extract_main_text
from tidemark.llm.line_dedup import MIN_PAGES, RATIO, drop_boilerplate
from tidemark.llm.packing import retrieval_packing
from tidemark.llm.quality import label_quality
from tidemark.llm.sharding import histogram_shards
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.simple8b import read_tokens, write_tokens
from tidemark.llm.suffix_tree_dedup import drop_repeated_words


def op1_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_shards(docs).select(
        "doc_id", "size", F.crc32(clean_text("text").cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = drop_boilerplate(docs, "source")
    return out.select("doc_id", "source", "n_lines", "n_removed", F.sha2(clean_text("text").cast("binary"), 256).alias("kept_sha256"))


def op7_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = f"""
WITH pages AS (SELECT doc_id, source, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT DISTINCT doc_id, host, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT doc_id, host, unnest(lines) AS l FROM pages)),
totals AS (SELECT host, count(*) AS host_pages FROM pages GROUP BY host),
heavy AS (
  SELECT host, line FROM each JOIN totals USING (host) WHERE line <> ''
  GROUP BY host, line, host_pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO}::DOUBLE * host_pages),
placed AS (SELECT doc_id, host, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM pages),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(h.line) AS n_removed, string_agg(l, chr(10) ORDER BY i) FILTER (WHERE h.line IS NULL) AS kept
  FROM placed p LEFT JOIN heavy h ON h.host = p.host AND h.line = trim(p.l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
  GROUP BY doc_id)
SELECT d.doc_id, d.source, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d JOIN kept USING (doc_id)
"""


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = label_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_dom_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simple8b": op1_simple8b,
        "op2_bwt_dedup": op2_bwt_dedup,
        "op3_bm25_packing": op3_bm25_packing,
        "op4_suffix_tree_dedup": op4_suffix_tree_dedup,
        "op5_histogram_sort": op5_histogram_sort,
        "op6_spaced_seeds": op6_spaced_seeds,
        "op7_simhash_bk_trees": op7_simhash_bk_trees,
        "op8_site_lines": op8_site_lines,
        "op9_weak_supervision": op9_weak_supervision,
        "op10_dom_boosting": op10_dom_boosting,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_site_lines": OP8_SQL}
