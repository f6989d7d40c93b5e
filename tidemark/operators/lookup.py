"""Small scans and searches of a corpus, as a service or a report asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import search

PREVIEW = 300


def limited(rows: DataFrame, n: int | None) -> DataFrame:
    """At most n rows, in any order; all for None."""
    return rows if n is None else rows.limit(n)


def rows_of_ids(rows: DataFrame, key: str, ids: list[int], columns: list[str]) -> DataFrame:
    """Named columns of the rows whose key is listed; both the filter and the columns reach the scan."""
    return rows.where(F.col(key).isin(ids)).select(key, *columns)


def result_ids(results: DataFrame, key: str = "did") -> DataFrame:
    """Different documents of all results, ascending."""
    return results.select(key).distinct().orderBy(key)


def sweep_rows(queries: DataFrame, docs: DataFrame, k: int, efs: list[int], coarse_dims: int = 16, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """qid, ef, rank, did, dist of the candidate-budget search: its answers with their distances."""
    most = max(efs)
    budget = search.ranked(search.block_scores(queries, docs, key, embedding, most, coarse_dims), [F.desc("coarse"), "did"], most, "place")
    each = budget.withColumn("ef", F.explode(F.array(*[F.lit(e) for e in efs]))).where(F.col("place") <= F.col("ef"))
    return search.ranked(each, ["dist", "did"], k, group=("qid", "ef")).select("qid", "ef", "rank", "did", "dist")


def previews(queries: DataFrame, docs: DataFrame, texts: DataFrame, k: int, text_key: str = "doc_id", text: str = "text") -> DataFrame:
    """qid, rank, did, dist and the first PREVIEW characters of each answer's text; a k below 1 is refused."""
    if k < 1:
        raise ValueError("k must be >= 1")
    top = search.exact_topk(queries, docs, k)
    body = texts.select(F.col(text_key).alias("did"), F.substring(F.coalesce(text, F.lit("")), 1, PREVIEW).alias("preview"))
    return top.join(body, "did").select("qid", "rank", "did", "dist", "preview")


def search_text(text: str, docs: DataFrame, texts: DataFrame, k: int, embed) -> DataFrame:
    """previews() of one text; embed gives the vector column of a text column."""
    if not text:
        raise ValueError("query must not be empty")
    spark = docs.sparkSession
    query = spark.createDataFrame([(-1, text)], "vec_id long, text string").select("vec_id", embed(F.col("text")).alias("embedding"))
    return previews(query, docs, texts, k).orderBy("rank")


def replay(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """qid, returned, nearest and farthest distance: one pass over stored queries, as a driver replays them."""
    top = search.exact_topk(queries, docs, k)
    return top.groupBy("qid").agg(F.count(F.lit(1)).alias("returned"), F.min("dist").alias("nearest"), F.max("dist").alias("farthest"))


def array_literal(values: Column) -> Column:
    """{"a","b"}: quotes and backslashes escaped, null elements as NULL; a null array is ''."""
    one = lambda x: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("NULL"))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform(values, one), ","), F.lit("}")), F.lit(""))


def csv_field(value: Column) -> Column:
    """A field as CSV: quoted where it has a comma, a quote or a line break; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(value.rlike('[",\\r\\n]'), quoted).otherwise(value), F.lit(""))


def quote_identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
