"""Corpus sources and builds: question dumps in XML, posts in JSON lines, integrity checks and cache manifests."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import accept_text, parse_int, parse_tags, squeezed, stream_seed, strip_html
from tidemark.operators.sampling import reservoir

QUESTION_ROWS = "_Id string, _PostTypeId string, _Title string, _Body string, _Tags string, _Score string, _CreationDate string, _AnswerCount string"
POST_ROWS = "id string, content string, title string, summary string, subreddit string, subreddit_id string"
#: Manifest entries that name places, which may differ between machines.
PATH_KEYS = frozenset({"path", "local_path", "docs_path", "queries_path", "output_path", "archive_path", "root"})


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, size, sha1 and md5 of files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("size"), F.sha1("content").alias("sha1"), F.md5("content").alias("md5"))


def bad_files(found: DataFrame, told: DataFrame) -> DataFrame:
    """Files that are missing or differ from what is told (path, size, sha1, md5)."""
    a, b = told.alias("a"), found.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("size", "sha1", "md5")]
    return a.join(b, "path", "left").where(~(same[0] & same[1] & same[2])).select("path")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """<row .../> elements of extracted XML dumps; other post types are dropped."""
    return spark.read.format("xml").option("rowTag", "row").schema(QUESTION_ROWS).load(path).where("_PostTypeId = '1'")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that doesn't parse is an error, blank lines are skipped."""
    return spark.read.schema(POST_ROWS).option("mode", "FAILFAST").json(path)


def question_corpus(rows: DataFrame, n_docs: int, n_queries: int, min_doc: int, min_query: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(docs by id, queries by id) sampled from accepted bodies and titles."""
    base = rows.select(
        parse_int(F.col("_Id")).alias("id"), strip_html("_Body").alias("body"), squeezed(F.col("_Title")).alias("title"), parse_tags(F.col("_Tags")).alias("tags"),
        parse_int(F.col("_Score")).alias("score"), F.coalesce("_CreationDate", F.lit("")).alias("creation_date"), parse_int(F.col("_AnswerCount")).alias("answer_count"),
    )
    side = lambda text, key: base.select(F.col("id").alias(key), F.col("id").cast("string").alias("source_id"), F.col(text).alias("text"), "tags", "score", "creation_date", "answer_count")
    return _sampled(side("body", "doc_id"), "doc_id", n_docs, min_doc, stream_seed(seed, "stackexchange", "docs")), _sampled(side("title", "query_id"), "query_id", n_queries, min_query, stream_seed(seed, "stackexchange", "queries"))


def post_corpus(rows: DataFrame, n_docs: int, n_queries: int, min_doc: int, min_query: int, seed: int, doc_field: str = "content", query_field: str = "title") -> tuple[DataFrame, DataFrame]:
    """The same for posts, whose ids are their places in the input, from 1."""
    place = rows.select("*", F.monotonically_increasing_id().alias("__m"))
    from pyspark.sql import Window

    # dense places: a count per input partition, then an offset, so that no task sees all rows
    part = F.shiftright("__m", 33)
    counts = place.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__o"))
    numbered = place.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn("place", F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1)
    text = lambda c: squeezed(F.col(c))

    def side(field: str, key: str) -> DataFrame:
        source = F.coalesce(F.nullif(F.col("id"), F.lit("")), (F.col("place") - 1).cast("string"))
        return numbered.select(F.col("place").alias(key), source.alias("source_id"), text(field).alias("text"), text("subreddit").alias("community"), F.lit(None).cast("bigint").alias("score"), F.lit(None).cast("string").alias("datetime"), F.lit("post").alias("data_type"), text("subreddit_id").alias("subreddit_id"))

    return _sampled(side(doc_field, "doc_id"), "doc_id", n_docs, min_doc, stream_seed(seed, "reddit", "docs")), _sampled(side(query_field, "query_id"), "query_id", n_queries, min_query, stream_seed(seed, "reddit", "queries"))


def _sampled(rows: DataFrame, key: str, n: int, min_chars: int, seed: int) -> DataFrame:
    return reservoir(rows.where(accept_text(F.col("text"), min_chars)), n, seed, key).orderBy(key)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector from hashed words: a stand-in for a model, for tests without one."""
    words = F.split(F.lower(squeezed(text)), " ")
    zero = F.array(*[F.lit(0.0)] * dim)
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")
    counts = F.aggregate(words, zero, lambda a, w: F.transform(a, lambda x, i: x + F.when(i == slot(w), 1.0).otherwise(0.0)))
    size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: x / F.greatest(size, F.lit(1e-12)))


def strict_join(docs: DataFrame, embeddings: DataFrame, key: str = "doc_id") -> DataFrame:
    """One-to-one join of texts and vectors; null ids or texts, repeats, and ids on one side alone are errors."""
    for name, side in (("texts", docs), ("vectors", embeddings)):
        problems = side.agg(F.count_if(F.col(key).isNull()).alias("nulls"), (F.count(key) - F.count_distinct(key)).alias("repeats")).first()
        if problems["nulls"] or problems["repeats"]:
            raise ValueError(f"{name}: {problems['nulls']} null and {problems['repeats']} repeated ids")
    if docs.where(F.col("text").isNull()).limit(1).count():
        raise ValueError("texts: null text")
    for name, a, b in (("vectors", docs, embeddings), ("texts", embeddings, docs)):
        if a.join(b, key, "left_anti").limit(1).count():
            raise ValueError(f"ids without {name}")
    return docs.join(embeddings, key)


def _leaves(value: Any, at: tuple = ()) -> dict[tuple, Any]:
    """Every scalar below `value` by its path, and each list's length; entries that name places are left out."""
    if isinstance(value, dict):
        inner = {k: v for k, v in value.items() if k not in PATH_KEYS}
        return {p: x for k, v in inner.items() for p, x in _leaves(v, (*at, k)).items()}
    if isinstance(value, list):
        return {(*at, len): len(value)} | {p: x for i, v in enumerate(value) for p, x in _leaves(v, (*at, i)).items()}
    return {at: value}


def cache_matches(manifest: dict[str, Any], wanted: dict[str, Any]) -> bool:
    """Whether a stage's manifest meets what is asked, wherever its files are; it may say more."""
    have = _leaves(manifest)
    return all(have.get(path) == value for path, value in _leaves(wanted).items())


def fingerprint(settings: dict[str, Any]) -> str:
    return hashlib.sha1(json.dumps(settings, sort_keys=True).encode()).hexdigest()
