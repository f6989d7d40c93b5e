"""Exact and effort-limited nearest-neighbour search.

Queries and documents are packed into blocks of vectors, and each pair of blocks
is one matrix product that keeps its best rows alone. So a fixed query set meets
all documents in blocks, a task holds two blocks, and what is shuffled grows as
queries x document blocks x kept rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOC_BLOCK = 8192
QUERY_BLOCK = 1024
SCORES = "qid long, did long, dist double, coarse double"


def _blocks(vectors: DataFrame, key: str, embedding: str, size: int, name: str) -> DataFrame:
    """One row per block: its ids and its vectors, each partition cut on its own."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def block(frame: pd.DataFrame) -> pd.DataFrame:
            matrix = np.stack(frame[embedding].to_numpy()).astype("<f8")
            return pd.DataFrame({f"{name}_ids": [frame[key].to_list()], f"{name}_vectors": [matrix.tobytes()]})

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            while rows >= size:
                frame = pd.concat(held)
                yield block(frame.iloc[:size])
                held, rows = [frame.iloc[size:]], rows - size
        if rows:
            yield block(pd.concat(held))

    kept = vectors.where(F.col(embedding).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), embedding)
    return kept.mapInPandas(pack, f"{name}_ids array<bigint>, {name}_vectors binary")


def block_scores(queries: DataFrame, docs: DataFrame, key: str, embedding: str, keep: int, coarse_dims: int = 0, metric: str = "cosine", exclude_self: bool = True) -> DataFrame:
    """Best `keep` documents of each query and document block: qid, did, dist, coarse.

    With coarse_dims the best are those of the greatest dot product over the first
    dimensions (column coarse), else those of the least distance. Ties go to the
    lesser document. Null vectors and ids are left out.
    """
    left, right = _blocks(queries, key, embedding, QUERY_BLOCK, "q"), _blocks(docs, key, embedding, DOC_BLOCK, "d")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, q_raw, d_ids, d_raw in zip(batch.q_ids, batch.q_vectors, batch.d_ids, batch.d_vectors, strict=True):
                q_ids, d_ids = np.asarray(q_ids), np.asarray(d_ids)
                q, d = np.frombuffer(q_raw).reshape(len(q_ids), -1), np.frombuffer(d_raw).reshape(len(d_ids), -1)
                product = q @ d.T
                if metric == "cosine":
                    size = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((d**2).sum(1))
                    dist = 1.0 - np.divide(product, size, out=np.full_like(product, np.nan), where=size > 0)
                else:
                    dist = -product
                rank = -(q[:, :coarse_dims] @ d[:, :coarse_dims].T) if coarse_dims else dist
                rank = np.where(np.isnan(dist), np.inf, rank)
                if exclude_self:
                    rank = np.where(q_ids[:, None] == d_ids[None, :], np.inf, rank)
                by_id = np.argsort(d_ids, kind="stable")
                order = by_id[np.argsort(rank[:, by_id], axis=1, kind="stable")[:, :keep]]
                rows = np.repeat(np.arange(len(q_ids)), order.shape[1])
                cols = order.ravel()
                real = np.isfinite(rank[rows, cols])
                rows, cols = rows[real], cols[real]
                yield pd.DataFrame({"qid": q_ids[rows], "did": d_ids[cols], "dist": dist[rows, cols], "coarse": -rank[rows, cols]})

    return left.join(right).mapInPandas(score, SCORES)


def ranked(rows: DataFrame, by: list, keep: int, name: str = "rank", group: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Rows of each group's best `keep`; Spark prunes before the shuffle (WindowGroupLimit)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col(name) <= keep)


def exact_topk(queries: DataFrame, docs: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding", metric: str = "cosine") -> DataFrame:
    """qid, rank, did, dist: the k nearest by distance, then key."""
    return ranked(block_scores(queries, docs, key, embedding, k, metric=metric), ["dist", "did"], k).select("qid", "rank", "did", "dist")


def as_lists(topk: DataFrame) -> DataFrame:
    """qid, gt_keys, gt_distances in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "did", "dist")))
    return topk.groupBy("qid").agg(rows.alias("r")).select("qid", F.col("r.did").alias("gt_keys"), F.col("r.dist").alias("gt_distances"))


def require_k(truth: DataFrame, k: int) -> DataFrame:
    """`truth` if each query has k rows, else an error when it runs: the table is smaller than k."""
    short = F.assert_true(F.size("gt_keys") >= k, F.lit(f"the table holds fewer than {k} rows"))
    return truth.where(short.isNull())


class Searcher(Protocol):
    """A search backend with an effort knob."""

    def search(self, queries: DataFrame, docs: DataFrame, k: int, efs: list[int]) -> DataFrame:
        """qid, ef, returned_keys (at most k, best first)."""


class CandidateBudget:
    """Ranks by a coarse score over the first dimensions, keeps ef candidates, reranks them exactly.

    Candidates nest in ef, so recall never falls with effort, and ef = all is exact.
    """

    def __init__(self, coarse_dims: int = 16, key: str = "vec_id", embedding: str = "embedding") -> None:
        self.coarse_dims, self.key, self.embedding = coarse_dims, key, embedding

    def search(self, queries: DataFrame, docs: DataFrame, k: int, efs: list[int]) -> DataFrame:
        most = max(efs)
        scored = block_scores(queries, docs, self.key, self.embedding, most, self.coarse_dims)
        budget = ranked(scored, [F.desc("coarse"), "did"], most, "place")
        each = budget.withColumn("ef", F.explode(F.array(*[F.lit(e) for e in efs]))).where(F.col("place") <= F.col("ef"))
        best = ranked(each, ["dist", "did"], k, group=("qid", "ef"))
        keys = F.transform(F.array_sort(F.collect_list(F.struct("rank", "did"))), lambda r: r["did"])
        return best.groupBy("qid", "ef").agg(keys.alias("returned_keys"))


def sweep_recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """qid, ef, hits, recall, result_count: the first k true keys against the returned ones; a query without truth is an error."""
    joined = found.join(truth.select("qid", F.slice("gt_keys", 1, k).alias("gt")), "qid", "left")
    gt = F.coalesce("gt", F.raise_error(F.lit("query without ground truth")).cast("array<bigint>"))
    hits = F.size(F.array_intersect(gt, "returned_keys"))
    return joined.select("qid", "ef", hits.cast("long").alias("hits"), (hits / F.lit(float(k))).alias("recall"), F.size("returned_keys").cast("long").alias("result_count"))


def boundary_gap(queries: DataFrame, docs: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """qid, gap between the distances at ranks k and k+1; the least gap tells whether ties can matter."""
    top = exact_topk(queries, docs, k + 1, key, embedding)
    after = F.lead("dist").over(Window.partitionBy("qid").orderBy("rank"))
    return top.withColumn("gap", after - F.col("dist")).where(F.col("rank") == k).select("qid", "gap")


def attach_attributes(results: DataFrame, docs: DataFrame, result_key: str, doc_key: str) -> DataFrame:
    """Results with their documents' columns; a result without a document is an error."""
    there = docs.withColumn("__there", F.lit(True))
    out = results.join(there, F.col(result_key) == F.col(doc_key), "left")
    return out.where(F.assert_true(F.col("__there"), F.lit("result without a document")).isNull()).drop("__there")
