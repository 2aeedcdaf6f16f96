"""Fusing rankings, choosing evidence, and blending with a reranker's scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seekwell.functions.text import nfkc

RRF_K = 60
RERANK_DEPTH = 40


def ranked(hits: DataFrame, order: list[Column]) -> DataFrame:
    """Dense ranks from 1 within each ranking, which has a path once: its first hit.

    ``hits(query_id, virtual_path, ...)``; searches cut their rankings to the candidates that
    are asked for, so a ranking is ranked by one task.
    """
    once = W.partitionBy("query_id", "virtual_path").orderBy(*order)
    first = hits.withColumn("_o", F.row_number().over(once)).where("_o = 1").drop("_o")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def bonus(best_rank: Column) -> Column:
    return F.when(best_rank == 1, 0.05).when(best_rank <= 3, 0.02).otherwise(0.0)


def fused(rankings: DataFrame, limit: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of ``rankings(query_id, weight, rank, virtual_path)``.

    Sums weight / (60 + rank), with a bonus for the best rank. With a limit, a top-k of each
    task comes before the fusion ranks, so that one task ranks that many rows.
    """
    sums = rankings.groupBy("virtual_path").agg(
        F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank")
    )
    scored = sums.withColumn("fusion_score", F.round(F.col("rrf") + bonus(F.col("best_rank")), 12))
    order = [F.desc("fusion_score"), F.col("virtual_path")]
    if limit is not None:
        scored = scored.orderBy(*order).limit(limit)
    return scored.withColumn("fusion_rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))


def blend(fusion_rank: Column, rerank: Column) -> Column:
    """The share of the fusion's reciprocal rank falls from .75 to .60 after 3, to .40 after 10."""
    w = F.when(fusion_rank <= 3, 0.75).when(fusion_rank <= 10, 0.60).otherwise(0.40)
    return w * (1 / fusion_rank) + (1 - w) * rerank


def blended(candidates: DataFrame) -> DataFrame:
    """``candidates(virtual_path, fusion_rank, fusion_score, rerank)`` in final order.

    The first ``RERANK_DEPTH`` go by blended score; the others follow in fusion order with
    their fusion scores, which are not comparable.
    """
    late = F.col("fusion_rank") > RERANK_DEPTH
    score = F.when(late, F.col("fusion_score")).otherwise(F.round(blend(F.col("fusion_rank"), F.col("rerank")), 12))
    order = W.partitionBy(F.lit(1)).orderBy(
        late, F.when(late, F.col("fusion_rank")).otherwise(F.lit(0)), F.desc("score"), "virtual_path"
    )
    return candidates.withColumn("score", score).withColumn("final_rank", F.row_number().over(order))


def term_score(text: Column, terms: list[tuple[str, float]]) -> Column:
    """Sum of the weights of the terms that a text has, in compatibility form and any case."""
    plain = F.lower(nfkc(text))
    return sum((F.when(plain.contains(t), float(w)).otherwise(0.0) for t, w in terms), F.lit(0.0))


def best_chunk(chunks: DataFrame, key: str, text: Column, terms: list[tuple[str, float]]) -> DataFrame:
    """For each ``key`` the chunk whose text has most of the weighted terms, the first on ties."""
    scored = chunks.withColumn("evidence_score", term_score(text, terms))
    return scored.groupBy(key).agg(
        F.max_by(F.struct("chunk_index", "evidence_score"), F.struct("evidence_score", -F.col("chunk_index"))).alias("e")
    ).select(key, "e.*")


def term_overlap(text: Column, terms: list[str]) -> Column:
    """The share of the terms that a text contains."""
    return term_score(text, [(t, 1.0) for t in terms]) / len(terms) if terms else F.lit(0.0)
