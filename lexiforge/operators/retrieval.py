"""Lexical and dense searches over stored indexes, fusion and re-ranking, for whole sets of queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import scratch_path
from . import vectors as V
from .index import LexicalIndex, build_index, score

RRF_K = 60
#: Adds ``score`` to rows, given the names of their question and passage.
PairScorer = Callable[[DataFrame, str, str], DataFrame]


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``query_id, doc_id, score`` without a stored index: one is built for the purpose."""
    return score(build_index(docs, scratch_path(docs.sparkSession, "index"), id_col, text_col), queries, query_id, query_text)


def ranked(scores: DataFrame, k: int, score: str = "score", rank: str = "rank", item: str = "doc_id") -> DataFrame:
    """The ``k`` best of each query; ties, to nine decimals, go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), item)
    return scores.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def bm25_top(index: LexicalIndex, queries: DataFrame, k: int, pad_zero: bool = False) -> DataFrame:
    """Ranked BM25 hits.  ``pad_zero`` fills up to ``k`` with the lowest ids that match nothing, at score 0."""
    hits = score(index, queries)
    if not pad_zero:
        return ranked(hits, k)
    # hits above 0 come first; of the others the lowest ids, of which the 2 k lowest suffice, as at most k are hits
    best = ranked(hits.filter(F.round("score", 9) > 0), k)
    lowest = index.forward.select(F.col("id").alias("doc_id")).orderBy("id").limit(2 * k)
    held = best.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.select(F.col("item_id").alias("query_id")).join(held, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("query_id")
    rest = short.crossJoin(F.broadcast(lowest)).join(best, ["query_id", "doc_id"], "left_anti")  # 2 k ids a query
    below = hits.filter(F.round("score", 9) < 0)
    rest = rest.join(below, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("score"))
    return ranked(best.drop("rank").union(rest).union(below.select("query_id", "doc_id", "score")), k)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Ranked exact hits of ``queries`` (rows of the same columns) among ``vectors``, ``vec_id, embedding``."""
    return ranked(V.search(vectors, queries, k), k)


def fuse(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of ``query_id, doc_id, score, rank`` channels; a missing channel's score is null."""
    d = dense.select("query_id", "doc_id", F.col("score").alias("score_dense"), F.col("rank").alias("rank_dense"))
    s = lexical.select("query_id", "doc_id", F.col("score").alias("score_bm25"), F.col("rank").alias("rank_bm25"))
    both = d.join(s, ["query_id", "doc_id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    channels = F.concat_ws("+", F.when(F.col("rank_dense").isNotNull(), "dense"), F.when(F.col("rank_bm25").isNotNull(), "bm25"))
    return ranked(both.withColumn("rrf", part("rank_dense") + part("rank_bm25")).withColumn("channels", channels), k, "rrf")


def hybrid(index: LexicalIndex, queries: DataFrame, vectors: DataFrame, fetch: int = 50, k: int = 20) -> DataFrame:
    """Fused hits of both channels; query i pairs the text of item i with vector i."""
    if not 0 < k <= fetch:
        raise ValueError("0 < k <= fetch is required")
    known = queries.select(F.col("item_id").alias("vec_id")).distinct()
    asked = vectors.join(known, "vec_id", "left_semi")
    in_corpus = vectors.join(index.forward.select(F.col("id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return fuse(dense_top(in_corpus, asked, fetch), bm25_top(index, queries, fetch, pad_zero=True), k)


def dense_only(hits: DataFrame, k: int) -> DataFrame:
    """Fused hits that the dense channel found too, by its score; may be fewer than ``k``."""
    return ranked(hits.filter("score_dense is not null").drop("rank"), k, "score_dense")


def shown_hits(hits: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits with what a reader sees of each: its columns and a preview; hits without a chunk are dropped."""
    return hits.join(chunks.withColumnRenamed(id_col, "doc_id"), "doc_id").withColumn("preview", T.preview(F.col("text"))).drop("text")


def overlap(question: Column, passage: Column) -> Column:
    """Stand-in for a cross-encoder: share of the query's words in the passage, shorter passages first among equals."""
    return T.coverage(T.word_set(question), T.word_set(passage)) + 0.01 / (1 + F.size(T.word_list(passage)))


def overlap_scorer(rows: DataFrame, question: str, passage: str) -> DataFrame:
    return rows.withColumn("score", overlap(F.col(question), F.col(passage)))


class EmptyPool(ValueError):
    """A query none of whose hits has a text."""


def rerank(hits: DataFrame, docs: DataFrame, queries: DataFrame, pool: int = 20, k: int = 5, scorer: PairScorer = overlap_scorer, strict: bool = False) -> DataFrame:
    """The ``k`` best of the first ``pool`` hits by ``scorer``; hits without a document are dropped.

    ``strict`` raises if a query is left without any hit.
    """
    if not 0 < k <= pool:
        raise ValueError("0 < k <= pool is required")
    head = hits.filter(F.col("rank") <= pool).select("query_id", "doc_id", F.col("rank").alias("hybrid_rank"), F.col("rrf").alias("hybrid_score"), "channels")
    asked = queries.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    texts = head.join(docs.select("doc_id", F.col("text").alias("passage")), "doc_id").join(asked, "query_id")
    out = ranked(scorer(texts, "question", "passage"), k, rank="final_rank")
    if strict and (lost := asked.join(out, "query_id", "left_anti").limit(1).count()):
        raise EmptyPool(f"at least {lost} query has no hit with a text")
    return out


def rank_movement(reranked: DataFrame) -> DataFrame:
    """``query_id, mean_abs_rank_change`` over the hits that were kept."""
    return reranked.groupBy("query_id").agg(F.avg(F.abs(F.col("hybrid_rank") - F.col("final_rank"))).alias("mean_abs_rank_change"))


def rerank_summary(reranked: DataFrame, pools: DataFrame) -> DataFrame:
    """One row over all queries: how many, pairs scored, and the mean of each query's movement, to two decimals."""
    moved = rank_movement(reranked).select(F.count("*").alias("queries"), F.round(F.avg(F.round("mean_abs_rank_change", 2)), 2).alias("mean_abs_rank_change"))
    return moved.crossJoin(pools.agg(F.count("*").alias("pairs_scored")))
