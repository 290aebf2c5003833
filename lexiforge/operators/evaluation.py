"""Measures of retrieval and answers, and their comparison between configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import COSTS
from .retrieval import dense_only

# Configurations from plain to full, what each adds, metrics of quality, and how deep hits are looked at.
CONFIGS = ("A", "B", "C", "D")
LABELS = {"A": "Dense", "B": "Hybrid", "C": "Hybrid + Rerank", "D": "Hybrid + Rerank + Verification"}
STEPS = (("A", "B", "bm25"), ("B", "C", "reranker"), ("C", "D", "nli"))
QUALITY = ("recall_at_3", "recall_at_5", "recall_at_10", "mrr", "faithfulness", "citation_accuracy")
DEPTH, POOL, SOURCES = 10, 20, 5
ACCURATE = 0.40


def recall(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (3, 5, 10), item: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, recall_at_k...``: share of a query's relevant items among its first k distinct hits.

    ``by``: further columns of ``hits``; each combination that occurs is measured over all queries with relevant items.
    """
    total = relevant.groupBy("query_id").agg(F.count_distinct(item).alias("total"))
    if by:
        total = total.crossJoin(F.broadcast(hits.select(*by).distinct()))
    found = hits.join(relevant.select("query_id", item).distinct(), ["query_id", item], "left_semi")
    at = found.groupBy("query_id", *by).agg(*[F.count_distinct(F.when(F.col("rank") <= k, F.col(item))).alias(f"k{k}") for k in ks])
    out = total.join(at, ["query_id", *by], "left")
    return out.select("query_id", *by, *[F.round(F.coalesce(f"k{k}", F.lit(0)) / F.col("total"), 4).alias(f"recall_at_{k}") for k in ks])


def reciprocal_rank(hits: DataFrame, relevant: DataFrame, item: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, rr``: one over the rank of the first relevant hit, 0 if there is none; ``by`` as for ``recall``."""
    first = hits.join(relevant.select("query_id", item).distinct(), ["query_id", item], "left_semi").groupBy("query_id", *by).agg(F.min("rank").alias("first"))
    asked = relevant.select("query_id").distinct()
    if by:
        asked = asked.crossJoin(F.broadcast(hits.select(*by).distinct()))
    return asked.join(first, ["query_id", *by], "left").select("query_id", *by, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("rr"))


def hits_by_config(hybrid: DataFrame, reranked: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``config, query_id, doc_id, rank``: the hits of every configuration from one search and one re-ranking.

    A takes the dense channel alone, B the fused ranks, C and D the re-ranked ones.
    """
    dense = dense_only(hybrid, depth)
    named = lambda df, config, rank: df.filter(F.col(rank) <= depth).select(F.lit(config).alias("config"), "query_id", "doc_id", F.col(rank).alias("rank"))
    return named(dense, "A", "rank").union(named(hybrid, "B", "rank")).union(named(reranked, "C", "final_rank")).union(named(reranked, "D", "final_rank"))


def evaluated(hits: DataFrame, relevant: DataFrame, verified: DataFrame | None = None, latency: DataFrame | None = None) -> DataFrame:
    """One row a query and configuration: recalls, reciprocal rank, and for D faithfulness and citation accuracy.

    ``verified`` are the verified citations of the full pipeline; a query of it without any has 0 in both.  ``latency``
    has ``config, query_id, latency_ms``.  What a configuration does not measure is null.
    """
    by = ("config",)
    out = recall(hits, relevant, by=by).join(reciprocal_rank(hits, relevant, by=by).withColumnRenamed("rr", "mrr"), ["query_id", "config"])
    null = F.lit(None).cast("double")
    if verified is None:
        out = out.withColumn("faithfulness", null).withColumn("citation_accuracy", null)
    else:
        per = faithfulness(verified).select("query_id", "faithfulness", F.col("claim_accuracy").alias("citation_accuracy"))
        full = F.col("config") == "D"
        measured = lambda c: F.when(full, F.coalesce(c, F.lit(0.0))).alias(c)
        out = out.join(per, "query_id", "left").select("query_id", "config", *[c for c in out.columns if c not in ("query_id", "config")], measured("faithfulness"), measured("citation_accuracy"))
    return out.join(latency.select("config", "query_id", "latency_ms"), ["config", "query_id"], "left") if latency is not None else out.withColumn("latency_ms", null)


def summarized(per_query: DataFrame) -> DataFrame:
    """``config`` and the means of its queries' metrics, which are rounded already, rounded again; the mean and the 95th
    percentile of its latencies."""
    means = per_query.groupBy("config").agg(*[F.round(F.avg(m), 4).alias(m) for m in QUALITY], F.count("*").alias("queries"))
    ms = latency(per_query, "config", "latency_ms").select(F.col("group").alias("config"), F.col("mean").alias("avg_latency_ms"), F.round("p95", 2).alias("p95_latency_ms"))
    return means.join(ms, "config", "left").select("config", *QUALITY, "avg_latency_ms", "p95_latency_ms", "queries")


def explored(per_query: DataFrame, asked: DataFrame, theme: str | None = None) -> DataFrame:
    """Rows of every query with its question and theme, of one theme or of all."""
    rows = per_query.join(asked, "query_id")
    return rows if theme is None else rows.filter(F.col("theme") == theme)


def displayed(summary: DataFrame) -> DataFrame:
    """A summary as a reader sees it: qualities in percent to one decimal, latencies to two."""
    return summary.select("config", *[F.round(F.col(m) * 100, 1).alias(m) for m in QUALITY], *[F.round(m, 2).alias(m) for m in COSTS])


def faithfulness(verified: DataFrame, accurate: float = 0.40) -> DataFrame:
    """Per query: mean of the best support of each claim, the share of claims that reach ``accurate`` and the share of
    citations that are supported: two definitions of citation accuracy, kept apart."""
    claims = verified.groupBy("query_id", "claim_text").agg(F.max("support").alias("best"), F.count("*").alias("n"), F.count_if(F.col("verdict") == "Supported").alias("good"))
    return claims.groupBy("query_id").agg(
        F.round(F.avg("best"), 4).alias("faithfulness"),
        F.round(F.avg((F.col("best") >= accurate).cast("double")), 4).alias("claim_accuracy"),
        F.round(F.sum("good") / F.sum("n"), 4).alias("pair_accuracy"),
        F.sum("n").cast("long").alias("pairs"),
    )


def weighted_by_citations(per_query: DataFrame) -> DataFrame:
    """Corpus figures: pair accuracy weighted by citations, faithfulness by query."""
    w = F.col("pairs")
    return per_query.agg(F.round(F.sum(F.col("pair_accuracy") * w) / F.sum(w), 4).alias("pair_accuracy"), F.round(F.avg("faithfulness"), 4).alias("faithfulness"))


def verdict_counts(verified: DataFrame) -> DataFrame:
    names = (("Supported", "supported"), ("Weak Support", "weak"), ("Unsupported", "unsupported"))
    counts = [F.count_if(F.col("verdict") == v).alias(c) for v, c in names]
    return verified.agg(F.count("*").alias("n"), *counts, F.round(F.avg("support"), 4).alias("mean"), F.min("support").alias("low"), F.max("support").alias("high"), F.round(100 * F.count_if(F.col("verdict") == "Supported") / F.count("*"), 1).alias("supported_pct"))


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, largest and 95th percentile of each group; the percentile is element ``int(0.95 * (n - 1))``.

    Found by ranks over distinct values, so no group is gathered.
    """
    counts = rows.select(F.col(group).alias("group"), F.col(value).alias("value")).filter("value is not null").groupBy("group", "value").agg(F.count("*").alias("c"))
    running = Window.partitionBy("group").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    up = counts.withColumn("upto", F.sum("c").over(running)).withColumn("n", F.sum("c").over(Window.partitionBy("group")))
    place = (F.lit(0.95) * (F.col("n") - 1)).cast("long")
    here = (place < F.col("upto")) & (place >= F.col("upto") - F.col("c"))
    return up.groupBy("group").agg(F.round(F.sum(F.col("value") * F.col("c")) / F.max("n"), 2).alias("mean"), F.max("value").alias("high"), F.max(F.when(here, F.col("value"))).alias("p95"))


def long_metrics(wide: DataFrame, metrics: list[str], key: str = "config") -> DataFrame:
    return wide.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(key, "m.metric", "m.value")


def pivot_metrics(long: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a configuration, one column a metric."""
    return long.groupBy("config").pivot("metric", metrics).agg(F.first("value"))


def best_config(long: DataFrame) -> DataFrame:
    """``metric, config, value`` of the best configuration: the largest value, the later name among equals, or of a cost the
    smallest value, the earlier name among equals."""
    cost = F.col("metric").isin(*COSTS)
    pair = F.struct("value", "config")
    best = long.filter("value is not null").groupBy("metric").agg(F.min(F.when(cost, pair)).alias("low"), F.max(F.when(~cost, pair)).alias("high"))
    return best.select("metric", F.coalesce("low.config", "high.config").alias("config"), F.coalesce("low.value", "high.value").alias("value"))


def winner(best: DataFrame) -> DataFrame:
    """One row: the configuration that is best in most qualities, the earlier name among equals, and the fastest one."""
    wins = best.filter(~F.col("metric").isin(*COSTS)).groupBy("config").agg(F.count("*").alias("n"))
    overall = wins.agg(F.min(F.struct((-F.col("n")).alias("less"), "config"))["config"].alias("best_quality"))
    return overall.crossJoin(best.agg(F.max(F.when(F.col("metric") == "avg_latency_ms", F.col("config"))).alias("fastest")))


def paired(long: DataFrame, steps: tuple = STEPS) -> DataFrame:
    """``step, metric, from, to, before, after`` of each step from one configuration to the next."""
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("step"), F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b, n in steps]))
    rows = long.sparkSession.range(1).select(pairs)
    side = lambda name, value: long.select(F.col("config").alias(name), "metric", F.col("value").alias(value))
    return F.broadcast(rows).join(side("from", "before"), "from").join(side("to", "after"), ["to", "metric"]).select("step", "metric", "from", "to", "before", "after")


def step_gains(long: DataFrame, steps: tuple = STEPS) -> DataFrame:
    """Change of every metric that either side of a step has: absolute, in percent, and its direction: ``cost`` of a
    latency, ``new`` where the earlier configuration has no value, else ``improvement``."""
    rows = paired(long, steps).filter("before is not null or after is not null")
    direction = F.when(F.col("metric").isin(*COSTS), "cost").when(F.col("before").isNull(), "new").otherwise("improvement")
    return rows.select("step", "metric", "from", "to", F.round(F.col("after") - F.col("before"), 4).alias("delta"), T.percent_gain(F.col("before"), F.col("after")).alias("gain_pct"), direction.alias("direction"))


def trade_off(long: DataFrame, metric: str = "recall_at_5", cost: str = "avg_latency_ms", steps: tuple = STEPS) -> DataFrame:
    """``step, points, cost, cost_per_point`` of each step: what a point of ``metric`` costs; null where none is gained."""
    rows = paired(long.filter(F.col("metric").isin(metric, cost)), steps).filter("before is not null and after is not null")
    change = F.col("after") - F.col("before")
    both = rows.groupBy("step").agg(F.max(F.when(F.col("metric") == metric, change * 100)).alias("p"), F.max(F.when(F.col("metric") == cost, change)).alias("c")).filter("p is not null and c is not null")
    return both.select("step", F.round("p", 2).alias("points"), F.round("c", 2).alias("cost"), F.when(F.round("p", 9) > 0, F.round(F.col("c") / F.col("p"), 1)).alias("cost_per_point"))


def normalised(long: DataFrame) -> DataFrame:
    """Values over the largest of their metric; 0 where that is 0."""
    top = F.max("value").over(Window.partitionBy("metric"))
    return long.select("config", "metric", F.when(top > 0, F.round(F.col("value") / top, 6)).otherwise(0.0).alias("share"))


def readiness(rows: DataFrame, group: str, good: str) -> DataFrame:
    """Whether all, any and how many rows of each group are good, as flags."""
    flag = F.expr(good)
    return rows.groupBy(group).agg(F.bool_and(flag).alias("all_good"), F.bool_or(flag).alias("any_good"), F.count_if(flag).alias("n_good"))


def verification_summary(verified: DataFrame) -> DataFrame:
    """One row over all queries: pairs, and means of each query's figures weighted by its pairs, but for faithfulness, which
    counts every query alike."""
    of = lambda v: F.count_if(F.col("verdict") == v) / F.count("*")
    per = verified.groupBy("query_id").agg(
        F.count("*").alias("w"), F.round(F.avg("support"), 4).alias("mean_support"), F.round(of("Supported"), 4).alias("supported_rate"),
        F.round(of("Weak Support"), 4).alias("weak_rate"), F.round(of("Unsupported"), 4).alias("unsupported_rate"),
    )
    names = ("mean_support", "supported_rate", "weak_rate", "unsupported_rate")
    weighted = per.agg(F.sum("w").alias("citations_verified"), *[F.round(F.sum(F.col(c) * F.col("w")) / F.sum("w"), 4).alias(c) for c in names])
    return weighted.crossJoin(faithfulness(verified).agg(F.round(F.avg("faithfulness"), 4).alias("faithfulness")))
