"""Measures of ranked lists. A list has query_id, config, rank from one, rel (0 or 1) and grade (0 to 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.vectors import discount


def _first(k: int, x: Column) -> Column:
    return F.when(F.col("rank") <= k, x)


def ir_metrics(runs: DataFrame, k: int = 5, min_relevant: int | Column = 3) -> DataFrame:
    """(config, query_id, precision, recall, mrr, ndcg) with 0/1 relevance.

    Precision divides by the results returned, up to k. Recall divides by ``min_relevant`` and is at most 1. mrr looks at the
    whole list. The ideal of ndcg has only the relevant results among this list's own first k.
    """
    needed = min_relevant if isinstance(min_relevant, Column) else F.lit(min_relevant)
    rel = F.col("rel")
    hits, n = F.sum(_first(k, rel)), F.count(_first(k, rel))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.coalesce(hits, F.lit(0)).cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + discount(i))
    out = runs.groupBy("config", "query_id").agg(
        F.coalesce(hits / n, F.lit(0.0)).alias("precision"),
        F.when(F.first(needed) <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(hits / F.first(needed), F.lit(0.0)))).alias("recall"),
        F.coalesce(1 / F.min(F.when(rel == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.when(hits > 0, F.sum(_first(k, rel * discount(F.col("rank")))) / ideal).otherwise(0.0).alias("ndcg"),
    )
    return out


def pool(runs: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, chunk_id, grade), distinct: what any configuration returned among its first ``depth``."""
    return runs.where(F.col("rank") <= depth).groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade"))


def pooled_metrics(runs: DataFrame, pooled: DataFrame, k: int = 5, threshold: int = 2) -> DataFrame:
    """(config, query_id, precision, recall, mrr, ndcg): recall against the pool, mrr within k, ndcg with gain 2^grade - 1.

    The ideal order is that of all pooled grades of the query, its first k.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    placed = pooled.withColumn("place", F.row_number().over(w))
    # Only the first k places count for the ideal; the count of relevant ones is a plain aggregate.
    ideal = placed.where(F.col("place") <= k).groupBy("query_id").agg(F.sum(gain * discount(F.col("place"))).alias("idcg"))
    relevant = pooled.groupBy("query_id").agg(F.count_if(F.col("grade") >= threshold).alias("n_relevant"))
    rel = (F.col("grade") >= threshold).cast("int")
    hits = F.sum(_first(k, rel))
    lists = runs.groupBy("config", "query_id").agg(
        F.coalesce(hits / F.count(_first(k, rel)), F.lit(0.0)).alias("precision"), hits.alias("hits"),
        F.coalesce(1 / F.min(_first(k, F.when(rel == 1, F.col("rank")))), F.lit(0.0)).alias("mrr"), F.coalesce(F.sum(_first(k, gain * discount(F.col("rank")))), F.lit(0.0)).alias("dcg"),
    )
    out = lists.join(relevant, "query_id").join(ideal, "query_id")
    return out.select(
        "config", "query_id", "precision",
        F.when(F.col("n_relevant") > 0, F.least(F.lit(1.0), F.coalesce("hits", F.lit(0)) / F.col("n_relevant"))).otherwise(0.0).alias("recall"),
        "mrr", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """(config, category, n, means): one rollup; category is "all" for the whole of a configuration."""
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "mrr", "ndcg")]
    out = metrics.withColumn("category", F.coalesce("category", F.lit("none"))).rollup("config", "category").agg(F.count("*").alias("n"), *means, F.grouping("category").alias("g"))
    return out.where("config IS NOT NULL").withColumn("category", F.when(F.col("g") == 1, "all").otherwise(F.col("category"))).drop("g")


def head_to_head(metrics: DataFrame, configs: list[str]) -> DataFrame:
    """(config, wins): queries in which a configuration has the highest ndcg; ties go to the earlier in ``configs``."""
    pos = F.array_position(F.array(*map(F.lit, configs)), F.col("config"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("ndcg", 9)), pos)
    return metrics.withColumn("k", F.row_number().over(w)).where("k = 1").groupBy("config").agg(F.count("*").alias("wins"))


def temporal_metrics(runs: DataFrame, least: int = 1) -> DataFrame:
    """(config, query_id, n_dated, hit1, hit3, newest_rank, monotonic, n_dates, same_admission) of dated results.

    The newest relevant record is the latest of those with a grade of at least ``least``, ranked first where times tie.
    monotonic is the share of neighbours in time order, null for fewer than two; same_admission the share in the newest's admission.
    """
    dated = runs.where("charttime IS NOT NULL")
    w = Window.partitionBy("config", "query_id").orderBy("rank")
    steps = dated.withColumns({"place": F.row_number().over(w), "next": F.lead("charttime").over(w)})
    relevant = F.col("grade") >= least
    newest = F.max(F.when(relevant, F.struct("charttime", (-F.col("place")).alias("back"), "hadm_id")))
    agg = steps.groupBy("config", "query_id").agg(
        F.count("*").alias("n_dated"), newest.alias("newest"), F.count_distinct("charttime").alias("n_dates"),
        F.avg(F.when(F.col("next").isNotNull(), (F.col("charttime") <= F.col("next")).cast("int"))).alias("monotonic"), F.collect_list(F.struct("hadm_id")).alias("adm"),
    )
    rank = -F.col("newest.back")
    same = F.size(F.filter("adm", lambda x: x["hadm_id"] == F.col("newest.hadm_id"))) / F.size("adm")
    return agg.select("config", "query_id", "n_dated", (rank == 1).cast("int").alias("hit1"), (rank <= 3).cast("int").alias("hit3"), rank.cast("long").alias("newest_rank"), "monotonic", "n_dates", F.when(F.col("newest.hadm_id").isNotNull(), same).alias("same_admission"))


def temporal_lift(metrics: DataFrame, base: str = "all") -> DataFrame:
    """(config, measure means and their difference from ``base``)."""
    means = metrics.groupBy("config").agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("hit1", "hit3", "monotonic")])
    b = means.where(F.col("config") == base).select(*[F.col(c).alias(f"base_{c}") for c in ("hit1", "hit3", "monotonic")])
    # The base is one row.
    return means.join(F.broadcast(b), F.lit(True), "left").select("config", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "monotonic")], *[F.round(F.col(c) - F.coalesce(f"base_{c}", F.lit(0.0)), 6).alias(f"lift_{c}") for c in ("hit1", "hit3", "monotonic")])
