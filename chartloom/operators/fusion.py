"""Fusing ranked lists, and what follows: dedup by note, time, context, rerank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.vectors import half_life, min_max, sigmoid

DEFAULT_K = 60


def reciprocal_rank_fusion(lexical: DataFrame, vector: DataFrame, k: int = DEFAULT_K, weights: tuple[float, float] = (1.0, 1.2), bonus: float = 0.5, scale: bool = True) -> DataFrame:
    """(query_id, chunk_id, lexical_rank, vector_rank, sources, raw, score, rank) of two ranked lists.

    Each list adds its weight over k plus the rank; a chunk in both gets ``bonus`` over k + 1 more. With ``scale`` the score is
    scaled to 0..1 within the query. Ties go by lexical rank, nulls last, then vector rank, then chunk_id.
    """
    l = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"))  # noqa: E741
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"))
    both = l.join(v, ["query_id", "chunk_id"], "full_outer")
    part = lambda rank, w: F.coalesce(F.lit(w) / (k + F.col(rank)), F.lit(0.0))
    extra = F.when(F.col("lexical_rank").isNotNull() & F.col("vector_rank").isNotNull(), bonus / (k + 1)).otherwise(0.0)
    source = F.when(F.col("vector_rank").isNull(), "bm25").when(F.col("lexical_rank").isNull(), "vector").otherwise("both")
    raw = both.withColumns({"raw": part("lexical_rank", weights[0]) + part("vector_rank", weights[1]) + extra, "sources": source})
    scored = raw.withColumn("score", min_max(F.col("raw"), "query_id") if scale else F.col("raw"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 9)), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("vector_rank"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long"))


def fusion_v1(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """The older fusion: equal weights, no bonus, no scaling."""
    return reciprocal_rank_fusion(lexical, vector, weights=(1.0, 1.0), bonus=0.0, scale=False)


def rerank_positions(rows: DataFrame) -> DataFrame:
    """``rows`` ranked anew in their order of rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))


def dedup_notes(results: DataFrame, per_note: int = 2) -> DataFrame:
    """At most ``per_note`` chunks of a note for each query, best rank first; ranked anew."""
    w = Window.partitionBy("query_id", "note_id").orderBy("rank")
    return rerank_positions(results.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_note).drop("k"))


def temporal(results: DataFrame, mode: str, recency_days: int = 365, weight: float = 0.20, halflife: float = 180.0, reference: DataFrame | None = None) -> DataFrame:
    """``results`` with days_ago, reweighted, filtered or sorted by time; the score may change, and so does rank.

    Time is counted back from each subject's latest dated result of the query, or from ``reference`` (subject_id, anchor).
    all: nothing changes. recent: rows more than ``recency_days`` old are dropped, the rest boosted. latest or most_recent: all
    are boosted. trend or oldest_first: oldest first, undated last. Undated rows are neither dropped nor boosted.
    """
    mode = {"oldest_first": "trend", "most_recent": "latest"}.get(mode, mode)
    if reference is None:
        dated = results.withColumn("anchor", F.max("charttime").over(Window.partitionBy("query_id", "subject_id")))
    else:
        dated = results.join(reference.select("subject_id", "anchor"), "subject_id", "left")
    days = F.timestamp_diff("SECOND", F.col("charttime"), F.col("anchor")) / 86400.0
    days = F.when(days.isNotNull(), F.greatest(F.lit(0.0), days))  # greatest would take the number before a null
    dated = dated.withColumn("days_ago", days).drop("anchor")
    if mode == "all":
        return dated
    if mode == "recent":
        dated = dated.where(F.col("days_ago").isNull() | (F.col("days_ago") <= recency_days))
    if mode in ("recent", "latest"):
        dated = dated.withColumn("score", F.col("score") + F.coalesce(half_life(F.col("days_ago"), weight, halflife), F.lit(0.0)))
        order = [F.desc(F.round("score", 9)), F.asc("rank")]
    else:
        order = [F.asc_nulls_last("charttime"), F.asc("rank")]
    return dated.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def temporal_v1(results: DataFrame, most: float = 0.20, span_days: int = 36_525) -> DataFrame:
    """The older rule: a boost by up to ``most`` that falls linearly from a fixed day, whatever the mode."""
    days = F.timestamp_diff("SECOND", F.col("charttime"), F.lit("2200-01-01").cast("timestamp_ntz")) / 86400.0
    share = F.when(days.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / span_days)))
    boosted = results.withColumn("score", F.col("score") * (1 + most * F.coalesce(share, F.lit(0.0))))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "rank")
    return boosted.withColumn("rank", F.row_number().over(w).cast("long"))


def context_windows(results: DataFrame, chunks: DataFrame, width: int = 1, budget: int = 600, anchor_first: bool = False) -> DataFrame:
    """``results`` with context_text, context_tokens and n_context: the chunk's neighbours in its note, as far as the budget goes.

    ``results`` has chunk_id, note_id, chunk_index and text; ``chunks`` has note_id, chunk_index, text and tokens, each index once.
    Neighbours are taken in index order until one more would exceed ``budget``; with ``anchor_first`` the chunk itself comes
    before them. Where nothing fits, the text is the chunk's own and context_tokens is 0. All chunks go through one join.
    """
    near = chunks.select("note_id", F.col("chunk_index").alias("n_index"), F.col("text").alias("n_text"), F.col("tokens").alias("n_tokens"))
    keys = [c for c in ("query_id", "chunk_id") if c in results.columns]
    # The places wanted, so that the join meets only these and not all chunks of a note.
    wanted = F.explode(F.sequence(F.col("chunk_index") - width, F.col("chunk_index") + width)).alias("n_index")
    joined = results.select(*keys, "note_id", "chunk_index", wanted).join(near, ["note_id", "n_index"])
    first = [F.desc(F.col("n_index") == F.col("chunk_index"))] if anchor_first else []
    w = Window.partitionBy(*keys).orderBy(*first, "n_index").rowsBetween(Window.unboundedPreceding, 0)
    fit = joined.withColumn("used", F.sum("n_tokens").over(w)).where(F.col("used") <= budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_index", "n_text"))), lambda x: x["n_text"]), "\n")
    context = fit.groupBy(*keys).agg(text.alias("context"), F.sum("n_tokens").cast("long").alias("context_tokens"), F.count("*").alias("n_context"))
    return results.join(context, keys, "left").withColumns({"context_text": F.coalesce("context", "text"), "context_tokens": F.coalesce("context_tokens", F.lit(0).cast("long")), "n_context": F.coalesce("n_context", F.lit(0).cast("long"))}).drop("context")


def source_blocks(results: DataFrame, budget: int = 8000) -> DataFrame:
    """(query_id, block, n_sources): numbered source blocks joined by blank lines, within ``budget`` characters.

    Blank bodies are left out before numbering. The first block is always kept; a block counts two characters more for its
    separator, and the first one that doesn't fit ends the list.
    """
    rows = results.where(F.trim(F.coalesce("context_text", F.lit(""))) != "")
    w = Window.partitionBy("query_id").orderBy("rank")
    tagged = rows.withColumn("n", F.row_number().over(w))
    head = F.concat(F.lit("[S"), F.col("n").cast("string"), F.lit("] note_type="), F.coalesce("note_type", F.lit("unknown")), F.lit(" | charttime="), F.coalesce(F.date_format("charttime", "yyyy-MM-dd"), F.lit("unknown")))
    blocks = tagged.withColumn("block", F.concat(head, F.lit("\n"), F.trim("context_text"))).withColumn("size", F.length("block") + 2)
    used = blocks.withColumn("before", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    kept = used.where((F.col("n") == 1) | (F.col("before") + F.length("block") <= budget))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("block"), F.count("*").alias("n_sources"))


def rerank(results: DataFrame, logit: Column, top: int = 10, confident: float = 0.35) -> DataFrame:
    """The ``top`` results of each query by the scorer's sigmoid, or by their own score where the best is not confident.

    Adds rerank_score and fallback; rank is the new place. Where the highest rerank_score among the query's results is below
    ``confident``, the order of rank is kept.
    """
    scored = results.withColumn("rerank_score", sigmoid(logit))
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    judged = scored.withColumn("fallback", best < confident)
    order = [F.desc(F.when(~F.col("fallback"), F.round("rerank_score", 9))), F.asc("rank")]
    placed = judged.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return placed.where(F.col("place") <= top).withColumn("rank", F.col("place").cast("long")).drop("place")
