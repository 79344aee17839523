"""Judgements of pairs: cache, votes, and the reading of a judge's answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import cache_key

PAIR_CHARACTERS = 4000


def pair_key(query: Column, text: Column, version: str = "v1", model: str = "stand-in") -> Column:
    """The cache key of a pair: version, model, query and the first characters of the text."""
    return cache_key(F.lit(version), F.lit(model), query, F.substring(text, 1, PAIR_CHARACTERS))


def parse_answer(raw: Column) -> Column:
    """The score 0 to 3 of a judge's answer, null where none can be read.

    Code fences are stripped; then the whole is read as JSON, or else the first braces in it, or these without a comma before
    the closing one. score, relevance or rating may be a number or a text with a digit; halves go to the even number.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{[^{}]*\})", 1)
    repaired = F.regexp_replace(inner, r",\s*\}", "}")
    found = F.coalesce(*[F.get_json_object(j, f"$.{name}") for j in (bare, inner, repaired) for name in ("score", "relevance", "rating")])
    number = F.coalesce(found.try_cast("double"), F.nullif(F.regexp_extract(found, r"(\d)", 1), F.lit("")).try_cast("double"))
    return F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(3), F.bround(number)))).cast("int")


def median_vote(votes: Column) -> Column:
    """The upper median of the votes that aren't null; null where there are none."""
    valid = F.array_sort(F.filter(votes, lambda v: v.isNotNull()))
    return F.try_element_at(valid, F.floor(F.size(valid) / 2).cast("int") + 1)


def judge_pairs(pairs: DataFrame, cache: DataFrame, judge: Callable[[Column, Column], Column], keep: tuple[str, ...] = ("query", "text")) -> DataFrame:
    """(key, keep, score, cached) of the distinct pairs: from ``cache`` (key, score) where it has them, otherwise judged.

    ``judge`` is an expression that gives the raw answer for query and text; an answer that can't be read gives a null score,
    and such rows shouldn't be put into the cache. ``pairs`` has query and text.
    """
    keyed = pairs.withColumn("key", pair_key(F.col("query"), F.col("text"))).dropDuplicates(["key"])
    have = keyed.join(cache.select("key", "score"), "key").withColumn("cached", F.lit(True))
    fresh = keyed.join(cache.select("key"), "key", "left_anti")
    judged = fresh.withColumns({"score": parse_answer(judge(F.col("query"), F.col("text"))), "cached": F.lit(False)})
    return have.unionByName(judged).select("key", *keep, "score", "cached")


def with_grades(results: DataFrame, judgements: DataFrame) -> DataFrame:
    """``results`` with the grade of each pair's judgement; 0 where there is none."""
    keyed = results.withColumn("key", pair_key(F.col("query"), F.col("text")))
    return keyed.join(judgements.select("key", F.col("score").alias("grade")), "key", "left").withColumn("grade", F.coalesce("grade", F.lit(0))).drop("key")
