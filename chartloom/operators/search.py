"""Hybrid search as one call: scoped questions, both arms, fusion, at most two chunks of a note, time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.text import temporal_mode
from chartloom.operators import fusion, lexical, vector
from chartloom.operators.models import embedder
from chartloom.sources.tables import cut

MODES = ("all", "recent", "latest", "trend")


def parse_questions(lines: DataFrame) -> DataFrame:
    """(query_id, query, subject_id, mode) of typed lines (query_id, line).

    ``p:<id> `` before a question limits it to a patient; ``/recent`` or else ``/oldest`` in it sets how time is looked at.
    A line without them has nulls there; what remains is trimmed.
    """
    patient = F.regexp_extract("line", r"^\s*p:(\d+)\s", 1).try_cast("int")
    low = F.lower("line")
    mode = F.when(low.contains("/recent"), "recent").when(low.contains("/oldest"), "trend")
    plain = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s*p:\d+\s+", ""), r"(?i)\s*/(?:recent|oldest)\b", ""))
    return lines.select("query_id", plain.alias("query"), patient.alias("subject_id"), mode.alias("mode"))


def search(questions: DataFrame, chunks: DataFrame, times: DataFrame, top: int = 10, per_note: int = 2, embed: Callable[[str], Callable[[Column], Column]] = lambda role: embedder(role=role)) -> DataFrame:
    """(query_id, chunk_id, note_id, subject_id, note_type, sources, score, mode, rank): the ``top`` chunks of each question.

    ``questions`` has query_id and query, and may have subject_id, hadm_id and note_type, which limit it where they aren't
    null and are applied in both arms before anything is ranked, and mode (all, recent, latest, trend), where a null mode is read from
    the question's words. ``chunks`` has chunk_id, note_id, text and the three fields, ``times`` note_id and charttime.
    ``embed`` gives the embedder of the role query or document.
    """
    known = [c for c in (*lexical.SCOPE, "mode") if c in questions.columns]
    kinds = {"subject_id": "int", "hadm_id": "int", "note_type": "string", "mode": "string"}
    asked = questions.select("query_id", "query", *known).withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in known})
    asked = cut(asked.withColumn("mode", F.coalesce("mode", temporal_mode(F.col("query")))).withColumn("mode", F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise("all")).distinct())
    # Questions alike in everything are answered once.
    alike = asked.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("query", *lexical.SCOPE, "mode"))).alias("all"))
    alike = cut(alike.select("query_id", F.min("query_id").over(Window.partitionBy("all")).alias("answered")))
    asked = cut(asked.join(alike.select(F.col("answered").alias("query_id")).distinct(), "query_id", "left_semi"))
    words, vocabulary = lexical.numbered(lexical.query_words(asked))
    # What both arms need of a chunk in place of its text: none is shuffled or kept.
    key = ("chunk_id", "note_id", *lexical.SCOPE, "mark")
    rows = chunks.withColumns({"mark": F.sha2("text", 256), "vector": embed("document")(F.col("text"))})
    held = lexical.word_lists(rows, vocabulary, (*key, "vector")).repartition("chunk_id").dropDuplicates([*key])
    held = cut(lexical.with_copies(held).drop("mark"))
    by_words = lexical.scoped_two_pass(asked, words, held, len(vocabulary))
    by_vectors = vector.vector_top(asked.withColumn("vector", embed("query")(F.col("query"))), held, scoped=True)
    fields = held.select("chunk_id", "note_id", *lexical.SCOPE)
    fused = fusion.reciprocal_rank_fusion(by_words, by_vectors).join(fields, "chunk_id").join(times.select("note_id", "charttime"), "note_id", "left")
    fused = cut(fusion.dedup_notes(fused, per_note).join(asked.select("query_id", "mode"), "query_id"))
    found = reduce(DataFrame.unionByName, [fusion.temporal(fused.where(F.col("mode") == m), m).select("query_id", "chunk_id", "note_id", "subject_id", "note_type", "sources", "score", "mode", "rank") for m in MODES])
    answers = found.where(F.col("rank") <= top).withColumnRenamed("query_id", "answered")
    return answers.join(alike, "answered").select("query_id", *[c for c in found.columns if c != "query_id"])
