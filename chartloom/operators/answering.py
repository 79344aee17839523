"""Grounded answers from source and laboratory blocks, and the summary of a sweep of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import citation_tags

REFUSAL = "The records available don't contain an answer to this question."


def extractive_answer(question: Column, labs: Column, notes: Column) -> Column:
    """A stand-in for a generator: the first line of the labs, or the first sentence of the first source, with its tag."""
    from_labs = F.concat(F.regexp_extract(labs, r"^\[L1\] ([^\n]*)", 1), F.lit(" [L1]"))
    from_notes = F.concat(F.regexp_extract(notes, r"^\[S1\][^\n]*\n(.*?[.!?])(?:\s|$)", 1), F.lit(" [S1]"))
    return F.when(F.coalesce(labs, F.lit("")) != "", from_labs).when(F.coalesce(notes, F.lit("")) != "", from_notes)


def grounded_answers(asked: DataFrame, generate: Callable[[Column, Column, Column], Column] = extractive_answer) -> DataFrame:
    """``asked`` (question, labs, notes and others) with answer, tags, grounded, has_valid_citation and refused.

    Without labs and notes the answer is the refusal and the generator isn't asked. grounded: some tag is cited and the answer is
    no refusal. has_valid_citation: some cited tag is one of the given blocks'.
    """
    given = F.trim(F.concat_ws("", "labs", "notes")) != ""
    answer = F.coalesce(F.when(given, generate(F.col("question"), F.col("labs"), F.col("notes"))), F.lit(REFUSAL))
    out = asked.withColumn("answer", answer).withColumn("tags", citation_tags(F.col("answer")))
    have = F.regexp_extract_all(F.concat_ws("\n", "labs", "notes"), F.lit(r"(?m)^\[([SL]\d+)\]"), F.lit(1))
    return out.withColumns({"refused": F.col("answer") == REFUSAL, "has_valid_citation": F.arrays_overlap("tags", have)}).withColumn("grounded", ~F.col("refused") & (F.size("tags") > 0))


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` (key, tag and others) that the answer of the same key cites; tags of no source count for nothing."""
    cited = answers.select("key", F.explode("tags").alias("tag"))
    return sources.join(cited, ["key", "tag"], "left_semi")


def sweep_summary(answers: DataFrame) -> DataFrame:
    """(n, n_grounded, n_refused, n_valid, n_errored, n_zero_hits) over a sweep; a null answer is an error, zero hits are questions with no block."""
    nothing = F.trim(F.concat_ws("", "labs", "notes")) == ""
    return answers.agg(F.count("*").alias("n"), F.count_if("grounded").alias("n_grounded"), F.count_if("refused").alias("n_refused"), F.count_if("has_valid_citation").alias("n_valid"), F.count_if(F.col("answer").isNull()).alias("n_errored"), F.count_if(nothing).alias("n_zero_hits"))


def zero_hits(answers: DataFrame) -> DataFrame:
    """(key, question) of the questions that no block was found for."""
    return answers.where(F.trim(F.concat_ws("", "labs", "notes")) == "").select("key", "question")
