"""Laboratory questions: which items they ask about, and the series that answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.coerce import abnormal_any
from chartloom.operators.cohort import first_rows

# Concepts of questions and the words of item labels that they stand for.
CONCEPTS = {
    "potassium": ("potassium",), "sodium": ("sodium",), "chloride": ("chloride",), "bicarbonate": ("bicarbonate",), "magnesium": ("magnesium",),
    "calcium": ("calcium",), "phosphate": ("phosphate",), "phosphorus": ("phosphate",), "glucose": ("glucose",), "blood sugar": ("glucose",),
    "creatinine": ("creatinine",), "bun": ("urea nitrogen",), "urea": ("urea nitrogen",), "kidney function": ("creatinine", "urea nitrogen"),
    "renal function": ("creatinine", "urea nitrogen"), "hemoglobin": ("hemoglobin",), "haemoglobin": ("hemoglobin",), "hematocrit": ("hematocrit",),
    "platelet": ("platelet count",), "platelets": ("platelet count",), "white blood cell": ("white blood cells",), "white blood cells": ("white blood cells",),
    "wbc": ("white blood cells",), "red blood cell": ("red blood cells",), "rbc": ("red blood cells",),
    "blood count": ("hemoglobin", "hematocrit", "white blood cells", "platelet count"), "cbc": ("hemoglobin", "hematocrit", "white blood cells", "platelet count"),
    "anemia": ("hemoglobin", "hematocrit"), "inr": ("inr",), "ptt": ("ptt",), "lactate": ("lactate",), "albumin": ("albumin",), "bilirubin": ("bilirubin",),
    "alt": ("alanine aminotransferase",), "ast": ("aspartate aminotransferase", "asparate aminotransferase"), "alkaline phosphatase": ("alkaline phosphatase",),
    "liver function": ("alanine aminotransferase", "aspartate aminotransferase", "asparate aminotransferase", "alkaline phosphatase", "bilirubin"),
    "lft": ("alanine aminotransferase", "aspartate aminotransferase", "asparate aminotransferase", "alkaline phosphatase", "bilirubin"),
    "troponin": ("troponin",), "lipase": ("lipase",), "cholesterol": ("cholesterol",),
}


def concept_table(spark) -> DataFrame:
    """(concept, keyword): the dictionary, a few dozen rows."""
    return spark.createDataFrame([(c, k) for c, ks in CONCEPTS.items() for k in ks], "concept string, keyword string")


def route_questions(questions: DataFrame, items: DataFrame) -> DataFrame:
    """(question, concept, itemid), distinct: the items that each question asks about.

    A concept must stand in the question as whole words. Its keywords are looked for in the labels; of items for one
    keyword, those from blood are taken where there are any, otherwise all.
    """
    concepts = concept_table(questions.sparkSession)
    label, fluid = F.lower(F.coalesce("label", F.lit(""))), F.lower(F.coalesce("fluid", F.lit("")))
    dictionary = items.where("itemid IS NOT NULL").select("itemid", label.alias("label"), (fluid == "blood").alias("blood")).distinct()
    matched = dictionary.join(F.broadcast(concepts.select("keyword").distinct()), F.instr(F.col("label"), F.col("keyword")) > 0)
    any_blood = F.max("blood").over(Window.partitionBy("keyword"))
    by_keyword = matched.withColumn("any_blood", any_blood).where("blood OR NOT any_blood").select("keyword", "itemid").distinct()
    whole = F.rlike(F.lower("question"), F.concat(F.lit("(^|[^a-z])"), F.col("concept"), F.lit("([^a-z]|$)")))
    asked = questions.select("question").where("question IS NOT NULL").distinct().join(F.broadcast(concepts), whole)
    return asked.join(by_keyword, "keyword").select("question", "concept", "itemid").distinct()


def lab_series(labevents: DataFrame, items: DataFrame, cap: int = 80, from_end: bool = False, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """(keys, label, n_total, n_abnormal, n_shown, uom, first_time, last_time, shown): numeric results by label.

    Items with the same label make one series. shown holds the ``cap`` earliest results, or latest with ``from_end``, by time and
    labevent_id, each with its time, number and whether any flag is set; uom is the first that isn't blank among them. Redelivered
    rows count once. Totals are aggregated before the shuffle and the shown rows are cut down before it, so long series cost little.
    """
    labels = items.where("itemid IS NOT NULL AND label IS NOT NULL").groupBy("itemid").agg(F.max_by("label", F.struct("loaded_at", "label")).alias("label"))
    rows = labevents.where("valuenum IS NOT NULL").select(*keys, "labevent_id", "itemid", "charttime", "valuenum", "valueuom", "flag").distinct().join(labels, "itemid")
    group = [*keys, "label"]
    abnormal = abnormal_any(F.col("flag"))
    totals = rows.groupBy(*group).agg(F.count("*").alias("n_total"), F.count_if(abnormal).alias("n_abnormal"))
    order = [F.col("charttime"), F.col("labevent_id")]
    shown = first_rows(rows, group, [F.desc(c) for c in ("charttime", "labevent_id")] if from_end else order, cap)
    entry = F.struct("charttime", "labevent_id", "valuenum", F.nullif(F.trim("valueuom"), F.lit("")).alias("uom"), abnormal.alias("abnormal"))
    series = shown.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("shown"))
    uom = F.try_element_at(F.filter(F.transform("shown", lambda x: x["uom"]), lambda u: u.isNotNull()), F.lit(1))
    out = totals.join(series, group)
    return out.select(*group, "n_total", "n_abnormal", F.size("shown").cast("long").alias("n_shown"), uom.alias("uom"), F.element_at("shown", 1)["charttime"].alias("first_time"), F.element_at("shown", -1)["charttime"].alias("last_time"), "shown")


def short_number(x: Column) -> Column:
    """A number with six significant digits at most and no trailing zeros."""
    places = 5 - F.floor(F.log10(F.abs(x))).cast("int")
    tidy = F.when((x == 0) | x.isNull(), x).otherwise(F.round(x * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places))
    return F.regexp_replace(F.regexp_replace(F.format_number(tidy, 8), ",", ""), r"\.?0+$", "")


def lab_blocks(series: DataFrame, most: int = 10) -> DataFrame:
    """``series`` with block: its label, counts and last ``most`` shown results as text."""
    value = lambda x: F.concat(F.date_format(x["charttime"], "yyyy-MM-dd"), F.lit(": "), short_number(x["valuenum"]), F.when(x["abnormal"], " *").otherwise(""))
    head = F.concat("label", F.coalesce(F.concat(F.lit(" ("), F.col("uom"), F.lit(")")), F.lit("")), F.lit(" — "), F.col("n_total").cast("string"), F.lit(" value(s), "), F.col("n_abnormal").cast("string"), F.lit(" abnormal: "))
    return series.withColumn("block", F.concat(head, F.array_join(F.transform(F.slice("shown", F.greatest(F.lit(1), F.size("shown") - most + 1), F.lit(most)), value), "; ")))


def answer_lab_questions(asked: DataFrame, routes: DataFrame, labevents: DataFrame) -> DataFrame:
    """(key, n_concepts, n_items, n_values, status) for questions about a subject.

    ``asked`` has key, question and subject_id. status: not a lab question, no data or data.
    """
    counts = labevents.where("valuenum IS NOT NULL").select("subject_id", "itemid", "labevent_id").distinct().groupBy("subject_id", "itemid").agg(F.count("*").alias("n"))
    routed = asked.join(routes, "question", "left")
    per_item = routed.select("key", "subject_id", "concept", "itemid").distinct()
    concepts = per_item.groupBy("key").agg(F.count_distinct("concept").alias("n_concepts"))
    values = per_item.select("key", "subject_id", "itemid").distinct().join(counts, ["subject_id", "itemid"], "left").groupBy("key").agg(F.count("itemid").alias("n_items"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"))
    status = F.when(F.col("n_items") == 0, "not a lab question").when(F.col("n_values") == 0, "no data").otherwise("data")
    return concepts.join(values, "key").withColumn("status", status)
