"""Choosing patients and loading tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.coerce import guideline_diagnosis


def repeat_patients(admissions: DataFrame, at_least: int) -> DataFrame:
    """(subject_id, n) of the patients with enough admissions; versions of an admission count once."""
    return admissions.groupBy("subject_id").agg(F.count_distinct("hadm_id").alias("n")).where(F.col("n") >= at_least)


def select_cohort(patients: DataFrame, admissions: DataFrame, notes: DataFrame, diagnoses: DataFrame, limit: int = 5000, min_admissions: int = 3, min_age: int = 18, note_type: str = "discharge", open_if_no_diagnosis: bool = False) -> DataFrame:
    """(subject_id): adults with enough admissions, a note of the type and a guideline diagnosis, the smallest ids first.

    With ``open_if_no_diagnosis`` the diagnosis isn't asked for where no patient at all has one.
    """
    adults = patients.where(F.col("anchor_age") >= min_age).select("subject_id").distinct()
    noted = notes.where(F.col("note_type") == note_type).select("subject_id")
    diagnosed = diagnoses.where(guideline_diagnosis(F.col("icd_code"), F.col("icd_version"))).select("subject_id")
    chosen = adults.join(repeat_patients(admissions, min_admissions), "subject_id", "left_semi").join(noted, "subject_id", "left_semi")
    if not open_if_no_diagnosis or diagnosed.limit(1).count():
        chosen = chosen.join(diagnosed, "subject_id", "left_semi")
    return chosen.orderBy("subject_id").limit(limit)


def members_of(rows: DataFrame, cohort: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows of the cohort's patients."""
    return rows.join(cohort.select(key).distinct(), key, "left_semi")


def outside_of(rows: DataFrame, cohort: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows of patients outside the cohort, and those without a patient."""
    return rows.join(cohort.select(key).distinct(), key, "left_anti")


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the order, with their place as ``place``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    # The bare comparison lets Spark cut each key down to n rows before the shuffle, so a hot key is no burden.
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def upsert_first(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``existing`` and, of ``incoming``, the first row of each key that isn't there yet."""
    fresh = incoming.join(existing.select(key), key, "left_anti")
    return existing.unionByName(first_rows(fresh, [key], order, 1).drop("place"))


def cascade_delete(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is left."""
    return children.join(parents.select(key), key, "left_semi")


def incremental_index(notes: DataFrame, chunks: DataFrame, key: str = "note_id") -> DataFrame:
    """Notes without any chunk yet."""
    return notes.join(chunks.select(key), key, "left_anti")


def sample_patients(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(key): ``n`` keys in the order of a hash of key and seed."""
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def split_by_hash(rows: DataFrame, key: str, train_percent: int = 90, seed: int = 42) -> DataFrame:
    """``rows`` with part, train or val, by a hash of key and seed: the same key is always in the same part.

    No sort of the whole is needed, and the share is met on average. Give the patient as key to keep patients apart.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("part", F.when(h < train_percent, "train").otherwise("val"))
