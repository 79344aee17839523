"""Tolerant casts and clinical predicates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes of the conditions that the guidelines cover.
ICD10_PREFIXES = ("I50", "I48", "I10", "I11", "I12", "I13", "I15", "E11", "N18", "J44")
ICD9_PREFIXES = ("428", "42731", "401", "402", "403", "404", "405", "250", "585", "491", "492", "496")


def safe_float(text: Column) -> Column:
    """The text as a double, null where it is none."""
    return F.trim(text).try_cast("double")


def safe_int(text: Column) -> Column:
    """The text as a whole number, cut off after the point; null where it is none or too large."""
    return safe_float(text).try_cast("int")


def strict_int(text: Column) -> Column:
    """The text as a whole number, null where it has a point."""
    return F.trim(text).try_cast("int")


def lenient_timestamp(text: Column) -> Column:
    """A time without zone from ISO or one of three other forms; null for nothing, none, nat, nan and other texts."""
    t = F.regexp_replace(F.trim(text), "Z$", "")
    known = F.when(~F.lower(t).isin("", "none", "nat", "nan"), t)
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm")
    parsed = [F.try_to_timestamp(known, F.lit(f)) for f in forms]
    return F.coalesce(known.try_cast("timestamp"), *parsed).cast("timestamp_ntz")


def guideline_diagnosis(code: Column, version: Column) -> Column:
    """Whether a code belongs to a guideline's condition; any version other than 10, null too, is read as 9."""
    tidy = F.upper(F.trim(code))
    starts = lambda prefixes: reduce(lambda a, b: a | b, [tidy.startswith(p) for p in prefixes])
    return F.coalesce(F.when(version == 10, starts(ICD10_PREFIXES)).otherwise(starts(ICD9_PREFIXES)), F.lit(False))


def age_band(age: Column) -> Column:
    """Age bands from 18-29 to 90+; below 18 is under 18, null stays null."""
    out = F.when(age < 18, "<18")
    for low, high in ((18, 29), (30, 39), (40, 49), (50, 59), (60, 69), (70, 79), (80, 89)):
        out = out.when(age <= high, f"{low}-{high}")
    return out.when(age >= 90, "90+")


def size_band(tokens: Column) -> Column:
    """Bands of chunk sizes in tokens."""
    return F.when(tokens < 50, "<50").when(tokens < 100, "50-99").when(tokens < 200, "100-199").when(tokens < 300, "200-299").when(tokens < 400, "300-399").when(tokens >= 400, "400+")


def abnormal_exact(flag: Column) -> Column:
    """The report's rule: the flag is exactly abnormal."""
    return flag == "abnormal"


def abnormal_trimmed(flag: Column) -> Column:
    """The training set's rule: abnormal in any case, blanks aside."""
    return F.lower(F.trim(flag)) == "abnormal"


def abnormal_any(flag: Column) -> Column:
    """The series' rule: any flag that isn't blank."""
    return F.coalesce(F.trim(flag) != "", F.lit(False))
