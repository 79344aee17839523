"""References to records that are missing, deleted or late.

Parents are cut into ranges of ``width`` consecutive keys and stored as one row of sorted arrays for
each range, so no array has more than ``width`` entries however the keys are spread. References are first
reduced to their different keys with the earliest arrival of each, on the map side, so that a range has at most
``width`` of them as well, however often one is referred to; there they are looked up by binary search, a whole batch
at once. Only keys that are missing, deleted or too late for some reference go back to the references.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.sources.tables import broadcast_if_small, cut

REASONS = ("missing", "deleted", "late")


def parent_ranges(parents: DataFrame, key: str, loaded: str, deleted: str, width: int = 65_536) -> DataFrame:
    """(bucket, keys, gone, first_us): sorted arrays of the parents' keys for each range of keys.

    ``gone`` says whether the version with the latest ``loaded`` has a deletion mark (at equal times one
    with a mark counts as the later), ``first_us`` is the earliest ``loaded`` in microseconds, or the
    smallest long where no version has a time. Null keys are left out.
    """
    versions = parents.select(F.col(key).cast("long").alias("k"), F.col(loaded).alias("at"), F.col(deleted).isNotNull().alias("gone")).where("k IS NOT NULL")
    latest = versions.groupBy("k").agg(F.max(F.struct("at", "gone")).alias("last"), F.min("at").alias("first"))
    entry = F.struct("k", F.col("last.gone").alias("gone"), F.coalesce(_micros("first"), F.lit(-(2**63))).alias("us"))
    arrays = latest.groupBy(F.floor(F.col("k") / width).alias("bucket")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return arrays.select("bucket", F.col("e.k").alias("keys"), F.col("e.gone").alias("gone"), F.col("e.us").alias("first_us"))


def _micros(column: str) -> F.Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """The keys of one range that may make an orphan: reason 0 missing, 1 deleted, 2 late for the earliest reference."""
    keys = left.column("ref_key").to_numpy()
    reason, first = np.zeros(len(keys), np.int32), np.full(len(keys), -(2**63), np.int64)
    if right.num_rows and left.num_rows:
        have, gone, loaded = (np.asarray(right.column(c).combine_chunks().values.to_numpy(zero_copy_only=False)) for c in ("keys", "gone", "first_us"))
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        earliest = left.column("earliest").fill_null(2**63 - 1).to_numpy()
        first = np.where(have[at] == keys, loaded[at], first)
        reason = np.where(have[at] != keys, 0, np.where(gone[at], 1, np.where(loaded[at] > earliest, 2, -1))).astype(np.int32)
    kept = left.select(["kind", "ref_key", "n"]).append_column("first_us", pa.array(first)).append_column("reason", pa.array(reason))
    return kept.filter(pa.array(reason >= 0))


def _back(refs: DataFrame, keys: DataFrame, suspects: DataFrame, max_keys: int, hot_rows: int) -> DataFrame:
    """``refs`` whose key is among the suspects: without a shuffle where these are few, otherwise hot keys apart."""
    on = ["kind", "ref_key"]
    if suspects.limit(max_keys + 1).count() <= max_keys:
        return refs.join(F.broadcast(suspects), on)
    # At most one key for each hot_rows references; a key that holds a third of all rows isn't sent to one task.
    hot = broadcast_if_small(cut(keys.where(F.col("n") > hot_rows).select(*on)), max_keys)
    cold = refs.join(hot, on, "left_anti").join(suspects.where(F.col("n") <= hot_rows), on)
    return cold.unionByName(refs.join(broadcast_if_small(suspects.where(F.col("n") > hot_rows), max_keys), on))


def find_orphans(references: DataFrame, parents: dict[str, DataFrame], width: int = 65_536, max_keys: int = 100_000, hot_rows: int = 1_000_000) -> DataFrame:
    """``references`` whose key has no live and timely parent, with their ``reason``.

    ``references`` has parent (a key of ``parents``), ref_key, arrival (timestamp) and any other columns;
    other columns come out as they are. ``parents`` has what ``parent_ranges`` returns, made with the same
    ``width``. reason: missing = no such key; else deleted; else late = first loaded after ``arrival``. A
    null key is no reference and gives no row; without an arrival nothing is late. Repeated references are
    all returned, each judged by its own arrival. Empty parents make every reference missing. ``max_keys`` and
    ``hot_rows`` change the plan, not the result.
    """
    names = list(parents)
    kind = reduce(lambda c, i: c.when(F.col("parent") == names[i], i), range(1, len(names)), F.when(F.col("parent") == names[0], 0))
    rest = [c for c in references.columns if c not in ("parent", "ref_key", "arrival")]
    refs = references.where("ref_key IS NOT NULL").select(kind.cast("int").alias("kind"), F.col("ref_key").cast("long").alias("ref_key"), _micros("arrival").alias("arrival_us"), *rest)
    keys = refs.groupBy("kind", "ref_key").agg(F.min("arrival_us").alias("earliest"), F.count("*").alias("n"))
    keys = cut(keys.withColumn("bucket", F.floor(F.col("ref_key") / width)))
    arrays = reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(i)) for i, df in enumerate(parents.values())])
    group = ["kind", "bucket"]
    suspects = cut(keys.groupBy(*group).cogroup(arrays.groupBy(*group)).applyInArrow(_probe, "kind int, ref_key long, n long, first_us long, reason int"))
    found = _back(refs, keys, suspects, max_keys, hot_rows).where((F.col("reason") < 2) | (F.col("first_us") > F.col("arrival_us")))
    reason = F.element_at(F.array(*map(F.lit, REASONS)), F.col("reason") + 1)
    parent = F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1)
    return found.select(parent.alias("parent"), "ref_key", *rest, reason.alias("reason"))


def lab_and_diagnosis_orphans(labevents: DataFrame, diagnoses: DataFrame, admissions: DataFrame, d_labitems: DataFrame) -> DataFrame:
    """(table_name, ref_field, row_key, ref_key, period_month, reason), distinct, for the three references.

    A laboratory row arrives at its storetime, or charttime where that is null, and its month is that of
    charttime; a diagnosis arrives at its loaded_at, which also gives its month. A month without its time
    is null, and so is the key of a row without labevent_id or seq_num.
    """
    labs = labevents.select("labevent_id", F.coalesce("storetime", "charttime").alias("arrival"), F.col("charttime").alias("at"), F.explode(F.array(F.struct(F.lit("admissions").alias("parent"), F.col("hadm_id").cast("long").alias("ref_key")), F.struct(F.lit("d_labitems").alias("parent"), F.col("itemid").cast("long").alias("ref_key")))).alias("r"))
    month = (F.year("at") * 12 + F.month("at") - 1).cast("int").alias("month")
    labs = labs.select("r.*", "arrival", month, F.lit(True).alias("lab"), F.col("labevent_id").cast("long").alias("row_id"))
    dx = diagnoses.withColumn("at", F.col("loaded_at")).select(F.lit("admissions").alias("parent"), F.col("hadm_id").cast("long").alias("ref_key"), F.col("loaded_at").alias("arrival"), month, F.lit(False).alias("lab"), F.col("seq_num").cast("long").alias("row_id"))
    parents = {"admissions": parent_ranges(admissions, "hadm_id", "loaded_at", "deleted_at"), "d_labitems": parent_ranges(d_labitems, "itemid", "loaded_at", "deleted_at")}
    found = find_orphans(labs.unionByName(dx), parents).distinct()
    return found.select(
        F.when(F.col("lab"), "labevents").otherwise("diagnoses_icd").alias("table_name"),
        F.when(F.col("parent") == "admissions", "hadm_id").otherwise("itemid").alias("ref_field"),
        F.when(F.col("lab"), F.col("row_id").cast("string")).otherwise(F.concat(F.col("ref_key").cast("string"), F.lit(":"), F.col("row_id").cast("string"))).alias("row_key"),
        "ref_key",
        F.format_string("%04d-%02d", F.floor(F.col("month") / 12), F.col("month") % 12 + 1).alias("period_month"),
        "reason",
    ).withColumn("period_month", F.when(F.col("period_month").rlike("^[0-9]{4}-[0-9]{2}$"), F.col("period_month")))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan rows per table, field, month and reason."""
    return orphans.groupBy("table_name", "ref_field", "period_month", "reason").agg(F.count("*").alias("n_rows"), F.countDistinct("ref_key").alias("n_keys"))
