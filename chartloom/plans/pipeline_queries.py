"""Queries of the general training-data problems, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.operators import orphans, spikes, units
from chartloom.sources.tables import table


def _labs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "labevents"), table(spark, d, "lab_unit_factors"), table(spark, d, "d_labitems")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.other_units(*_labs(spark, d))


def p1_converted(spark: SparkSession, d: str) -> DataFrame:
    return units.common_values(*_labs(spark, d))


def p1_calibration(spark: SparkSession, d: str) -> DataFrame:
    return units.unit_calibration(*_labs(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = [table(spark, d, n) for n in ("labevents", "diagnoses_icd", "admissions", "d_labitems")]
    return orphans.lab_and_diagnosis_orphans(*t)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p5_found(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(spikes.lab_readings(*_labs(spark, d)))


QUERIES = {f.__name__: f for f in (p1_found, p1_converted, p1_calibration, p5_found, p5_report, p6_found)}

_ORPHANS = """
WITH adm AS (
  SELECT hadm_id AS k, arg_max(deleted_at IS NOT NULL, (loaded_at, deleted_at IS NOT NULL)) AS gone, min(loaded_at) AS first_at
  FROM admissions WHERE hadm_id IS NOT NULL GROUP BY hadm_id
), item AS (
  SELECT itemid AS k, arg_max(deleted_at IS NOT NULL, (loaded_at, deleted_at IS NOT NULL)) AS gone, min(loaded_at) AS first_at
  FROM d_labitems WHERE itemid IS NOT NULL GROUP BY itemid
), refs AS (
  SELECT 'labevents' AS table_name, 'hadm_id' AS ref_field, CAST(labevent_id AS VARCHAR) AS row_key, CAST(hadm_id AS BIGINT) AS ref_key,
         strftime(charttime, '%Y-%m') AS period_month, coalesce(storetime, charttime) AS arrival FROM labevents WHERE hadm_id IS NOT NULL
  UNION ALL
  SELECT 'labevents', 'itemid', CAST(labevent_id AS VARCHAR), CAST(itemid AS BIGINT), strftime(charttime, '%Y-%m'), coalesce(storetime, charttime)
  FROM labevents WHERE itemid IS NOT NULL
  UNION ALL
  SELECT 'diagnoses_icd', 'hadm_id', hadm_id || ':' || seq_num, CAST(hadm_id AS BIGINT), strftime(loaded_at, '%Y-%m'), loaded_at
  FROM diagnoses_icd WHERE hadm_id IS NOT NULL
), joined AS (
  SELECT r.*, a.k AS k, a.gone AS gone, a.first_at AS first_at FROM refs r LEFT JOIN adm a ON a.k = r.ref_key WHERE ref_field = 'hadm_id'
  UNION ALL
  SELECT r.*, i.k, i.gone, i.first_at FROM refs r LEFT JOIN item i ON i.k = r.ref_key WHERE ref_field = 'itemid'
), found AS (
  SELECT DISTINCT table_name, ref_field, row_key, ref_key, period_month,
         CASE WHEN k IS NULL THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END AS reason
  FROM joined WHERE k IS NULL OR gone OR first_at > arrival
)
"""

SQL = {
    "p5_found": _ORPHANS + "SELECT * FROM found",
    "p5_report": _ORPHANS + "SELECT table_name, ref_field, period_month, reason, count(*) AS n_rows, count(DISTINCT ref_key) AS n_keys FROM found GROUP BY table_name, ref_field, period_month, reason",
}
