"""Queries of profiling, cohort choice and loading, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import coerce as C
from chartloom.functions import text as T
from chartloom.operators import cohort, profile
from chartloom.sources.tables import table

COUNTED = ("patients", "admissions", "diagnoses_icd", "labevents", "d_labitems", "deid_results", "note_chunks", "training_examples", "documents", "eval_passages")
SHARED = ("admission_type", "admission_location", "discharge_location", "insurance", "language", "race")


def profile_counts(s: SparkSession, d: str) -> DataFrame:
    return profile.table_counts({n: table(s, d, n) for n in COUNTED})


def profile_shares(s: SparkSession, d: str) -> DataFrame:
    return profile.group_shares(table(s, d, "admissions"), list(SHARED))


def profile_note_types(s: SparkSession, d: str) -> DataFrame:
    return profile.group_shares(table(s, d, "note_chunks"), ["note_type"])


def profile_ages(s: SparkSession, d: str) -> DataFrame:
    return profile.band_counts(table(s, d, "patients"), C.age_band(F.col("anchor_age")))


def profile_chunk_sizes(s: SparkSession, d: str) -> DataFrame:
    return profile.band_counts(table(s, d, "note_chunks"), C.size_band(F.col("token_count")))


def profile_conditions(s: SparkSession, d: str) -> DataFrame:
    p = profile.conditional_counts(table(s, d, "patients"), {"met": F.col("dod").isNotNull()}).withColumn("what", F.lit("deaths"))
    a = profile.conditional_counts(table(s, d, "admissions"), {"met": F.col("hospital_expire_flag") == 1}).withColumn("what", F.lit("expired"))
    labs = table(s, d, "labevents")
    wide = profile.conditional_counts(labs, {"abnormal": C.abnormal_exact(F.col("flag")), "numeric": F.col("valuenum").isNotNull(), "abnormal_trimmed": C.abnormal_trimmed(F.col("flag")), "flagged": C.abnormal_any(F.col("flag"))})
    long = wide.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("met")) for c in wide.columns[1:]])).alias("x")).select("n", "x.met", "x.what")
    return p.unionByName(a).unionByName(long)


def profile_top_codes(s: SparkSession, d: str) -> DataFrame:
    return profile.top_groups(table(s, d, "diagnoses_icd"), ["icd_code", "icd_version"], 15)


def profile_top_principal(s: SparkSession, d: str) -> DataFrame:
    return profile.top_groups(table(s, d, "diagnoses_icd").where("seq_num = 1"), ["icd_code", "icd_version"], 10)


def profile_heavy_admitters(s: SparkSession, d: str) -> DataFrame:
    return profile.top_groups(table(s, d, "admissions"), ["subject_id"], 5)


def profile_lab_means(s: SparkSession, d: str) -> DataFrame:
    return profile.rounded_means(table(s, d, "labevents"), ["itemid", "valueuom"], "valuenum", 10)


def profile_lengths(s: SparkSession, d: str) -> DataFrame:
    return profile.text_lengths(table(s, d, "deid_results"), "note_type", "original_text")


def profile_ratios(s: SparkSession, d: str) -> DataFrame:
    adm = table(s, d, "admissions").agg((F.count("*") / F.count_distinct("subject_id")).alias("ratio")).withColumn("what", F.lit("admissions per patient"))
    dx = table(s, d, "diagnoses_icd").agg((F.count("*") / F.count_distinct("hadm_id")).alias("ratio")).withColumn("what", F.lit("diagnoses per admission"))
    ch = table(s, d, "note_chunks").agg((F.count("*") / F.count_distinct("note_id")).alias("ratio")).withColumn("what", F.lit("chunks per note"))
    return adm.unionByName(dx).unionByName(ch).select("what", F.round("ratio", 6).alias("ratio"))


def profile_coverage(s: SparkSession, d: str) -> DataFrame:
    notes = table(s, d, "deid_results").where("note_id IS NOT NULL")
    return profile.coverage(notes, "note_id", {"redacted": F.col("text").isNotNull(), "original": F.col("original_text").isNotNull(), "admitted": F.col("hadm_id").isNotNull()})


def profile_most_negatives(s: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size("negatives"), F.lit(0)).cast("long").alias("n_negatives")
    rows = table(s, d, "training_examples").select("example_id", n).distinct()
    return rows.orderBy(F.desc("n_negatives"), "example_id").limit(5)


def patients_with_timelines(s: SparkSession, d: str) -> DataFrame:
    return profile.frequent_groups(table(s, d, "deid_results").where("subject_id IS NOT NULL"), "subject_id", "charttime", 4, 3)


def notes_with_many_chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "note_chunks").groupBy("note_id").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "note_id").limit(1)


def chunks_per_section(s: SparkSession, d: str) -> DataFrame:
    section = F.upper(F.regexp_replace(F.trim("section"), ":$", ""))
    return table(s, d, "note_chunks").groupBy(section.alias("section")).agg(F.count("*").alias("n"), F.count_distinct("note_id").alias("n_notes"))


def index_coverage(s: SparkSession, d: str) -> DataFrame:
    filled = F.count_if(F.size(T.tokens(F.col("text"))) > 0)
    return table(s, d, "note_chunks").agg(F.count("*").alias("total"), filled.alias("populated"), F.round(filled / F.count("*"), 6).alias("ratio"))


def repeat_admissions(s: SparkSession, d: str) -> DataFrame:
    return cohort.repeat_patients(table(s, d, "admissions"), 3)


def cohort_select(s: SparkSession, d: str) -> DataFrame:
    return cohort.select_cohort(table(s, d, "patients"), table(s, d, "admissions"), table(s, d, "deid_results"), table(s, d, "diagnoses_icd"), min_admissions=2)


def guideline_diagnoses(s: SparkSession, d: str) -> DataFrame:
    hit = C.guideline_diagnosis(F.col("icd_code"), F.col("icd_version"))
    return table(s, d, "diagnoses_icd").where(hit).groupBy("icd_code", "icd_version").agg(F.count("*").alias("n"), F.count_distinct("hadm_id").alias("n_admissions"))


def cohort_labs(s: SparkSession, d: str) -> DataFrame:
    labs = cohort.members_of(table(s, d, "labevents"), cohort_select(s, d))
    return labs.groupBy("subject_id").agg(F.count("*").alias("n"), F.count_distinct("itemid").alias("n_items"))


def exclude_cohort(s: SparkSession, d: str) -> DataFrame:
    rest = cohort.outside_of(table(s, d, "diagnoses_icd"), cohort_select(s, d))
    return rest.groupBy("subject_id").agg(F.count("*").alias("n"))


def first_labs_per_patient(s: SparkSession, d: str) -> DataFrame:
    first = cohort.first_rows(table(s, d, "labevents"), ["subject_id"], [F.col("charttime"), F.col("labevent_id"), F.col("storetime")], 200)
    return first.groupBy("subject_id").agg(F.max("place").alias("kept"), F.min("charttime").alias("first_time"), F.max("charttime").alias("last_time"))


def upsert_first_wins(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "admissions").where("hadm_id IS NOT NULL").select("hadm_id", "subject_id", "admission_type", "loaded_at", "deleted_at")
    have = rows.where("loaded_at < TIMESTAMP_NTZ'2101-01-01'")
    order = [F.asc_nulls_first(c) for c in ("loaded_at", "deleted_at", "subject_id", "admission_type")]
    start = cohort.first_rows(have, ["hadm_id"], order, 1).drop("place")
    return cohort.upsert_first(start, rows, "hadm_id", order)


def cascade_chunks(s: SparkSession, d: str) -> DataFrame:
    left = cohort.cascade_delete(table(s, d, "note_chunks"), table(s, d, "deid_results").where("text IS NOT NULL"), "note_id")
    return left.select("chunk_id", "note_id").distinct()


def index_incremental(s: SparkSession, d: str) -> DataFrame:
    return cohort.incremental_index(table(s, d, "deid_results"), table(s, d, "note_chunks")).select("note_id", "note_type").distinct()


def coalesced_texts(s: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", "original_text")
    return table(s, d, "deid_results").where(t.isNotNull() & (t != "")).select("note_id", F.length(t).cast("long").alias("length"), F.col("text").isNull().alias("raw")).distinct()


def coerced_results(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(s, d, "labevents").select("labevent_id", C.safe_float(v).alias("as_float"), C.safe_int(v).alias("as_int"), C.strict_int(v).alias("as_strict_int")).distinct()


def parsed_times(s: SparkSession, d: str) -> DataFrame:
    """The results' times as the files that they come in have them, in four ways, one of them not a time, read back."""
    form = F.col("labevent_id") % 4
    written = F.when(form == 0, F.date_format("charttime", "yyyy-MM-dd HH:mm:ss")).when(form == 1, F.concat(F.date_format("charttime", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(form == 2, F.date_format("charttime", "MM/dd/yyyy HH:mm")).otherwise("NaT")
    return table(s, d, "labevents").select("labevent_id", C.lenient_timestamp(written).alias("t")).distinct()


def first_preview(s: SparkSession, d: str) -> DataFrame:
    """The first note's first 500 characters."""
    return table(s, d, "deid_results").where("note_id IS NOT NULL AND original_text IS NOT NULL").orderBy("note_id", "original_text").limit(1).select("note_id", F.substring("original_text", 1, 500).alias("preview"))


def sample_cohort(s: SparkSession, d: str) -> DataFrame:
    return cohort.sample_patients(table(s, d, "patients"), "subject_id", 10_000)


def split_examples(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "training_examples").select("example_id", F.element_at(F.split("positive_chunk_id", "_"), 2).alias("note")).distinct()
    return cohort.split_by_hash(cohort.split_by_hash(rows, "example_id").withColumnRenamed("part", "by_example"), "note").withColumnRenamed("part", "by_note")


def split_sizes(s: SparkSession, d: str) -> DataFrame:
    return split_examples(s, d).groupBy("by_example", "by_note").agg(F.count("*").alias("n"))


def union_notes(s: SparkSession, d: str) -> DataFrame:
    notes = table(s, d, "deid_results").select("note_id", "note_type", "charttime").distinct()
    return notes.where("note_type = 'discharge'").unionByName(notes.where("note_type = 'radiology'"))


QUERIES = {f.__name__: f for f in (
    profile_counts, profile_shares, profile_note_types, profile_ages, profile_chunk_sizes, profile_conditions, profile_top_codes, profile_top_principal,
    profile_heavy_admitters, profile_lab_means, profile_lengths, profile_ratios, profile_coverage, profile_most_negatives, patients_with_timelines,
    notes_with_many_chunks, chunks_per_section, index_coverage, repeat_admissions, cohort_select, guideline_diagnoses, cohort_labs, exclude_cohort,
    first_labs_per_patient, upsert_first_wins, cascade_chunks, index_incremental, coalesced_texts, coerced_results, parsed_times, first_preview, sample_cohort,
    split_examples, split_sizes, union_notes,
)}


def _shares(name: str, columns: tuple[str, ...]) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM {name}" for c in columns)
    return f"SELECT field, value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY field), 4) AS pct FROM ({long}) GROUP BY field, value"


def _starts(prefixes: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with(upper(trim(icd_code)), '{p}')" for p in prefixes) + ")"


_DX = f"CASE WHEN icd_version = 10 THEN {_starts(C.ICD10_PREFIXES)} ELSE {_starts(C.ICD9_PREFIXES)} END"
_COHORT = f"""(SELECT DISTINCT subject_id FROM patients WHERE anchor_age >= 18
 AND subject_id IN (SELECT subject_id FROM admissions GROUP BY subject_id HAVING count(DISTINCT hadm_id) >= 2)
 AND subject_id IN (SELECT subject_id FROM deid_results WHERE note_type = 'discharge')
 AND subject_id IN (SELECT subject_id FROM diagnoses_icd WHERE {_DX}) ORDER BY subject_id LIMIT 5000)"""
_BAND = "CASE " + " ".join(f"WHEN anchor_age <= {b} THEN '{a}-{b}'" for a, b in ((18, 29), (30, 39), (40, 49), (50, 59), (60, 69), (70, 79), (80, 89)))
_TOP = "SELECT icd_code, icd_version, count(*) AS n FROM diagnoses_icd {} GROUP BY icd_code, icd_version ORDER BY n DESC, icd_code NULLS FIRST, icd_version NULLS FIRST LIMIT {}"
_HASH = "CASE WHEN CAST(('0x' || substr(md5(concat_ws(':', CAST({} AS VARCHAR), '42')), 1, 8)) AS BIGINT) % 100 < 90 THEN 'train' ELSE 'val' END"
_SPLIT = f"SELECT example_id, note, {_HASH.format('example_id')} AS by_example, {_HASH.format('note')} AS by_note FROM (SELECT DISTINCT example_id, split_part(positive_chunk_id, '_', 2) AS note FROM training_examples)"
_VERSION_ORDER = "loaded_at NULLS FIRST, deleted_at NULLS FIRST, subject_id NULLS FIRST, admission_type NULLS FIRST"

SQL = {
    "profile_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in COUNTED),
    "profile_shares": _shares("admissions", SHARED),
    "profile_note_types": _shares("note_chunks", ("note_type",)),
    "profile_ages": f"SELECT CASE WHEN anchor_age < 18 THEN '<18' ELSE {_BAND} WHEN anchor_age >= 90 THEN '90+' END END AS band, count(*) AS n FROM patients GROUP BY 1",
    "profile_chunk_sizes": "SELECT CASE WHEN token_count < 50 THEN '<50' WHEN token_count < 100 THEN '50-99' WHEN token_count < 200 THEN '100-199' WHEN token_count < 300 THEN '200-299' WHEN token_count < 400 THEN '300-399' WHEN token_count >= 400 THEN '400+' END AS band, count(*) AS n FROM note_chunks GROUP BY 1",
    "profile_conditions": """SELECT count(*) AS n, count(dod) AS met, 'deaths' AS what FROM patients
 UNION ALL SELECT count(*), count(*) FILTER (hospital_expire_flag = 1), 'expired' FROM admissions
 UNION ALL SELECT count(*), count(*) FILTER (flag = 'abnormal'), 'abnormal' FROM labevents
 UNION ALL SELECT count(*), count(valuenum), 'numeric' FROM labevents
 UNION ALL SELECT count(*), count(*) FILTER (lower(trim(flag)) = 'abnormal'), 'abnormal_trimmed' FROM labevents
 UNION ALL SELECT count(*), count(*) FILTER (trim(flag) <> ''), 'flagged' FROM labevents""",
    "profile_top_codes": _TOP.format("", 15),
    "profile_top_principal": _TOP.format("WHERE seq_num = 1", 10),
    "profile_heavy_admitters": "SELECT subject_id, count(*) AS n FROM admissions GROUP BY subject_id ORDER BY n DESC, subject_id NULLS FIRST LIMIT 5",
    "profile_lab_means": "SELECT itemid, valueuom, count(*) AS n, round(avg(valuenum), 2) AS mean FROM labevents WHERE valuenum IS NOT NULL GROUP BY itemid, valueuom ORDER BY n DESC, itemid NULLS FIRST, valueuom NULLS FIRST LIMIT 10",
    "profile_lengths": "SELECT note_type, count(*) AS n, round(avg(length(original_text))) AS mean_length, min(length(original_text)) AS min_length, max(length(original_text)) AS max_length FROM deid_results GROUP BY note_type",
    "profile_ratios": """SELECT 'admissions per patient' AS what, round(count(*) / count(DISTINCT subject_id), 6) AS ratio FROM admissions
 UNION ALL SELECT 'diagnoses per admission', round(count(*) / count(DISTINCT hadm_id), 6) FROM diagnoses_icd
 UNION ALL SELECT 'chunks per note', round(count(*) / count(DISTINCT note_id), 6) FROM note_chunks""",
    "profile_coverage": """WITH k AS (SELECT note_id, max(CAST(text IS NOT NULL AS INT)) AS redacted, max(CAST(original_text IS NOT NULL AS INT)) AS original, max(CAST(hadm_id IS NOT NULL AS INT)) AS admitted
 FROM deid_results WHERE note_id IS NOT NULL GROUP BY note_id)
 SELECT part, n_keys, n_covered, round(n_covered / n_keys, 6) AS ratio FROM (
 SELECT 'redacted' AS part, count(*) AS n_keys, CAST(sum(redacted) AS BIGINT) AS n_covered FROM k
 UNION ALL SELECT 'original', count(*), CAST(sum(original) AS BIGINT) FROM k UNION ALL SELECT 'admitted', count(*), CAST(sum(admitted) AS BIGINT) FROM k)""",
    "profile_most_negatives": "SELECT DISTINCT example_id, coalesce(len(negatives), 0) AS n_negatives FROM training_examples ORDER BY n_negatives DESC, example_id LIMIT 5",
    "patients_with_timelines": "SELECT subject_id, count(*) AS n_rows, count(DISTINCT charttime) AS n_times FROM deid_results WHERE subject_id IS NOT NULL GROUP BY subject_id HAVING count(*) >= 4 AND count(DISTINCT charttime) >= 3",
    "notes_with_many_chunks": "SELECT note_id, count(*) AS n FROM note_chunks GROUP BY note_id HAVING count(*) > 2 ORDER BY n DESC, note_id LIMIT 1",
    "chunks_per_section": "SELECT upper(regexp_replace(trim(section), ':$', '')) AS section, count(*) AS n, count(DISTINCT note_id) AS n_notes FROM note_chunks GROUP BY 1",
    "index_coverage": r"SELECT count(*) AS total, count(*) FILTER (regexp_matches(text, '[\p{L}\p{N}]')) AS populated, round(count(*) FILTER (regexp_matches(text, '[\p{L}\p{N}]')) / count(*), 6) AS ratio FROM note_chunks",
    "repeat_admissions": "SELECT subject_id, count(DISTINCT hadm_id) AS n FROM admissions GROUP BY subject_id HAVING count(DISTINCT hadm_id) >= 3",
    "cohort_select": f"SELECT subject_id FROM {_COHORT}",
    "guideline_diagnoses": f"SELECT icd_code, icd_version, count(*) AS n, count(DISTINCT hadm_id) AS n_admissions FROM diagnoses_icd WHERE {_DX} GROUP BY icd_code, icd_version",
    "cohort_labs": f"SELECT subject_id, count(*) AS n, count(DISTINCT itemid) AS n_items FROM labevents WHERE subject_id IN (SELECT subject_id FROM {_COHORT}) GROUP BY subject_id",
    "exclude_cohort": f"SELECT subject_id, count(*) AS n FROM diagnoses_icd WHERE subject_id IS NULL OR subject_id NOT IN (SELECT subject_id FROM {_COHORT}) GROUP BY subject_id",
    "first_labs_per_patient": """SELECT subject_id, count(*) AS kept, min(charttime) AS first_time, max(charttime) AS last_time FROM (
 SELECT subject_id, charttime, row_number() OVER (PARTITION BY subject_id ORDER BY charttime NULLS FIRST, labevent_id NULLS FIRST, storetime NULLS FIRST) AS place FROM labevents) WHERE place <= 200 GROUP BY subject_id""",
    "upsert_first_wins": f"""WITH r AS (SELECT hadm_id, subject_id, admission_type, loaded_at, deleted_at FROM admissions WHERE hadm_id IS NOT NULL),
 old AS (SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY {_VERSION_ORDER}) AS place FROM r WHERE loaded_at < TIMESTAMP '2101-01-01') WHERE place = 1),
 new AS (SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY {_VERSION_ORDER}) AS place FROM r WHERE hadm_id NOT IN (SELECT hadm_id FROM old)) WHERE place = 1)
 SELECT * FROM old UNION ALL SELECT * FROM new""",
    "cascade_chunks": "SELECT DISTINCT chunk_id, note_id FROM note_chunks WHERE note_id IN (SELECT note_id FROM deid_results WHERE text IS NOT NULL)",
    "index_incremental": "SELECT DISTINCT note_id, note_type FROM deid_results r WHERE NOT EXISTS (SELECT 1 FROM note_chunks c WHERE c.note_id = r.note_id)",
    "coalesced_texts": "SELECT DISTINCT note_id, length(coalesce(text, original_text)) AS length, text IS NULL AS raw FROM deid_results WHERE coalesce(text, original_text) <> ''",
    "coerced_results": r"SELECT DISTINCT labevent_id, try_cast(trim(value) AS DOUBLE) AS as_float, CAST(trunc(try_cast(trim(value) AS DOUBLE)) AS INTEGER) AS as_int, CASE WHEN regexp_matches(trim(value), '^[-+]?[0-9]+$') THEN try_cast(trim(value) AS INTEGER) END AS as_strict_int FROM labevents",
    "parsed_times": "SELECT DISTINCT labevent_id, CASE labevent_id % 4 WHEN 2 THEN date_trunc('minute', charttime) WHEN 3 THEN NULL ELSE date_trunc('second', charttime) END AS t FROM labevents",
    "first_preview": "SELECT note_id, left(original_text, 500) AS preview FROM deid_results WHERE note_id IS NOT NULL AND original_text IS NOT NULL ORDER BY note_id, original_text LIMIT 1",
    "sample_cohort": "SELECT subject_id FROM (SELECT DISTINCT subject_id FROM patients WHERE subject_id IS NOT NULL) ORDER BY md5(concat_ws(':', CAST(subject_id AS VARCHAR), '42')), subject_id LIMIT 10000",
    "split_examples": _SPLIT,
    "split_sizes": f"SELECT by_example, by_note, count(*) AS n FROM ({_SPLIT}) GROUP BY by_example, by_note",
    "union_notes": "SELECT DISTINCT note_id, note_type, charttime FROM deid_results WHERE note_type IN ('discharge', 'radiology')",
}
