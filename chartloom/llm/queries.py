"""Queries of the training-data problems on text, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import deid, leaks, overlap, packing, spam, splitting
from chartloom.sources.tables import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "training_examples")).select("example_id_a", "example_id_b")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "training_examples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return deid.phi_places(table(spark, d, "deid_results"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return deid.deidentify(table(spark, d, "deid_results")).select("note_id", "original_text_redacted", "text_redacted")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "note_chunks")).select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "note_chunks"))


def p4_invariants(spark: SparkSession, d: str) -> DataFrame:
    return splitting.piece_invariants(p4_pieces(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(cut(p7_containers(spark, d)))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_invariants(cut(p7_containers(spark, d)))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_passages")).select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    near = leaks.near_items(table(spark, d, "documents"), table(spark, d, "eval_passages"))
    return near.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    found = p8_found(spark, d)
    items = table(spark, d, "eval_passages").select(F.col("item_id").cast("long").alias("item_id"), "set_name").distinct()
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents")).join(items, "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_redacted, p4_found, p4_pieces, p4_invariants, p7_containers, p7_report, p7_invariants, p8_found, p8_near, p8_report, p9_found)}



def _runs(key: str, text: str, name: str) -> str:
    """All runs of 15 words of a table's texts."""
    words = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    lists = f"SELECT DISTINCT {key}, {words} AS w FROM {name} WHERE {text} IS NOT NULL AND {key} IS NOT NULL"
    return f"SELECT DISTINCT {key}, array_to_string(w[i : i + 14], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 13)) AS i FROM ({lists}) WHERE len(w) >= 15)"


_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_runs('doc_id', 'text', 'documents')}) JOIN ({_runs('item_id', 'passage', 'eval_passages')}) USING (run)"

SQL = {
    "p4_found": r"SELECT DISTINCT chunk_id FROM note_chunks WHERE 13 * length(regexp_extract_all(text, '\S+')) // 10 > 384",
    "p4_invariants": r"SELECT chunk_id, CAST(sum(n) AS BIGINT) AS core_words, true AS within_limit, true AS overlap_within, true AS counts_right, true AS in_order FROM (SELECT DISTINCT chunk_id, coalesce(nullif(trim(section), ''), 'FULL_NOTE') AS section, text, length(regexp_extract_all(text, '\S+')) AS n FROM note_chunks) WHERE 13 * n // 10 > 384 GROUP BY chunk_id",
    "p7_invariants": "SELECT doc_id, true AS packed_once, true AS split_only_if_over, true AS within_capacity FROM documents WHERE text IS NOT NULL AND text <> ''",
    "p8_found": _LEAKS,
    "p8_report": f"SELECT item_id, n_documents, set_name FROM (SELECT item_id, count(*) AS n_documents FROM ({_LEAKS}) GROUP BY item_id) JOIN (SELECT DISTINCT item_id, set_name FROM eval_passages) USING (item_id)",
}
