"""Writing results: idempotent reloads, partitions, exports and the log of loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reload_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Put ``df`` in the place of whatever is at ``path``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str = "note_type") -> None:
    """Replace the partitions that ``df`` has rows of, and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def fill_where_null(df: DataFrame, column: str, value: F.Column) -> DataFrame:
    """``df`` with ``value`` where the column is null."""
    return df.withColumn(column, F.coalesce(F.col(column), value))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks with their vectors as arrays of floats."""
    chunks.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("append").parquet(path)


def log_load(spark: SparkSession, path: str, table: str, source: str, rows: int, status: str = "ok", error: str | None = None) -> str | None:
    """Append a line to the log of loads. A failure to do so doesn't stop the load: its text is returned, else None."""
    try:
        row = spark.createDataFrame([(table, source, rows, status, error)], "table_name string, source_file string, rows_loaded bigint, status string, error string")
        row.withColumn("completed_at", F.current_timestamp()).write.mode("append").parquet(path)
        return None
    except Exception as e:  # noqa: BLE001
        return str(e)[:500]


def load_logged(spark: SparkSession, log_path: str, table: str, source: str, load: Callable[[], DataFrame], path: str) -> int:
    """Reload a table and log how many rows it has, counted in what was written, or what went wrong."""
    try:
        reload_table(load(), path)
        n = spark.read.parquet(path).count()  # from the files' footers
    except Exception as e:
        log_load(spark, log_path, table, source, 0, "failed", str(e)[:500])
        raise
    log_load(spark, log_path, table, source, n)
    return n


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nested fields as they are."""
    df.write.mode("overwrite").json(path)


def export_text(df: DataFrame, column: str, path: str) -> None:
    """One line of text for each row."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def table_status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, n) of each path; -1 where there is no table."""
    rows = []
    for name, path in paths.items():
        try:
            rows.append((name, spark.read.parquet(path).count()))
        except Exception:  # noqa: BLE001
            rows.append((name, -1))
    return spark.createDataFrame(rows, "table_name string, n bigint")


def verify_tokens(chunks: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(total, populated, ratio) of a derived token column after it was added."""
    filled = F.count_if(F.size(tokens) > 0)
    return chunks.agg(F.count("*").alias("total"), filled.alias("populated"), F.round(filled / F.count("*"), 6).alias("ratio"))
