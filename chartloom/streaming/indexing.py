"""Notes indexed as they arrive: each micro-batch's new notes are chunked and appended."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartloom.operators.chunking import chunk_notes
from chartloom.operators.models import embedder


def index_batch(notes: DataFrame, index_path: str) -> None:
    """Chunk, embed and append the notes whose note_id the index doesn't have; a repeated batch adds nothing."""
    spark = notes.sparkSession
    fresh = notes.select("note_id", "text").dropDuplicates(["note_id"])
    try:
        fresh = fresh.join(spark.read.parquet(index_path).select("note_id"), "note_id", "left_anti")
    except AnalysisException:
        pass  # no index yet
    chunks = chunk_notes(fresh)
    chunks.withColumn("embedding", embedder()(F.col("text"))).write.mode("append").parquet(index_path)


def stream_index(notes: DataFrame, index_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start indexing a stream of notes (note_id, text); with ``once`` it ends when all that is there is done."""
    writer = notes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: index_batch(batch, index_path))
    return (writer.trigger(availableNow=True) if once else writer).start()
