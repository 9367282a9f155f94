"""Document arrivals and embedding backfill as Structured Streaming jobs.

Derived rows are kept as one delta folder per micro-batch, holding only the documents of that batch, so
a batch costs what arrived and not what is stored. Replaying a batch after a lost driver rewrites the
same folder. Readers take each document's rows from its latest delta.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from casebook.operators import ingest as ig

ARRIVAL_SCHEMA = (
    "document_id BIGINT, patient_id BIGINT, content_type STRING, content BINARY, page_texts ARRAY<STRING>,"
    " parser_error STRING, extracted_at TIMESTAMP"
)
EXTRACTION_SCHEMA = (
    "document_id BIGINT, patient_id BIGINT, extraction_status STRING, extracted_text STRING,"
    " extraction_method STRING, error_message STRING, extracted_at TIMESTAMP"
)
CHUNK_SCHEMA = (
    "id STRING, document_id BIGINT, patient_id BIGINT, chunk_index INT, page_number INT, chunk_text STRING,"
    " embedding ARRAY<FLOAT>"
)


def _delta(folder: str, table: str, number: int) -> str:
    return f"{folder}/{table}/v={number}"


def _deltas(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, v BIGINT").parquet(f"{folder}/{table}")


def current_extractions(spark: SparkSession, folder: str) -> DataFrame:
    """One extraction per document, from its latest delta."""
    rows = _deltas(spark, folder, "extractions", EXTRACTION_SCHEMA)
    latest = rows.groupBy("document_id").agg(F.max_by(F.struct(*rows.columns), "v").alias("r"))
    return latest.select("r.*")


def current_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of each document's latest delta; a document that lost its text has none."""
    latest = current_extractions(spark, folder).select("document_id", "patient_id", "v")
    return _deltas(spark, folder, "chunks", CHUNK_SCHEMA).join(latest, ["document_id", "patient_id", "v"]).drop("v")


def extract_arrivals(arrivals: DataFrame) -> DataFrame:
    """Extraction rows of arrived originals, the latest arrival of each document only."""
    e = ig.extraction(F.col("content_type"), F.col("content"), F.col("page_texts"), F.col("parser_error"))
    latest = arrivals.groupBy("document_id").agg(F.max_by(F.struct(*arrivals.columns), "extracted_at").alias("a"))
    return latest.select("a.*").select(
        "document_id", "patient_id", e.alias("e"), "extracted_at"
    ).select("document_id", "patient_id", "e.*", "extracted_at")


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("id", F.concat_ws("-", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")))


def ingest_stream(
    spark: SparkSession,
    arrivals_folder: str,
    out_folder: str,
    checkpoint: str,
    embedder: Callable[[list[str]], list[list[float]]],
    dimension: int,
) -> StreamingQuery:
    """Extract, chunk and embed arriving originals; every stage replaces by document."""

    def process(batch: DataFrame, number: int) -> None:
        place = _delta(out_folder, "extractions", number)
        extract_arrivals(batch).select(*_names(EXTRACTION_SCHEMA)).write.mode("overwrite").parquet(place)
        stored = spark.read.schema(EXTRACTION_SCHEMA).parquet(place)
        cut = with_chunk_id(ig.chunk_documents(stored)).withColumn("embedding", F.lit(None).cast("array<float>"))
        vectors = ig.embed(ig.pending_chunks(cut), embedder, dimension)
        done = ig.compare_and_set(cut, vectors).select(*_names(CHUNK_SCHEMA))
        done.write.mode("overwrite").parquet(_delta(out_folder, "chunks", number))

    return (
        spark.readStream.schema(ARRIVAL_SCHEMA)
        .parquet(arrivals_folder)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def backfill_stream(
    spark: SparkSession,
    chunks_folder: str,
    out_folder: str,
    checkpoint: str,
    embedder: Callable[[list[str]], list[list[float]]],
    dimension: int,
) -> StreamingQuery:
    """Embed chunks that have no vector yet; finished micro-batches are never embedded again."""

    def process(batch: DataFrame, number: int) -> None:
        vectors = ig.embed(ig.pending_chunks(batch), embedder, dimension)
        vectors.write.mode("overwrite").parquet(_delta(out_folder, "vectors", number))

    return (
        spark.readStream.schema(CHUNK_SCHEMA)
        .option("maxFilesPerTrigger", 64)
        .parquet(chunks_folder)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.replace("\n", " ").split(", ")]
