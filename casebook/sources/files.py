"""File sources and sinks: stored originals by key, typed parquet scans, bucketed parquet output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

KEY_PATTERN = r"documents/([^/]+)/([^/]+)$"

_AUDIT = "recorded_at TIMESTAMP, created_at TIMESTAMP, notes STRING, source_type STRING, source_id BIGINT, verification_state STRING"
SCHEMAS = {
    "patients": "patient_id BIGINT, user_id BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "health_profiles": "id BIGINT, patient_id BIGINT, date_of_birth DATE, biological_sex STRING,"
    " height_cm DECIMAL(5,2), blood_group STRING, notes STRING, created_at TIMESTAMP",
    "conditions": "id BIGINT, patient_id BIGINT, name STRING, status STRING, is_chronic BOOLEAN, started_at DATE,"
    f" ended_at DATE, {_AUDIT}",
    "symptoms": f"id BIGINT, patient_id BIGINT, name STRING, severity STRING, started_at DATE, ended_at DATE, {_AUDIT}",
    "medications": "id BIGINT, patient_id BIGINT, name STRING, dosage STRING, frequency STRING, status STRING,"
    f" as_needed BOOLEAN, started_at DATE, ended_at DATE, {_AUDIT}",
    "allergies": f"id BIGINT, patient_id BIGINT, allergen STRING, reaction STRING, severity STRING, {_AUDIT}",
    "patient_goals": f"id BIGINT, patient_id BIGINT, description STRING, status STRING, target_date DATE, {_AUDIT}",
    "medical_documents": "id BIGINT, patient_id BIGINT, file_name STRING, display_name STRING, document_type STRING,"
    " content_type STRING, file_size_bytes BIGINT, storage_key STRING, document_date DATE, uploaded_at TIMESTAMP,"
    " created_at TIMESTAMP, notes STRING, source_type STRING, verification_state STRING",
    "document_extractions": "document_id BIGINT, patient_id BIGINT, extraction_status STRING, extracted_text STRING,"
    " extraction_method STRING, extraction_version STRING, extracted_at TIMESTAMP, error_message STRING",
    "document_chunks": "id BIGINT, document_id BIGINT, patient_id BIGINT, chunk_index INT, page_number INT,"
    " chunk_text STRING, embedding ARRAY<FLOAT>",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


class StoredTables:
    """The record tables under one folder, each read with its declared schema."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(schema_of(name)).parquet(f"{self.folder}/{name}")


def read_originals(spark: SparkSession, folder: str) -> DataFrame:
    """Stored originals with the tenant and document parts of their key."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.regexp_extract("path", KEY_PATTERN, 1).alias("patient_id"),
        F.regexp_extract("path", KEY_PATTERN, 2).alias("document_id"),
        "path", "length", "content",
    )


def write_table(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace a derived table, split by tenant bucket so tenant filters prune folders.

    A rebalance spreads a bucket over as many files as its size needs, so a hot tenant does not end
    up in one task.
    """
    bucketed = rows.withColumn("patient_bucket", F.pmod(F.xxhash64("patient_id"), F.lit(buckets)))
    bucketed.hint("rebalance", "patient_bucket").write.partitionBy("patient_bucket").mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("patient_bucket")
