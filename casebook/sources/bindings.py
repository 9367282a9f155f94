"""Record tables derived from the supplied star schema.

Every view is a narrow projection (or one equi-join) of a supplied table, so its size follows
the data. ``Bindings`` builds each view on first use.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from casebook.plans.templates import TEMPLATES
from casebook.session import configure, spread

#: Characters per stored chunk in the derived chunk table; every character of the text is kept.
CHUNK_WIDTH = 900

#: Clinical wording appended to stored chunks, by (document ordinal + chunk index) % 5.
SUFFIXES = (
    " Lisinopril. Dosage: 10 mg daily. Prescribed by: Dr. Jordan Casey",
    " Total cholesterol 180 mg/dL. LDL 100. HDL 50.",
    " BP 120/80, pulse 70. Blood pressure noted. Hypertension follow-up.",
    " RBP normal. S/P cholecystectomy. Phone: 555-123-4567",
    "",
)

#: Tenants who hold documents: one customer in so many, but never fewer than the least.
CUSTOMERS_PER_TENANT, LEAST_TENANTS = 30, 50

_DOC_TYPES = (
    "lab_report", "prescription", "diagnostic_report", "discharge_summary", "medical_record", "other",
)


class Bindings:
    """Lazily derived record tables over one folder of supplied parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def tenants(self) -> int:
        """How many customers hold documents; it grows with the customers."""
        return max(LEAST_TENANTS, self.table("customer").count() // CUSTOMERS_PER_TENANT)

    def tenant(self, number: str) -> str:
        """The customer whom a numbered thing belongs to."""
        return f"1 + {number} % {self.tenants}"

    @cached_property
    def patients(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey AS patient_id", "c_custkey AS user_id")

    @cached_property
    def health_profiles(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS id",
            "c_custkey AS patient_id",
            "date_add(DATE'1950-01-01', CAST(c_custkey * 17 % 18000 AS INT)) AS date_of_birth",
            "CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS biological_sex",
            "CAST(150 + c_custkey % 50 AS DECIMAL(5,2)) AS height_cm",
            "CASE c_custkey % 4 WHEN 0 THEN 'A+' WHEN 1 THEN 'O-' WHEN 2 THEN 'B+' END AS blood_group",
            "CAST(NULL AS STRING) AS notes",
            "TIMESTAMP'2020-01-01 00:00:00' AS created_at",
        )

    @cached_property
    def conditions(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS patient_id",
            "CASE o_orderkey % 8 WHEN 0 THEN 'Hypertension' WHEN 1 THEN 'Asthma'"
            " WHEN 2 THEN 'Type 2 Diabetes' WHEN 3 THEN 'GERD' WHEN 4 THEN 'Anxiety disorder'"
            " ELSE o_orderpriority END AS name",
            "CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'active' END AS status",
            "o_totalprice > 200000 AS is_chronic",
            "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS started_at",
            "CASE WHEN o_orderkey % 11 <> 0 AND o_orderstatus = 'F'"
            " THEN date_add(CAST(o_orderdate AS DATE), 90) END AS ended_at",
            "CAST(o_orderdate AS TIMESTAMP) AS recorded_at",
            "CAST(o_orderdate AS TIMESTAMP) AS created_at",
            "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS notes",
            "CASE WHEN o_orderkey % 4 = 0 THEN 'SOURCE_DOCUMENT' ELSE 'PATIENT_REPORTED' END AS source_type",
            f"CASE WHEN o_orderkey % 4 = 0 THEN o_custkey - 1 + {self.tenants} * (o_orderkey % 20) END AS source_id",
            "CASE WHEN o_orderkey % 4 = 0 THEN 'SOURCE_RECORDED' ELSE 'PATIENT_REPORTED' END"
            " AS verification_state",
        )

    @cached_property
    def medications(self) -> DataFrame:
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus",
        )
        orders = self.table("orders").selectExpr("o_orderkey", "o_custkey AS patient_id")
        parts = self.table("part").select("p_partkey", "p_name")
        # (order, line) repeats a handful of times: this window never holds more than those repeats. It and the join with
        # orders use one shuffle by order.
        numbered = lines.repartition("l_orderkey").selectExpr(
            "*",
            "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey,"
            " l_shipdate, l_extendedprice, l_quantity) AS rn",
        )
        return (
            numbered.join(orders, numbered.l_orderkey == orders.o_orderkey)
            .join(parts, numbered.l_partkey == parts.p_partkey)
            .selectExpr(
                "(l_orderkey * 8 + l_linenumber) * 100 + rn AS id",
                "patient_id",
                "CASE l_partkey % 9 WHEN 0 THEN 'Lisinopril' WHEN 1 THEN 'Metformin'"
                " WHEN 2 THEN 'Atorvastatin' WHEN 3 THEN 'Albuterol inhaler' ELSE p_name END AS name",
                "CASE WHEN l_partkey % 5 <> 0 THEN concat(CAST(l_quantity AS INT), ' mg') END AS dosage",
                "CASE l_returnflag WHEN 'A' THEN 'daily' WHEN 'R' THEN 'bid' END AS frequency",
                "CASE WHEN l_linestatus = 'F' THEN 'stopped' ELSE 'active' END AS status",
                "l_linenumber % 2 = 0 AS as_needed",
                "CAST(l_shipdate AS DATE) AS started_at",
                "CASE WHEN l_linestatus = 'F' THEN date_add(CAST(l_shipdate AS DATE), 30) END AS ended_at",
                "CAST(l_shipdate AS TIMESTAMP) AS recorded_at",
                "CAST(l_shipdate AS TIMESTAMP) AS created_at",
                "CAST(NULL AS STRING) AS notes",
                "'PATIENT_REPORTED' AS source_type",
                "CAST(NULL AS BIGINT) AS source_id",
                "'PATIENT_REPORTED' AS verification_state",
            )
        )

    @cached_property
    def symptoms(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS id",
            "user_id AS patient_id",
            "event_type AS name",
            "CASE event_id % 4 WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' WHEN 3 THEN 'severe' END AS severity",
            "CAST(ts AS DATE) AS started_at",
            "CASE WHEN event_id % 2 = 0 THEN date_add(CAST(ts AS DATE), 3) END AS ended_at",
            "CAST(ts AS TIMESTAMP) AS recorded_at",
            "CAST(ts AS TIMESTAMP) AS created_at",
            "CASE WHEN event_id % 6 = 0 THEN concat('seen ', event_type) END AS notes",
            "'PATIENT_REPORTED' AS source_type",
            "CAST(NULL AS BIGINT) AS source_id",
            "'PATIENT_REPORTED' AS verification_state",
        )

    @cached_property
    def allergies(self) -> DataFrame:
        recorded = "CAST(date_add(DATE'2020-01-01', CAST(p_partkey % 1500 AS INT)) AS TIMESTAMP)"
        return self.table("part").selectExpr(
            "p_partkey AS id",
            f"{self.tenant('p_partkey')} AS patient_id",
            "CASE p_partkey % 7 WHEN 0 THEN 'Peanut' WHEN 1 THEN 'Penicillin' WHEN 2 THEN 'Latex'"
            " ELSE p_type END AS allergen",
            "CASE WHEN p_size % 3 = 0 THEN 'hives' END AS reaction",
            "CASE p_size % 5 WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' WHEN 3 THEN 'severe'"
            " WHEN 4 THEN 'life_threatening' END AS severity",
            f"{recorded} AS recorded_at",
            f"{recorded} AS created_at",
            "CAST(NULL AS STRING) AS notes",
            "'PATIENT_REPORTED' AS source_type",
            "CAST(NULL AS BIGINT) AS source_id",
            "'PATIENT_REPORTED' AS verification_state",
        )

    @cached_property
    def patient_goals(self) -> DataFrame:
        return self.table("orders").where("o_orderstatus = 'P'").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS patient_id",
            "concat('Goal ', o_orderpriority) AS description",
            "CASE o_orderkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'achieved' ELSE 'abandoned' END AS status",
            "date_add(CAST(o_orderdate AS DATE), 180) AS target_date",
            "CAST(o_orderdate AS TIMESTAMP) AS recorded_at",
            "CAST(o_orderdate AS TIMESTAMP) AS created_at",
            "CAST(NULL AS STRING) AS notes",
            "'PATIENT_REPORTED' AS source_type",
            "CAST(NULL AS BIGINT) AS source_id",
            "'PATIENT_REPORTED' AS verification_state",
        )

    @cached_property
    def medical_documents(self) -> DataFrame:
        kinds = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_DOC_TYPES))
        uploaded = "CAST(date_add(DATE'2020-01-01', CAST(doc_id % 2000 AS INT)) AS TIMESTAMP)"
        return self.documents.selectExpr(
            "doc_id AS id",
            f"{self.tenant('doc_id')} AS patient_id",
            "concat('doc-', doc_id, '.pdf') AS file_name",
            "concat('doc-', doc_id) AS display_name",
            f"CASE (doc_id div {self.tenants}) % 6 {kinds} END AS document_type",
            "'application/pdf' AS content_type",
            "CAST(n_chars AS BIGINT) AS file_size_bytes",
            f"concat('documents/', {self.tenant('doc_id')}, '/', doc_id) AS storage_key",
            "CASE WHEN doc_id % 7 <> 0 THEN date_add(DATE'2020-01-01', CAST(doc_id * 37 % 2000 AS INT)) END"
            " AS document_date",
            f"{uploaded} AS uploaded_at",
            f"{uploaded} AS created_at",
            "CASE WHEN doc_id % 9 = 0 THEN concat('from ', source) END AS notes",
            "'PATIENT_REPORTED' AS source_type",
            "'PATIENT_REPORTED' AS verification_state",
        )

    @cached_property
    def document_extractions(self) -> DataFrame:
        status = (
            "CASE WHEN doc_id % 13 = 0 THEN 'FAILED' WHEN doc_id % 17 = 0 THEN 'UNSUPPORTED'"
            " ELSE 'COMPLETED' END"
        )
        return self.documents.selectExpr(
            "doc_id AS document_id",
            f"{self.tenant('doc_id')} AS patient_id",
            f"{status} AS extraction_status",
            f"CASE WHEN {status} = 'COMPLETED' THEN text END AS extracted_text",
            "CASE WHEN doc_id % 2 = 0 THEN 'pypdf' ELSE 'text/plain' END AS extraction_method",
            "'v1' AS extraction_version",
            "CAST(date_add(DATE'2020-01-01', CAST(doc_id % 2000 AS INT)) AS TIMESTAMP) AS extracted_at",
            f"CASE WHEN {status} <> 'COMPLETED' THEN 'no text' END AS error_message",
        )

    @cached_property
    def document_chunks(self) -> DataFrame:
        """The whole text of every document in stored chunks, with vectors where they exist."""
        pieces = self.documents.selectExpr(
            "doc_id",
            "text",
            f"explode(sequence(0, CAST(greatest(ceil(length(text) / {CHUNK_WIDTH}.0), 1) AS INT) - 1))"
            " AS chunk_index",
        )
        which = f"((doc_id div {self.tenants}) + chunk_index) % 5"
        suffix = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES))
        chunks = pieces.selectExpr(
            "doc_id * 100000 + chunk_index AS id",
            "doc_id AS document_id",
            f"{self.tenant('doc_id')} AS patient_id",
            "chunk_index",
            "CASE WHEN doc_id % 2 = 0 THEN 1 + chunk_index div 2 END AS page_number",
            f"concat(substr(text, chunk_index * {CHUNK_WIDTH} + 1, {CHUNK_WIDTH}), CASE {which} {suffix} END)"
            " AS chunk_text",
            "doc_id + chunk_index AS vec_id",
        )
        return chunks.join(self.vectors, "vec_id", "left").drop("vec_id")

    @cached_property
    def vectors(self) -> DataFrame:
        """Stored vectors by ``vec_id``."""
        vectors = self.table("embeddings").select("vec_id", "embedding")
        if vectors.groupBy("vec_id").count().where("count > 1").isEmpty():
            # a key known to be unique lets Spark leave the join out wherever no vector is read
            vectors = vectors.groupBy("vec_id").agg(F.first("embedding").alias("embedding"))
        return vectors

    @cached_property
    def inquiries(self) -> DataFrame:
        """Every customer asks every question template; question vectors are dealt over all stored ones."""
        questions = F.array(
            *[
                F.struct(F.lit(number).alias("template_no"), F.lit(t.text).alias("query_text"))
                for number, t in enumerate(TEMPLATES)
            ]
        )
        # Customers are few bytes, their questions are not: the file's few splits would make them all.
        asked = (
            spread(self.table("customer").select(F.col("c_custkey").alias("patient_id")), "patient_id")
            .select("patient_id", F.explode(questions).alias("q"))
            .selectExpr(
                "patient_id * 1000 + q.template_no AS query_id",
                "patient_id",
                "q.template_no AS template_no",
                "q.query_text AS query_text",
                "DATE'2026-09-24' AS ref_date",
                f"(q.template_no * 7 + patient_id) % {self.table('embeddings').count()} AS vec_id",
            )
        )
        vectors = self.vectors.withColumnRenamed("embedding", "query_vec")
        return asked.join(vectors, "vec_id", "left").drop("vec_id")

    @cached_property
    def turns(self) -> DataFrame:
        """Every conversation turn as an inquiry, whole text, any role."""
        return self.table("conversations").selectExpr(
            "conv_id * 1000 + turn AS query_id",
            f"{self.tenant('conv_id')} AS patient_id",
            "text AS query_text",
            "DATE'2026-09-24' AS ref_date",
        )
