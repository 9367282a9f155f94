"""Queries over record tables: timeline, lists, lookups, keyed writes, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions import text as tx
from casebook.functions.skew import rank_within
from casebook.operators import quality as ql
from casebook.operators import records as rc
from casebook.operators import timeline as tl
from casebook.plans.oracle_views import TENANTS, over_views
from casebook.plans.registry import query

_EVENT = "patient_id, event_date, event_type, event_state, title, description, source_type, source_id"


@query("timeline_events", over_views(f"SELECT {_EVENT} FROM timeline_events"))
def timeline_events(t):
    return tl.ordered(tl.events_of(t)).drop("created_at")


@query(
    "timeline_ordinals",
    over_views(
        "SELECT patient_id, event_type, source_type, source_id, row_number() OVER (PARTITION BY patient_id"
        " ORDER BY event_date DESC, created_at DESC NULLS LAST, source_type, CAST(source_id AS VARCHAR), event_type)"
        " AS ordinal FROM timeline_events"
    ),
)
def timeline_ordinals(t):
    return tl.ranked(tl.events_of(t)).select("patient_id", "event_type", "source_type", "source_id", "ordinal")


_UUID_SQL = """
SELECT source_type, source_id, event_type,
  concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
    substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1), substr(h, 18, 3), '-',
    substr(h, 21, 12)) AS event_id
FROM (SELECT source_type, source_id, event_type, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') ||
  encode(concat('timeline:', source_type, ':', source_id, ':', event_type))) AS h FROM timeline_events)"""


@query("timeline_event_ids", over_views(_UUID_SQL))
def timeline_event_ids(t):
    return tl.events_of(t).select(
        "source_type", "source_id", "event_type",
        tx.event_uuid(F.col("source_type"), F.col("source_id"), F.col("event_type")).alias("event_id"),
    )


_LISTED = ("conditions", "symptoms", "medications", "allergies", "patient_goals", "medical_documents")


def _when(table: str) -> str:
    return "uploaded_at" if table == "medical_documents" else "recorded_at"


@query(
    "tenant_lists",
    over_views(
        "SELECT entity, patient_id, id, row_number() OVER (PARTITION BY entity, patient_id"
        " ORDER BY recorded_at DESC, created_at DESC, id) AS position FROM ("
        + " UNION ALL ".join(
            f"SELECT '{t}' AS entity, patient_id, id, {_when(t)} AS recorded_at, created_at FROM {t}" for t in _LISTED
        )
        + ")"
    ),
)
def tenant_lists(t):
    rows = None
    for name in _LISTED:
        part = getattr(t, name).select(
            F.lit(name).alias("entity"), "patient_id", "id", F.col(_when(name)).alias("recorded_at"), "created_at"
        )
        rows = part if rows is None else rows.unionByName(part)
    order = [F.col("recorded_at").desc(), F.col("created_at").desc(), F.col("id").asc()]
    return rank_within(rows, ["entity", "patient_id"], order, "position").select("entity", "patient_id", "id", "position")


@query(
    "record_lookup",
    """SELECT conv_id * 1000 + turn AS request_id, outcome, CASE WHEN outcome = 'OK' THEN o_orderpriority END AS priority
FROM (SELECT c.*, o.o_orderpriority, CASE WHEN o.o_orderkey IS NULL THEN 'NOT_FOUND'
    WHEN o.o_custkey % 5 <> c.conv_id % 5 THEN 'FORBIDDEN' ELSE 'OK' END AS outcome
  FROM conversations c LEFT JOIN orders o ON o.o_orderkey = c.conv_id * 97 + turn)""",
)
def record_lookup(t):
    requests = t.table("conversations").selectExpr(
        "conv_id * 1000 + turn AS request_id", "conv_id * 97 + turn AS id", "conv_id % 5 AS patient_id"
    )
    owned = t.table("orders").selectExpr("o_orderkey AS id", "o_custkey % 5 AS patient_id", "o_orderpriority AS priority")
    return rc.lookup(requests, owned).select("request_id", "outcome", "priority")


@query(
    "patients_insert_if_absent",
    "SELECT c_custkey AS user_id, c_custkey AS patient_id FROM customer UNION ALL"
    " SELECT p_partkey, min(p_partkey * 2 + p_size % 2) FROM part"
    " WHERE p_partkey NOT IN (SELECT c_custkey FROM customer) GROUP BY p_partkey",
)
def patients_insert_if_absent(t):
    new = t.table("part").selectExpr("p_partkey AS user_id", "p_partkey * 2 + p_size % 2 AS patient_id")
    return rc.insert_if_absent(t.patients.select("user_id", "patient_id"), new)


@query(
    "profile_upsert",
    over_views(
        """SELECT coalesce(o.patient_id, n.patient_id) AS patient_id,
  CASE WHEN n.k IN (0, 1) THEN n.blood_group ELSE o.blood_group END AS blood_group,
  CASE WHEN n.k IN (1, 2) THEN n.notes ELSE o.notes END AS notes,
  o.biological_sex, CAST(o.date_of_birth AS VARCHAR) AS date_of_birth
FROM health_profiles o FULL JOIN (SELECT p_partkey AS patient_id, p_partkey % 3 AS k, 'AB+' AS blood_group,
  p_name AS notes FROM part) n ON o.patient_id = n.patient_id"""
    ),
)
def profile_upsert(t):
    changes = t.table("part").selectExpr(
        "p_partkey AS patient_id", "'AB+' AS blood_group", "p_name AS notes", "CAST(NULL AS DATE) AS date_of_birth",
        "CAST(NULL AS STRING) AS biological_sex", "CAST(NULL AS DECIMAL(5,2)) AS height_cm",
        "CASE p_partkey % 3 WHEN 0 THEN array('blood_group') WHEN 1 THEN array('blood_group', 'notes')"
        " ELSE array('notes') END AS supplied",
    )
    return rc.upsert_profile(t.health_profiles, changes).select(
        "patient_id", "blood_group", "notes", "biological_sex", F.col("date_of_birth").cast("string").alias("date_of_birth")
    )


@query(
    "document_patch",
    over_views(
        """SELECT d.id, CASE WHEN l.quality = 1 THEN 'renamed ' || d.id ELSE d.display_name END AS display_name,
  CASE WHEN l.toxic = 1 THEN 'other' ELSE d.document_type END AS document_type, d.file_name,
  CAST(d.document_date AS VARCHAR) AS document_date
FROM medical_documents d LEFT JOIN labels l ON l.doc_id = d.id"""
    ),
)
def document_patch(t):
    changes = t.table("labels").selectExpr(
        "doc_id AS id", f"{t.tenant('doc_id')} AS patient_id", "concat('renamed ', doc_id) AS display_name",
        "'other' AS document_type", "'hidden.pdf' AS file_name",
        "array_compact(array(CASE WHEN quality = 1 THEN 'display_name' END, CASE WHEN toxic = 1 THEN 'document_type' END,"
        " 'file_name')) AS supplied",
    )
    return rc.apply_changes(t.medical_documents, changes).select(
        "id", "display_name", "document_type", "file_name", F.col("document_date").cast("string").alias("document_date")
    )


#: Per record type: the column a toxic label changes, and to what.
_PATCHED = {
    "conditions": ("status", "resolved"),
    "medications": ("status", "stopped"),
    "allergies": ("severity", "mild"),
    "symptoms": ("severity", "mild"),
    "patient_goals": ("status", "abandoned"),
}
_PATCH_SQL = " UNION ALL ".join(
    f"""SELECT '{kind}' AS kind, CAST(x.id AS VARCHAR) AS id, CASE WHEN a.toxic = 1 THEN '{value}' ELSE x.{column} END AS state,
  CASE WHEN a.first_doc IS NOT NULL THEN concat('note ', a.first_doc) ELSE x.notes END AS notes,
  CAST(CAST(x.created_at AS DATE) AS VARCHAR) AS created_on
FROM {kind} x LEFT JOIN (SELECT 1 + doc_id % {TENANTS} AS patient_id, min(doc_id) AS first_doc, max(toxic) AS toxic
  FROM labels GROUP BY ALL) a ON a.patient_id = x.patient_id"""
    for kind, (column, value) in _PATCHED.items()
)


@query("record_patches", over_views(_PATCH_SQL))
def record_patches(t):
    """Each labelled tenant's records get a note and some a new state; the creation time can't be changed."""
    asked = (
        t.table("labels")
        .selectExpr(f"{t.tenant('doc_id')} AS patient_id", "doc_id", "toxic")
        .groupBy("patient_id")
        .agg(F.min("doc_id").alias("first_doc"), F.max("toxic").alias("toxic"))
    )
    out = None
    for kind, (column, value) in _PATCHED.items():
        table = getattr(t, kind)
        changes = table.select("id", "patient_id").join(asked, "patient_id").selectExpr(
            "id", "patient_id", "concat('note ', first_doc) AS notes", f"'{value}' AS {column}", "TIMESTAMP'1999-01-01 00:00:00' AS created_at",
            f"array_compact(array('notes', 'created_at', CASE WHEN toxic = 1 THEN '{column}' END)) AS supplied",
        )
        part = rc.patch_records(table, changes, kind).select(
            F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col(column).alias("state"), "notes",
            F.col("created_at").cast("date").cast("string").alias("created_on"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "extraction_replace",
    over_views(
        """SELECT e.document_id, CASE WHEN l.doc_id IS NULL THEN e.extraction_status WHEN l.quality = 1 THEN 'COMPLETED'
  ELSE 'FAILED' END AS extraction_status, CASE WHEN l.doc_id IS NULL THEN e.extraction_method ELSE 'rerun' END AS extraction_method
FROM document_extractions e LEFT JOIN labels l ON l.doc_id = e.document_id"""
    ),
)
def extraction_replace(t):
    arrived = t.table("labels").selectExpr(
        "doc_id AS document_id", f"{t.tenant('doc_id')} AS patient_id",
        "CASE WHEN quality = 1 THEN 'COMPLETED' ELSE 'FAILED' END AS extraction_status",
        "CASE WHEN quality = 1 THEN 'text' END AS extracted_text", "'rerun' AS extraction_method",
        "'v2' AS extraction_version", "TIMESTAMP'2030-01-01 00:00:00' AS extracted_at", "CAST(NULL AS STRING) AS error_message",
    )
    return rc.latest_per_key(t.document_extractions, arrived, "document_id", "extracted_at").select(
        "document_id", "extraction_status", "extraction_method"
    )


_GONE = "(SELECT doc_id FROM labels WHERE toxic = 1)"


@query(
    "document_delete_cascade",
    over_views(
        " UNION ALL ".join(
            [
                f"SELECT 'medical_documents' AS table_name, count(*) AS n_rows, 0 AS n_linked FROM medical_documents"
                f" WHERE id NOT IN {_GONE}",
                f"SELECT 'document_extractions', count(*), 0 FROM document_extractions WHERE document_id NOT IN {_GONE}",
                f"SELECT 'document_chunks', count(*), 0 FROM document_chunks WHERE document_id NOT IN {_GONE}",
                f"SELECT 'conditions', count(*), count(CASE WHEN source_id NOT IN {_GONE} THEN 1 END) FROM conditions",
            ]
        )
    ),
)
def document_delete_cascade(t):
    gone = t.table("labels").where("toxic = 1").selectExpr("doc_id AS document_id", f"{t.tenant('doc_id')} AS patient_id")
    names = ("medical_documents", "document_extractions", "document_chunks", "conditions")
    left = rc.delete_documents({n: getattr(t, n) for n in names}, gone)
    out = None
    for name in names:
        linked = F.count("source_id") if name == "conditions" else F.lit(0).cast("long")
        part = left[name].agg(F.count("*").alias("n_rows"), linked.alias("n_linked")).select(
            F.lit(name).alias("table_name"), "n_rows", "n_linked"
        )
        out = part if out is None else out.unionByName(part)
    return out


_LOST = "(SELECT DISTINCT user_id FROM events WHERE event_type = 'error')"


@query(
    "patient_delete_cascade",
    over_views(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n} WHERE patient_id NOT IN {_LOST}"
            for n in rc.CHILD_TABLES
        )
    ),
)
def patient_delete_cascade(t):
    gone = t.table("events").where("event_type = 'error'").selectExpr("user_id AS patient_id").distinct()
    left = rc.delete_patients({n: getattr(t, n) for n in rc.CHILD_TABLES}, gone)
    out = None
    for name, rows in left.items():
        part = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "documents_with_status",
    over_views(
        "SELECT d.id, d.patient_id, d.display_name, e.extraction_status FROM medical_documents d"
        " LEFT JOIN document_extractions e ON e.document_id = d.id AND e.patient_id = d.patient_id"
    ),
)
def documents_with_status(t):
    return rc.with_extraction_status(t.medical_documents, t.document_extractions).select(
        "id", "patient_id", "display_name", "extraction_status"
    )


_AGE = (
    "SELECT patient_id, year(r) - year(d) - CASE WHEN (month(r), day(r)) < (month(d), day(d)) THEN 1 ELSE 0 END"
    " AS age_years FROM (SELECT patient_id, date_of_birth AS d, DATE '2026-09-24' AS r FROM health_profiles)"
)


@query("profile_ages", over_views(_AGE))
def profile_ages(t):
    age = tx.age_years(F.col("date_of_birth"), F.lit("2026-09-24").cast("date"))
    return t.health_profiles.select("patient_id", age.alias("age_years"))


# --- provenance and quality --------------------------------------------------------------------


def _provenance_changes(t):
    return t.table("orders").selectExpr(
        "o_orderkey AS record_id", "o_custkey AS patient_id", "o_orderkey % 3 = 0 AS is_create",
        "o_orderkey % 5 < 3 AS has_source_type", "o_orderkey % 7 < 4 AS has_source_id",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'SOURCE_DOCUMENT' WHEN o_orderkey % 5 = 1 THEN 'PATIENT_REPORTED'"
        " WHEN o_orderkey % 35 = 2 THEN 'CLINICIAN_CONFIRMED' WHEN o_orderkey % 5 = 2 THEN 'IMPORTED' END AS source_type",
        f"CASE WHEN o_orderkey % 7 < 3 THEN o_custkey - 1 + {t.tenants} * (o_orderkey % 11) END AS source_id",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'SOURCE_DOCUMENT' ELSE 'PATIENT_REPORTED' END AS old_source_type",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey - 1 END AS old_source_id",
        "CASE WHEN o_orderkey % 41 = 0 THEN 'AI_DERIVED' END AS sent_verification_state",
    )


_PROVENANCE_SQL = f"""
SELECT record_id, CASE WHEN violation IS NULL THEN k END AS source_type, CASE WHEN violation IS NULL THEN s END AS source_id,
  CASE WHEN violation IS NULL THEN CASE k WHEN 'PATIENT_REPORTED' THEN 'PATIENT_REPORTED' ELSE 'SOURCE_RECORDED' END END
    AS verification_state, violation
FROM (SELECT *, CASE
    WHEN sent IS NOT NULL THEN 'verification_state is server-owned and must not be submitted by clients.'
    WHEN st = 'CLINICIAN_CONFIRMED' THEN 'source_type ''CLINICIAN_CONFIRMED'' is reserved and cannot be submitted by clients.'
    WHEN same THEN NULL
    WHEN k = 'PATIENT_REPORTED' AND s IS NOT NULL THEN 'source_id must be null when source_type is PATIENT_REPORTED.'
    WHEN k = 'SOURCE_DOCUMENT' AND s IS NULL THEN 'source_id is required when source_type is SOURCE_DOCUMENT.'
    WHEN k IS NULL OR k NOT IN ('PATIENT_REPORTED', 'SOURCE_DOCUMENT')
      THEN concat('Unsupported source_type value: ''', coalesce(k, 'None'), '''.')
    WHEN s IS NOT NULL AND (doc_id IS NULL OR 1 + doc_id % {TENANTS} <> patient_id)
      THEN 'source_id does not reference a valid document owned by this patient.' END AS violation
  FROM (SELECT *, CASE WHEN same THEN old_st WHEN mk THEN coalesce(st, 'PATIENT_REPORTED') WHEN hst THEN st ELSE old_st END AS k,
      CASE WHEN same THEN old_s WHEN mk OR hs THEN sid ELSE old_s END AS s
    FROM (SELECT *, NOT mk AND NOT hst AND NOT hs AS same FROM (
      SELECT o_orderkey AS record_id, o_custkey AS patient_id, o_orderkey % 3 = 0 AS mk, o_orderkey % 5 < 3 AS hst,
        o_orderkey % 7 < 4 AS hs,
        CASE WHEN o_orderkey % 5 = 0 THEN 'SOURCE_DOCUMENT' WHEN o_orderkey % 5 = 1 THEN 'PATIENT_REPORTED'
          WHEN o_orderkey % 35 = 2 THEN 'CLINICIAN_CONFIRMED' WHEN o_orderkey % 5 = 2 THEN 'IMPORTED' END AS st,
        CASE WHEN o_orderkey % 7 < 3 THEN o_custkey - 1 + {TENANTS} * (o_orderkey % 11) END AS sid,
        CASE WHEN o_orderkey % 2 = 0 THEN 'SOURCE_DOCUMENT' ELSE 'PATIENT_REPORTED' END AS old_st,
        CASE WHEN o_orderkey % 2 = 0 THEN o_custkey - 1 END AS old_s,
        CASE WHEN o_orderkey % 41 = 0 THEN 'AI_DERIVED' END AS sent FROM orders)))
  LEFT JOIN documents ON doc_id = s)"""


@query(
    "document_payloads",
    """SELECT doc_id, CASE WHEN len(locked) > 0 THEN concat('Medical document payloads must not include provenance fields: ',
    array_to_string(locked, ', '), '. These values are locked server-side.') END AS violation
FROM (SELECT doc_id, list_filter([CASE WHEN doc_id % 7 = 0 THEN 'source_id' END, CASE WHEN doc_id % 3 = 0 THEN 'source_type' END,
    CASE WHEN doc_id % 5 = 0 THEN 'verification_state' END], lambda f: f IS NOT NULL) AS locked FROM documents)""",
)
def document_payloads(t):
    sent = t.documents.selectExpr(
        "doc_id",
        "array_compact(array('display_name', CASE WHEN doc_id % 5 = 0 THEN 'verification_state' END,"
        " CASE WHEN doc_id % 3 = 0 THEN 'source_type' END, CASE WHEN doc_id % 7 = 0 THEN 'source_id' END)) AS fields",
    )
    return ql.document_payload_violation(sent).select("doc_id", "violation")


@query("provenance_resolution", _PROVENANCE_SQL)
def provenance_resolution(t):
    return ql.resolve_provenance(_provenance_changes(t), t.medical_documents).drop("patient_id")


def _in(column: str, values, required: bool = True) -> str:
    inside = f"{column} IN ({', '.join(repr(v) for v in values)})"
    return f"count(*) FILTER (WHERE NOT coalesce({inside}, {'false' if required else 'true'}))"


def _check_sql() -> str:
    parts = []
    for name in ("conditions", "symptoms", "medications", "allergies", "patient_goals"):
        rules = {"source_type": "0", "verification_state": "0"}
        if name in ql.STATUS_VALUES:
            rules["status"] = _in("status", ql.STATUS_VALUES[name])
        if name in ql.SEVERITY_VALUES:
            rules["severity"] = _in("severity", ql.SEVERITY_VALUES[name], False)
        parts += [f"SELECT '{name}' AS table_name, count(*) AS n_rows, '{r}' AS rule, {e} AS n_bad FROM {name}" for r, e in rules.items()]
    kinds = ("lab_report", "prescription", "diagnostic_report", "discharge_summary", "medical_record", "other")
    parts.append(f"SELECT 'medical_documents', count(*), 'document_type', {_in('document_type', kinds)} FROM medical_documents")
    parts.append("SELECT 'medical_documents', count(*), 'provenance_lock', 0 FROM medical_documents")
    states = ("COMPLETED", "FAILED", "UNSUPPORTED")
    parts.append(f"SELECT 'document_extractions', count(*), 'extraction_status', {_in('extraction_status', states)} FROM document_extractions")
    parts.append(
        "SELECT 'document_extractions', count(*), 'status_text', count(*) FILTER (WHERE (extraction_status = 'COMPLETED')"
        " = (length(trim(coalesce(extracted_text, ''))) = 0)) FROM document_extractions"
    )
    parts.append(
        "SELECT 'document_chunks', count(*), 'blank_chunk', count(*) FILTER (WHERE length(trim(chunk_text)) = 0) FROM document_chunks"
    )
    return " UNION ALL ".join(parts)


@query("quality_check_rules", over_views(_check_sql()))
def quality_check_rules(t):
    return ql.check_rules(t)


def _length_sql() -> str:
    parts = []
    for table, limits in ql.LENGTH_RULES.items():
        for column, low, high, required in limits:
            bad = f"length({column}) < {low}" + (f" OR length({column}) > {high}" if high else "")
            parts.append(
                f"SELECT '{table}' AS table_name, count(*) AS n_rows, '{column}_length' AS rule,"
                f" count(*) FILTER (WHERE coalesce({bad}, {str(required).lower()})) AS n_bad FROM {table}"
            )
    return " UNION ALL ".join(parts)


@query("quality_length_rules", over_views(_length_sql()))
def quality_length_rules(t):
    return ql.length_rules(t)


def _unique_sql() -> str:
    keys = {
        "patient_user": ("patients", "user_id"), "profile_per_patient": ("health_profiles", "patient_id"),
        "extraction_per_document": ("document_extractions", "document_id"),
        "chunk_index_per_document": ("document_chunks", "document_id, chunk_index"),
        "document_in_tenant": ("medical_documents", "id, patient_id"),
    }
    return " UNION ALL ".join(
        f"SELECT '{r}' AS rule, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_repeated"
        f" FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"
        for r, (t, k) in keys.items()
    )


@query("quality_uniqueness", over_views(_unique_sql()))
def quality_uniqueness(t):
    return ql.uniqueness_report(t)


_ORPHAN_SQL = """
SELECT 'document_extractions_orphan' AS rule, count(*) AS n_bad FROM document_extractions x
  WHERE NOT EXISTS (SELECT 1 FROM medical_documents d WHERE d.id = x.document_id AND d.patient_id = x.patient_id)
UNION ALL SELECT 'document_chunks_orphan', count(*) FROM document_chunks x
  WHERE NOT EXISTS (SELECT 1 FROM medical_documents d WHERE d.id = x.document_id AND d.patient_id = x.patient_id)
UNION ALL SELECT 'conditions_source_missing', count(*) FROM conditions c WHERE source_id IS NOT NULL
  AND source_id NOT IN (SELECT id FROM medical_documents)
UNION ALL SELECT 'conditions_source_foreign', count(*) FROM conditions c JOIN medical_documents d ON d.id = c.source_id
  WHERE d.patient_id <> c.patient_id"""


@query("quality_orphans", over_views(_ORPHAN_SQL))
def quality_orphans(t):
    return ql.orphan_report(t)
