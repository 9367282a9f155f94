"""The derived record tables restated in the oracle's SQL dialect, as one list of named subqueries."""

from __future__ import annotations

from casebook.plans.templates import TEMPLATES


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def _value(v: str | None, kind: str = "VARCHAR") -> str:
    return f"NULL::{kind}" if v is None else "'" + v.replace("'", "''") + f"'::{kind}"


def _template_rows() -> str:
    rows = []
    for number, t in enumerate(TEMPLATES):
        anchor = t.start[:4] if t.start and t.raw and not t.raw.startswith("between") else None
        rows.append(
            f"({number}, {_value(t.text)}, {text_list(t.structured)}, {text_list(t.document)}, {_value(t.entity)}, "
            f"{text_list(t.attributes)}, '{t.scope}', {_value(t.start, 'DATE')}, {_value(t.end, 'DATE')}, "
            f"{_value(anchor, 'INTEGER')}, {_value(t.raw)}, {_value(t.superlative)}, '{t.intent}', '{t.mode}')"
        )
    return ",\n".join(rows)


#: The oracle's own statement of how many customers hold documents.
TENANTS = "(SELECT greatest(50, count(*) // 30) FROM customer)"

VIEWS = f"""
patients AS (SELECT c_custkey AS patient_id, c_custkey AS user_id FROM customer),
health_profiles AS (
  SELECT c_custkey AS id, c_custkey AS patient_id,
    DATE '1950-01-01' + CAST(c_custkey * 17 % 18000 AS INTEGER) AS date_of_birth,
    CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS biological_sex,
    CAST(150 + c_custkey % 50 AS DECIMAL(5,2)) AS height_cm,
    CASE c_custkey % 4 WHEN 0 THEN 'A+' WHEN 1 THEN 'O-' WHEN 2 THEN 'B+' END AS blood_group,
    NULL::VARCHAR AS notes FROM customer),
conditions AS (
  SELECT o_orderkey AS id, o_custkey AS patient_id,
    CASE o_orderkey % 8 WHEN 0 THEN 'Hypertension' WHEN 1 THEN 'Asthma' WHEN 2 THEN 'Type 2 Diabetes'
      WHEN 3 THEN 'GERD' WHEN 4 THEN 'Anxiety disorder' ELSE o_orderpriority END AS name,
    CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'active' END AS status,
    o_totalprice > 200000 AS is_chronic,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS started_at,
    CASE WHEN o_orderkey % 11 <> 0 AND o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 90 END AS ended_at,
    o_orderdate AS recorded_at, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS notes,
    CASE WHEN o_orderkey % 4 = 0 THEN 'SOURCE_DOCUMENT' ELSE 'PATIENT_REPORTED' END AS source_type,
    CASE WHEN o_orderkey % 4 = 0 THEN o_custkey - 1 + {TENANTS} * (o_orderkey % 20) END AS source_id,
    CASE WHEN o_orderkey % 4 = 0 THEN 'SOURCE_RECORDED' ELSE 'PATIENT_REPORTED' END AS verification_state
  FROM orders),
numbered_lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS rn FROM lineitem),
medications AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 100 + rn AS id, o_custkey AS patient_id,
    CASE l_partkey % 9 WHEN 0 THEN 'Lisinopril' WHEN 1 THEN 'Metformin' WHEN 2 THEN 'Atorvastatin'
      WHEN 3 THEN 'Albuterol inhaler' ELSE p_name END AS name,
    CASE WHEN l_partkey % 5 <> 0 THEN concat(CAST(l_quantity AS INTEGER), ' mg') END AS dosage,
    CASE l_returnflag WHEN 'A' THEN 'daily' WHEN 'R' THEN 'bid' END AS frequency,
    CASE WHEN l_linestatus = 'F' THEN 'stopped' ELSE 'active' END AS status,
    l_linenumber % 2 = 0 AS as_needed,
    CAST(l_shipdate AS DATE) AS started_at,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 30 END AS ended_at,
    l_shipdate AS recorded_at, l_shipdate AS created_at, NULL::VARCHAR AS notes
  FROM numbered_lines JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
symptoms AS (
  SELECT event_id AS id, user_id AS patient_id, event_type AS name,
    CASE event_id % 4 WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' WHEN 3 THEN 'severe' END AS severity,
    CAST(ts AS DATE) AS started_at,
    CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) + 3 END AS ended_at,
    ts AS recorded_at, ts AS created_at,
    CASE WHEN event_id % 6 = 0 THEN concat('seen ', event_type) END AS notes FROM events),
allergies AS (
  SELECT p_partkey AS id, 1 + p_partkey % {TENANTS} AS patient_id,
    CASE p_partkey % 7 WHEN 0 THEN 'Peanut' WHEN 1 THEN 'Penicillin' WHEN 2 THEN 'Latex' ELSE p_type END AS allergen,
    CASE WHEN p_size % 3 = 0 THEN 'hives' END AS reaction,
    CASE p_size % 5 WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' WHEN 3 THEN 'severe'
      WHEN 4 THEN 'life_threatening' END AS severity,
    CAST(DATE '2020-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS TIMESTAMP) AS recorded_at,
    CAST(DATE '2020-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS TIMESTAMP) AS created_at,
    NULL::VARCHAR AS notes FROM part),
patient_goals AS (
  SELECT o_orderkey AS id, o_custkey AS patient_id, concat('Goal ', o_orderpriority) AS description,
    CASE o_orderkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'achieved' ELSE 'abandoned' END AS status,
    CAST(o_orderdate AS DATE) + 180 AS target_date, o_orderdate AS recorded_at, o_orderdate AS created_at,
    NULL::VARCHAR AS notes FROM orders WHERE o_orderstatus = 'P'),
medical_documents AS (
  SELECT doc_id AS id, 1 + doc_id % {TENANTS} AS patient_id, concat('doc-', doc_id, '.pdf') AS file_name,
    concat('doc-', doc_id) AS display_name,
    CASE (doc_id // {TENANTS}) % 6 WHEN 0 THEN 'lab_report' WHEN 1 THEN 'prescription' WHEN 2 THEN 'diagnostic_report'
      WHEN 3 THEN 'discharge_summary' WHEN 4 THEN 'medical_record' WHEN 5 THEN 'other' END AS document_type,
    CASE WHEN doc_id % 7 <> 0 THEN DATE '2020-01-01' + CAST(doc_id * 37 % 2000 AS INTEGER) END AS document_date,
    CAST(DATE '2020-01-01' + CAST(doc_id % 2000 AS INTEGER) AS TIMESTAMP) AS uploaded_at,
    CAST(DATE '2020-01-01' + CAST(doc_id % 2000 AS INTEGER) AS TIMESTAMP) AS created_at,
    CASE WHEN doc_id % 9 = 0 THEN concat('from ', source) END AS notes FROM documents),
document_extractions AS (
  SELECT doc_id AS document_id, 1 + doc_id % {TENANTS} AS patient_id,
    CASE WHEN doc_id % 13 = 0 THEN 'FAILED' WHEN doc_id % 17 = 0 THEN 'UNSUPPORTED' ELSE 'COMPLETED' END
      AS extraction_status,
    CASE WHEN doc_id % 13 <> 0 AND doc_id % 17 <> 0 THEN text END AS extracted_text,
    CASE WHEN doc_id % 2 = 0 THEN 'pypdf' ELSE 'text/plain' END AS extraction_method FROM documents),
chunk_pieces AS (
  SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil(length(text) / 900.0), 1) AS BIGINT))) AS chunk_index
  FROM documents),
document_chunks AS (
  SELECT doc_id * 100000 + chunk_index AS id, doc_id AS document_id, 1 + doc_id % {TENANTS} AS patient_id, chunk_index,
    CASE WHEN doc_id % 2 = 0 THEN 1 + chunk_index // 2 END AS page_number,
    concat(substr(text, chunk_index * 900 + 1, 900), CASE ((doc_id // {TENANTS}) + chunk_index) % 5
      WHEN 0 THEN ' Lisinopril. Dosage: 10 mg daily. Prescribed by: Dr. Jordan Casey'
      WHEN 1 THEN ' Total cholesterol 180 mg/dL. LDL 100. HDL 50.'
      WHEN 2 THEN ' BP 120/80, pulse 70. Blood pressure noted. Hypertension follow-up.'
      WHEN 3 THEN ' RBP normal. S/P cholecystectomy. Phone: 555-123-4567' ELSE '' END) AS chunk_text,
    embedding
  FROM chunk_pieces LEFT JOIN embeddings ON vec_id = doc_id + chunk_index),
templates(template_no, query_text, structured_domains, document_domains, target_entity, requested_attributes,
  temporal_scope, start_date, end_date, anchor_year, raw_expression, superlative, question_intent, routing_mode) AS (
VALUES {_template_rows()}),
targets AS (
  SELECT c_custkey * 1000 + template_no AS query_id, c_custkey AS patient_id, t.*, e.embedding AS query_vec
  FROM customer CROSS JOIN templates t
  LEFT JOIN embeddings e ON vec_id = (template_no * 7 + c_custkey) % (SELECT count(*) FROM embeddings)),
timeline_events AS (
  SELECT patient_id, strftime(started_at, '%Y-%m-%d') AS event_date, 'CONDITION_STARTED' AS event_type,
    CASE WHEN status = 'active' THEN 'current' ELSE 'historical' END AS event_state, name AS title,
    notes AS description, 'CONDITION' AS source_type, id AS source_id, created_at
  FROM conditions WHERE started_at IS NOT NULL
  UNION ALL
  SELECT patient_id, strftime(ended_at, '%Y-%m-%d'), 'CONDITION_RESOLVED', 'historical', name || ' (Resolved)', notes,
    'CONDITION', id, created_at FROM conditions WHERE ended_at IS NOT NULL
  UNION ALL
  SELECT patient_id, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ'), 'SYMPTOM_RECORDED', 'neutral', name,
    nullif(concat_ws(' | ', 'Severity: ' || severity, notes), ''), 'SYMPTOM', id, created_at FROM symptoms
  UNION ALL
  SELECT patient_id, strftime(started_at, '%Y-%m-%d'), 'MEDICATION_STARTED',
    CASE WHEN status = 'active' THEN 'current' ELSE 'historical' END, name,
    nullif(concat_ws(' | ', 'Dosage: ' || dosage, 'Frequency: ' || frequency, notes), ''), 'MEDICATION', id, created_at
  FROM medications WHERE started_at IS NOT NULL
  UNION ALL
  SELECT patient_id, strftime(ended_at, '%Y-%m-%d'), 'MEDICATION_STOPPED', 'historical', name || ' (Stopped)', notes,
    'MEDICATION', id, created_at FROM medications WHERE ended_at IS NOT NULL
  UNION ALL
  SELECT patient_id, strftime(document_date, '%Y-%m-%d'), 'DOCUMENT_DATED', 'neutral', display_name,
    coalesce(notes, 'Type: ' || document_type), 'DOCUMENT', id, created_at
  FROM medical_documents WHERE document_date IS NOT NULL
  UNION ALL
  SELECT patient_id, strftime(uploaded_at, '%Y-%m-%dT%H:%M:%SZ'), 'DOCUMENT_UPLOADED', 'neutral', display_name,
    coalesce(notes, 'Type: ' || document_type), 'DOCUMENT', id, created_at
  FROM medical_documents WHERE document_date IS NULL
  UNION ALL
  SELECT patient_id, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ'), 'GOAL_RECORDED',
    CASE WHEN status = 'active' THEN 'current' ELSE 'historical' END, description, notes, 'GOAL', id, created_at
  FROM patient_goals)
"""


def over_views(body: str, *extra: str) -> str:
    """A query over the derived tables, with further named subqueries in between."""
    return "WITH RECURSIVE " + ",\n".join([VIEWS.strip(), *extra]) + "\n" + body
