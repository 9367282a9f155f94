"""Queries over retrieval, evidence verdicts, context and answers."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from casebook.functions import lexicons as lx
from casebook.functions import text as tx
from casebook.functions.skew import key_counts
from casebook.operators import answer as an
from casebook.operators import context as cx
from casebook.operators import retrieve as rt
from casebook.operators import verdicts as vd
from casebook.operators.records import health_records
from casebook.plans.oracle_views import over_views
from casebook.plans.question_queries import attribute_sql
from casebook.plans.registry import query
from casebook.session import materialise

_ROUTED = ("STRUCTURED_ONLY", "DOCUMENT_ONLY", "CROSS_DOMAIN")


def _targets(t, *modes: str):
    """Understood inquiries of the given routes, safety cases left out."""
    # Not written: each reader joins the few columns it needs to the questions' targets.
    return an.gate(t.inquiries).where(~F.col("safety_triggered") & F.col("routing_mode").isin(*(modes or _ROUTED)))


def _retrieved(t, targets):
    return rt.retrieve(targets, t.document_chunks, t.medical_documents, t.document_extractions)


# --- retrieval ---------------------------------------------------------------------------------

_TYPES = (
    "flatten([" + ", ".join(
        f"CASE WHEN list_contains(document_domains, '{d}') THEN [{', '.join(repr(k) for k in kinds)}] ELSE [] END"
        for d, kinds in lx.DOMAIN_DOCUMENT_TYPES.items()
    ) + "])"
)
ROUTED_SQL = f"""routed AS (
  SELECT *, {_TYPES} AS types FROM targets
  WHERE routing_mode IN ('STRUCTURED_ONLY', 'DOCUMENT_ONLY', 'CROSS_DOMAIN') AND NOT contains(query_text, 'passed out'))"""


def word_sql(term: str, text: str) -> str:
    """Whole-word test for a term column or literal, substring test for phrases."""
    return (
        rf"(CASE WHEN contains({term}, ' ') THEN contains({text}, {term})"
        rf" ELSE regexp_matches({text}, concat('(^|[^\p{{L}}\p{{N}}_])', {term}, '($|[^\p{{L}}\p{{N}}_])')) END)"
    )


_VARIANTS = (
    "CASE lower(target_entity) " + " ".join(
        f"WHEN '{k}' THEN [{', '.join(repr(v) for v in words)}]" for k, words in lx.LEXICAL_VARIANTS.items()
    ) + " ELSE [lower(target_entity)] END"
)
RETRIEVAL_SQL = f"""scoped AS (
  SELECT c.id AS chunk_id, c.document_id, c.patient_id, c.chunk_index, c.page_number, c.chunk_text, c.embedding,
    d.display_name, d.document_type, d.document_date,
    coalesce(e.extraction_status = 'COMPLETED' AND length(trim(e.extracted_text)) > 0, false)
      AND c.embedding IS NOT NULL AND length(trim(c.chunk_text)) > 0 AS ready
  FROM document_chunks c JOIN medical_documents d ON d.id = c.document_id AND d.patient_id = c.patient_id
  LEFT JOIN document_extractions e ON e.document_id = d.id AND e.patient_id = d.patient_id),
asked AS (
  SELECT query_id, patient_id, types, target_entity, superlative, query_vec,
    CASE WHEN temporal_scope = 'interval' THEN start_date END AS lo, CASE WHEN temporal_scope = 'interval' THEN end_date END AS hi
  FROM routed WHERE len(types) > 0),
extremes AS (
  SELECT query_id, CASE WHEN any_value(superlative) = 'latest' THEN max(document_date) ELSE min(document_date) END AS day
  FROM asked a JOIN medical_documents d USING (patient_id)
  WHERE superlative IS NOT NULL AND target_entity IS NULL AND list_contains(types, document_type) AND document_date IS NOT NULL
    AND (lo IS NULL OR document_date >= lo) AND (hi IS NULL OR document_date <= hi) GROUP BY query_id),
dense AS (
  SELECT * FROM (SELECT query_id, chunk_id, document_id, chunk_index, document_date, target_entity, dist,
      row_number() OVER (PARTITION BY query_id ORDER BY dist, document_id, chunk_index) AS rank
    FROM (SELECT a.query_id, a.target_entity, s.*,
        1 - list_dot_product(s.embedding::DOUBLE[], a.query_vec::DOUBLE[])
          / (sqrt(list_dot_product(s.embedding::DOUBLE[], s.embedding::DOUBLE[]))
             * sqrt(list_dot_product(a.query_vec::DOUBLE[], a.query_vec::DOUBLE[]))) AS dist
      FROM asked a JOIN scoped s USING (patient_id) LEFT JOIN extremes x ON x.query_id = a.query_id
      WHERE s.ready AND list_contains(a.types, s.document_type) AND CASE
        WHEN superlative IS NULL THEN lo IS NULL OR hi IS NULL OR coalesce(document_date BETWEEN lo AND hi, false)
        WHEN target_entity IS NOT NULL THEN document_date IS NOT NULL AND (lo IS NULL OR document_date >= lo)
          AND (hi IS NULL OR document_date <= hi)
        ELSE coalesce(document_date = x.day, false) END))
  WHERE rank <= CASE WHEN target_entity IS NULL THEN 3 ELSE 10 END),
lexical AS (
  SELECT * FROM (SELECT query_id, chunk_id, document_id, chunk_index, document_date,
      row_number() OVER (PARTITION BY query_id ORDER BY
        CASE WHEN superlative = 'first' THEN document_date - DATE '1970-01-01' ELSE DATE '1970-01-01' - document_date END NULLS LAST,
        document_id, chunk_index) AS rank
    FROM asked JOIN scoped USING (patient_id)
    WHERE target_entity IS NOT NULL AND list_contains(types, document_type)
      AND len(list_filter({_VARIANTS}, lambda v: {word_sql('v', 'lower(chunk_text)')})) > 0
      AND CASE WHEN superlative IS NULL
        THEN ready AND (lo IS NULL OR hi IS NULL OR coalesce(document_date BETWEEN lo AND hi, false))
        ELSE document_date IS NOT NULL AND (lo IS NULL OR document_date >= lo) AND (hi IS NULL OR document_date <= hi) END)
  WHERE rank <= 10),
found AS (
  SELECT query_id, chunk_id, any_value(document_id) AS document_id, any_value(chunk_index) AS chunk_index,
    any_value(document_date) AS document_date, min(dr) AS dr, min(lr) AS lr, coalesce(min(dist), 0.0) AS dist
  FROM (SELECT query_id, chunk_id, document_id, chunk_index, document_date, rank AS dr, NULL AS lr, dist FROM dense
    UNION ALL SELECT query_id, chunk_id, document_id, chunk_index, document_date, NULL, rank, NULL FROM lexical)
  GROUP BY query_id, chunk_id),
passages AS (
  SELECT f.query_id, a.patient_id, row_number() OVER (PARTITION BY f.query_id ORDER BY
      CASE WHEN superlative IS NOT NULL AND target_entity IS NOT NULL
        THEN CASE WHEN superlative = 'latest' THEN DATE '1970-01-01' - f.document_date ELSE f.document_date - DATE '1970-01-01' END
        WHEN lr IS NOT NULL THEN lr ELSE 10 + dr END, f.document_id, f.chunk_index) AS ord,
    f.chunk_id, f.document_id, f.chunk_index, f.document_date, s.page_number, s.chunk_text, s.display_name, s.document_type,
    f.dist AS cosine_distance, CASE WHEN dr IS NULL THEN 1.0 ELSE greatest(0.0, 1 - f.dist) END AS similarity
  FROM found f JOIN asked a USING (query_id) JOIN scoped s USING (chunk_id))"""


@query(
    "retrieved_passages",
    over_views(
        "SELECT query_id, ord, chunk_id, document_id, chunk_index, page_number, CAST(document_date AS VARCHAR) AS document_date,"
        " document_type, display_name, round(cosine_distance, 6) + 0.0 AS cosine_distance, round(similarity, 6) AS similarity FROM passages",
        ROUTED_SQL, RETRIEVAL_SQL,
    ),
)
def retrieved_passages(t):
    return _retrieved(t, _targets(t)).select(
        "query_id", "ord", "chunk_id", "document_id", "chunk_index", "page_number",
        F.col("document_date").cast("string").alias("document_date"), "document_type", "display_name",
        (F.round("cosine_distance", 6) + 0.0).alias("cosine_distance"), F.round("similarity", 6).alias("similarity"),
    )


@query(
    "dense_neighbours",
    over_views("SELECT query_id, chunk_id, rank, round(dist, 6) + 0.0 AS cosine_distance FROM dense", ROUTED_SQL, RETRIEVAL_SQL),
)
def dense_neighbours(t):
    counts = key_counts(t.document_chunks, ["patient_id"])
    asked = materialise(rt.of_tenants(rt.document_questions(_targets(t)), counts))
    searchable = rt.searchable_chunks(t.document_chunks, t.medical_documents, t.document_extractions)
    extrema = rt.extremum_dates(asked, t.medical_documents)
    return rt.dense_candidates(asked, searchable, extrema, counts, lx.DEFAULT_TOP_K).select(
        "query_id", "chunk_id", "rank", (F.round("cosine_distance", 6) + 0.0).alias("cosine_distance")
    )


@query(
    "lexical_neighbours",
    over_views("SELECT query_id, chunk_id, rank FROM lexical", ROUTED_SQL, RETRIEVAL_SQL),
)
def lexical_neighbours(t):
    searchable = rt.searchable_chunks(t.document_chunks, t.medical_documents, t.document_extractions)
    counts = key_counts(t.document_chunks, ["patient_id"])
    asked = materialise(rt.of_tenants(rt.document_questions(_targets(t)), counts))
    return rt.lexical_candidates(asked, searchable, counts).select("query_id", "chunk_id", "rank")


def digest_embedder(texts: list[str]) -> list[list[float]]:
    """Vectors SQL can state too: the sixteen bytes of the text's digest."""
    return [[b / 255 for b in hashlib.md5(text.encode("utf-8")).digest()] for text in texts]


@query(
    "question_embeddings",
    over_views(
        r"SELECT query_id, md5(trim(regexp_replace(query_text, '\s+', ' ', 'g'))) AS vector_hex, CAST(NULL AS VARCHAR) AS embedding_error"
        " FROM routed WHERE len(types) > 0",
        ROUTED_SQL,
    ),
)
def question_embeddings(t):
    asked = rt.embed_questions(_targets(t), digest_embedder, 16).where("query_vec IS NOT NULL OR embedding_error IS NOT NULL")
    digits = F.transform("query_vec", lambda v: F.lpad(F.lower(F.hex(F.round(v * 255).cast("long"))), 2, "0"))
    return asked.select("query_id", F.array_join(digits, "").alias("vector_hex"), "embedding_error")


@query(
    "extremum_dates",
    over_views("SELECT query_id, CAST(day AS VARCHAR) AS target_date FROM extremes", ROUTED_SQL, RETRIEVAL_SQL),
)
def extremum_dates(t):
    return rt.extremum_dates(rt.document_questions(_targets(t)), t.medical_documents).select(
        "query_id", F.col("target_date").cast("string").alias("target_date")
    )


WHOLE_SQL = """whole_documents AS (
  SELECT * FROM (SELECT r.query_id, r.patient_id, d.id AS document_id, d.display_name, d.document_type, d.document_date,
      e.extracted_text, r.target_entity, r.requested_attributes, r.temporal_scope,
      row_number() OVER (PARTITION BY r.query_id ORDER BY d.document_date DESC NULLS LAST, d.uploaded_at DESC, d.id) AS ord
    FROM (SELECT *, CASE WHEN len(structured_domains) > 0 OR len(document_domains) = 0 THEN '' ELSE document_domains[1] END AS dom
      FROM routed) r
    JOIN medical_documents d ON d.patient_id = r.patient_id AND CASE r.dom WHEN 'labs' THEN d.document_type = 'lab_report'
      WHEN 'reports' THEN d.document_type = 'diagnostic_report' WHEN 'prescriptions' THEN d.document_type = 'prescription'
      WHEN 'clinical_documents' THEN d.document_type IN ('discharge_summary', 'medical_record', 'other') ELSE false END
    JOIN document_extractions e ON e.document_id = d.id AND e.extraction_status = 'COMPLETED' AND e.extracted_text <> '')
  WHERE ord <= 2)"""


@query(
    "whole_documents",
    over_views(
        "SELECT query_id, concat('[DOC-', ord, ']') AS token, document_id, display_name, CAST(document_date AS VARCHAR)"
        " AS document_date, md5(substr(extracted_text, 1, 6000)) AS digest FROM whole_documents",
        ROUTED_SQL, WHOLE_SQL,
    ),
)
def whole_documents(t):
    chosen = rt.select_whole_documents(_targets(t), t.medical_documents, t.document_extractions)
    return cx.document_tokens(chosen).select(
        "query_id", "token", "document_id", "display_name", "document_date", F.md5("extracted_excerpt").alias("digest")
    )


_MASK_WHOLE = f"list_filter(requested_attributes, lambda a: {word_sql('lower(a)', 'lower(extracted_text)')})"
_IN_DOC = (
    "concat('The uploaded document', CASE WHEN document_date IS NULL THEN '' ELSE concat(' (dated ', CAST(document_date AS VARCHAR),"
    " ')') END, ' does not contain a record of: ', {0}, '.')"
)


@query(
    "document_verdicts",
    over_views(
        f"""SELECT query_id, document_id, CASE WHEN n = 0 THEN CASE WHEN target_entity IS NOT NULL AND NOT hit THEN 'INSUFFICIENT'
      ELSE 'SUFFICIENT' END WHEN len(m) = n THEN 'SUFFICIENT' WHEN len(m) = 0 THEN 'INSUFFICIENT' ELSE 'PARTIALLY_SUFFICIENT' END AS status,
  CASE WHEN n = 0 THEN CASE WHEN target_entity IS NULL THEN 'Document content is available.'
      WHEN hit THEN 'Relevant content was found in the uploaded document.' ELSE {_IN_DOC.format('lower(target_entity)')} END
    WHEN len(m) = n THEN 'All requested information was found in the uploaded document.'
    WHEN len(m) = 0 THEN {_IN_DOC.format("array_to_string(requested_attributes, ', ')")}
    ELSE concat('Information partially found in the uploaded document. Not found in document: ',
      array_to_string(list_filter(requested_attributes, lambda a: NOT list_contains(m, a)), ', '), '.') END AS evidence_directive
FROM (SELECT *, len(requested_attributes) AS n, {_MASK_WHOLE} AS m,
    {word_sql("lower(target_entity)", "lower(extracted_text)")} AS hit FROM whole_documents)""",
        ROUTED_SQL, WHOLE_SQL,
    ),
)
def document_verdicts(t):
    targets = _targets(t)
    chosen = rt.select_whole_documents(targets, t.medical_documents, t.document_extractions)
    evidence = chosen.select(
        "query_id", F.col("patient_id").alias("owner_id"), "document_id", "extraction_status", "extracted_text", "document_date"
    )
    return vd.document_verdicts(targets, evidence).select("query_id", "document_id", "status", "evidence_directive")


# --- evidence ----------------------------------------------------------------------------------

_LISTED_ATTRIBUTES = ("dosage", "clinic", "blood_group", "status", "frequency", "consultation_notes", "contact_number", "physician_name")


def _held(text: str) -> str:
    """Requested attributes evidenced in a lower-cased text."""
    tests = " ".join(f"WHEN '{n}' THEN {attribute_sql(n, text)}" for n in _LISTED_ATTRIBUTES)
    return f"list_filter(requested_attributes, lambda a: CASE a {tests} ELSE false END)"


def _held_or_named(text: str) -> str:
    tests = " ".join(f"WHEN '{n}' THEN {attribute_sql(n, text)} OR {word_sql(repr(n), text)}" for n in _LISTED_ATTRIBUTES)
    return f"list_filter(requested_attributes, lambda a: CASE a {tests} ELSE false END)"


_LABEL = (
    "array_to_string(list_transform({0}, lambda a: CASE a " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in lx.ATTRIBUTE_LABELS.items() if k in _LISTED_ATTRIBUTES
    ) + " ELSE a END), ', ')"
)


def _label(expr: str) -> str:
    return _LABEL.format(expr)


def _less(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


RECORD_SQL = f"""facts AS (
  SELECT patient_id, 'conditions' AS domain, id, name, name AS match_text, status, started_at, ended_at, started_at AS day,
    NULL::VARCHAR AS dosage, NULL::VARCHAR AS frequency, NULL::VARCHAR AS blood_group,
    NULL::VARCHAR AS event_type, NULL::VARCHAR AS event_state, NULL::VARCHAR AS title, NULL::VARCHAR AS description,
    NULL::DATE AS event_day, recorded_at AS rec, created_at AS cre FROM conditions
  UNION ALL SELECT patient_id, 'medications', id, name, name, status, started_at, ended_at, started_at, dosage, frequency, NULL,
    NULL, NULL, NULL, NULL, NULL, recorded_at, created_at FROM medications
  UNION ALL SELECT patient_id, 'symptoms', id, name, name, NULL, started_at, ended_at, started_at, NULL, NULL, NULL,
    NULL, NULL, NULL, NULL, NULL, recorded_at, created_at FROM symptoms
  UNION ALL SELECT patient_id, 'allergies', id, allergen, allergen, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    NULL, NULL, NULL, NULL, NULL, recorded_at, created_at FROM allergies
  UNION ALL SELECT patient_id, 'goals', id, NULL, description, status, NULL, NULL, NULL, NULL, NULL, NULL,
    NULL, NULL, NULL, NULL, NULL, recorded_at, created_at FROM patient_goals
  UNION ALL SELECT patient_id, 'profile', id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, blood_group,
    NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM health_profiles
  UNION ALL SELECT patient_id, 'timeline', source_id, NULL, NULL, NULL, NULL, NULL,
    CASE WHEN event_type <> 'DOCUMENT_UPLOADED' THEN CAST(substr(event_date, 1, 10) AS DATE) END, NULL, NULL, NULL,
    event_type, event_state, title, description, CAST(substr(event_date, 1, 10) AS DATE), NULL, created_at FROM timeline_events),
asked_domains AS (
  SELECT query_id, patient_id, target_entity, requested_attributes, temporal_scope, start_date, end_date, raw_expression,
    superlative, question_intent, routing_mode, unnest(list_zip(structured_domains, range(len(structured_domains)))) AS z
  FROM routed WHERE routing_mode <> 'DOCUMENT_ONLY'),
pairs AS (
  SELECT q.*, q.z[1] AS domain, q.z[2] AS domain_ord, f.* EXCLUDE (patient_id, domain)
  FROM asked_domains q JOIN facts f ON f.patient_id = q.patient_id AND f.domain = q.z[1])"""

_SCOPE = """CASE
  WHEN domain = 'timeline' THEN CASE temporal_scope WHEN 'interval' THEN event_day BETWEEN start_date AND end_date
    WHEN 'all' THEN true ELSE event_state = temporal_scope END
  WHEN domain IN ('profile', 'allergies') THEN true
  WHEN temporal_scope = 'current' THEN (domain IN ('conditions', 'medications', 'goals') AND status = 'active')
    OR (domain IN ('conditions', 'medications', 'symptoms') AND ended_at IS NULL)
  WHEN temporal_scope = 'historical' THEN (domain IN ('conditions', 'medications', 'goals') AND status <> 'active')
    OR (domain IN ('conditions', 'medications', 'symptoms') AND ended_at IS NOT NULL)
  WHEN temporal_scope = 'interval' THEN coalesce(started_at <= end_date AND CASE WHEN ended_at IS NOT NULL THEN ended_at >= start_date
    ELSE domain = 'symptoms' OR status = 'active' END, false)
  ELSE true END"""
_CONTAINS = """CASE WHEN target_entity IS NULL OR domain = 'profile' THEN true
  WHEN domain = 'timeline' THEN contains(lower(title), lower(target_entity)) OR coalesce(contains(lower(description), lower(target_entity)), false)
  ELSE contains(lower(match_text), lower(target_entity)) END"""
_FIELDS = """list_filter(requested_attributes, lambda a: CASE a WHEN 'dosage' THEN dosage IS NOT NULL WHEN 'frequency' THEN frequency IS NOT NULL
  WHEN 'status' THEN status IS NOT NULL WHEN 'blood_group' THEN blood_group IS NOT NULL ELSE false END)"""
_EVENT_HELD = f"list_distinct(list_concat({_held_or_named('lower(title)')}, {_held_or_named(chr(10).join(['coalesce(lower(description), chr(0))']))}))"

STRUCTURED_SQL = f"""kept AS (
  SELECT *, entity_ok AND {_SCOPE} AS survives FROM (SELECT *, {_CONTAINS} AS entity_ok FROM pairs
    WHERE question_intent = 'QUERY' AND NOT (routing_mode = 'CROSS_DOMAIN' AND superlative IS NOT NULL))),
held AS (
  SELECT *, CASE WHEN NOT survives THEN [] WHEN len(requested_attributes) = 0 THEN [] WHEN domain = 'timeline' THEN {_EVENT_HELD}
    ELSE {_FIELDS} END AS have FROM kept),
winning AS (
  SELECT query_id, domain, CASE WHEN any_value(superlative) = 'latest' THEN max(day) ELSE min(day) END AS win
  FROM held WHERE domain = 'timeline' AND superlative IS NOT NULL AND survives AND day IS NOT NULL GROUP BY query_id, domain),
per_domain AS (
  SELECT q.*, q.z[1] AS domain, q.z[2] AS domain_ord, coalesce(n, 0) AS n, coalesce(n_entity, 0) AS n_entity,
    coalesce(n_kept, 0) AS n_kept, w.win, list_filter(requested_attributes, lambda a: list_contains(coalesce(g.have, []), a)) AS m
  FROM (SELECT * FROM asked_domains WHERE question_intent = 'QUERY'
      AND NOT (routing_mode = 'CROSS_DOMAIN' AND superlative IS NOT NULL)) q
  LEFT JOIN (SELECT h.query_id, h.domain, count(*) AS n, count(*) FILTER (WHERE entity_ok) AS n_entity,
      count(*) FILTER (WHERE survives) AS n_kept,
      flatten(list(h.have) FILTER (WHERE w.win IS NULL OR h.day = w.win)) AS have
    FROM held h LEFT JOIN winning w ON w.query_id = h.query_id AND w.domain = h.domain GROUP BY h.query_id, h.domain) g
    ON g.query_id = q.query_id AND g.domain = q.z[1]
  LEFT JOIN winning w ON w.query_id = q.query_id AND w.domain = q.z[1]),
gated AS (
  SELECT *, {_less('requested_attributes', 'm')} AS miss, len(requested_attributes) > 0 AS wants,
    domain = 'timeline' AND superlative IS NOT NULL AND win IS NULL AS undated, CASE
    WHEN domain = 'timeline' THEN CASE
      WHEN n = 0 AND target_entity IS NULL THEN 'Timeline events are not recorded.'
      WHEN n_entity = 0 THEN concat('No timeline events were recorded matching: ', target_entity, '.')
      WHEN n_kept = 0 THEN CASE temporal_scope WHEN 'interval' THEN concat('No timeline events found for ', raw_expression, '.')
        WHEN 'current' THEN 'Current timeline events are not recorded.' WHEN 'historical' THEN 'Historical timeline events are not recorded.'
        ELSE 'Timeline events are not recorded.' END
      WHEN NOT (superlative IS NOT NULL AND win IS NULL) AND len(requested_attributes) > 0 AND target_entity IS NULL AND len(m) = 0
        THEN concat('No timeline events contain a record of: ', {_label('requested_attributes')}, '.') END
    WHEN n = 0 THEN CASE WHEN domain = 'profile' THEN 'Profile data is not recorded.' ELSE concat(domain, ' are not recorded.') END
    WHEN n_entity = 0 THEN concat(target_entity, ' is not recorded in ', domain, '.')
    WHEN domain = 'allergies' AND temporal_scope = 'interval' THEN concat('An allergy to ', coalesce(target_entity, 'this substance'),
      ' is on record, but its presence during ', raw_expression, ' is unverified.')
    WHEN n_kept = 0 THEN CASE temporal_scope WHEN 'current' THEN 'Current records for this entity are not recorded.'
      WHEN 'historical' THEN 'Historical records for this entity are not recorded.' ELSE concat('No records found for ', raw_expression, '.') END
    END AS gate FROM per_domain),
domain_results AS (
  SELECT query_id, patient_id, routing_mode, target_entity, requested_attributes, domain, domain_ord, temporal_scope,
    CASE WHEN gate IS NOT NULL THEN 'INSUFFICIENT' WHEN undated OR (wants AND len(miss) > 0) THEN 'PARTIALLY_SUFFICIENT'
      ELSE 'SUFFICIENT' END AS status,
    CASE WHEN gate IS NULL AND NOT undated THEN m ELSE [] END AS matched,
    CASE WHEN (gate IS NULL AND NOT undated) OR gate LIKE 'No timeline events contain%' THEN miss ELSE [] END AS missing,
    coalesce(gate, CASE WHEN domain = 'timeline' THEN CASE
        WHEN undated THEN CASE WHEN target_entity IS NOT NULL THEN concat('Records for ', target_entity,
            ' were found, but lack documented clinical dates to verify which is the ', superlative, '.')
          ELSE concat('Timeline events were found, but lack documented clinical dates to verify which is the ', superlative, '.') END
        WHEN wants AND len(miss) > 0 THEN CASE WHEN target_entity IS NOT NULL
          THEN concat(target_entity, ' is recorded on your timeline, but not found: ', {_label('miss')}, '.')
          ELSE concat('Information partially found on your timeline. Not found: ', {_label('miss')}, '.') END
        WHEN wants THEN 'All requested information is recorded on your timeline.'
        WHEN target_entity IS NOT NULL THEN 'Relevant records found on your timeline.' ELSE 'Timeline events are available.' END
      WHEN wants AND len(miss) > 0 THEN concat('Information partially available. Not recorded: ', array_to_string(miss, ', '), '.')
      WHEN wants THEN 'All requested information is recorded.' ELSE 'Relevant records found.' END) AS directive,
    undated FROM gated),
pooled AS (
  SELECT *, {_less('requested_attributes', 'm')} AS miss FROM (
    SELECT query_id, any_value(patient_id) AS patient_id, any_value(routing_mode) AS routing_mode, any_value(target_entity) AS target_entity,
      any_value(requested_attributes) AS requested_attributes, any_value(temporal_scope) AS temporal_scope, count(*) AS n_domains,
      count(*) FILTER (WHERE status <> 'INSUFFICIENT') AS n_ok, any_value(status) AS only_status, any_value(directive) AS only_directive,
      any_value(matched) AS only_matched, any_value(missing) AS only_missing,
      list_distinct(list(directive ORDER BY domain_ord) FILTER (WHERE status = 'PARTIALLY_SUFFICIENT' AND len(missing) = 0)) AS caveats,
      list_filter(any_value(requested_attributes), lambda a: list_contains(flatten(list(CASE WHEN status <> 'INSUFFICIENT' THEN matched ELSE [] END)), a)) AS m
    FROM domain_results GROUP BY query_id)),
structured_verdicts AS (
  SELECT query_id, patient_id, routing_mode,
    CASE WHEN n_domains = 1 THEN only_status
      WHEN n_ok = 0 AND (target_entity IS NOT NULL OR len(requested_attributes) = 0) THEN 'INSUFFICIENT'
      WHEN len(requested_attributes) > 0 AND target_entity IS NULL AND len(m) = 0 THEN 'INSUFFICIENT'
      WHEN len(miss) > 0 OR len(coalesce(caveats, [])) > 0 THEN 'PARTIALLY_SUFFICIENT' ELSE 'SUFFICIENT' END AS status,
    CASE WHEN n_domains = 1 THEN only_matched ELSE m END AS matched, CASE WHEN n_domains = 1 THEN only_missing ELSE miss END AS missing,
    CASE WHEN n_domains = 1 THEN only_directive
      WHEN len(miss) > 0 OR len(coalesce(caveats, [])) > 0 THEN concat_ws(' ',
        CASE WHEN len(miss) > 0 THEN CASE WHEN target_entity IS NOT NULL
          THEN concat(target_entity, ' is recorded, but not found in records: ', {_label('miss')}, '.')
          ELSE concat('Information partially found. Not found: ', {_label('miss')}, '.') END END, nullif(array_to_string(caveats, ' '), ''))
      WHEN n_ok = 0 AND target_entity IS NOT NULL THEN concat('No records found matching: ', target_entity, '.')
      WHEN len(requested_attributes) > 0 THEN 'All requested information is recorded in your health context.'
      WHEN target_entity IS NOT NULL THEN concat('Relevant records found for: ', target_entity, '.')
      WHEN n_ok > 0 THEN 'Health records are available.' ELSE 'No health records found in context.' END AS directive
  FROM pooled)"""

_NO = "Your uploaded records were searched, but do not contain a record of: "
PASSAGE_SQL = f"""cands AS (
  SELECT p.query_id, p.patient_id, p.ord, p.chunk_id, p.document_id, p.chunk_index, p.document_date AS day,
    r.target_entity IS NOT NULL AND coalesce({word_sql('lower(r.target_entity)', 'lower(p.chunk_text)')}, false) AS hit,
    CASE WHEN len(requested_attributes) = 0 THEN [] ELSE {_held('lower(p.chunk_text)')} END AS have
  FROM passages p JOIN routed r USING (query_id)
  WHERE r.temporal_scope <> 'interval' OR coalesce(p.document_date BETWEEN r.start_date AND r.end_date, false)),
best_docs AS (
  SELECT c.query_id, document_id, bool_or(hit) AS has_hit, min(ord) AS first_ord,
    list_distinct(flatten(list(have))) AS have FROM cands c GROUP BY c.query_id, document_id),
by_query AS (
  SELECT query_id, bool_or(has_hit) AS any_hit, flatten(list(have)) AS pooled,
    first(have ORDER BY len(have) DESC, first_ord) FILTER (WHERE has_hit) AS best FROM best_docs GROUP BY query_id),
doc_targets AS (
  SELECT r.*, b.any_hit, b.query_id IS NOT NULL AS retrieved,
    list_filter(requested_attributes, lambda a: list_contains(coalesce(CASE WHEN target_entity IS NULL THEN pooled ELSE best END, []), a)) AS m
  FROM routed r LEFT JOIN by_query b USING (query_id) WHERE routing_mode IN ('DOCUMENT_ONLY', 'CROSS_DOMAIN')),
passage_verdicts AS (
  SELECT query_id, patient_id, routing_mode, superlative, question_intent, retrieved, CASE
      WHEN NOT retrieved THEN 'INSUFFICIENT' WHEN target_entity IS NOT NULL AND NOT any_hit THEN 'INSUFFICIENT'
      WHEN len(miss) = 0 THEN 'SUFFICIENT' WHEN target_entity IS NOT NULL OR len(m) > 0 THEN 'PARTIALLY_SUFFICIENT'
      ELSE 'INSUFFICIENT' END AS status,
    CASE WHEN NOT retrieved OR (target_entity IS NOT NULL AND NOT any_hit) THEN [] ELSE m END AS matched,
    CASE WHEN retrieved AND target_entity IS NOT NULL AND NOT any_hit THEN [] ELSE miss END AS missing,
    CASE WHEN NOT retrieved THEN CASE
        WHEN len(requested_attributes) > 0 THEN concat('{_NO}', array_to_string(requested_attributes, ', '), '.',
          CASE WHEN temporal_scope = 'interval' THEN concat(' (for ', raw_expression, ')') ELSE '' END)
        WHEN target_entity IS NOT NULL THEN concat('{_NO}', target_entity, '.',
          CASE WHEN temporal_scope = 'interval' THEN concat(' (for ', raw_expression, ')') ELSE '' END)
        WHEN temporal_scope = 'interval' THEN concat('No document records are available for ', raw_expression, '.')
        ELSE 'No document records are available for this domain.' END
      WHEN target_entity IS NOT NULL AND NOT any_hit THEN concat('{_NO}', target_entity, '.')
      WHEN target_entity IS NULL AND len(requested_attributes) = 0 THEN 'Document content is available.'
      WHEN len(miss) = 0 THEN 'All requested information was found in your uploaded records.'
      WHEN target_entity IS NOT NULL THEN concat(target_entity, ' is recorded, but not found in records: ', {_label('miss')}, '.')
      WHEN len(m) = 0 THEN concat('{_NO}', {_label('miss')}, '.')
      ELSE concat('Information partially found in your uploaded records. Not found in records: ', {_label('miss')}, '.') END AS directive
  FROM (SELECT *, {_less('requested_attributes', 'm')} AS miss FROM doc_targets))"""

_OUT = ("SELECT query_id, status, array_to_string(matched, ',') AS matched_fields, array_to_string(missing, ',') AS missing_fields,"
        " directive AS evidence_directive FROM ")


def _flat(verdicts):
    return verdicts.select(
        "query_id", "status", F.array_join("matched_fields", ",").alias("matched_fields"),
        F.array_join("missing_fields", ",").alias("missing_fields"), "evidence_directive",
    )


@query(
    "structured_verdicts",
    over_views(_OUT + "structured_verdicts WHERE routing_mode = 'STRUCTURED_ONLY'", ROUTED_SQL, RECORD_SQL, STRUCTURED_SQL),
)
def structured_verdicts(t):
    targets = _targets(t, "STRUCTURED_ONLY").drop("query_vec").where("question_intent = 'QUERY'")
    return _flat(vd.structured_evidence(targets, health_records(t)).verdicts)


@query(
    "passage_verdicts",
    over_views(
        _OUT + "passage_verdicts WHERE routing_mode = 'DOCUMENT_ONLY' AND (NOT retrieved OR (superlative IS NULL AND question_intent = 'QUERY'))",
        ROUTED_SQL, RETRIEVAL_SQL, PASSAGE_SQL,
    ),
)
def passage_verdicts(t):
    targets = _targets(t, "DOCUMENT_ONLY")
    passages = materialise(_retrieved(t, targets))
    lean = targets.drop("query_vec")
    some = passages.select("query_id", "patient_id").distinct()
    plain = lean.where("superlative IS NULL AND question_intent = 'QUERY'")
    empty = lean.where("superlative IS NOT NULL OR question_intent <> 'QUERY'").join(some, ["query_id", "patient_id"], "left_anti")
    return _flat(vd.passage_evidence(plain.unionByName(empty), passages).verdicts)


FUSED_SQL = f"""fused AS (
  SELECT query_id, s_ok, d_ok, target_entity, requested_attributes, m, {_less('requested_attributes', 'm')} AS miss
  FROM (SELECT r.query_id, r.target_entity, r.requested_attributes, s.status <> 'INSUFFICIENT' AS s_ok, d.status <> 'INSUFFICIENT' AS d_ok,
      list_filter(r.requested_attributes, lambda a: (s.status <> 'INSUFFICIENT' AND list_contains(s.matched, a))
        OR (d.status <> 'INSUFFICIENT' AND list_contains(d.matched, a))) AS m
    FROM routed r JOIN structured_verdicts s USING (query_id) JOIN passage_verdicts d USING (query_id)
    WHERE r.routing_mode = 'CROSS_DOMAIN')),
fused_verdicts AS (
  SELECT query_id, m AS matched, miss AS missing, CASE
      WHEN target_entity IS NOT NULL AND NOT (s_ok OR d_ok) THEN 'INSUFFICIENT'
      WHEN target_entity IS NULL AND len(requested_attributes) > 0 AND len(m) = 0 THEN 'INSUFFICIENT'
      WHEN len(miss) > 0 THEN 'PARTIALLY_SUFFICIENT' WHEN len(requested_attributes) > 0 OR s_ok OR d_ok THEN 'SUFFICIENT'
      ELSE 'INSUFFICIENT' END AS status,
    CASE WHEN target_entity IS NOT NULL AND NOT (s_ok OR d_ok)
        THEN concat('Your records and documents do not contain a record of: ', target_entity, '.')
      WHEN target_entity IS NULL AND len(requested_attributes) > 0 AND len(m) = 0 THEN concat('{_NO}', {_label('miss')}, '.')
      WHEN len(requested_attributes) > 0 AND len(miss) = 0 THEN 'All requested information is recorded.'
      WHEN len(miss) > 0 AND target_entity IS NOT NULL
        THEN concat(target_entity, ' is recorded, but not found in records: ', {_label('miss')}, '.')
      WHEN len(miss) > 0 THEN concat('Information partially found. Not found in records: ', {_label('miss')}, '.')
      WHEN s_ok OR d_ok THEN 'Relevant records found.' ELSE 'No records are available for this domain.' END AS directive FROM fused)"""


@query(
    "fused_verdicts",
    over_views(_OUT + "fused_verdicts", ROUTED_SQL, RECORD_SQL, STRUCTURED_SQL, RETRIEVAL_SQL, PASSAGE_SQL, FUSED_SQL),
)
def fused_verdicts(t):
    targets = _targets(t, "CROSS_DOMAIN").where("question_intent = 'QUERY' AND superlative IS NULL")
    passages = materialise(_retrieved(t, targets))
    return _flat(vd.fused_evidence(targets.drop("query_vec"), health_records(t), passages).verdicts)


# --- comparisons and latest/first over the whole candidate pool ---------------------------------

_NAMED = f"""(target_entity IS NULL OR CASE WHEN domain = 'timeline'
  THEN {word_sql('lower(target_entity)', "coalesce(lower(description), '')")} OR {word_sql('lower(target_entity)', 'lower(title)')}
  ELSE {word_sql('lower(target_entity)', "coalesce(lower(name), '')")} END)"""
_BOTH = "lower(concat(title, ' ', coalesce(description, '')))"
POOL_SQL = f"""pool AS (
  SELECT query_id, 0 AS cls, domain, CAST(id AS VARCHAR) AS tie_id, 0 AS chunk_index, NULL::BIGINT AS chunk_id, day,
    CASE WHEN len(requested_attributes) = 0 THEN [] WHEN domain = 'timeline' THEN {_held_or_named(_BOTH)} ELSE {_FIELDS} END AS have
  FROM pairs WHERE (question_intent = 'COMPARISON' OR (routing_mode = 'CROSS_DOMAIN' AND superlative IS NOT NULL))
    AND event_type IS DISTINCT FROM 'DOCUMENT_UPLOADED' AND {_NAMED}
  UNION ALL
  SELECT c.query_id, 1, 'documents', CAST(c.document_id AS VARCHAR), c.chunk_index, c.chunk_id, c.day, c.have
  FROM cands c JOIN routed r USING (query_id)
  WHERE (r.question_intent = 'COMPARISON' OR r.superlative IS NOT NULL) AND (r.target_entity IS NULL OR c.hit)),
pool_targets AS (
  SELECT r.* FROM routed r WHERE (question_intent = 'COMPARISON' OR (superlative IS NOT NULL AND routing_mode <> 'STRUCTURED_ONLY'))
    AND (routing_mode <> 'DOCUMENT_ONLY' OR query_id IN (SELECT query_id FROM cands)))"""

TREND_SQL = f"""dated AS (
  SELECT p.query_id, p.day, flatten(list(p.have)) AS have, row_number() OVER (PARTITION BY p.query_id ORDER BY p.day) AS up,
    row_number() OVER (PARTITION BY p.query_id ORDER BY p.day DESC) AS down, count(*) OVER (PARTITION BY p.query_id) AS n_dates
  FROM pool p JOIN pool_targets t USING (query_id) WHERE t.question_intent = 'COMPARISON' AND p.day IS NOT NULL GROUP BY p.query_id, p.day),
milestones AS (SELECT *, CASE WHEN n_dates = 1 THEN 4 WHEN n_dates >= 3 AND down <> 1 THEN 1 ELSE 2 END AS quota
  FROM dated WHERE up = 1 OR down <= 2),
trend_shown AS (
  SELECT query_id, chunk_id, tie_id, chunk_index, day FROM (SELECT p.*, m.quota,
      row_number() OVER (PARTITION BY p.query_id, p.day ORDER BY len(p.have) DESC, p.tie_id, p.chunk_index) AS place
    FROM pool p JOIN milestones m ON m.query_id = p.query_id AND m.day = p.day WHERE cls = 1) WHERE place <= quota),
trend_counts AS (
  SELECT t.query_id, t.routing_mode, t.target_entity, t.requested_attributes, coalesce(max(m.n_dates), 0) AS n, min(m.day) AS only_day,
    list_filter(t.requested_attributes, lambda a: list_contains(coalesce(flatten(list(m.have)), []), a)) AS matched,
    list_filter(t.requested_attributes, lambda a: len(list_filter(coalesce(list(m.have), []), lambda h: list_contains(h, a))) = 1) AS single,
    list_filter(t.requested_attributes, lambda a: list_contains(coalesce(any_value(u.have), []), a)) AS anywhere
  FROM pool_targets t LEFT JOIN milestones m USING (query_id)
  LEFT JOIN (SELECT query_id, flatten(list(have)) AS have FROM pool GROUP BY query_id) u ON u.query_id = t.query_id
  WHERE t.question_intent = 'COMPARISON' GROUP BY t.query_id, t.routing_mode, t.target_entity, t.requested_attributes),
trend_verdicts AS (
  SELECT query_id, CASE WHEN n = 0 THEN [] ELSE matched END AS matched, miss AS missing, CASE WHEN n = 0 THEN 'INSUFFICIENT'
      WHEN n = 1 THEN 'PARTIALLY_SUFFICIENT' WHEN len(miss) + len(single) = 0 THEN 'SUFFICIENT'
      WHEN len(anywhere) > 0 OR target_entity IS NOT NULL THEN 'PARTIALLY_SUFFICIENT' ELSE 'INSUFFICIENT' END AS status,
    concat(CASE WHEN n = 0 THEN 'No clinically dated records were found to compare changes over time.'
      WHEN n = 1 THEN concat('Only a single record on ', CAST(only_day AS VARCHAR),
        ' was found; at least two recorded dates are required to compare changes over time.',
        CASE WHEN len(miss) > 0 THEN concat(' Not recorded: ', {_label('miss')}, '.') ELSE '' END)
      WHEN len(requested_attributes) = 0 THEN 'Relevant records found across comparison dates.'
      WHEN len(miss) + len(single) = 0 THEN 'All requested information is recorded across comparison dates.'
      ELSE concat_ws(' ', CASE WHEN target_entity IS NOT NULL THEN concat(target_entity, ' is recorded.') ELSE 'Information partially available.' END,
        CASE WHEN len({_less('miss', 'anywhere')}) > 0 THEN concat('Not found in records: ', {_label(_less('miss', 'anywhere'))}, '.') END,
        CASE WHEN len(list_intersect(miss, anywhere)) > 0 THEN concat('Not recorded on the selected comparison milestone dates: ',
          {_label('list_intersect(miss, anywhere)')}, '.') END,
        CASE WHEN len(single) > 0 THEN concat('Attribute ''', {_label('single')},
          ''' was recorded on only one milestone date and cannot be compared across time.') END) END,
      CASE WHEN n > 3 THEN ' {lx.BOUNDED_QUALIFIER}' ELSE '' END) AS directive,
    CASE WHEN n > 3 THEN 'BOUNDED_WITH_ADDITIONAL_QUALIFIED_CANDIDATES' WHEN n > 0 THEN 'COMPLETE_WITHIN_EVALUATED_CANDIDATES' END AS completeness
  FROM (SELECT *, {_less('requested_attributes', 'matched')} AS miss FROM trend_counts))"""

BEST_SQL = f"""qualified AS (
  SELECT p.*, t.superlative, t.requested_attributes FROM pool p JOIN pool_targets t USING (query_id)
  WHERE t.question_intent = 'QUERY' AND (len(t.requested_attributes) = 0 OR len(p.have) > 0)),
winners AS (
  SELECT query_id, count(*) AS n, CASE WHEN any_value(superlative) = 'latest' THEN max(day) ELSE min(day) END AS win FROM qualified GROUP BY query_id),
bucketed AS (
  SELECT q.*, w.win, CASE WHEN q.day IS NULL THEN 'none' WHEN q.day = w.win THEN 'win' ELSE 'other' END AS bucket
  FROM qualified q JOIN winners w USING (query_id) WHERE cls = 1),
bucket_sizes AS (
  SELECT query_id, least(n_win, CASE WHEN n_other > 0 THEN 2 ELSE 4 END) AS take_win, n_other FROM (
    SELECT query_id, count(*) FILTER (WHERE bucket = 'win') AS n_win, count(*) FILTER (WHERE bucket = 'other') AS n_other
    FROM bucketed GROUP BY query_id)),
best_shown AS (
  SELECT query_id, chunk_id, tie_id, chunk_index, day, have, win FROM (SELECT b.*, s.take_win, least(s.n_other, 4 - s.take_win) AS take_other,
      CASE WHEN bucket = 'other' AND superlative = 'latest'
        THEN row_number() OVER (PARTITION BY b.query_id, bucket ORDER BY day DESC, tie_id DESC, chunk_index DESC)
        ELSE row_number() OVER (PARTITION BY b.query_id, bucket ORDER BY day, tie_id, chunk_index) END AS place
    FROM bucketed b JOIN bucket_sizes s USING (query_id))
  WHERE place <= CASE bucket WHEN 'win' THEN take_win WHEN 'other' THEN take_other ELSE 4 - take_win - take_other END),
best_rows AS (
  SELECT t.*, w.n, w.win,
    list_filter(t.requested_attributes, lambda a: list_contains(coalesce(f.have, []), a)) AS full_have,
    list_filter(t.requested_attributes, lambda a: list_contains(coalesce(f.rec, []), a) OR list_contains(coalesce(s.have, []), a)) AS seen
  FROM (SELECT * FROM pool_targets WHERE question_intent = 'QUERY') t LEFT JOIN winners w USING (query_id)
  LEFT JOIN (SELECT q.query_id, flatten(list(q.have)) AS have, flatten(list(q.have) FILTER (WHERE cls = 0)) AS rec
    FROM qualified q JOIN winners w ON w.query_id = q.query_id AND q.day = w.win GROUP BY q.query_id) f ON f.query_id = t.query_id
  LEFT JOIN (SELECT query_id, flatten(list(have)) AS have FROM best_shown WHERE day = win GROUP BY query_id) s ON s.query_id = t.query_id),
best_verdicts AS (
  SELECT query_id, CASE WHEN win IS NULL THEN [] ELSE list_concat(covered, omitted) END AS matched,
    CASE WHEN win IS NULL THEN requested_attributes ELSE miss END AS missing,
    CASE WHEN n IS NULL THEN 'INSUFFICIENT' WHEN win IS NULL THEN 'PARTIALLY_SUFFICIENT'
      WHEN len(miss) > 0 AND len(covered) + len(omitted) = 0 THEN 'INSUFFICIENT'
      WHEN len(miss) + len(omitted) > 0 THEN 'PARTIALLY_SUFFICIENT' ELSE 'SUFFICIENT' END AS status,
    CASE WHEN n IS NULL THEN CASE WHEN routing_mode = 'CROSS_DOMAIN' THEN concat('No records found for ', coalesce(target_entity, 'health query'), '.')
        ELSE concat('{_NO}', CASE WHEN len(requested_attributes) > 0 THEN {_label('requested_attributes')} ELSE coalesce(target_entity, 'health') END, '.') END
      WHEN win IS NULL THEN concat('Identified ', coalesce(target_entity, 'health'),
        ' records, but no verifiable clinical dates were recorded to establish recency.')
      ELSE concat(CASE WHEN superlative = 'latest' THEN 'Most recent ' ELSE 'Earliest ' END, coalesce(target_entity, 'health'),
        ' record identified on ', CAST(win AS VARCHAR), '.',
        CASE WHEN len(miss) > 0 THEN concat(' Not recorded on ', CAST(win AS VARCHAR), ': ', {_label('miss')}, '.') ELSE '' END,
        CASE WHEN len(omitted) > 0 THEN concat(' Additional information for ''', {_label('omitted')}, ''' on ', CAST(win AS VARCHAR),
          ' could not be displayed due to summary space limits.') ELSE '' END) END AS directive
  FROM (SELECT *, {_less('requested_attributes', 'full_have')} AS miss, {_less('full_have', 'seen')} AS omitted,
      list_filter(full_have, lambda a: list_contains(seen, a)) AS covered FROM best_rows))"""

_POOL_PARTS = (ROUTED_SQL, RECORD_SQL, RETRIEVAL_SQL, PASSAGE_SQL, POOL_SQL)


def _pooled_evidence(t, condition: str):
    """Evidence of the inquiries decided over their whole candidate pool."""
    targets = _targets(t).where(condition)
    passages = materialise(_retrieved(t, targets))
    some = passages.select("query_id", "patient_id").distinct()
    documents_only = F.col("routing_mode") == "DOCUMENT_ONLY"
    lean = targets.drop("query_vec")
    open_ = lean.where(~documents_only).unionByName(lean.where(documents_only).join(some, ["query_id", "patient_id"], "left_semi"))
    return vd.evaluate(open_, health_records(t), passages)


@query("comparison_verdicts", over_views(_OUT + "trend_verdicts", *_POOL_PARTS, TREND_SQL))
def comparison_verdicts(t):
    return _flat(_pooled_evidence(t, "question_intent = 'COMPARISON'").verdicts)


_SUPERLATIVE = "question_intent = 'QUERY' AND superlative IS NOT NULL AND routing_mode <> 'STRUCTURED_ONLY'"


@query("superlative_verdicts", over_views(_OUT + "best_verdicts", *_POOL_PARTS, BEST_SQL))
def superlative_verdicts(t):
    return _flat(_pooled_evidence(t, _SUPERLATIVE).verdicts)


@query(
    "milestone_passages",
    over_views(
        "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY day, tie_id, chunk_index) AS place FROM trend_shown",
        *_POOL_PARTS, TREND_SQL,
    ),
)
def milestone_passages(t):
    shown = _pooled_evidence(t, "question_intent = 'COMPARISON'").passages
    return shown.select("query_id", F.col("chunk_id").cast("long").alias("chunk_id"), "place")


@query(
    "winner_passages",
    over_views(
        "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY day NULLS FIRST, tie_id, chunk_index) AS place FROM best_shown",
        *_POOL_PARTS, BEST_SQL,
    ),
)
def winner_passages(t):
    shown = _pooled_evidence(t, _SUPERLATIVE).passages
    return shown.select("query_id", F.col("chunk_id").cast("long").alias("chunk_id"), "place")


# --- answers, citations, context ---------------------------------------------------------------


@query(
    "inquiry_routes",
    over_views(
        "SELECT query_id, contains(query_text, 'passed out') AS safety_triggered, routing_mode,"
        " routing_mode = 'AMBIGUOUS_CLARIFY' AS clarification_required FROM targets"
    ),
)
def inquiry_routes(t):
    return an.gate(t.inquiries).select("query_id", "safety_triggered", "routing_mode", "clarification_required")


ALL_SQL = f"""all_verdicts AS (
  SELECT query_id, status, matched, missing, directive, NULL AS completeness FROM structured_verdicts WHERE routing_mode = 'STRUCTURED_ONLY'
  UNION ALL SELECT query_id, status, matched, missing, directive, NULL FROM passage_verdicts
    WHERE routing_mode = 'DOCUMENT_ONLY' AND (NOT retrieved OR (superlative IS NULL AND question_intent = 'QUERY'))
  UNION ALL SELECT query_id, status, matched, missing, directive, NULL FROM fused_verdicts
  UNION ALL SELECT query_id, status, matched, missing, directive, completeness FROM trend_verdicts
  UNION ALL SELECT query_id, status, matched, missing, directive, NULL FROM best_verdicts),
useful AS (SELECT * FROM all_verdicts WHERE status <> 'INSUFFICIENT'),
record_values AS (
  SELECT id, domain, dosage, frequency, status, blood_group FROM facts WHERE domain <> 'timeline'),
matched_records AS (
  SELECT h.query_id, h.domain, CAST(h.id AS VARCHAR) AS tie, h.domain_ord, h.rec, h.cre, NULL::DATE AS day, h.dosage, h.frequency,
    h.status, h.blood_group, h.event_type
  FROM held h JOIN useful u USING (query_id) JOIN structured_verdicts sv ON sv.query_id = h.query_id AND sv.status <> 'INSUFFICIENT'
  JOIN domain_results d ON d.query_id = h.query_id AND d.domain = h.domain AND d.status <> 'INSUFFICIENT'
  LEFT JOIN winning w ON w.query_id = h.query_id AND w.domain = h.domain
  WHERE h.survives AND (w.win IS NULL OR h.day = w.win)
  UNION ALL
  SELECT p.query_id, p.domain, p.tie_id, 0, NULL, NULL, p.day, v.dosage, v.frequency, v.status, v.blood_group, p.event_type
  FROM (SELECT p.query_id, p.domain, p.tie_id, p.day, NULL AS event_type FROM pool p JOIN milestones m ON m.query_id = p.query_id AND m.day = p.day
      WHERE cls = 0
    UNION ALL SELECT query_id, domain, tie_id, day, NULL FROM qualified WHERE cls = 0) p
  JOIN useful u USING (query_id) LEFT JOIN record_values v ON v.domain = p.domain AND CAST(v.id AS VARCHAR) = p.tie_id),
plain_shown AS (
  SELECT c.query_id, c.chunk_id, row_number() OVER (PARTITION BY c.query_id ORDER BY
      CASE WHEN len(r.requested_attributes) > 0 AND r.target_entity IS NULL THEN b.first_ord ELSE 0 END,
      CASE WHEN len(r.requested_attributes) > 0 AND NOT c.hit THEN list_position(r.requested_attributes, c.have[1]) ELSE 0 END, c.ord) AS place
  FROM cands c JOIN routed r USING (query_id) JOIN useful u USING (query_id)
  JOIN passage_verdicts pv ON pv.query_id = c.query_id AND pv.status <> 'INSUFFICIENT'
  JOIN best_docs b ON b.query_id = c.query_id AND b.document_id = c.document_id
  WHERE r.superlative IS NULL AND r.question_intent = 'QUERY' AND CASE
    WHEN len(r.requested_attributes) > 0 AND r.target_entity IS NOT NULL THEN (c.hit OR len(c.have) > 0) AND c.document_id = (
      SELECT x.document_id FROM best_docs x WHERE x.query_id = c.query_id AND x.has_hit ORDER BY len(x.have) DESC, x.first_ord LIMIT 1)
    WHEN r.target_entity IS NOT NULL THEN c.hit WHEN len(r.requested_attributes) > 0 THEN len(c.have) > 0 ELSE true END),
shown AS (
  SELECT query_id, chunk_id, place FROM plain_shown
  UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY day NULLS FIRST, tie_id, chunk_index)
    FROM (SELECT * FROM trend_shown UNION ALL SELECT query_id, chunk_id, tie_id, chunk_index, day FROM best_shown)
    WHERE query_id IN (SELECT query_id FROM useful)),
details AS (
  SELECT s.query_id, s.place, c.id AS chunk_id, c.document_id, c.chunk_index, c.page_number, c.chunk_text, d.display_name,
    d.document_type, d.document_date
  FROM shown s JOIN document_chunks c ON c.id = s.chunk_id JOIN medical_documents d ON d.id = c.document_id)"""

_EVERYTHING = (ROUTED_SQL, RECORD_SQL, STRUCTURED_SQL, RETRIEVAL_SQL, PASSAGE_SQL, FUSED_SQL, POOL_SQL, TREND_SQL, BEST_SQL, ALL_SQL)

_TEXT_VALUE = r"""CASE q.a
  WHEN 'dosage' THEN coalesce(nullif(trim(regexp_extract(txt, '(?i)(?:dosage|dose|strength)\s*:\s*([^\n\r]+)', 1)), ''),
    nullif(trim(regexp_extract(txt, '(?i)\b(\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)\b[^\n\r,.]*)', 1)), ''))
  WHEN 'physician_name' THEN coalesce(nullif(trim(regexp_replace(regexp_extract(txt,
      '(?i)(?:prescribing (?:physician|doctor)|prescribed by|ordered by|physician|provider|doctor)\s*:\s*([^\n\r]+)', 1), '\(.*?\)', '', 'g')), ''),
    nullif(trim(regexp_extract(txt, '(?i)\b(dr\.?\s+[a-z]+(?:\s+[a-z]+){0,2}(?:,\s*md)?)\b', 1)), ''))
  WHEN 'clinic' THEN nullif(trim(regexp_replace(regexp_extract(txt, '(?i)(?:clinic|facility|hospital|practice)\s*:\s*([^\n\r]+)', 1), '\(.*?\)', '', 'g')), '')
  WHEN 'contact_number' THEN nullif(trim(regexp_extract(txt, '(?i)(?:phone|tel|telephone|contact|fax)\s*(?:#|no\.?|number)?\s*:\s*([^\n\r]+)', 1)), '')
  WHEN 'frequency' THEN nullif(trim(regexp_extract(txt, '(?i)(?:frequency|schedule)\s*:\s*([^\n\r]+)', 1)), '')
  WHEN 'status' THEN nullif(trim(regexp_extract(txt, '(?i)\bstatus\s*:\s*([^\n\r]+)', 1)), '') END"""

ANSWER_SQL = f"""asked_values AS (
  SELECT u.query_id, unnest(u.matched) AS a, unnest(range(len(u.matched))) AS pos FROM useful u),
first_values AS (
  SELECT query_id, a, first(v ORDER BY domain_ord, day NULLS FIRST, rec DESC, cre DESC, tie) AS v FROM (
    SELECT q.query_id, q.a, m.domain_ord, m.day, m.rec, m.cre, m.tie, CASE q.a WHEN 'dosage' THEN m.dosage WHEN 'frequency' THEN m.frequency
      WHEN 'status' THEN m.status WHEN 'blood_group' THEN m.blood_group END AS v
    FROM asked_values q JOIN matched_records m USING (query_id) WHERE m.domain <> 'timeline') WHERE v IS NOT NULL GROUP BY query_id, a),
texts AS (SELECT query_id, string_agg(chunk_text, ' ' ORDER BY place) AS txt FROM details GROUP BY query_id),
stated AS (
  SELECT query_id, string_agg(concat_ws(': ', a, v), ', ' ORDER BY pos) AS words FROM (
    SELECT q.query_id, q.a, q.pos, coalesce(f.v, {_TEXT_VALUE}) AS v
    FROM asked_values q LEFT JOIN first_values f ON f.query_id = q.query_id AND f.a = q.a LEFT JOIN texts t ON t.query_id = q.query_id)
  GROUP BY query_id),
answers AS (
  SELECT t.query_id, coalesce(v.status, 'INSUFFICIENT') AS evidence_status, CASE
    WHEN contains(t.query_text, 'passed out') THEN '{lx.SAFETY_ADVISORY}'
    WHEN t.routing_mode = 'AMBIGUOUS_CLARIFY' THEN '{lx.CLARIFICATION_PROMPT}'
    WHEN t.routing_mode = 'UNROUTABLE' THEN '{lx.UNROUTABLE_ANSWER}'
    WHEN v.status = 'SUFFICIENT' THEN concat(CASE
        WHEN d.query_id IS NOT NULL AND t.query_id IN (SELECT query_id FROM matched_records)
          THEN concat('According to structured records and your uploaded ', d.display_name, coalesce(' from ' || CAST(d.document_date AS VARCHAR), ''), ', records ')
        WHEN d.query_id IS NOT NULL THEN concat('According to your uploaded ', d.display_name, coalesce(' from ' || CAST(d.document_date AS VARCHAR), ''), ', records ')
        ELSE 'Records ' END, 'confirm ', coalesce(t.target_entity, 'requested information'), '.',
      coalesce(' Attributes ' || s.words || ' are present.', ''),
      CASE WHEN v.completeness LIKE 'BOUNDED%' THEN concat(chr(10), chr(10), '{lx.BOUNDED_QUALIFIER}') ELSE '' END)
    ELSE v.directive END AS answer
  FROM targets t LEFT JOIN all_verdicts v USING (query_id) LEFT JOIN details d ON d.query_id = t.query_id AND d.place = 1
  LEFT JOIN stated s ON s.query_id = t.query_id)"""


@query("inquiry_results", over_views("SELECT * FROM answers", *_EVERYTHING, ANSWER_SQL))
def inquiry_results(t):
    return an.answer_inquiries(t.inquiries, t).results.select("query_id", "evidence_status", "answer")


@query(
    "inquiry_citations",
    over_views(
        """SELECT query_id, CAST(sum(n_records) AS BIGINT) AS n_records, CAST(sum(n_documents) AS BIGINT) AS n_documents,
  CAST(sum(n_records) + sum(n_documents) AS BIGINT) AS last_number FROM (
  SELECT query_id, count(*) AS n_records, 0 AS n_documents FROM matched_records GROUP BY query_id
  UNION ALL SELECT query_id, 0, count(DISTINCT document_id) FROM details GROUP BY query_id) GROUP BY query_id""",
        *_EVERYTHING,
    ),
)
def inquiry_citations(t):
    cited = an.answer_inquiries(t.inquiries, t).citations
    is_document = F.col("entity_type") == "DOCUMENT"
    return cited.groupBy("query_id").agg(
        F.count_if(~is_document).alias("n_records"), F.count_if(is_document).alias("n_documents"),
        F.max("citation_id").alias("last_number"),
    )


@query(
    "passage_blocks",
    over_views(
        """SELECT query_id, place, concat('[DOC-', place, '] Document: ', display_name, ' | Date: ', coalesce(CAST(document_date AS VARCHAR), 'not recorded'),
  ' | Page: ', coalesce(CAST(page_number AS VARCHAR), 'not recorded'), ' | Type: ', upper(document_type), chr(10), 'Passage:', chr(10),
  substr(chunk_text, 1, 1200)) AS line FROM details WHERE place <= 5""",
        *_EVERYTHING,
    ),
)
def passage_blocks(t):
    job = an.answer_inquiries(t.inquiries, t)
    return cx.passage_blocks(job.details).select("query_id", "place", "line")


TOKEN_SQL = """sized AS (SELECT patient_id, domain, count(*) AS n FROM facts WHERE domain <> 'timeline' GROUP BY patient_id, domain),
exposed AS (
  SELECT r.query_id, r.patient_id, s.domain, s.n, list_position(['profile', 'conditions', 'medications', 'allergies', 'symptoms', 'goals'], s.domain) AS o
  FROM routed r JOIN sized s ON s.patient_id = r.patient_id AND list_contains(r.structured_domains, s.domain)),
placed AS (SELECT patient_id, domain, id, row_number() OVER (PARTITION BY patient_id, domain ORDER BY CAST(id AS VARCHAR)) AS place
  FROM facts WHERE domain <> 'timeline'),
tokens AS (
  SELECT e.query_id, e.patient_id, e.domain, CAST(p.id AS VARCHAR) AS record_id, e.before + p.place AS number
  FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM exposed) e JOIN placed p ON p.patient_id = e.patient_id AND p.domain = e.domain)"""


def _tokens(t, shown=()):
    records = health_records(t)
    return cx.record_tokens(_targets(t).drop("query_vec"), cx.described(records) if shown else records, shown=shown)


@query(
    "record_tokens",
    over_views("SELECT query_id, domain, record_id, concat('[REC-', CAST(number AS BIGINT), ']') AS token FROM tokens", ROUTED_SQL, RECORD_SQL, TOKEN_SQL),
)
def record_tokens(t):
    return _tokens(t).select("query_id", "domain", "record_id", "token")


_S = "coalesce(CAST({0} AS VARCHAR), 'not recorded')"
LINE_SQL = f"""lines AS (
  SELECT query_id, record_id, concat('  [REC-', CAST(number AS BIGINT), '] [', upper(kind), '] ', body) AS line FROM (
    SELECT k.query_id, k.record_id, k.number, 'condition' AS kind, concat('ended_at: ', {_S.format('ended_at')}, ', is_chronic: ',
      CASE WHEN is_chronic THEN 'True' ELSE 'False' END, ', name: ', name, ', notes: ', {_S.format('notes')}, ', started_at: ',
      {_S.format('started_at')}, ', status: ', status, ', verification_state: ', verification_state) AS body
    FROM tokens k JOIN conditions x ON k.domain = 'conditions' AND CAST(x.id AS VARCHAR) = k.record_id
    UNION ALL SELECT k.query_id, k.record_id, k.number, 'medication', concat('as_needed: ', CASE WHEN as_needed THEN 'True' ELSE 'False' END,
      ', dosage: ', {_S.format('dosage')}, ', ended_at: ', {_S.format('ended_at')}, ', frequency: ', {_S.format('frequency')}, ', name: ', name,
      ', notes: not recorded, started_at: ', {_S.format('started_at')}, ', status: ', status, ', verification_state: PATIENT_REPORTED')
    FROM tokens k JOIN medications x ON k.domain = 'medications' AND CAST(x.id AS VARCHAR) = k.record_id
    UNION ALL SELECT k.query_id, k.record_id, k.number, 'allergy', concat('allergen: ', allergen, ', notes: not recorded, reaction: ',
      {_S.format('reaction')}, ', recorded_at: ', strftime(recorded_at, '%Y-%m-%dT%H:%M:%S+00:00'), ', severity: ', {_S.format('severity')},
      ', verification_state: PATIENT_REPORTED')
    FROM tokens k JOIN allergies x ON k.domain = 'allergies' AND CAST(x.id AS VARCHAR) = k.record_id
    UNION ALL SELECT k.query_id, k.record_id, k.number, 'symptom', concat('ended_at: ', {_S.format('ended_at')}, ', name: ', name, ', notes: ',
      {_S.format('notes')}, ', severity: ', {_S.format('severity')}, ', started_at: ', {_S.format('started_at')}, ', verification_state: PATIENT_REPORTED')
    FROM tokens k JOIN symptoms x ON k.domain = 'symptoms' AND CAST(x.id AS VARCHAR) = k.record_id
    UNION ALL SELECT k.query_id, k.record_id, k.number, 'goal', concat('description: ', description, ', notes: not recorded, status: ', status,
      ', target_date: ', {_S.format('target_date')}, ', title: ', description, ', verification_state: PATIENT_REPORTED')
    FROM tokens k JOIN patient_goals x ON k.domain = 'goals' AND CAST(x.id AS VARCHAR) = k.record_id
    UNION ALL SELECT k.query_id, k.record_id, k.number, 'profile', concat('age_years: ', a.age, ', biological_sex: ', biological_sex,
      CASE WHEN r.structured_domains[1] = 'profile' THEN concat(', blood_group: ', {_S.format('blood_group')}, ', height_cm: ',
        CAST(CAST(height_cm AS DOUBLE) AS VARCHAR), ', notes: not recorded') ELSE '' END)
    FROM tokens k JOIN health_profiles x ON k.domain = 'profile' AND CAST(x.id AS VARCHAR) = k.record_id JOIN routed r ON r.query_id = k.query_id
    JOIN (SELECT patient_id, year(r) - year(d) - CASE WHEN (month(r), day(r)) < (month(d), day(d)) THEN 1 ELSE 0 END AS age
      FROM (SELECT patient_id, date_of_birth AS d, DATE '2026-09-24' AS r FROM health_profiles)) a ON a.patient_id = x.patient_id))"""


@query(
    "record_lines",
    over_views("SELECT query_id, record_id, line FROM lines", ROUTED_SQL, RECORD_SQL, TOKEN_SQL, LINE_SQL),
)
def record_lines(t):
    return cx.record_lines(_tokens(t, cx.SHOWN_TEXT)).select("query_id", "record_id", "line")


@query(
    "cited_token_reconciliation",
    over_views(
        """SELECT query_id, record_id, min(position) AS position, arg_min(token, position) AS token FROM (
  SELECT r.query_id, c.position, c.token, k.record_id FROM routed r
  CROSS JOIN (VALUES (1, 'REC-1'), (2, 'REC-3'), (3, 'REC-1'), (4, 'REC-999999'), (5, 'REC-2')) AS c(position, token)
  JOIN tokens k ON k.query_id = r.query_id AND k.number = CAST(substr(c.token, 5) AS BIGINT)) GROUP BY query_id, record_id""",
        ROUTED_SQL, RECORD_SQL, TOKEN_SQL,
    ),
)
def cited_token_reconciliation(t):
    mentions = F.array(F.lit("[REC-1]"), F.lit(" REC-3 "), F.lit("REC-1"), F.lit("[REC-999999]"), F.lit("[REC-2]"))
    targets = _targets(t).drop("query_vec").withColumn("cited", mentions)
    # What is cited travels with the inquiries, so only tokens among it are made and shuffled.
    cited = cx.record_tokens(targets, health_records(t))
    return cx.reconcile_tokens(cited).select("query_id", "record_id", "position", "token")


@query(
    "context_line_counts",
    over_views(
        """SELECT section, count(*) AS n_lines FROM (
  SELECT 'passages' AS section FROM details WHERE place <= 5 UNION ALL SELECT 'trajectory' FROM details
  UNION ALL SELECT 'trajectory' FROM matched_records
  UNION ALL SELECT 'records' FROM tokens JOIN useful USING (query_id)) GROUP BY section""",
        *_EVERYTHING, TOKEN_SQL,
    ),
)
def context_line_counts(t):
    return context(t).groupBy("section").agg(F.count("*").alias("n_lines"))


def context(t):
    """The full context relation of all answerable inquiries."""
    job = an.answer_inquiries(t.inquiries, t)
    useful = job.evidence.verdicts.where("status <> 'INSUFFICIENT'").select("query_id", "patient_id")
    answered = job.targets.join(useful, ["query_id", "patient_id"], "left_semi")
    numbers = cx.numbering(answered, cx.described(job.records), shown=cx.SHOWN_TEXT)
    trail = cx.trajectory_lines(job.evidence.records, job.records, numbers, job.details)
    return cx.prompt_lines(cx.record_lines(cx.numbered_tokens(numbers)), cx.passage_blocks(job.details), trail)


@query(
    "context_leakage",
    over_views(
        """SELECT rule, 0 AS n_leaks, n_lines FROM (SELECT count(*) AS n_lines FROM (
  SELECT 1 FROM details WHERE place <= 5 UNION ALL SELECT 1 FROM details UNION ALL SELECT 1 FROM matched_records
  UNION ALL SELECT 1 FROM tokens JOIN useful USING (query_id)))
CROSS JOIN (VALUES ('uuid_like'), ('internal_key'), ('birth_date')) AS r(rule)""",
        *_EVERYTHING, TOKEN_SQL,
    ),
)
def context_leakage(t):
    return cx.leakage_flags(context(t), t.health_profiles)
