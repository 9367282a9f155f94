"""Queries over ingest: upload checks, extraction, chunks, embeddings, backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.operators import ingest as ig
from casebook.plans.oracle_views import over_views
from casebook.plans.registry import query

_MAGIC_ERROR = "concat('File content does not match declared type ''', ct, '''. The file signature (magic bytes) is invalid.')"


@query(
    "upload_verdicts",
    f"""SELECT page_id, reason IS NULL AS accepted, CASE WHEN reason IS NULL THEN 201 ELSE 422 END AS status_code, reason
FROM (SELECT page_id, CASE WHEN ct = 'text/html'
    THEN 'Unsupported file type: ''text/html''. Allowed types: [''application/pdf'', ''image/jpeg'', ''image/png'']'
    WHEN kind = 'empty' THEN 'Uploaded file is empty.' WHEN ct <> kind THEN {_MAGIC_ERROR} END AS reason
  FROM (SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'text/html'
      ELSE 'application/pdf' END AS ct, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png'
      WHEN 2 THEN 'empty' ELSE 'image/jpeg' END AS kind FROM pages))""",
)
def upload_verdicts(t):
    files = t.table("pages").selectExpr(
        "page_id",
        "CASE page_id % 5 WHEN 1 THEN ' image/png' WHEN 2 THEN 'IMAGE/JPEG' WHEN 3 THEN 'text/html'"
        " ELSE 'application/pdf' END AS content_type",
        "CASE page_id % 4 WHEN 0 THEN CAST(concat('%PDF-1.7 ', html) AS BINARY)"
        " WHEN 1 THEN concat(unhex('89504E470D0A1A0A'), CAST(html AS BINARY)) WHEN 2 THEN CAST('' AS BINARY)"
        " ELSE concat(unhex('FFD8FFE0'), CAST(html AS BINARY)) END AS content",
    )
    return files.select("page_id", ig.upload_verdict(F.col("content_type"), F.col("content")).alias("v")).select(
        "page_id", "v.*"
    )


@query(
    "upload_metadata",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'document' ELSE concat('f', doc_id, '.pdf') END AS file_name,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'document' ELSE concat('f', doc_id, '.pdf') END
    ELSE concat('Scan ', doc_id) END AS display_name,
  CASE doc_id % 5 WHEN 1 THEN '2024-03-01' END AS document_date,
  CASE WHEN doc_id % 2 = 0 THEN source END AS notes FROM documents""",
)
def upload_metadata(t):
    uploads = t.documents.selectExpr(
        "doc_id", "CASE WHEN doc_id % 4 <> 0 THEN concat('f', doc_id, '.pdf') END AS file_name",
        "CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE concat(' Scan ', doc_id, ' ') END AS display_name",
        "CASE doc_id % 5 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-03-01' WHEN 2 THEN 'yesterday' WHEN 3 THEN '2024-3-1' END"
        " AS document_date",
        "CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS notes",
    )
    return ig.upload_metadata(uploads).withColumn("document_date", F.col("document_date").cast("string"))


@query(
    "text_extraction",
    r"""SELECT page_id, CASE WHEN err IS NULL THEN 'COMPLETED' WHEN k = 'text/html' THEN 'UNSUPPORTED'
    WHEN k = 'pdf' AND err LIKE '%produced no text%' THEN 'UNSUPPORTED' ELSE 'FAILED' END AS extraction_status,
  CASE WHEN err IS NULL THEN md5(CASE k WHEN 'pdf' THEN replace(html, '<', chr(12)) ELSE replace(html, '>', '>' || chr(10)) END) END AS digest,
  CASE k WHEN 'pdf' THEN 'pypdf' WHEN 'plain' THEN 'text/plain' END AS extraction_method, err AS error_message
FROM (SELECT page_id, html, k, CASE
    WHEN k = 'text/html' THEN 'No extractor registered for content type: ''text/html'''
    WHEN k = 'pdf' AND page_id % 10 = 3 THEN 'PDF extraction failed: empty file bytes provided'
    WHEN k = 'pdf' AND page_id % 10 = 7 THEN 'PDF extraction failed: PdfReadError'
    WHEN k = 'pdf' AND page_id % 10 = 9
      THEN 'PDF extraction produced no text content. The document may be a scanned image or contain only graphics.'
    WHEN k = 'plain' AND page_id % 10 = 3 THEN 'Plain text extraction failed: empty file bytes provided' END AS err
  FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'pdf' WHEN 2 THEN 'text/html' ELSE 'pdf' END AS k FROM pages))""",
)
def text_extraction(t):
    files = t.table("pages").selectExpr(
        "page_id",
        "CASE page_id % 4 WHEN 0 THEN 'Text/Plain; charset=utf-8' WHEN 2 THEN 'text/html' ELSE 'application/pdf' END AS ct",
        "CASE WHEN page_id % 10 = 3 THEN CAST('' AS BINARY) ELSE CAST(replace(html, '>', '>\\r\\n') AS BINARY) END AS content",
        "CASE WHEN page_id % 10 = 9 THEN array(' ', NULL) ELSE split(html, '<') END AS page_texts",
        "CASE WHEN page_id % 10 = 7 THEN 'PdfReadError' END AS parser_error",
    )
    e = ig.extraction(F.col("ct"), F.col("content"), F.col("page_texts"), F.col("parser_error"))
    return files.select("page_id", e.alias("e")).select(
        "page_id", "e.extraction_status", F.md5("e.extracted_text").alias("digest"), "e.extraction_method", "e.error_message"
    )


def _paged(t):
    """Completed extractions, every third with its lines set as pages."""
    return t.document_extractions.withColumn(
        "extracted_text",
        F.when(F.col("document_id") % 3 == 0, F.translate("extracted_text", "\n", "\f")).otherwise(F.col("extracted_text")),
    )


_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_PIECES = (
    r"""pages_of AS (
  SELECT document_id, patient_id, p.page_no, CASE WHEN n_pages > 1 THEN p.page_no
      WHEN extraction_method = 'pypdf' THEN 1 END AS page_number, """
    + _STRIP.format("p.page")
    + r""" AS page
  FROM (SELECT *, len(string_split(body, chr(12))) AS n_pages,
      unnest(list_transform(string_split(body, chr(12)), lambda x, i: {'page': x, 'page_no': i})) AS p
    FROM (SELECT *, CASE WHEN document_id % 3 = 0 THEN replace(extracted_text, chr(10), chr(12)) ELSE extracted_text END AS body
      FROM document_extractions WHERE extraction_status = 'COMPLETED'))),
walk AS (
  SELECT document_id, patient_id, page_no, page_number, page, 0::BIGINT AS step, 0::BIGINT AS pos, NULL::BIGINT AS cut
  FROM pages_of WHERE page <> ''
  UNION ALL
  SELECT document_id, patient_id, page_no, page_number, page, step + 1,
    CASE WHEN back > pos AND back < cut THEN back ELSE cut END, NULL
  FROM (SELECT *, CASE WHEN raw_back > pos AND raw_back < cut AND NOT regexp_matches(substr(page, raw_back, 1), '\s')
          AND regexp_matches(seg, '\s+\S') AND raw_back + hop < cut THEN raw_back + hop ELSE raw_back END AS back
    FROM (SELECT *, cut - 150 AS raw_back, substr(page, cut - 149, 150) AS seg,
        length(regexp_extract(substr(page, cut - 149, 150), '^(\S*\s+)\S', 1)) AS hop
      FROM (SELECT document_id, patient_id, page_no, page_number, page, step, pos, CASE
          WHEN contains(w, chr(10) || chr(10)) THEN pos + 800 + length(regexp_extract(w, '(?s)^(.*\n\n)', 1))
          WHEN contains(w, chr(10)) THEN pos + 800 + length(regexp_extract(w, '(?s)^(.*\n)', 1))
          WHEN regexp_matches(w, '[.!?]\s') THEN pos + 800 + length(regexp_extract(w, '(?s)^(.*[.!?])\s', 1))
          WHEN regexp_matches(w, '\S\s') THEN pos + 800 + length(regexp_extract(w, '(?s)^(.*\S)\s', 1))
          WHEN regexp_matches(w, '\s') THEN pos + 800 ELSE pos + 1000 END AS cut
        FROM (SELECT *, substr(page, pos + 801, 200) AS w FROM walk WHERE length(page) - pos > 1000))))),
cut_pieces AS (
  SELECT document_id, page_no, page_number, step, pos, """
    + _STRIP.format(
        "substr(page, pos + 1, coalesce(lead(0) OVER w, 0) + CASE WHEN length(page) - pos <= 1000 THEN length(page) - pos ELSE c - pos END)"
    )
    + r""" AS chunk_text
  FROM (SELECT *, CASE
          WHEN contains(w, chr(10) || chr(10)) THEN pos + 800 + length(regexp_extract(w, '(?s)^(.*\n\n)', 1))
          WHEN contains(w, chr(10)) THEN pos + 800 + length(regexp_extract(w, '(?s)^(.*\n)', 1))
          WHEN regexp_matches(w, '[.!?]\s') THEN pos + 800 + length(regexp_extract(w, '(?s)^(.*[.!?])\s', 1))
          WHEN regexp_matches(w, '\S\s') THEN pos + 800 + length(regexp_extract(w, '(?s)^(.*\S)\s', 1))
          WHEN regexp_matches(w, '\s') THEN pos + 800 ELSE pos + 1000 END AS c
    FROM (SELECT *, substr(page, pos + 801, 200) AS w FROM walk))
  WINDOW w AS (PARTITION BY document_id, page_no ORDER BY step))"""
)


@query(
    "document_pieces",
    over_views(
        "SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_no, step) - 1 AS chunk_index, page_number,"
        " length(chunk_text) AS n_chars, md5(chunk_text) AS digest FROM cut_pieces WHERE chunk_text <> ''",
        _PIECES,
    ),
)
def document_pieces(t):
    return ig.chunk_documents(_paged(t)).select(
        "document_id", "chunk_index", "page_number", F.length("chunk_text").alias("n_chars"), F.md5("chunk_text").alias("digest")
    )


@query(
    "chunk_replace",
    over_views(
        """SELECT document_id, count(*) AS n_chunks, count(embedding) AS n_embedded FROM (
  SELECT document_id, embedding FROM document_chunks WHERE document_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, NULL FROM labels WHERE quality = 1) GROUP BY document_id"""
    ),
)
def chunk_replace(t):
    looked_at = t.table("labels").selectExpr("doc_id AS document_id", f"{t.tenant('doc_id')} AS patient_id", "quality")
    fresh = looked_at.where("quality = 1").selectExpr(
        "document_id", "patient_id", "document_id * 100000L AS id", "0 AS chunk_index", "'fresh text' AS chunk_text"
    )
    out = ig.replace_chunks(t.document_chunks, looked_at, fresh)
    return out.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("n_embedded"))


@query(
    "embedding_texts",
    over_views(
        r"SELECT id, md5(trim(regexp_replace(chunk_text, '\s+', ' ', 'g'))) AS digest FROM document_chunks"
    ),
)
def embedding_texts(t):
    return t.document_chunks.select("id", F.md5(ig.embedding_text(F.col("chunk_text"))).alias("digest"))


@query(
    "chunks_to_embed",
    over_views("SELECT id, document_id, chunk_index FROM document_chunks WHERE embedding IS NULL"),
)
def chunks_to_embed(t):
    return ig.pending_chunks(t.document_chunks).select("id", "document_id", "chunk_index")


@query("documents_to_embed", over_views("SELECT DISTINCT document_id, patient_id FROM document_chunks WHERE embedding IS NULL"))
def documents_to_embed(t):
    return ig.pending_documents(t.document_chunks, t.medical_documents)


@query(
    "seeded_embeddings",
    over_views("SELECT id, 64 AS n_values, true AS unit_length FROM document_chunks WHERE embedding IS NULL"),
)
def seeded_embeddings(t):
    made = ig.embed(ig.pending_chunks(t.document_chunks), ig.seeded_embedder(64), 64)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return made.select("id", F.size("vector").alias("n_values"), (F.abs(norm - 1) < 1e-4).alias("unit_length"))


@query(
    "hashed_embeddings",
    over_views("SELECT id, 32 AS n_values, true AS unit_length FROM document_chunks"),
)
def hashed_embeddings(t):
    made = t.document_chunks.select("id", ig.hashed_vector(F.col("chunk_text"), 32).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return made.select("id", F.size("vector").alias("n_values"), (F.abs(norm - 1) < 1e-4).alias("unit_length"))


def _outcomes(t):
    """Chunks embedded while labelled documents changed (quality 0) or disappeared (toxic)."""
    made = ig.embed(ig.pending_chunks(t.document_chunks), ig.seeded_embedder(16), 16)
    labels = t.table("labels").selectExpr("doc_id AS document_id", "quality", "toxic")
    now = (
        t.document_chunks.join(labels, "document_id", "left")
        .where("toxic IS NULL OR toxic = 0")
        .withColumn("chunk_text", F.when(F.col("quality") == 0, F.concat("chunk_text", F.lit(" edited"))).otherwise(F.col("chunk_text")))
    )
    return ig.update_outcomes(now, made)


_OUTCOME_SQL = """outcomes AS (
  SELECT c.id, c.document_id, CASE WHEN l.toxic = 1 THEN 'gone' WHEN l.quality = 0 THEN 'stale' ELSE 'updated' END AS outcome
  FROM document_chunks c LEFT JOIN labels l ON l.doc_id = c.document_id WHERE c.embedding IS NULL)"""


@query("embedding_outcomes", over_views("SELECT id, outcome FROM outcomes", _OUTCOME_SQL))
def embedding_outcomes(t):
    return _outcomes(t).select("id", "outcome")


@query(
    "backfill_report",
    over_views(
        "SELECT count(DISTINCT document_id) AS documents_processed,"
        " CAST(count(*) FILTER (WHERE outcome = 'updated') AS BIGINT) AS chunks_embedded, 0 AS failures FROM outcomes",
        _OUTCOME_SQL,
    ),
)
def backfill_report(t):
    return ig.backfill_report(_outcomes(t))


@query(
    "ingest_stages",
    over_views(
        """SELECT d.id AS document_id, e.extraction_status AS extraction_stage, 'DONE' AS chunk_stage,
  CASE WHEN m = n THEN 'DONE' WHEN m > 0 THEN 'PARTIAL' ELSE 'PENDING' END AS embedding_stage
FROM medical_documents d JOIN document_extractions e ON e.document_id = d.id
JOIN (SELECT document_id, count(*) AS n, count(embedding) AS m FROM document_chunks GROUP BY document_id) c ON c.document_id = d.id"""
    ),
)
def ingest_stages(t):
    return ig.stage_status(t.medical_documents, t.document_extractions, t.document_chunks).drop("patient_id")


@query(
    "extraction_consistency",
    over_views(
        "SELECT extraction_status, count(*) AS n, count(*) AS n_consistent FROM document_extractions GROUP BY extraction_status"
    ),
)
def extraction_consistency(t):
    ok = ig.extraction_consistent(F.col("extraction_status"), F.col("extracted_text"))
    return t.document_extractions.groupBy("extraction_status").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_consistent")
    )
