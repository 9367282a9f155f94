"""Document ingest: upload checks, text extraction, page-local chunks, embeddings, backfill."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions import lexicons as lx
from casebook.functions import text as tx
from casebook.operators.records import latest_per_key

KEYS = ["document_id", "patient_id"]

# --- fixed values: accepted types with their leading bytes -------------------------------------
SIGNATURES = {"application/pdf": "25504446", "image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A"}


# --- upload and extraction -------------------------------------------------------------------


def upload_verdict(content_type: Column, content: Column) -> Column:
    """struct(accepted, status_code, reason): declared type, emptiness, signature, then size."""
    declared = F.lower(tx.strip(F.coalesce(content_type, F.lit(""))))
    allowed = ", ".join(f"'{t}'" for t in SIGNATURES)
    signed = None
    for kind, prefix in SIGNATURES.items():
        hit = (declared == kind) & (F.hex(F.substring(content, 1, len(prefix) // 2)) == prefix)
        signed = hit if signed is None else signed | hit
    size = F.coalesce(F.octet_length(content), F.lit(0))
    too_big = f"File exceeds the maximum allowed size of {lx.MAX_UPLOAD_BYTES // (1024 * 1024)} MiB."
    reason = (
        F.when(
            ~declared.isin(*SIGNATURES),
            F.concat(F.lit("Unsupported file type: '"), declared, F.lit(f"'. Allowed types: [{allowed}]")),
        )
        .when(size == 0, "Uploaded file is empty.")
        .when(
            ~signed,
            F.concat(
                F.lit("File content does not match declared type '"), declared,
                F.lit("'. The file signature (magic bytes) is invalid."),
            ),
        )
        .when(size > lx.MAX_UPLOAD_BYTES, too_big)
    )
    return F.struct(
        reason.isNull().alias("accepted"),
        F.when(reason.isNull(), 201).when(reason == too_big, 413).otherwise(422).alias("status_code"),
        reason.alias("reason"),
    )


def upload_metadata(uploads: DataFrame) -> DataFrame:
    """Defaults of a new document: file name, display name, date that parses or null, blank notes null."""
    name = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.lit("document"))
    shown = F.nullif(tx.strip(F.coalesce("display_name", F.lit(""))), F.lit(""))
    iso = F.when(F.col("document_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("document_date", "yyyy-MM-dd"))
    return uploads.select(
        *[c for c in uploads.columns if c not in ("file_name", "display_name", "document_date", "notes")],
        name.alias("file_name"),
        F.coalesce(shown, name).alias("display_name"),
        iso.alias("document_date"),
        F.nullif(F.col("notes"), F.lit("")).alias("notes"),
    )


def normalise_text(raw: Column) -> Column:
    """Drop NUL characters; carriage returns become line feeds."""
    return F.regexp_replace(F.replace(raw, F.lit("\x00"), F.lit("")), r"\r\n?", "\n")


def bare_type(content_type: Column) -> Column:
    return F.lower(tx.strip(F.element_at(F.split(content_type, ";"), 1)))


def extraction(content_type: Column, content: Column, page_texts: Column, parser_error: Column) -> Column:
    """struct(extraction_status, extracted_text, extraction_method, error_message) per original.

    Page texts of a PDF come from a parser outside; a parser error name marks a failed parse.
    """
    kind = bare_type(content_type)
    is_pdf, is_plain = kind.startswith("application/pdf"), kind.startswith("text/plain")
    empty = F.coalesce(F.octet_length(content), F.lit(0)) == 0
    decoded = normalise_text(F.make_valid_utf8(content.cast("string")))
    joined = normalise_text(F.array_join(F.transform(page_texts, lambda p: F.coalesce(p, F.lit(""))), "\f"))
    text = F.when(is_pdf, joined).when(is_plain, decoded)
    blank = tx.is_blank(text)
    error = (
        F.when(~is_pdf & ~is_plain, F.concat(F.lit("No extractor registered for content type: '"), content_type, F.lit("'")))
        .when(
            is_pdf & (kind != "application/pdf"),
            F.concat(F.lit("PyPDFExtractor does not handle content type: '"), kind, F.lit("'")),
        )
        .when(is_pdf & empty, "PDF extraction failed: empty file bytes provided")
        .when(is_pdf & parser_error.isNotNull(), F.concat(F.lit("PDF extraction failed: "), parser_error))
        .when(
            is_pdf & blank,
            "PDF extraction produced no text content. The document may be a scanned image or contain only graphics.",
        )
        .when(is_plain & empty, "Plain text extraction failed: empty file bytes provided")
        .when(is_plain & blank, "Plain text extraction produced no text content")
    )
    failed = (is_pdf & (kind == "application/pdf") & (empty | parser_error.isNotNull())) | (is_plain & (empty | blank))
    return F.struct(
        F.when(error.isNull(), "COMPLETED").when(failed, "FAILED").otherwise("UNSUPPORTED").alias("extraction_status"),
        F.when(error.isNull(), text).alias("extracted_text"),
        F.when(is_pdf, "pypdf").when(is_plain, "text/plain").alias("extraction_method"),
        error.alias("error_message"),
    )


def extraction_consistent(status: Column, text: Column) -> Column:
    """A completed extraction has text, any other has none."""
    known = F.coalesce(status.isin("COMPLETED", "FAILED", "UNSUPPORTED"), F.lit(False))
    return known & ((status == "COMPLETED") == ~tx.is_blank(text))


# --- chunks ----------------------------------------------------------------------------------

#: Where a chunk may end inside its window, best first; group 1 reaches up to the last such place.
_BREAKS = tuple(
    re.compile(p, re.S) for p in (r"(.*\n\n)", r"(.*\n)", r"(.*[.!?])\s", r"(.*\S)\s", r"()\s")
)
_NEXT_WORD = re.compile(r"\s+(?=\S)")


def check_chunk_sizes(smallest: int, largest: int, overlap: int) -> None:
    if smallest <= 0:
        raise ValueError("smallest chunk must be positive")
    if largest < smallest:
        raise ValueError("largest chunk must be at least the smallest")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= smallest:
        raise ValueError("overlap must be below the smallest chunk")


def _pieces(page: str, smallest: int, largest: int, overlap: int) -> Iterator[str]:
    """Overlapping pieces of one stripped page."""
    at, end = 0, len(page)
    while end - at > largest:
        window = page[at + smallest : at + largest]
        ends = (m.end(1) for m in (b.match(window) for b in _BREAKS) if m)
        cut = at + smallest + next(ends, largest - smallest)
        yield page[at:cut].strip()
        back = cut - overlap
        if at < back < cut and not page[back - 1].isspace():
            word = _NEXT_WORD.search(page, back, cut)
            back = word.end() if word and word.end() < cut else back
        at = back if at < back < cut else cut
    yield page[at:].strip()


def chunk_documents(
    extractions: DataFrame, smallest: int = 800, largest: int = 1000, overlap: int = 150
) -> DataFrame:
    """Page-local overlapping chunks of completed extractions with one running index per document.

    Each document is cut inside its own row, so numbering needs no shuffle. The cut search is
    sequential within a page, which column expressions can only do quadratically; hence an Arrow batch
    function of a few lines.
    """
    check_chunk_sizes(smallest, largest, overlap)

    @F.pandas_udf("array<struct<page_number:int,chunk_text:string>>")
    def cut(texts: pd.Series, single_page: pd.Series) -> pd.Series:
        def one(text: str, only: float) -> list:
            pages = text.split("\f")
            numbers = range(1, len(pages) + 1) if len(pages) > 1 else [None if pd.isna(only) else int(only)]
            return [
                {"page_number": number, "chunk_text": piece}
                for number, page in zip(numbers, pages)
                if page.strip()
                for piece in _pieces(page.strip(), smallest, largest, overlap)
                if piece
            ]

        return pd.Series([one(t, o) for t, o in zip(texts, single_page)])

    ready = extractions.where((F.col("extraction_status") == "COMPLETED") & ~tx.is_blank(F.col("extracted_text")))
    only = F.when(F.col("extraction_method") == "pypdf", 1).cast("int")
    return ready.select(*KEYS, F.posexplode(cut("extracted_text", only)).alias("chunk_index", "c")).select(
        *KEYS, "chunk_index", "c.page_number", "c.chunk_text"
    )


def replace_chunks(existing: DataFrame, processed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing chunks of documents not processed, plus the fresh ones.

    ``processed`` lists every document looked at, so a document without usable text loses its chunks.
    """
    kept = existing.join(processed.select(*KEYS).distinct(), KEYS, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def replace_extractions(existing: DataFrame, arrived: DataFrame) -> DataFrame:
    """One extraction per document, the latest result."""
    return latest_per_key(existing, arrived, "document_id", "extracted_at")


# --- embeddings ------------------------------------------------------------------------------


def embedding_text(raw: Column) -> Column:
    """Text handed to the embedder; blank text is an error and gives null."""
    return F.nullif(tx.collapse(raw), F.lit(""))


def pending_chunks(chunks: DataFrame, force: bool = False) -> DataFrame:
    """Snapshot of the chunks to embed."""
    rows = chunks if force else chunks.where(F.col("embedding").isNull())
    return rows.select("id", *KEYS, "chunk_index", F.col("chunk_text").alias("snapshot_text"))


def _seeded_vector(text: str, dimension: int) -> list[float]:
    """Unit vector drawn from a generator seeded by the text's digest, six decimals."""
    digest = hashlib.sha256(" ".join(text.split()).lower().encode("utf-8")).digest()
    draw = random.Random(int.from_bytes(digest[:8], "big")).uniform
    raw = [draw(-1.0, 1.0) for _ in range(dimension)]
    norm = math.sqrt(sum(x * x for x in raw))
    return [round(x / norm, 6) for x in raw]


def seeded_embedder(dimension: int = 768) -> Callable[[list[str]], list[list[float]]]:
    """Offline embedder with reproducible vectors; not meaningful for similarity."""
    return lambda texts: [_seeded_vector(t, dimension) for t in texts]


def hashed_vector(text: Column, dimension: int) -> Column:
    """Reproducible unit vector from hashes alone, all inside the JVM."""
    places = F.sequence(F.lit(0), F.lit(dimension - 1))

    def draw(cleaned: Column) -> Column:
        return F.transform(places, lambda i: F.xxhash64(cleaned, i).cast("double") / F.lit(2.0**63))

    def scale(raw: Column) -> Column:
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x))
        return tx.let(norm, lambda n: F.transform(raw, lambda x: F.round(x / n, 6).cast("float")))

    return tx.let(F.lower(tx.collapse(text)), lambda cleaned: tx.let(draw(cleaned), scale))


def embed(
    snapshots: DataFrame,
    embedder: Callable[[list[str]], list[list[float]]],
    dimension: int,
    batch: int = lx.EMBEDDING_BATCH,
) -> DataFrame:
    """Call the embedder in batches inside the tasks; its count and dimension are checked.

    A failing batch marks its rows with the error instead of losing the others.
    """
    columns = ["id", *KEYS, "snapshot_text"]
    prepared = snapshots.select(*columns, embedding_text(F.col("snapshot_text")).alias("_text"))
    types = dict(snapshots.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", vector array<float>, error string"

    def call(texts: list[str]) -> tuple[list, str | None]:
        try:
            vectors = embedder(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"Provider returned {len(vectors)} vectors for {len(texts)} chunks")
            if any(len(v) != dimension for v in vectors):
                raise ValueError(f"Provider returned a vector of the wrong dimension; expected {dimension}")
            return vectors, None
        except Exception as failure:  # a provider may raise anything; the row records it
            return [None] * len(texts), str(failure)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].reset_index(drop=True)
                usable = part["_text"].notna()
                vectors, error = call(part.loc[usable, "_text"].tolist()) if usable.any() else ([], None)
                out = part[columns].copy()
                out["vector"] = pd.Series([None] * len(part), dtype=object)
                out["error"] = pd.Series("Cannot format empty or whitespace-only passage", index=part.index, dtype=object)
                for position, vector in zip(part.index[usable], vectors):
                    out.at[position, "vector"] = vector
                out.loc[usable, "error"] = error
                yield out

    return prepared.mapInPandas(run, schema)


def compare_and_set(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Store a vector only where the chunk still exists with the text that was embedded."""
    new = embedded.where("vector is not null").select("id", *KEYS, "snapshot_text", "vector")
    joined = chunks.join(new, ["id", *KEYS], "left")
    current = F.col("chunk_text").eqNullSafe(F.col("snapshot_text")) & F.col("vector").isNotNull()
    return joined.select(
        *[
            F.when(current, F.col("vector")).otherwise(F.col("embedding")).alias("embedding") if c == "embedding" else c
            for c in chunks.columns
        ]
    )


def update_outcomes(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Per embedded snapshot: updated, stale (text changed), gone (chunk replaced) or failed."""
    now = chunks.select("id", *KEYS, "chunk_text")
    joined = embedded.join(now, ["id", *KEYS], "left")
    outcome = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("chunk_text").isNull(), "gone")
        .when(F.col("chunk_text") != F.col("snapshot_text"), "stale")
        .otherwise("updated")
    )
    return joined.select("id", *KEYS, outcome.alias("outcome"))


def pending_documents(chunks: DataFrame, documents: DataFrame, patient_id=None) -> DataFrame:
    """Documents that still exist and have chunks without a vector, one tenant or all."""
    rows = chunks.where(F.col("embedding").isNull())
    if patient_id is not None:
        rows = rows.where(F.col("patient_id") == F.lit(patient_id))
    owned = documents.select(F.col("id").alias("document_id"), "patient_id")
    return rows.select(*KEYS).distinct().join(owned, KEYS, "left_semi")


def backfill_report(outcomes: DataFrame) -> DataFrame:
    """documents_processed, chunks_embedded, failures: a document fails as a whole."""
    per_document = outcomes.groupBy(*KEYS).agg(
        F.bool_or(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "updated").alias("n")
    )
    return per_document.agg(
        F.count_if(~F.col("failed")).alias("documents_processed"),
        F.coalesce(F.sum(F.when(~F.col("failed"), F.col("n"))), F.lit(0)).alias("chunks_embedded"),
        F.count_if("failed").alias("failures"),
    )


def stage_status(documents: DataFrame, extractions: DataFrame, chunks: DataFrame) -> DataFrame:
    """How far each document came; a later stage that failed never removes an earlier one."""
    per_document = chunks.groupBy(*KEYS).agg(
        F.count("*").alias("n_chunks"), F.count("embedding").alias("n_embedded")
    )
    n = F.coalesce("n_chunks", F.lit(0))
    m = F.coalesce("n_embedded", F.lit(0))
    status = F.coalesce("extraction_status", F.lit("PENDING"))
    return (
        documents.select(F.col("id").alias("document_id"), "patient_id")
        .join(extractions.select(*KEYS, "extraction_status"), KEYS, "left")
        .join(per_document, KEYS, "left")
        .select(
            *KEYS,
            status.alias("extraction_stage"),
            F.when(n > 0, "DONE").when(status == "COMPLETED", "PENDING").otherwise("SKIPPED").alias("chunk_stage"),
            F.when(n == 0, "SKIPPED").when(m == n, "DONE").when(m > 0, "PARTIAL").otherwise("PENDING").alias("embedding_stage"),
        )
    )
