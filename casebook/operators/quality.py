"""Provenance resolution and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions import lexicons as lx

# --- fixed values: closed value sets -----------------------------------------------------------
SOURCE_TYPES = ("PATIENT_REPORTED", "SOURCE_DOCUMENT", "CLINICIAN_CONFIRMED")
RESERVED_SOURCE_TYPES = ("CLINICIAN_CONFIRMED",)
VERIFICATION_STATES = ("PATIENT_REPORTED", "SOURCE_RECORDED", "CLINICIAN_CONFIRMED", "AI_DERIVED", "UNCERTAIN")
EXTRACTION_STATES = ("COMPLETED", "FAILED", "UNSUPPORTED")
STATUS_VALUES = {
    "conditions": ("active", "resolved"),
    "medications": ("active", "stopped"),
    "patient_goals": ("active", "achieved", "abandoned"),
}
SEVERITY_VALUES = {
    "symptoms": ("mild", "moderate", "severe"),
    "allergies": ("mild", "moderate", "severe", "life_threatening"),
}
#: Keys that writes without a source document are dealt over.
NO_SOURCE_KEYS = 10_000
#: (column, shortest, longest, required)
LENGTH_RULES = {
    "conditions": (("name", 1, 255, True),),
    "symptoms": (("name", 1, 255, True),),
    "medications": (("name", 1, 255, True), ("dosage", 0, 100, False), ("frequency", 0, 100, False)),
    "allergies": (("allergen", 1, 255, True), ("reaction", 0, 255, False)),
    "patient_goals": (("description", 1, None, True),),
}


def resolve_provenance(changes: DataFrame, documents: DataFrame) -> DataFrame:
    """Server-side provenance of record writes.

    ``changes`` carries record_id, patient_id, is_create, has_source_type, has_source_id, source_type,
    source_id, old_source_type, old_source_id, and what the client sent as sent_verification_state.
    Adds the resolved source_type, source_id, verification_state and the reason a write is refused.
    """
    held = F.struct("id", F.lit(0).alias("at")).alias("_held")
    owned = documents.select(held, F.col("patient_id").alias("_owner"))
    create = F.col("is_create")
    untouched = ~create & ~F.col("has_source_type") & ~F.col("has_source_id")
    kind = F.when(create, F.coalesce(F.nullif(F.col("source_type"), F.lit("")), F.lit("PATIENT_REPORTED"))).otherwise(
        F.when(F.col("has_source_type"), F.col("source_type")).otherwise(F.col("old_source_type"))
    )
    source = F.when(create | F.col("has_source_id"), F.col("source_id")).otherwise(F.col("old_source_id"))
    staged = changes.withColumn("_kind", F.when(untouched, F.col("old_source_type")).otherwise(kind)).withColumn(
        "_source", F.when(untouched, F.col("old_source_id")).otherwise(source)
    )
    # Writes without a source match no document: they are dealt over many keys instead of meeting in one task.
    dealt = 1 + F.pmod(F.xxhash64("record_id", "patient_id"), F.lit(NO_SOURCE_KEYS)).cast("int")
    wanted = F.struct(F.col("_source").alias("id"), F.when(F.col("_source").isNull(), dealt).otherwise(0).alias("at"))
    joined = staged.withColumn("_wanted", wanted).drop("_source").join(owned, F.col("_wanted") == F.col("_held"), "left")
    joined = joined.withColumn("_source", F.col("_wanted.id"))
    missing_owner = F.col("_source").isNotNull() & ~F.col("_owner").eqNullSafe(F.col("patient_id"))
    sent_reserved = F.coalesce(F.col("source_type").isin(*RESERVED_SOURCE_TYPES), F.lit(False))
    reason = (
        F.when(
            F.col("sent_verification_state").isNotNull(),
            "verification_state is server-owned and must not be submitted by clients.",
        )
        .when(
            sent_reserved,
            F.concat(F.lit("source_type '"), F.col("source_type"), F.lit("' is reserved and cannot be submitted by clients.")),
        )
        .when(untouched, None)
        .when(
            (F.col("_kind") == "PATIENT_REPORTED") & F.col("_source").isNotNull(),
            "source_id must be null when source_type is PATIENT_REPORTED.",
        )
        .when(
            (F.col("_kind") == "SOURCE_DOCUMENT") & F.col("_source").isNull(),
            "source_id is required when source_type is SOURCE_DOCUMENT.",
        )
        .when(
            ~F.coalesce(F.col("_kind").isin("PATIENT_REPORTED", "SOURCE_DOCUMENT"), F.lit(False)),
            F.concat(F.lit("Unsupported source_type value: '"), F.coalesce("_kind", F.lit("None")), F.lit("'.")),
        )
        .when(missing_owner, "source_id does not reference a valid document owned by this patient.")
    )
    state = F.when(F.col("_kind") == "PATIENT_REPORTED", "PATIENT_REPORTED").when(
        F.col("_kind") == "SOURCE_DOCUMENT", "SOURCE_RECORDED"
    )
    ok = reason.isNull()
    return joined.select(
        "record_id",
        "patient_id",
        F.when(ok, F.col("_kind")).alias("source_type"),
        F.when(ok, F.col("_source")).alias("source_id"),
        F.when(ok, state).alias("verification_state"),
        reason.alias("violation"),
    )


def document_payload_violation(payload: DataFrame) -> DataFrame:
    """Document writes that name provenance fields; ``fields`` lists the names the client sent."""
    locked = F.sort_array(F.array_intersect("fields", F.array(*[F.lit(f) for f in ("source_id", "source_type", "verification_state")])))
    return payload.withColumn(
        "violation",
        F.when(
            F.size(locked) > 0,
            F.concat(
                F.lit("Medical document payloads must not include provenance fields: "), F.array_join(locked, ", "),
                F.lit(". These values are locked server-side."),
            ),
        ),
    )


def _outside(column: str, allowed: tuple[str, ...], required: bool = True) -> Column:
    bad = ~F.col(column).isin(*allowed)
    return F.coalesce(bad, F.lit(required))


def _report(table: str, rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule in one pass over the table."""
    counts = rows.agg(F.count("*").alias("n_rows"), *[F.count_if(v).alias(k) for k, v in rules.items()])
    pairs = ", ".join(f"'{k}', {k}" for k in rules)
    return counts.selectExpr(f"'{table}' AS table_name", "n_rows", f"stack({len(rules)}, {pairs}) AS (rule, n_bad)")


def check_rules(tables) -> DataFrame:
    """Closed value sets, extraction consistency, non-blank chunks and the document provenance lock."""
    parts = []
    for name in ("conditions", "symptoms", "medications", "allergies", "patient_goals"):
        rules = {
            "source_type": _outside("source_type", SOURCE_TYPES),
            "verification_state": _outside("verification_state", VERIFICATION_STATES),
        }
        if name in STATUS_VALUES:
            rules["status"] = _outside("status", STATUS_VALUES[name])
        if name in SEVERITY_VALUES:
            rules["severity"] = _outside("severity", SEVERITY_VALUES[name], required=False)
        parts.append(_report(name, getattr(tables, name), rules))
    parts.append(
        _report(
            "medical_documents",
            tables.medical_documents,
            {
                "document_type": _outside("document_type", lx.DOCUMENT_TYPES),
                "provenance_lock": _outside("source_type", ("PATIENT_REPORTED",))
                | _outside("verification_state", ("PATIENT_REPORTED",)),
            },
        )
    )
    text = F.length(F.trim(F.coalesce("extracted_text", F.lit(""))))
    completed = F.col("extraction_status") == "COMPLETED"
    parts.append(
        _report(
            "document_extractions",
            tables.document_extractions,
            {
                "extraction_status": _outside("extraction_status", EXTRACTION_STATES),
                "status_text": (completed & (text == 0)) | (~completed & (text > 0)),
            },
        )
    )
    parts.append(
        _report(
            "document_chunks", tables.document_chunks,
            {"blank_chunk": F.length(F.trim(F.coalesce("chunk_text", F.lit("")))) == 0},
        )
    )
    return _stack(parts)


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def length_rules(tables) -> DataFrame:
    """Required fields and length limits per record table."""
    parts = []
    for table, limits in LENGTH_RULES.items():
        rules = {}
        for column, low, high, required in limits:
            size = F.length(column)
            bad = size < low
            if high is not None:
                bad = bad | (size > high)
            rules[f"{column}_length"] = F.coalesce(bad, F.lit(required))
        parts.append(_report(table, getattr(tables, table), rules))
    return _stack(parts)


def uniqueness_report(tables) -> DataFrame:
    """Keys that occur more than once, per rule."""
    keys = {
        "patient_user": (tables.patients, ["user_id"]),
        "profile_per_patient": (tables.health_profiles, ["patient_id"]),
        "extraction_per_document": (tables.document_extractions, ["document_id"]),
        "chunk_index_per_document": (tables.document_chunks, ["document_id", "chunk_index"]),
        "document_in_tenant": (tables.medical_documents, ["id", "patient_id"]),
    }
    parts = [
        rows.groupBy(*columns)
        .count()
        .agg(F.count("*").alias("n_keys"), F.count_if(F.col("count") > 1).alias("n_repeated"))
        .select(F.lit(rule).alias("rule"), "n_keys", "n_repeated")
        for rule, (rows, columns) in keys.items()
    ]
    return _stack(parts)


def orphans(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Child rows whose document does not exist in the same tenant."""
    owned = documents.select(F.col("id").alias("document_id"), "patient_id")
    return children.join(owned, ["document_id", "patient_id"], "left_anti")


def source_violations(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Records citing a document that is missing or belongs to another tenant."""
    owned = documents.select(F.col("id").alias("_doc"), F.col("patient_id").alias("_owner"))
    cited = records.where(F.col("source_id").isNotNull())
    joined = cited.join(owned, cited["source_id"] == owned["_doc"], "left")
    reason = F.when(F.col("_doc").isNull(), "missing").when(F.col("_owner") != F.col("patient_id"), "foreign")
    return joined.select("id", "patient_id", "source_id", reason.alias("reason")).where("reason is not null")


def orphan_report(tables) -> DataFrame:
    """Orphans and cross-tenant citations counted per rule."""
    parts = [
        orphans(getattr(tables, name), tables.medical_documents)
        .agg(F.count("*").alias("n_bad"))
        .select(F.lit(f"{name}_orphan").alias("rule"), "n_bad")
        for name in ("document_extractions", "document_chunks")
    ]
    bad = source_violations(tables.conditions, tables.medical_documents).agg(
        F.count_if(F.col("reason") == "missing").alias("conditions_source_missing"),
        F.count_if(F.col("reason") == "foreign").alias("conditions_source_foreign"),
    )
    parts.append(
        bad.selectExpr(
            "stack(2, 'conditions_source_missing', conditions_source_missing,"
            " 'conditions_source_foreign', conditions_source_foreign) AS (rule, n_bad)"
        )
    )
    return _stack(parts)
