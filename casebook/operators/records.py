"""Record tables: list scans, lookups, keyed writes and the merged record relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions import text as tx
from casebook.functions.skew import rank_within
from casebook.operators import timeline as tl

#: Record columns a question may ask for by name.
FIELDS = (
    "name", "allergen", "description", "status", "dosage", "frequency", "severity", "reaction", "notes",
    "is_chronic", "as_needed", "started_at", "ended_at", "recorded_at", "target_date", "date_of_birth",
    "biological_sex", "height_cm", "blood_group", "verification_state", "source_type",
)
MUTABLE_DOCUMENT_COLUMNS = ("display_name", "document_type", "document_date", "notes")

#: What a client may change of each record type; the origin of a record is resolved by the server.
MUTABLE_RECORD_COLUMNS = {
    "conditions": ("name", "status", "is_chronic", "started_at", "ended_at", "notes"),
    "medications": ("name", "dosage", "frequency", "status", "as_needed", "started_at", "ended_at", "notes"),
    "allergies": ("allergen", "reaction", "severity", "notes"),
    "symptoms": ("name", "severity", "started_at", "ended_at", "notes"),
    "patient_goals": ("description", "status", "target_date", "notes"),
}
PROVENANCE_COLUMNS = ("source_type", "source_id", "verification_state")
PROFILE_COLUMNS = ("date_of_birth", "biological_sex", "height_cm", "blood_group", "notes")
CHILD_TABLES = (
    "health_profiles", "conditions", "symptoms", "medications", "allergies", "patient_goals",
    "medical_documents", "document_extractions", "document_chunks",
)
RECORD_TABLES = ("conditions", "symptoms", "medications", "allergies", "patient_goals")


# --- scans -----------------------------------------------------------------------------------


def newest_first(table: DataFrame, recorded: str = "recorded_at") -> DataFrame:
    """Rows of every tenant, newest first, with their place in the tenant's list."""
    order = [F.col(recorded).desc(), F.col("created_at").desc(), F.col("id").asc()]
    return rank_within(table, ["patient_id"], order, "position")


def tenant_list(table: DataFrame, patient_id, recorded: str = "recorded_at") -> DataFrame:
    """One tenant's list; the tenant filter reaches the scan."""
    rows = table.where(F.col("patient_id") == F.lit(patient_id))
    return rows.orderBy(F.col(recorded).desc(), F.col("created_at").desc(), F.col("id").asc())


def lookup(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Requests (request_id, id, patient_id) with NOT_FOUND / FORBIDDEN / OK and the own row only."""
    rows = table.withColumnRenamed("patient_id", "_owner").withColumnRenamed("id", "_id")
    kept = [c for c in table.columns if c not in ("id", "patient_id")]
    joined = requests.join(rows, requests["id"] == rows["_id"], "left")
    outcome = (
        F.when(F.col("_id").isNull(), "NOT_FOUND")
        .when(F.col("_owner") != F.col("patient_id"), "FORBIDDEN")
        .otherwise("OK")
    )
    return joined.select(
        *requests.columns, outcome.alias("outcome"), *[F.when(outcome == "OK", F.col(c)).alias(c) for c in kept]
    )


# --- keyed writes ----------------------------------------------------------------------------


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "user_id") -> DataFrame:
    """Existing rows plus the new ones whose key is not taken; the lowest id wins among new rows."""
    others = [c for c in new.columns if c != key]
    fresh = new.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*")
    return existing.unionByName(fresh.join(existing, key, "left_anti").select(*existing.columns))


def upsert_profile(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Full outer merge: columns named in ``supplied`` overwrite, all others are kept."""
    old = existing.alias("old")
    new = changes.alias("new")
    merged = old.join(new, F.col("old.patient_id") == F.col("new.patient_id"), "full")
    values = [
        F.when(F.array_contains("new.supplied", c), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        for c in PROFILE_COLUMNS
    ]
    return merged.select(F.coalesce("old.patient_id", "new.patient_id").alias("patient_id"), *values)


def apply_changes(
    table: DataFrame, changes: DataFrame, allowed: tuple[str, ...] = MUTABLE_DOCUMENT_COLUMNS
) -> DataFrame:
    """Partial update by id within a tenant; only allowed columns named in ``supplied`` change."""
    new = changes.alias("new")
    old = table.alias("old")
    joined = old.join(
        new, (F.col("old.id") == F.col("new.id")) & (F.col("old.patient_id") == F.col("new.patient_id")), "left"
    )
    return joined.select(
        *[
            F.when(F.array_contains("new.supplied", c), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
            if c in allowed and c in changes.columns
            else F.col(f"old.{c}")
            for c in table.columns
        ]
    )


def patch_records(table: DataFrame, changes: DataFrame, kind: str, provenance: DataFrame | None = None) -> DataFrame:
    """Partial update of one record type: only its own mutable columns named in ``supplied`` change.

    ``provenance`` (id, patient_id, source_type, source_id, verification_state, violation) is the resolved origin of
    each change; it is written along, and a change with a violation leaves its record as it was.
    """
    allowed = MUTABLE_RECORD_COLUMNS[kind]
    if provenance is not None:
        sound = provenance.where("violation IS NULL").select("id", "patient_id", *PROVENANCE_COLUMNS)
        changes = changes.drop(*PROVENANCE_COLUMNS).join(sound, ["id", "patient_id"]).withColumn(
            "supplied", F.concat("supplied", F.array(*map(F.lit, PROVENANCE_COLUMNS)))
        )
        allowed += PROVENANCE_COLUMNS
    return apply_changes(table, changes, allowed)


def latest_per_key(existing: DataFrame, arrived: DataFrame, key: str, order: str) -> DataFrame:
    """Idempotent replace: one row per key, the latest arrival; ties keep the arrived row.

    ``max_by`` combines map-side, so a key delivered many times is reduced before the shuffle.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(arrived.withColumn("_new", F.lit(1)))
    row = F.struct(*existing.columns)
    best = both.groupBy(key).agg(F.max_by(row, F.struct("_new", order)).alias("_row"))
    return best.select("_row.*")


def delete_patients(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove the tenants in ``gone`` (patient_id) from every table."""
    return {name: rows.join(gone, "patient_id", "left_anti") for name, rows in tables.items()}


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove documents (document_id, patient_id) with their derived rows; unlink citing records."""
    keys = ["document_id", "patient_id"]
    out = dict(tables)
    for name in ("document_extractions", "document_chunks"):
        if name in tables:
            out[name] = tables[name].join(gone.select(*keys), keys, "left_anti")
    if "medical_documents" in tables:
        as_id = gone.select(F.col("document_id").alias("id"), "patient_id")
        out["medical_documents"] = tables["medical_documents"].join(as_id, ["id", "patient_id"], "left_anti")
    for name in RECORD_TABLES:
        if name in tables:
            out[name] = unlink_source(tables[name], gone)
    return out


def unlink_source(records: DataFrame, gone: DataFrame) -> DataFrame:
    """``source_id`` becomes null where the cited document is deleted; rows are kept."""
    lost = gone.select(F.col("document_id").alias("_lost")).distinct()
    joined = records.join(lost, records["source_id"] == lost["_lost"], "left")
    return joined.withColumn("source_id", F.when(F.col("_lost").isNull(), F.col("source_id"))).drop("_lost")


def with_extraction_status(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """Document listing enriched with its extraction status, null when none exists."""
    status = extractions.select(F.col("document_id").alias("id"), "patient_id", "extraction_status")
    return documents.drop("storage_key").join(status, ["id", "patient_id"], "left")


# --- merged record relation ------------------------------------------------------------------


def _micros(name: str) -> Column:
    return -F.unix_micros(name)


def _rows(table: DataFrame, domain: str, name: str | None, match: str | None) -> DataFrame:
    null = F.lit(None).cast("string")
    dated = "started_at" in table.columns
    fields = [
        F.when(F.col(c), "True").otherwise("False").alias(f"f_{c}")
        if dict(table.dtypes)[c] == "boolean"
        else F.col(c).cast("string").alias(f"f_{c}")
        for c in FIELDS
        if c in table.columns
    ]
    return table.select(
        "patient_id",
        F.lit(domain).alias("domain"),
        F.col("id").cast("string").alias("record_id"),
        (F.col(name) if name else null).alias("name"),
        (F.col(match) if match else null).alias("match_text"),
        (F.col("status") if "status" in table.columns else null).alias("status"),
        (F.col("started_at") if dated else F.lit(None).cast("date")).alias("started_at"),
        (F.col("ended_at") if dated else F.lit(None).cast("date")).alias("ended_at"),
        (F.col("started_at") if dated else F.lit(None).cast("date")).alias("clinical_date"),
        (_micros("recorded_at") if "recorded_at" in table.columns else F.lit(0).cast("long")).alias("order1"),
        _micros("created_at").alias("order2"),
        F.col("id").cast("string").alias("order3"),
        *fields,
    )


def event_records(event_rows: DataFrame) -> DataFrame:
    """Timeline events in the shape of records, carrying their own identifier."""
    uploaded = F.col("event_type") == "DOCUMENT_UPLOADED"
    return event_rows.select(
        "patient_id",
        F.lit("timeline").alias("domain"),
        tx.event_uuid(F.col("source_type"), F.col("source_id"), F.col("event_type")).alias("record_id"),
        F.when(~uploaded, tx.event_day(F.col("event_date"))).alias("clinical_date"),
        (-tl.order_number(F.col("event_date"))).alias("order1"),
        F.coalesce(_micros("created_at"), F.lit(2**63 - 1)).alias("order2"),
        F.concat_ws("\x01", "source_type", F.col("source_id").cast("string"), "event_type").alias("order3"),
        "event_date",
        "event_type",
        "event_state",
        "title",
        "description",
        "source_type",
        F.col("source_id").cast("string").alias("source_id"),
    )


def health_records(tables, domains: tuple[str, ...] | None = None) -> DataFrame:
    """All record domains and timeline events as one relation keyed by tenant and domain."""
    builders = {
        "profile": lambda: _rows(tables.health_profiles, "profile", None, None),
        "conditions": lambda: _rows(tables.conditions, "conditions", "name", "name"),
        "medications": lambda: _rows(tables.medications, "medications", "name", "name"),
        "allergies": lambda: _rows(tables.allergies, "allergies", "allergen", "allergen"),
        "symptoms": lambda: _rows(tables.symptoms, "symptoms", "name", "name"),
        "goals": lambda: _rows(tables.patient_goals, "goals", None, "description"),
        "timeline": lambda: event_records(tl.events_of(tables)),
    }
    merged = None
    for domain in domains or tuple(builders):
        rows = builders[domain]()
        merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
    for column in [f"f_{c}" for c in FIELDS] + ["title", "description", "event_type", "event_state",
                                               "event_date", "source_type", "source_id"]:
        if column not in merged.columns:
            merged = merged.withColumn(column, F.lit(None).cast("string"))
    return merged


def record_field(attribute: Column) -> Column:
    """Value of the record column an attribute names, null when absent."""
    chain = None
    for c in FIELDS:
        value = F.col(f"f_{c}")
        chain = F.when(attribute == c, value) if chain is None else chain.when(attribute == c, value)
    return chain
