"""Timeline: every dated fact of five record tables as one event relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions import text as tx
from casebook.functions.skew import rank_within

EVENT_COLUMNS = (
    "patient_id", "event_date", "event_type", "event_state", "title", "description", "source_type",
    "source_id", "created_at",
)


def _event(when: Column, kind: str, state: Column, title: Column, description: Column) -> Column:
    return F.struct(
        when.alias("event_date"),
        F.lit(kind).alias("event_type"),
        state.alias("event_state"),
        title.alias("title"),
        description.alias("description"),
    )


def _emit(table: DataFrame, source: str, *candidates: Column) -> DataFrame:
    """One scan per table: the dated candidates of each row become event rows."""
    dated = F.filter(F.array(*candidates), lambda e: e["event_date"].isNotNull())
    return (
        table.select(
            "patient_id", F.col("id").alias("source_id"), "created_at", F.explode(dated).alias("e")
        )
        .select("patient_id", "e.*", F.lit(source).alias("source_type"), "source_id", "created_at")
        .select(*EVENT_COLUMNS)
    )


def _day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd")


def _present(prefix: str, name: str) -> Column:
    return F.when(F.length(name) > 0, F.concat(F.lit(prefix), F.col(name)))


def _described(*parts: Column) -> Column:
    """Non-empty parts joined by a bar, null when there are none."""
    joined = F.concat_ws(" | ", *parts)
    return F.nullif(joined, F.lit(""))


def events(
    conditions: DataFrame,
    symptoms: DataFrame,
    medications: DataFrame,
    documents: DataFrame,
    goals: DataFrame,
) -> DataFrame:
    """Union of the event projections, unordered."""
    past, neutral = F.lit("historical"), F.lit("neutral")
    active = F.when(F.col("status") == "active", "current").otherwise("historical")
    name, notes = F.col("name"), F.col("notes")
    parts = [
        _emit(
            conditions, "CONDITION",
            _event(_day("started_at"), "CONDITION_STARTED", active, name, notes),
            _event(_day("ended_at"), "CONDITION_RESOLVED", past, F.concat(name, F.lit(" (Resolved)")), notes),
        ),
        _emit(
            symptoms, "SYMPTOM",
            _event(
                tx.iso_utc(F.col("recorded_at")), "SYMPTOM_RECORDED", neutral, name,
                _described(_present("Severity: ", "severity"), _present("", "notes")),
            ),
        ),
        _emit(
            medications, "MEDICATION",
            _event(
                _day("started_at"), "MEDICATION_STARTED", active, name,
                _described(_present("Dosage: ", "dosage"), _present("Frequency: ", "frequency"), _present("", "notes")),
            ),
            _event(_day("ended_at"), "MEDICATION_STOPPED", past, F.concat(name, F.lit(" (Stopped)")), notes),
        ),
        _documents(documents),
        _emit(goals, "GOAL", _event(tx.iso_utc(F.col("recorded_at")), "GOAL_RECORDED", active, F.col("description"), notes)),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _documents(documents: DataFrame) -> DataFrame:
    dated = F.col("document_date").isNotNull()
    return (
        documents.where(dated | F.col("uploaded_at").isNotNull())
        .select(
            "patient_id",
            F.when(dated, _day("document_date")).otherwise(tx.iso_utc(F.col("uploaded_at"))).alias("event_date"),
            F.when(dated, "DOCUMENT_DATED").otherwise("DOCUMENT_UPLOADED").alias("event_type"),
            F.lit("neutral").alias("event_state"),
            F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.col("file_name")).alias("title"),
            F.coalesce(
                F.nullif(F.col("notes"), F.lit("")), F.concat(F.lit("Type: "), F.col("document_type"))
            ).alias("description"),
            F.lit("DOCUMENT").alias("source_type"),
            F.col("id").alias("source_id"),
            "created_at",
        )
    )


def events_of(tables) -> DataFrame:
    """Events over an object exposing the five record tables."""
    return events(
        tables.conditions, tables.symptoms, tables.medications, tables.medical_documents, tables.patient_goals
    )


def event_order() -> list[Column]:
    """Total order of one tenant's timeline; a missing creation time sorts as the earliest."""
    return [
        F.col("event_date").desc(),
        F.col("created_at").desc_nulls_last(),
        F.col("source_type").asc(),
        F.col("source_id").cast("string").asc(),
        F.col("event_type").asc(),
    ]


def ordered(event_rows: DataFrame) -> DataFrame:
    """Events of all tenants in timeline order; the range sort splits a large tenant by date."""
    return event_rows.orderBy("patient_id", *event_order())


def ranked(event_rows: DataFrame) -> DataFrame:
    """Events with their 1-based place in the tenant's timeline."""
    return rank_within(event_rows, ["patient_id"], event_order(), "ordinal")


def order_number(event_date: Column) -> Column:
    """Number that sorts like the event date text: a bare date comes before any time of that day."""
    seconds = F.unix_seconds(F.coalesce(F.try_to_timestamp(event_date, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")),
                                        F.try_to_timestamp(event_date, F.lit("yyyy-MM-dd"))))
    return seconds * 2 + F.when(F.length(event_date) > 10, 1).otherwise(0)
