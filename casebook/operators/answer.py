"""Deterministic answers with verified citations, and the whole inquiry job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions import lexicons as lx
from casebook.functions import text as tx
from casebook.functions.skew import ROWS_PER_SALT, key_counts, rank_within
from casebook.operators import context as cx
from casebook.operators import retrieve as rt
from casebook.operators import verdicts as vd
from casebook.operators.records import FIELDS, health_records, record_field
from casebook.operators.understand import annotate, once_each, safety_triggered, validation_error
from casebook.session import materialise

K = ["query_id", "patient_id"]

# --- fixed values: value patterns, matched without regard to case -------------------------------
_LABELLED = {
    "dosage": r"(?iU)(?:dosage|dose|strength)\s*:\s*([^\n\r]+)",
    "physician_name": r"(?iU)(?:prescribing (?:physician|doctor)|prescribed by|ordered by|physician|provider|doctor)"
    r"\s*:\s*([^\n\r]+)",
    "clinic": r"(?iU)(?:clinic|facility|hospital|practice)\s*:\s*([^\n\r]+)",
    "contact_number": r"(?iU)(?:phone|tel|telephone|contact|fax)\s*(?:#|no\.?|number)?\s*:\s*([^\n\r]+)",
    "frequency": r"(?iU)(?:frequency|schedule)\s*:\s*([^\n\r]+)",
    "status": r"(?iU)\bstatus\s*:\s*([^\n\r]+)",
}
_UNLABELLED = {
    "dosage": r"(?iU)\b(\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)\b[^\n\r,.]*)",
    "physician_name": r"(?iU)\b(dr\.?\s+[a-z]+(?:\s+[a-z]+){0,2}(?:,\s*md)?)\b",
}
_PARENTHESISED = ("physician_name", "clinic")


def value_in_text(attribute: Column, text: Column) -> Column:
    """Explicit value of an attribute in passage text, null when none is stated."""
    chain = None
    for name, pattern in _LABELLED.items():
        raw = tx.strip(F.regexp_extract(text, pattern, 1))
        if name in _PARENTHESISED:
            bare = tx.strip(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\(.*?\)", ""))
            raw = F.coalesce(F.nullif(bare, F.lit("")), raw)
        value = F.when(text.rlike(pattern), raw)
        if name in _UNLABELLED:
            loose = _UNLABELLED[name]
            value = F.coalesce(value, F.when(text.rlike(loose), tx.strip(F.regexp_extract(text, loose, 1))))
        chain = F.when(attribute == name, value) if chain is None else chain.when(attribute == name, value)
    return chain


def attribute_details(targets: DataFrame, evidence: vd.Evidence, records: DataFrame, details: DataFrame) -> DataFrame:
    """Value text of the matched attributes per inquiry: record column first, else passage text."""
    asked = evidence.verdicts.where(F.size("matched_fields") > 0).select(
        *K, F.posexplode("matched_fields").alias("position", "attribute")
    )
    # Only records that hold one of the matched fields can give a value, and only these fields are carried.
    names = [r["attribute"] for r in asked.select("attribute").distinct().collect()]
    fields = sorted(f"f_{n}" for n in names if n in FIELDS)
    held = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields], F.lit(False))
    valued = records.where(held).select(
        "patient_id", "domain", "record_id", *[F.col(f"f_{c}") if f"f_{c}" in fields else F.lit(None).cast("string").alias(f"f_{c}") for c in FIELDS]
    )
    rows = (
        evidence.records.join(asked.where(F.col("attribute").isin([f[2:] for f in fields])), K)
        .join(valued, ["patient_id", "domain", "record_id"])
        .withColumn("value", record_field(F.col("attribute")))
        .where("value is not null")
    )
    order = F.struct("domain_ord", "order1", "order2", "order3")
    from_records = rows.groupBy(*K, "attribute").agg(F.min_by("value", order).alias("record_value"))
    texts = details.groupBy(*K).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_text"))), lambda p: p["chunk_text"]), " "
        ).alias("text")
    )
    value = F.nullif(F.coalesce("record_value", value_in_text(F.col("attribute"), F.col("text"))), F.lit(""))
    phrase = F.concat_ws(": ", F.col("attribute"), value)
    return (
        asked.join(from_records, [*K, "attribute"], "left")
        .join(texts, K, "left")
        .groupBy(*K)
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("position", phrase.alias("p")))), lambda x: x["p"]), ", "
            ).alias("attribute_text")
        )
    )


def answer_text(targets: DataFrame, evidence: vd.Evidence, records: DataFrame, details: DataFrame) -> DataFrame:
    """Template answer per inquiry from its verdict, first passage and attribute values."""
    has_records = evidence.records.groupBy(*K).agg(F.lit(True).alias("_records"))
    first = details.where("place = 1").select(*K, F.col("display_name").alias("_doc"), F.col("document_date").alias("_doc_date"))
    values = attribute_details(targets, evidence, records, details)
    rows = (
        evidence.verdicts.join(targets.select(*K, "target_entity"), K)
        .join(has_records, K, "left")
        .join(first, K, "left")
        .join(values, K, "left")
    )
    named = F.coalesce(F.length("target_entity"), F.lit(0)) > 0
    subject = F.when(named, F.concat(F.lit("confirm "), "target_entity", F.lit("."))).otherwise(
        "confirm requested information."
    )
    source = F.concat("_doc", F.coalesce(F.concat(F.lit(" from "), F.date_format("_doc_date", "yyyy-MM-dd")), F.lit("")))
    with_doc = F.col("_doc").isNotNull()
    sentence = (
        F.when(
            with_doc & F.col("_records"),
            F.concat(F.lit("According to structured records and your uploaded "), source, F.lit(", records "), subject),
        )
        .when(with_doc, F.concat(F.lit("According to your uploaded "), source, F.lit(", records "), subject))
        .otherwise(F.concat(F.lit("Records "), subject))
    )
    stated = F.coalesce(F.concat(F.lit(" Attributes "), "attribute_text", F.lit(" are present.")), F.lit(""))
    text = F.when(F.col("status") == "SUFFICIENT", F.concat(sentence, stated)).otherwise(F.col("evidence_directive"))
    return rows.select(*vd.VERDICT_COLUMNS, tx.strip(qualify(text, F.col("trajectory_completeness"))).alias("answer"))


def qualify(text: Column, completeness: Column) -> Column:
    """Append the bounded-summary note once, when the summary leaves dated candidates out."""
    bounded = F.coalesce(completeness == "BOUNDED_WITH_ADDITIONAL_QUALIFIED_CANDIDATES", F.lit(False))
    absent = ~F.contains(text, F.lit(lx.BOUNDED_QUALIFIER))
    return F.when(bounded & absent, F.concat(F.rtrim(text), F.lit(f"\n\n{lx.BOUNDED_QUALIFIER}"))).otherwise(text)


def event_label(title: Column, event_type: Column, event_date: Column) -> Column:
    return F.concat(title, F.lit(" ("), F.initcap(F.replace(event_type, F.lit("_"), F.lit(" "))), F.lit(") - "), event_date)


def record_labels(records: DataFrame) -> DataFrame:
    """Citation label, entity type and verification state of every record."""
    domain = F.col("domain")
    kind = (
        F.when(domain == "profile", "PROFILE").when(domain == "conditions", "CONDITION")
        .when(domain == "medications", "MEDICATION").when(domain == "allergies", "ALLERGY")
        .when(domain == "symptoms", "SYMPTOM").when(domain == "goals", "GOAL").otherwise("TIMELINE")
    )
    label = (
        F.when(domain == "profile", "Health Profile")
        .when(domain == "timeline", event_label(F.col("title"), F.col("event_type"), F.col("event_date")))
        .otherwise(F.col("match_text"))
    )
    state = F.when(domain.isin("profile", "timeline"), "SOURCE_RECORDED").otherwise(
        F.coalesce("f_verification_state", F.lit("UNCERTAIN"))
    )
    return records.select(
        "patient_id", "domain", "record_id", kind.alias("entity_type"), label.alias("label"),
        state.alias("verification_state"),
    )


def citations(evidence: vd.Evidence, records: DataFrame, details: DataFrame) -> DataFrame:
    """Numbered citations per inquiry: matched records in order, then each document once.

    A tenant may match very many records, so the numbering is a distributed rank.
    """
    null = F.lit(None).cast("string")
    from_records = evidence.records.join(record_labels(records), ["patient_id", "domain", "record_id"]).select(
        *K, F.lit(0).alias("_class"), "domain_ord", "order1", "order2", "order3", "entity_type", "record_id", "label",
        "verification_state", null.alias("chunk_id"), F.lit(None).cast("int").alias("page_number"),
        null.alias("passage_text"),
    )
    # First passage of each document: at most twenty passages per inquiry.
    first = details.groupBy(*K, "document_id").agg(
        F.min_by(F.struct("place", "token", "display_name", "document_date", "chunk_id", "page_number", "chunk_text"), "place").alias("p")
    )
    tokened = F.col("p.token").isNotNull()
    dated = F.concat(F.lit(" ("), F.date_format("p.document_date", "yyyy-MM-dd"), F.lit(")"))
    from_documents = first.select(
        *K, F.lit(1).alias("_class"), F.lit(0).alias("domain_ord"), F.col("p.place").cast("long").alias("order1"),
        F.lit(0).cast("long").alias("order2"), F.col("document_id").cast("string").alias("order3"),
        F.lit("DOCUMENT").alias("entity_type"), F.col("document_id").cast("string").alias("record_id"),
        F.concat(F.col("p.display_name"), F.coalesce(dated, F.lit(""))).alias("label"),
        F.lit("SOURCE_RECORDED").alias("verification_state"),
        F.when(tokened, F.col("p.chunk_id")).alias("chunk_id"),
        F.when(tokened, F.col("p.page_number")).cast("int").alias("page_number"),
        F.when(tokened, F.col("p.chunk_text")).alias("passage_text"),
    )
    order = [F.col(c) for c in ("_class", "domain_ord", "order1", "order2", "order3")]
    # An inquiry of few records has few citations: documents add at most twenty.
    many = key_counts(evidence.records, K)
    return rank_within(from_records.unionByName(from_documents), K, order, "citation_id", counts=many).select(
        *K, "citation_id", "entity_type", "record_id", "label", "verification_state", "chunk_id", "page_number",
        "passage_text",
    )


@dataclass
class InquiryJob:
    """Everything one batch of inquiries produces."""

    targets: DataFrame
    results: DataFrame
    evidence: vd.Evidence
    passages: DataFrame
    records: DataFrame
    details: DataFrame

    @property
    def citations(self) -> DataFrame:
        return citations(self.evidence, self.records, self.details)


def refused(inquiries: DataFrame) -> DataFrame:
    """Requests that fail validation, with the reason; they are answered by it alone."""
    return inquiries.withColumn("error", validation_error(F.col("query_text"))).where(F.col("error").isNotNull())


def gate(inquiries: DataFrame) -> DataFrame:
    """Accepted inquiries, annotated, with the safety flag; each distinct question is understood once."""
    return once_each(
        inquiries.where(validation_error(F.col("query_text")).isNull()),
        lambda questions: annotate(questions).withColumn("safety_triggered", safety_triggered(F.col("query_text"))),
    )


def answer_inquiries(inquiries: DataFrame, tables, top_k: int | None = None,
                     rows_per_salt: int = ROWS_PER_SALT, embedder: Callable[[list[str]], list[list[float]]] | None = None,
                     dimension: int = 768) -> InquiryJob:
    """Safety, understanding, retrieval, evidence, answer and citations for a table of inquiries.

    ``results`` has one row per inquiry; one that is refused has its reason in ``error`` and no answer.

    With an ``embedder`` the questions that reach documents are embedded in the job; one that can't be has the reason
    in ``error`` and no answer. Without it inquiries bring their ``query_vec``.

    ``tables`` exposes the record, document, extraction and chunk tables. Retrieved passages feed several branches, so
    they are written once; targets are joined to inquiries anew in each, without vectors but for retrieval.
    """
    gated = gate(inquiries)
    reaches = ~F.col("safety_triggered") & F.col("routing_mode").isin("STRUCTURED_ONLY", "DOCUMENT_ONLY", "CROSS_DOMAIN")
    routable, failed = gated.where(reaches), None
    if embedder is not None:
        asked = materialise(rt.embed_questions(routable, embedder, dimension))
        routable = asked.where("embedding_error IS NULL").drop("embedding_error")
        failed = asked.where("embedding_error IS NOT NULL").select(
            *K, "query_text", "routing_mode", "safety_triggered", "clarification_required",
            F.concat(F.lit("The question could not be embedded: "), F.col("embedding_error")).alias("error"),
        )
    passages = materialise(
        rt.retrieve(
            routable, tables.document_chunks, tables.medical_documents, tables.document_extractions, top_k, rows_per_salt
        )
    )
    lean = routable.drop("query_vec")
    records = health_records(tables)
    found = vd.evaluate(lean, records, passages, rows_per_salt)
    verdicts = materialise(found.verdicts)
    useful = verdicts.where("status <> 'INSUFFICIENT'").select(*K)
    evidence = vd.Evidence(
        verdicts,
        lambda _: materialise(found.match(useful)),
        materialise(found.passages.join(useful, K, "left_semi")),
    )
    details = cx.passage_details(evidence.passages, passages)
    spoken = answer_text(lean, evidence, records, details).select(
        *K, F.col("status").alias("evidence_status"), "answer"
    )
    silent = gated.where(F.col("safety_triggered") | F.col("routing_mode").isin("AMBIGUOUS_CLARIFY", "UNROUTABLE"))
    short = silent.select(
        *K,
        F.lit("INSUFFICIENT").alias("evidence_status"),
        F.when(F.col("safety_triggered"), lx.SAFETY_ADVISORY)
        .when(F.col("routing_mode") == "AMBIGUOUS_CLARIFY", F.col("clarification_prompt"))
        .otherwise(lx.UNROUTABLE_ANSWER)
        .alias("answer"),
    )
    flags = gated.select(
        *K, "query_text", "routing_mode", "safety_triggered",
        (~F.col("safety_triggered") & F.col("clarification_required")).alias("clarification_required"),
    )
    answered = flags.join(spoken.unionByName(short), K).withColumn("error", F.lit(None).cast("string"))
    results = answered.unionByName(refused(inquiries).select(*K, "query_text", "error"), allowMissingColumns=True)
    if failed is not None:
        results = results.unionByName(failed, allowMissingColumns=True)
    return InquiryJob(lean, results, evidence, passages, records, details)
