"""Question understanding as column expressions over a table of inquiries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions import lexicons as lx
from casebook.functions import text as tx
from casebook.session import materialise, spread

#: Distinct questions that are sent to every task, each with its target at most some kilobytes.
LISTED = 10_000

TARGET_COLUMNS = (
    "structured_domains", "document_domains", "target_entity", "requested_attributes", "temporal_scope",
    "start_date", "end_date", "anchor_year", "raw_expression", "superlative", "question_intent",
    "routing_mode", "clarification_required", "clarification_prompt",
)


def _strings(values=()) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def entity(q: Column) -> Column:
    """Longest dictionary entry contained in the question; ties go to the earlier entry."""
    ordered = sorted(lx.ENTITIES, key=len, reverse=True)
    chain = F.when(q.contains(ordered[0].lower()), ordered[0])
    for name in ordered[1:]:
        chain = chain.when(q.contains(name.lower()), name)
    return chain


def is_consultation_timeline(q: Column) -> Column:
    return q.contains("consultation") & (q.rlike(r"(?U)\bwhen\b") | q.contains("timeline"))


def domain_rules(q: Column, found: Column) -> list[tuple[Column, tuple, tuple]]:
    """(condition, structured domains, document domains), in routing order."""
    when_consulted = is_consultation_timeline(q)
    provider = tx.mentions(q, lx.PROVIDER)
    record = tx.mentions(q, lx.MEDICATION_RECORD)
    document = tx.mentions(q, lx.MEDICATION_DOCUMENT)
    visits = ("clinical_documents", "reports")
    medicine_named = record | document | F.coalesce(found.isin(*lx.MEDICATION_ENTITIES), F.lit(False))
    return [
        (
            tx.mentions(q, lx.BROAD),
            ("conditions", "medications"),
            ("clinical_documents", "reports", "prescriptions", "labs"),
        ),
        (when_consulted, ("timeline",), visits),
        (~when_consulted & tx.mentions(q, lx.CONSULTATION), (), visits),
        (when_consulted & provider, (), visits),
        (~when_consulted & provider, (), ("prescriptions", "clinical_documents")),
        (~when_consulted & provider & medicine_named, ("medications",), ()),
        (record, ("medications",), ("prescriptions",)),
        (document, (), ("prescriptions",)),
        (tx.mentions(q, lx.DIAGNOSTIC), (), ("reports", "clinical_documents")),
        (tx.mentions(q, lx.LAB), (), ("labs",)),
        (tx.mentions(q, lx.CONDITION), ("conditions",), ("clinical_documents",)),
        (q.contains("blood pressure") & ~q.contains("high blood pressure"), (), visits),
        (tx.mentions(q, lx.VITALS), (), visits),
        (tx.mentions(q, lx.TIMELINE), ("timeline",), ()),
        (tx.mentions(q, lx.EVENT), ("timeline",), ("reports", "labs", "clinical_documents")),
        (tx.mentions(q, lx.ALLERGY), ("allergies",), ("clinical_documents",)),
        (tx.mentions(q, lx.PROFILE), ("profile",), ()),
        (tx.mentions(q, lx.GOAL), ("goals",), ()),
        (tx.mentions(q, lx.SYMPTOM), ("symptoms",), ()),
        (tx.mentions(q, lx.CLINIC), (), visits),
    ]


def domains(rules: list[tuple[Column, tuple, tuple]], side: int) -> Column:
    """Domains added by the rules that hold, first mention first."""
    added = [F.when(r[0], _strings(r[side])).otherwise(_strings()) for r in rules if r[side]]
    return F.array_distinct(F.concat(*added))


def attributes(q: Column) -> Column:
    """Requested attributes in their fixed order."""
    when_consulted = is_consultation_timeline(q)
    notes = ~when_consulted & tx.mentions(q, lx.NOTES_WORDS)
    contact = tx.mentions(q, lx.CONTACT_WORDS)
    asked = [
        ("dosage", tx.mentions(q, lx.DOSAGE_WORDS)),
        ("clinic", tx.mentions(q, lx.CLINIC)),
        ("blood_group", tx.mentions(q, lx.BLOOD_GROUP_WORDS)),
        ("status", tx.mentions(q, lx.STATUS_WORDS)),
        ("frequency", tx.mentions(q, lx.FREQUENCY_WORDS)),
        ("consultation_notes", notes),
        ("contact_number", contact),
        ("physician_name", tx.mentions(q, lx.PHYSICIAN_WORDS) & ~contact & ~notes & ~when_consulted),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in asked]))


def superlative(q: Column) -> Column:
    """latest / first; relative spans such as "past 3 months" do not count as recency."""
    spans = tx.holds_any(q, ("past", "last", "recent"))
    masked = F.when(spans, F.regexp_replace(q, lx.RELATIVE_SPAN, " ")).otherwise(q)
    return F.when(
        tx.mentions(masked, lx.LATEST_WORDS) | masked.rlike(r"(?U)\blast\b") | masked.rlike(r"(?U)\brecent\b"), "latest"
    ).when(tx.mentions(q, lx.FIRST_WORDS), "first")


def temporal(q: Column, ref: Column) -> Column:
    """First matching date expression as struct(raw, start_date, end_date, anchor_year, invalid)."""

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(q, pattern, group)

    def interval(raw, start, end, year=None, invalid=None) -> Column:
        return F.struct(
            raw.alias("raw"),
            start.cast("date").alias("start_date"),
            end.cast("date").alias("end_date"),
            (F.lit(None) if year is None else year).cast("int").alias("anchor_year"),
            (F.lit(False) if invalid is None else invalid).alias("invalid"),
        )

    def years(first: Column, last: Column) -> tuple[Column, Column]:
        first, last = (F.lpad(y.cast("string"), 4, "0") for y in (first, last))
        return (
            F.try_to_date(F.concat(first, F.lit("-01-01")), "yyyy-MM-dd"),
            F.try_to_date(F.concat(last, F.lit("-12-31")), "yyyy-MM-dd"),
        )

    def one_year(raw: Column, year: Column) -> Column:
        return interval(raw, *years(year, year), year=year)

    def back(pattern: str, days_per_unit: int) -> Column:
        span = part(pattern, 2).try_cast("int") * days_per_unit
        return interval(part(pattern, 0), F.date_sub(ref, span), ref, invalid=span.isNull())

    def month_number(name: Column) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in lx.MONTHS.items() for x in (k, f"{v:02d}")])
        return F.try_element_at(table, name)

    def day_of(raw: Column, day: Column) -> Column:
        return interval(raw, day, day, F.year(day), day.isNull())

    low, high = (part(lx.BETWEEN_YEARS, g).try_cast("int") for g in (1, 2))
    inverted = low > high
    span = years(low, high)
    iso = F.try_to_date(part(lx.ISO_DATE, 0), "yyyy-MM-dd")
    calendar = F.try_to_date(
        F.concat_ws(
            "-",
            part(lx.CALENDAR_DATE, 4),
            month_number(part(lx.CALENDAR_DATE, 2)),
            F.lpad(part(lx.CALENDAR_DATE, 3), 2, "0"),
        ),
        "yyyy-MM-dd",
    )
    month = F.try_to_date(
        F.concat_ws("-", part(lx.MONTH_YEAR, 2), month_number(part(lx.MONTH_YEAR, 1)), F.lit("01")), "yyyy-MM-dd"
    )
    last_raw = F.when(q.contains("last year"), "last year").otherwise("past year")
    this_raw = F.when(q.contains("this year"), "this year").otherwise("current year")
    return (
        F.when(q.rlike(lx.PAST_DAYS), back(lx.PAST_DAYS, 1))
        .when(q.rlike(lx.PAST_MONTHS), back(lx.PAST_MONTHS, 30))
        .when(
            q.rlike(lx.BETWEEN_YEARS),
            interval(
                part(lx.BETWEEN_YEARS, 0),
                F.when(~inverted, span[0]),
                F.when(~inverted, span[1]),
                invalid=inverted,
            ),
        )
        .when(q.rlike(lx.ISO_DATE), day_of(part(lx.ISO_DATE, 0), iso))
        .when(q.rlike(lx.CALENDAR_DATE), day_of(part(lx.CALENDAR_DATE, 0), calendar))
        .when(
            q.rlike(lx.MONTH_YEAR),
            interval(part(lx.MONTH_YEAR, 0), month, F.last_day(month), F.year(month), month.isNull()),
        )
        .when(tx.mentions(q, lx.LAST_YEAR_WORDS), one_year(last_raw, F.year(ref) - 1))
        .when(tx.mentions(q, lx.THIS_YEAR_WORDS), one_year(this_raw, F.year(ref)))
        .when(q.rlike(lx.IN_YEAR), one_year(part(lx.IN_YEAR, 0), part(lx.IN_YEAR, 1).try_cast("int")))
        .when(q.rlike(lx.BARE_YEAR), one_year(part(lx.BARE_YEAR, 0), part(lx.BARE_YEAR, 1).try_cast("int")))
    )


def categorical_scope(q: Column, has_superlative: Column) -> Column:
    """current / historical / all when the question names no interval."""
    event_words = tx.mentions(q, lx.TIMELINE + lx.EVENT) | is_consultation_timeline(q)
    current = tx.mentions(q, lx.CURRENT_WORDS)
    says_have = F.array_contains(F.split(q, r"(?U)\s+"), "have")
    with_superlative = F.when(tx.mentions(q, lx.HISTORICAL_WITH_SUPERLATIVE), "historical").otherwise("all")
    plain = (
        F.when(tx.mentions(q, lx.HISTORICAL_WORDS), F.when(event_words, "all").otherwise("historical"))
        .when(says_have, "current")
        .otherwise("all")
    )
    return F.when(current, "current").when(has_superlative, with_superlative).otherwise(plain)


def is_comparison(q: Column) -> Column:
    return q.rlike("(?Ud)" + "|".join(lx.COMPARISON))


def safety_triggered(text: Column) -> Column:
    """Any acute-symptom pattern, ignoring case; a dot stops at line feeds only."""
    return text.rlike("(?idU)" + "|".join(lx.SAFETY))


def validation_error(text: Column) -> Column:
    """Reason a question is refused, null when accepted."""
    return (
        F.when(text.isNull(), "missing")
        .when(F.length(text) < 2, "too_short")
        .when(F.length(text) > 1000, "too_long")
        .when(tx.is_blank(text), "blank")
    )


def annotate(inquiries: DataFrame) -> DataFrame:
    """Add the target columns to a table with ``query_text`` and ``ref_date``."""
    q = F.col("_q")
    lowered = inquiries.withColumn("_q", F.lower("query_text"))
    named = lowered.withColumn("_named", entity(q))
    rules = domain_rules(q, F.col("_named"))
    staged = named.select(
        "*",
        domains(rules, 1).alias("structured_domains"),
        domains(rules, 2).alias("document_domains"),
        F.when(is_consultation_timeline(q), F.coalesce("_named", F.lit("consultation")))
        .otherwise(F.col("_named"))
        .alias("target_entity"),
        attributes(q).alias("requested_attributes"),
        temporal(q, F.col("ref_date")).alias("_when"),
        superlative(q).alias("_superlative"),
        (tx.mentions(q, lx.VAGUE_RECENCY)).alias("_vague_recency"),
    )
    has_structured = F.size("structured_domains") > 0
    has_document = F.size("document_domains") > 0
    has_detail = (F.size("requested_attributes") > 0) | F.col("target_entity").isNotNull()
    recency = F.col("_vague_recency") & (has_structured | has_document | has_detail)
    vague = ~has_detail & tx.mentions(q, lx.VAGUE)
    mode = (
        F.when(F.coalesce(F.col("_when.invalid"), F.lit(False)), "UNROUTABLE")
        .when(has_structured & has_document, "CROSS_DOMAIN")
        .when(has_structured, "STRUCTURED_ONLY")
        .when(has_document, "DOCUMENT_ONLY")
        .when(vague, "AMBIGUOUS_CLARIFY")
        .otherwise("UNROUTABLE")
    )
    scope = (
        F.when(F.col("_when").isNotNull(), "interval")
        .when(recency, "all")
        .otherwise(categorical_scope(q, F.col("_superlative").isNotNull()))
    )
    ask = F.col("routing_mode") == "AMBIGUOUS_CLARIFY"
    return (
        staged.select(
            "*",
            scope.alias("temporal_scope"),
            F.col("_when.start_date").alias("start_date"),
            F.col("_when.end_date").alias("end_date"),
            F.col("_when.anchor_year").alias("anchor_year"),
            F.col("_when.raw").alias("raw_expression"),
            F.when(recency, "latest").otherwise(F.col("_superlative")).alias("superlative"),
            F.when(is_comparison(q), "COMPARISON").otherwise("QUERY").alias("question_intent"),
            mode.alias("routing_mode"),
        )
        .withColumn("clarification_required", ask)
        .withColumn("clarification_prompt", F.when(ask, lx.CLARIFICATION_PROMPT))
        .select(*inquiries.columns, *TARGET_COLUMNS)
    )


def once_each(inquiries: DataFrame, understand: Callable[[DataFrame], DataFrame], listed: int = LISTED) -> DataFrame:
    """``inquiries`` with the columns that ``understand`` adds to a table of ``query_text`` and ``ref_date``.

    Each distinct question is understood and written once. Up to ``listed`` of them go to every task, so one that very
    many ask is no hot key; more are joined, where Spark splits hot ones."""
    key = F.struct("query_text", "ref_date")
    # Questions are short, matching them against the word lists is not: one small shuffle evens it out.
    questions = spread(inquiries.select("query_text", "ref_date").distinct(), "query_text", "ref_date")
    keyed = materialise(understand(questions).withColumn("_key", key).drop("query_text", "ref_date"))
    if keyed.limit(listed + 1).count() <= listed:
        keyed = F.broadcast(keyed)
    return inquiries.withColumn("_key", key).join(keyed, "_key").drop("_key")


def legacy_target(domain: Column) -> Column:
    """Single-domain request as struct(structured_domains, document_domains, routing_mode)."""
    in_documents = domain.isin(*lx.DOCUMENT_DOMAINS)
    return F.struct(
        F.when(domain.isNull() | in_documents, _strings()).otherwise(F.array(domain)).alias("structured_domains"),
        F.when(in_documents, F.array(domain)).otherwise(_strings()).alias("document_domains"),
        F.when(domain.isNull(), "UNROUTABLE")
        .when(in_documents, "DOCUMENT_ONLY")
        .otherwise("STRUCTURED_ONLY")
        .alias("routing_mode"),
    )


def primary_domain(structured: Column, document: Column) -> Column:
    """First structured domain, else first document domain."""
    return F.coalesce(F.try_element_at(structured, F.lit(1)), F.try_element_at(document, F.lit(1)))
