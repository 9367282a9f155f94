"""Queries over questions: annotation, routing, safety, validation, conformance, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions import lexicons as lx
from casebook.functions import attributes as at
from casebook.functions import text as tx
from casebook.operators import evaluation as vl
from casebook.operators import understand as un
from casebook.plans.oracle_views import over_views
from casebook.plans.registry import query
from casebook.plans.templates import TEMPLATES

_LISTS = ("structured_domains", "document_domains", "requested_attributes")


@query(
    "inquiry_targets",
    over_views(
        "SELECT query_id, array_to_string(structured_domains, ',') AS structured_domains,"
        " array_to_string(document_domains, ',') AS document_domains, target_entity,"
        " array_to_string(requested_attributes, ',') AS requested_attributes, temporal_scope,"
        " CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, anchor_year,"
        " raw_expression, superlative, question_intent, routing_mode,"
        " routing_mode = 'AMBIGUOUS_CLARIFY' AS clarification_required FROM targets"
    ),
)
def inquiry_targets(t):
    rows = un.once_each(t.inquiries.drop("query_vec"), un.annotate)
    for name in _LISTS:
        rows = rows.withColumn(name, F.array_join(name, ","))
    return rows.select(
        "query_id", *_LISTS, "target_entity", "temporal_scope", F.col("start_date").cast("string").alias("start_date"),
        F.col("end_date").cast("string").alias("end_date"), "anchor_year", "raw_expression", "superlative",
        "question_intent", "routing_mode", "clarification_required",
    )


def _texts(t, understand=None):
    """Every question, conversation turn and document text, whole, with the columns that ``understand`` adds.

    Each distinct question is understood once; turns and documents row by row."""
    day = F.lit("2026-09-24").cast("date")
    asked = t.inquiries.selectExpr("concat('q', query_id) AS text_id", "query_text").withColumn("ref_date", day)
    told = t.turns.selectExpr("concat('t', query_id) AS text_id", "query_text").unionByName(
        t.documents.selectExpr("concat('d', doc_id) AS text_id", "text AS query_text")
    ).withColumn("ref_date", day)
    if understand is None:
        return asked.unionByName(told)
    return un.once_each(asked, understand).unionByName(understand(told))


_TEXTS = """all_texts AS (
  SELECT concat('q', query_id) AS text_id, query_text, lower(query_text) AS q FROM targets
  UNION ALL SELECT concat('t', conv_id * 1000 + turn), text, lower(text) FROM conversations
  UNION ALL SELECT concat('d', doc_id), text, lower(text) FROM documents)"""


def _bounded(alternation: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_])(?:{alternation})($|[^\p{{L}}\p{{N}}_])"


def _m(words, column: str = "q") -> str:
    """Word-list test with letter boundaries that hold for accented neighbours too."""
    tokens = "|".join(w for w in words if " " not in w)
    phrases = [f"contains({column}, '{p}')" for p in (w.replace("'", "''") for w in words if " " in w)]
    tests = ([f"regexp_matches({column}, '{_bounded(tokens)}')"] if tokens else []) + phrases
    return "(" + " OR ".join(tests) + ")"


def _entity_sql() -> str:
    ordered = sorted(lx.ENTITIES, key=len, reverse=True)
    return "CASE " + " ".join(f"WHEN contains(q, '{e.lower()}') THEN '{e}'" for e in ordered) + " END"


_CONSULTED = rf"(contains(q, 'consultation') AND (regexp_matches(q, '{_bounded('when')}') OR contains(q, 'timeline')))"
_VISITS = "['clinical_documents', 'reports']"


def _domain_sql(side: str) -> str:
    """Ordered list of the domains one side gains, nulls for rules that do not hold."""
    provider, record, document = _m(lx.PROVIDER), _m(lx.MEDICATION_RECORD), _m(lx.MEDICATION_DOCUMENT)
    medicine = ", ".join(f"'{e}'" for e in lx.MEDICATION_ENTITIES)
    rules = {
        "s": [
            (_m(lx.BROAD), "['conditions', 'medications']"),
            (_CONSULTED, "['timeline']"),
            (f"NOT {_CONSULTED} AND {provider} AND ({record} OR {document} OR coalesce(e IN ({medicine}), false))", "['medications']"),
            (record, "['medications']"),
            (_m(lx.CONDITION), "['conditions']"),
            (_m(lx.TIMELINE + lx.EVENT), "['timeline']"),
            (_m(lx.ALLERGY), "['allergies']"),
            (_m(lx.PROFILE), "['profile']"),
            (_m(lx.GOAL), "['goals']"),
            (_m(lx.SYMPTOM), "['symptoms']"),
        ],
        "d": [
            (_m(lx.BROAD), "['clinical_documents', 'reports', 'prescriptions', 'labs']"),
            (f"{_CONSULTED} OR {_m(lx.CONSULTATION)}", _VISITS),
            (f"NOT {_CONSULTED} AND {provider}", "['prescriptions', 'clinical_documents']"),
            (f"{record} OR {document}", "['prescriptions']"),
            (_m(lx.DIAGNOSTIC), "['reports', 'clinical_documents']"),
            (_m(lx.LAB), "['labs']"),
            (_m(lx.CONDITION), "['clinical_documents']"),
            ("(contains(q, 'blood pressure') AND NOT contains(q, 'high blood pressure')) OR " + _m(lx.VITALS), _VISITS),
            (_m(lx.EVENT), "['reports', 'labs', 'clinical_documents']"),
            (_m(lx.ALLERGY), "['clinical_documents']"),
            (_m(lx.CLINIC), _VISITS),
        ],
    }[side]
    parts = ", ".join(f"CASE WHEN {c} THEN {d} ELSE [] END" for c, d in rules)
    return f"flatten([{parts}])"


_FIRST_SEEN = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i), ',')"

_ROUTING_SQL = over_views(
    f"SELECT text_id, e AS target_entity, {_FIRST_SEEN.format('s')} AS structured_domains,"
    f" {_FIRST_SEEN.format('d')} AS document_domains FROM routed",
    _TEXTS,
    f"named AS (SELECT *, {_entity_sql()} AS e FROM all_texts)",
    f"routed AS (SELECT text_id, CASE WHEN {_CONSULTED} THEN coalesce(e, 'consultation') ELSE e END AS e,"
    f" {_domain_sql('s')} AS s, {_domain_sql('d')} AS d FROM named)",
)


@query("question_routing", _ROUTING_SQL)
def question_routing(t):
    rows = _texts(t, un.annotate)
    return rows.select(
        "text_id", "target_entity", F.array_join("structured_domains", ",").alias("structured_domains"),
        F.array_join("document_domains", ",").alias("document_domains"),
    )


def _attribute_sql() -> str:
    notes, contact = f"(NOT {_CONSULTED} AND {_m(lx.NOTES_WORDS)})", _m(lx.CONTACT_WORDS)
    asked = [
        ("dosage", _m(lx.DOSAGE_WORDS)), ("clinic", _m(lx.CLINIC)), ("blood_group", _m(lx.BLOOD_GROUP_WORDS)),
        ("status", _m(lx.STATUS_WORDS)), ("frequency", _m(lx.FREQUENCY_WORDS)), ("consultation_notes", notes),
        ("contact_number", contact),
        ("physician_name", f"{_m(lx.PHYSICIAN_WORDS)} AND NOT {contact} AND NOT {notes} AND NOT {_CONSULTED}"),
    ]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in asked) + ")"


_SUPERLATIVE_SQL = (
    "regexp_replace(q, '" + _bounded(r"(?:past|last|recent)\s+(?:\d+\s+)?(?:days?|months?|weeks?|years?)") + r"', '\1 \2', 'g')"
)
_SCOPE_SQL = f"""CASE WHEN {_m(lx.CURRENT_WORDS)} THEN 'current'
  WHEN sup IS NOT NULL THEN CASE WHEN {_m(lx.HISTORICAL_WITH_SUPERLATIVE)} THEN 'historical' ELSE 'all' END
  WHEN {_m(lx.HISTORICAL_WORDS)} THEN CASE WHEN {_m(lx.TIMELINE + lx.EVENT)} OR {_CONSULTED} THEN 'all' ELSE 'historical' END
  WHEN list_contains(regexp_split_to_array(q, '\\s+'), 'have') THEN 'current' ELSE 'all' END"""


@query(
    "question_attributes",
    over_views(
        f"SELECT text_id, {_attribute_sql()} AS requested_attributes, sup AS superlative, {_SCOPE_SQL} AS categorical_scope,"
        f" regexp_matches(q, '{'|'.join(lx.COMPARISON)}') AS comparison FROM ("
        f"SELECT *, CASE WHEN {_m(lx.LATEST_WORDS + ('last', 'recent'), 'masked')} THEN 'latest'"
        f" WHEN {_m(lx.FIRST_WORDS)} THEN 'first' END AS sup FROM (SELECT *, {_SUPERLATIVE_SQL} AS masked FROM all_texts))",
        _TEXTS,
    ),
)
def question_attributes(t):
    q = F.col("q")

    def understand(texts):
        return texts.withColumn("q", F.lower("query_text")).withColumn("superlative", un.superlative(q)).select(
            *texts.columns, F.array_join(un.attributes(q), ",").alias("requested_attributes"), "superlative",
            un.categorical_scope(q, F.col("superlative").isNotNull()).alias("categorical_scope"),
            un.is_comparison(q).alias("comparison"),
        )

    return _texts(t, understand).drop("query_text", "ref_date")


_MONTH_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v:02d}'" for k, v in lx.MONTHS.items()) + " END"


def _x(pattern: str, group: int) -> str:
    return f"regexp_extract(q, '{pattern}', {group})"


_DATES_SQL = f"""
SELECT text_id, nullif(raw, '') AS raw_expression, CAST(coalesce(
    CASE kind WHEN 'days' THEN DATE '2026-09-24' - CAST(n AS INTEGER) WHEN 'months' THEN DATE '2026-09-24' - 30 * CAST(n AS INTEGER)
      WHEN 'between' THEN CASE WHEN y1 <= y2 THEN make_date(y1, 1, 1) END WHEN 'year' THEN make_date(y1, 1, 1) END,
    CASE WHEN kind IN ('iso', 'cal', 'month') THEN day END) AS VARCHAR) AS start_date,
  CAST(CASE kind WHEN 'days' THEN DATE '2026-09-24' WHEN 'months' THEN DATE '2026-09-24'
    WHEN 'between' THEN CASE WHEN y1 <= y2 THEN make_date(y2, 12, 31) END WHEN 'year' THEN make_date(y1, 12, 31)
    WHEN 'month' THEN last_day(day) ELSE day END AS VARCHAR) AS end_date,
  kind IS NOT NULL AND ((kind = 'between' AND y1 > y2) OR (kind IN ('iso', 'cal', 'month') AND day IS NULL)) AS invalid
FROM (SELECT text_id, kind, CASE kind WHEN 'days' THEN {_x(lx.PAST_DAYS, 0)} WHEN 'months' THEN {_x(lx.PAST_MONTHS, 0)}
    WHEN 'between' THEN {_x(lx.BETWEEN_YEARS, 0)} WHEN 'iso' THEN {_x(lx.ISO_DATE, 0)} WHEN 'cal' THEN {_x(lx.CALENDAR_DATE, 0)}
    WHEN 'month' THEN {_x(lx.MONTH_YEAR, 0)}
    WHEN 'year' THEN CASE WHEN {_m(lx.LAST_YEAR_WORDS)} THEN CASE WHEN contains(q, 'last year') THEN 'last year' ELSE 'past year' END
      WHEN {_m(lx.THIS_YEAR_WORDS)} THEN CASE WHEN contains(q, 'this year') THEN 'this year' ELSE 'current year' END
      ELSE coalesce(nullif({_x(lx.IN_YEAR, 0)}, ''), {_x(lx.BARE_YEAR, 0)}) END END AS raw,
  try_cast(CASE kind WHEN 'days' THEN {_x(lx.PAST_DAYS, 2)} WHEN 'months' THEN {_x(lx.PAST_MONTHS, 2)} END AS INTEGER) AS n,
  CASE kind WHEN 'between' THEN try_cast({_x(lx.BETWEEN_YEARS, 1)} AS INTEGER)
    WHEN 'year' THEN CASE WHEN {_m(lx.LAST_YEAR_WORDS)} THEN 2025 WHEN {_m(lx.THIS_YEAR_WORDS)} THEN 2026
      ELSE try_cast(coalesce(nullif({_x(lx.IN_YEAR, 1)}, ''), {_x(lx.BARE_YEAR, 1)}) AS INTEGER) END END AS y1,
  try_cast({_x(lx.BETWEEN_YEARS, 2)} AS INTEGER) AS y2,
  try_cast(CASE kind WHEN 'iso' THEN {_x(lx.ISO_DATE, 0)}
    WHEN 'cal' THEN concat({_x(lx.CALENDAR_DATE, 4)}, '-', {_MONTH_CASE.format(_x(lx.CALENDAR_DATE, 2))}, '-',
      lpad({_x(lx.CALENDAR_DATE, 3)}, 2, '0'))
    WHEN 'month' THEN concat({_x(lx.MONTH_YEAR, 2)}, '-', {_MONTH_CASE.format(_x(lx.MONTH_YEAR, 1))}, '-01') END AS DATE) AS day
  FROM (SELECT *, CASE WHEN regexp_matches(q, '{lx.PAST_DAYS}') THEN 'days' WHEN regexp_matches(q, '{lx.PAST_MONTHS}') THEN 'months'
      WHEN regexp_matches(q, '{lx.BETWEEN_YEARS}') THEN 'between' WHEN regexp_matches(q, '{lx.ISO_DATE}') THEN 'iso'
      WHEN regexp_matches(q, '{lx.CALENDAR_DATE}') THEN 'cal' WHEN regexp_matches(q, '{lx.MONTH_YEAR}') THEN 'month'
      WHEN {_m(lx.LAST_YEAR_WORDS + lx.THIS_YEAR_WORDS)} OR regexp_matches(q, '{lx.IN_YEAR}')
        OR regexp_matches(q, '{lx.BARE_YEAR}') THEN 'year' END AS kind FROM all_texts))"""


@query("question_dates", over_views(_DATES_SQL, _TEXTS))
def question_dates(t):
    when = un.temporal(F.lower("query_text"), F.col("ref_date"))
    return _texts(t, lambda texts: texts.withColumn("w", when)).select(
        "text_id", F.col("w.raw").alias("raw_expression"), F.col("w.start_date").cast("string").alias("start_date"),
        F.col("w.end_date").cast("string").alias("end_date"), F.coalesce("w.invalid", F.lit(False)).alias("invalid"),
    )


_SAFETY_SQL = "|".join(lx.SAFETY).replace("'", "''")


@query(
    "question_safety",
    over_views(f"SELECT text_id, regexp_matches(query_text, '(?i){_SAFETY_SQL}') AS safety_triggered FROM all_texts", _TEXTS),
)
def question_safety(t):
    return _texts(t).select("text_id", un.safety_triggered(F.col("query_text")).alias("safety_triggered"))


@query(
    "question_validation",
    over_views(
        r"SELECT text_id, CASE WHEN length(query_text) < 2 THEN 'too_short' WHEN length(query_text) > 1000 THEN 'too_long'"
        r" WHEN NOT regexp_matches(query_text, '\S') THEN 'blank' END AS error FROM all_texts",
        _TEXTS,
    ),
)
def question_validation(t):
    return _texts(t).select("text_id", un.validation_error(F.col("query_text")).alias("error"))


_DOMAIN_NAMES = lx.STRUCTURED_DOMAINS + lx.DOCUMENT_DOMAINS + ("unknown",)
_DOMAIN_PICK = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_DOMAIN_NAMES))
_DOC_SET = ", ".join(f"'{d}'" for d in lx.DOCUMENT_DOMAINS)


@query(
    "legacy_targets",
    f"""SELECT event_id, CASE WHEN d IS NOT NULL AND d NOT IN ({_DOC_SET}) THEN d ELSE '' END AS structured_domains,
  CASE WHEN d IN ({_DOC_SET}) THEN d ELSE '' END AS document_domains,
  CASE WHEN d IS NULL THEN 'UNROUTABLE' WHEN d IN ({_DOC_SET}) THEN 'DOCUMENT_ONLY' ELSE 'STRUCTURED_ONLY' END AS routing_mode,
  d AS target_domain FROM (SELECT event_id, CASE event_id % 13 {_DOMAIN_PICK} END AS d FROM events)""",
)
def legacy_targets(t):
    named = t.table("events").selectExpr("event_id", f"CASE event_id % 13 {_DOMAIN_PICK} END AS d")
    return named.select("event_id", un.legacy_target(F.col("d")).alias("x")).select(
        "event_id", F.array_join("x.structured_domains", ",").alias("structured_domains"),
        F.array_join("x.document_domains", ",").alias("document_domains"), "x.routing_mode",
        un.primary_domain(F.col("x.structured_domains"), F.col("x.document_domains")).alias("target_domain"),
    )


def _expected(t):
    """The stated target of every inquiry."""
    schema = (
        "template_no int, structured_domains array<string>, document_domains array<string>, target_entity string,"
        " requested_attributes array<string>, temporal_scope string, start_date string, end_date string,"
        " anchor_year int, superlative string, question_intent string, routing_mode string"
    )
    rows = [
        (
            n, list(x.structured), list(x.document), x.entity, list(x.attributes), x.scope, x.start, x.end,
            int(x.start[:4]) if x.start and not x.raw.startswith("between") else None, x.superlative, x.intent, x.mode,
        )
        for n, x in enumerate(TEMPLATES)
    ]
    stated = t.spark.createDataFrame(rows, schema).withColumn("start_date", F.col("start_date").cast("date")).withColumn(
        "end_date", F.col("end_date").cast("date")
    )
    return (
        un.once_each(
            t.inquiries.select("query_id", "template_no", "query_text", "ref_date"),
            lambda questions: questions.withColumn("is_safety", un.safety_triggered(F.col("query_text"))),
        )
        .drop("ref_date")
        .join(F.broadcast(stated), "template_no")
        .withColumn("clarification_required", F.col("routing_mode") == "AMBIGUOUS_CLARIFY")
        .withColumn("checks_intent", F.lit(True))
    )


_GATE_SQL = """
SELECT metric, passed, total FROM (SELECT
  count(*) FILTER (WHERE NOT saf) AS p, count(*) FILTER (WHERE NOT saf AND routing_mode NOT IN ('UNROUTABLE', 'AMBIGUOUS_CLARIFY')) AS r,
  count(*) FILTER (WHERE NOT saf AND routing_mode = 'AMBIGUOUS_CLARIFY') AS a,
  count(*) FILTER (WHERE NOT saf AND routing_mode <> 'AMBIGUOUS_CLARIFY') AS na,
  count(*) FILTER (WHERE NOT saf AND routing_mode <> 'UNROUTABLE' AND temporal_scope = 'interval') AS tv,
  count(*) FILTER (WHERE NOT saf AND routing_mode = 'UNROUTABLE' AND temporal_scope = 'interval') AS ti,
  count(*) FILTER (WHERE NOT saf AND superlative IS NOT NULL) AS su,
  count(*) FILTER (WHERE NOT saf AND question_intent = 'COMPARISON') AS co,
  count(*) FILTER (WHERE NOT saf AND list_contains(structured_domains, 'timeline')) AS tl
  FROM (SELECT *, contains(query_text, 'passed out') AS saf FROM targets))
CROSS JOIN LATERAL (VALUES ('routing_conformance', p, p), ('false_unroutable', 0, r), ('clarification_recall', a, a),
  ('clarification_precision', a, a), ('false_clarification', 0, na), ('temporal_valid', tv, tv), ('temporal_invalid', ti, ti),
  ('superlative', su, su), ('comparison', co, co), ('timeline_routing', tl, tl)) AS g(metric, passed, total)"""


@query("conformance_gates", over_views(_GATE_SQL))
def conformance_gates(t):
    actual = un.once_each(t.inquiries.select("query_id", "query_text", "ref_date"), un.annotate)
    return vl.conformance(_expected(t), actual, "query_id")


@query(
    "telemetry_rollup",
    """SELECT event_type AS provider, count(*) AS sample_count, CAST(floor(sum(ms) / count(*)) AS BIGINT) AS avg_latency_ms,
  min(ms) AS min_latency_ms, max(ms) AS max_latency_ms, count(*) FILTER (WHERE event_id % 17 = 0) AS fallback_count,
  count(*) FILTER (WHERE event_id % 19 = 0) AS refusal_count, count(*) FILTER (WHERE event_id % 23 = 0) AS malformed_count,
  sum(event_id % 5) AS citations_emitted, sum(event_id % 5 // 2) AS citations_verified, sum(700 + user_id) AS prompt_tokens,
  sum(150 + event_id % 200) AS completion_tokens, sum(850 + user_id + event_id % 200) AS total_tokens
FROM (SELECT *, 100 + event_id * 7 % 900 AS ms FROM events) GROUP BY event_type""",
)
def telemetry_rollup(t):
    calls = t.table("events").selectExpr(
        "event_type AS provider", "100 + event_id * 7 % 900 AS latency_ms",
        "CASE WHEN event_id % 19 = 0 THEN 'refusal' ELSE 'stop' END AS finish_reason", "event_id % 17 = 0 AS fallback",
        "event_id % 23 = 0 AS malformed", "event_id % 5 AS citations_emitted", "event_id % 5 div 2 AS citations_verified",
        "700 + user_id AS prompt_tokens", "150 + event_id % 200 AS completion_tokens",
    )
    return vl.telemetry_rollup(calls)


# --- attribute evidence in stored text ---------------------------------------------------------

#: The oracle's engine has no lookaround: these restate the affected patterns without it.
ORACLE_PATTERNS = {
    **at.PATTERNS,
    "physician_name": (
        r"\b(prescribing (?:doctor|physician)|attending (?:physician|doctor)|prescribed by|ordered by|signed by|"
        r"physician|provider|prescriber)\s*:\s*(?:dr\.?\s+|doctor\s+)?[a-z]+(?:\s+[a-z]+){0,2}\b",
        r"\b(?:dr\.?|doctor)\s+[a-z]+(?:\s+[a-z]+){0,2}\b",
        r"(^|[^\p{L}\p{N}_])[a-z]+(?:\s+[a-z]+){1,2},\s*(?:m\.?d|d\.?o|n\.?p|p\.?a\.?-c)($|[^\p{L}\p{N}_])",
    ),
    "clinic": (
        r"\b(clinic|facility|hospital|location|practice)\s*:\s*[a-z0-9]+(?:\s+[a-z0-9]+){0,4}\b",
        r"\b[a-z0-9]+(?:\s+[a-z0-9]+){1,3}\s+(?:medical center|health center|hospital|clinic|infirmary|family practice|"
        r"health system|institute)\b",
        r"\b(seen at|visited|admitted to|discharged from|treated at|referred to|return to)\s+"
        r"(?:[a-z0-9]+(?:\s+[a-z0-9]+){0,3}\s+)?(?:medical center|health center|hospital|clinic|infirmary|"
        r"family practice|health system|institute)\b",
    ),
    "blood_group": (
        *at.PATTERNS["blood_group"][:3],
        r"\b(a|b|ab|o)[\+\-](?:$|[^\p{L}\p{N}_])",
        r"\b(a|b|ab|o)\s+(positive|negative|pos|neg)\b",
    ),
}


def attribute_sql(name: str, column: str) -> str:
    """Boolean SQL for one attribute over a lower-cased column."""
    if name == "contact_number":
        found = " || ".join(
            f"regexp_extract_all({column}, '{p}')" for p in (at.CONTACT_LABELLED, at.CONTACT_SPOKEN)
        )
        after = (
            "CASE WHEN contains(m, ':') THEN substr(m, strpos(m, ':') + 1) WHEN contains(m, ' at ')"
            " THEN substr(m, strpos(m, ' at ') + 4) ELSE m END"
        )
        digits = rf"length(regexp_replace({after}, '[-.()\s+]', '', 'g'))"
        return f"len(list_filter({found}, lambda m: {digits} BETWEEN 7 AND 15)) > 0"
    tests = [f"regexp_matches({column}, '{p}')".replace("r'?s", "r''?s") for p in ORACLE_PATTERNS[name]]
    return "(" + " OR ".join(tests) + ")"


_ATTRIBUTES = tuple(at.PATTERNS) + ("contact_number",)


@query(
    "attribute_evidence",
    over_views(
        "SELECT id AS chunk_id, concat_ws(',', "
        + ", ".join(f"CASE WHEN {attribute_sql(n, 'low')} THEN '{n}' END" for n in _ATTRIBUTES)
        + ") AS attributes FROM (SELECT id, lower(chunk_text) AS low FROM document_chunks)"
    ),
)
def attribute_evidence(t):
    def held(text):
        return F.concat_ws(",", *[F.when(at.named_attribute(n, text["low"], text["plain"]), n) for n in _ATTRIBUTES])

    low = F.lower("chunk_text")
    found = tx.let(F.struct(low.alias("low"), at.is_ascii(low).alias("plain")), held)
    return t.document_chunks.select(F.col("id").alias("chunk_id"), found.alias("attributes"))


@query(
    "attribute_labels",
    over_views(
        "SELECT query_id, array_to_string(list_transform(requested_attributes, lambda a: CASE a "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.ATTRIBUTE_LABELS.items())
        + " ELSE a END), ', ') AS labels FROM targets"
    ),
)
def attribute_labels(t):
    rows = un.once_each(t.inquiries.drop("query_vec"), un.annotate)
    return rows.select("query_id", tx.join_labels(F.col("requested_attributes")).alias("labels"))
