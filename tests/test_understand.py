"""Question understanding against the golden cases (fixed values) and its metric gates."""

import datetime

from pyspark.sql import functions as F

from casebook.operators import evaluation as vl
from casebook.operators import understand as un

REF = datetime.date(2026, 9, 24)

# --- fixed values: id | question | mode | structured | document | entity | attributes | scope | year | start | end |
# --- superlative | intent ----------------------------------------------------------------------
GOLDEN = """
EXP-01|What medications am I taking?|X|medications|prescriptions|||current|||||
EXP-02|Show me my diagnosed conditions.|X|conditions|clinical_documents|||historical|||||
EXP-03|What are my active allergies?|X|allergies|clinical_documents||status|current|||||
EXP-04|What symptoms have I logged?|S|symptoms||||current|||||
EXP-05|What are my health goals?|S|goals||||all|||||
EXP-06|What lab reports have been uploaded?|D||clinical_documents,labs,reports|||current|||||
IMP-01|What did my chest x-ray show?|D||reports,clinical_documents|||all|||||
IMP-02|What were the findings on my brain MRI?|D||reports,clinical_documents|||all|||||
IMP-03|What did the ultrasound reveal?|D||reports,clinical_documents|||all|||||
IMP-04|What were my biopsy results?|D||reports,clinical_documents|||all|||||
IMP-05|What did my doctor say at the last consultation?|D||clinical_documents,prescriptions,reports||consultation_notes|all|||||
IMP-06|What are my discharge instructions?|D||clinical_documents,reports||consultation_notes|all|||||
PRV-01|What is my physician name?|D||prescriptions,clinical_documents||physician_name|all|||||
PRV-02|Who is my prescribing doctor?|D||prescriptions,clinical_documents||physician_name|all|||||
PRV-03|What is my doctor's phone number?|D||prescriptions,clinical_documents||contact_number|all|||||
PRV-04|What clinic did I visit?|D||clinical_documents,reports||clinic|all|||||
PRV-05|Who signed my prescription?|X|medications|prescriptions,clinical_documents||physician_name|all|||||
PRV-06|What hospital was I admitted to?|D||clinical_documents,reports||clinic|historical|||||
SYN-01|Am I taking Metformin?|X|medications|prescriptions|Metformin||current|||||
SYN-02|What is my dosage of Atorvastatin?|X|medications|prescriptions|Atorvastatin|dosage|all|||||
SYN-03|Do I have Hypertension?|X|conditions|clinical_documents|Hypertension||current|||||
SYN-04|Was I diagnosed with Type 2 Diabetes?|X|conditions|clinical_documents|Diabetes||historical|||||
SYN-05|Do I have an allergy to Penicillin?|X|allergies|clinical_documents|Penicillin||current|||||
SYN-06|Do I have a Peanut allergy?|X|allergies|clinical_documents|Peanut||current|||||
CRS-01|Who prescribed my Lisinopril and at what dose?|X|medications|prescriptions,clinical_documents|Lisinopril|dosage,physician_name|all|||||
CRS-02|Do I have asthma and what did my chest report say?|X|conditions|reports,clinical_documents|Asthma||current|||||
CRS-03|What medications am I taking and what were the doctor notes?|X|medications|clinical_documents,reports,prescriptions||consultation_notes|current|||||
CRS-04|What did the lab say about my diabetes?|X|conditions|labs,clinical_documents|Diabetes||all|||||
CRS-05|Show my medical history and recent records.|X|conditions,medications|clinical_documents,reports,prescriptions,labs|||historical|||||
CRS-06|Who prescribed my medication and what clinic was it?|X|medications|prescriptions,clinical_documents,reports||clinic,physician_name|historical|||||
ATT-01|What is my dosage?|D||prescriptions||dosage|all|||||
ATT-02|What is my blood group?|S|profile|||blood_group|all|||||
ATT-03|How often should I take my prescription?|D||prescriptions||frequency|all|||||
ATT-04|What is the clinic contact number?|D||clinical_documents,reports||clinic,contact_number|all|||||
ATT-05|What is the medication frequency?|X|medications|prescriptions||frequency|all|||||
ATT-06|What clinic was listed?|D||clinical_documents,reports||clinic|historical|||||
AMB-01|How am I doing?|A|||||all|||||
AMB-02|Tell me something useful.|A|||||all|||||
AMB-03|What should I know?|A|||||all|||||
AMB-04|Can you help me?|A|||||all|||||
UNR-01|What is the capital of France?|U|||||all|||||
UNR-02|How do I repair my car engine?|U|||||all|||||
TMP-01|What was my cholesterol in 2024?|D||labs|Cholesterol||interval|2024|2024-01-01|2024-12-31||
TMP-02|What medications was I taking in 2023?|X|medications|prescriptions|||interval|2023|2023-01-01|2023-12-31||
TMP-03|What was my blood work last year?|D||labs|||interval|2025|2025-01-01|2025-12-31||
TMP-04|Show my lab results from March 2024.|D||labs|||interval|2024|2024-03-01|2024-03-31||
TMP-05|What was my cholesterol on 2024-06-15?|D||labs|Cholesterol||interval|2024|2024-06-15|2024-06-15||
TMP-06|Did I have hypertension between 2021 and 2023?|X|conditions|clinical_documents|Hypertension||interval||2021-01-01|2023-12-31||
TMP-07|What was my blood test on February 30, 2024?|U||labs|||interval|||||
TMP-08|What were my meds between 2024 and 2021?|U|||||interval|||||
SAF-01|I have severe crushing chest pain right now.|U|||||all|||||
SAF-02|I have sudden weakness and facial drooping.|U|||||all|||||
SAF-03|I can't breathe and am gasping for air.|U|||||all|||||
SAF-04|I am having an allergic reaction and my throat is closing.|U|||||all|||||
SUP-01|What is my latest cholesterol?|D||labs|Cholesterol||all||||latest|
SUP-02|What is my newest prescription?|D||prescriptions|||all||||latest|
SUP-03|What is my latest blood pressure reading?|D||clinical_documents,reports|blood pressure||all||||latest|
SUP-04|What was my latest lab report in 2024?|D||clinical_documents,labs,reports|||interval|2024|2024-01-01|2024-12-31|latest|
SUP-05|What was my first diagnosed condition?|X|conditions|clinical_documents|||all||||first|
SUP-06|What was my earliest recorded medication?|X|medications|prescriptions|||all||||first|
SUP-07|What was my first blood pressure measurement?|D||clinical_documents,reports|blood pressure||all||||first|
SUP-08|What was my first lab test in 2023?|D||labs|||interval|2023|2023-01-01|2023-12-31|first|
TML-01|Show my health timeline|S|timeline||||all|||||
TML-02|What events happened in 2024?|X|timeline|clinical_documents,labs,reports|||interval|2024|2024-01-01|2024-12-31||
TML-03|When was my doctor consultation?|X|timeline|clinical_documents,reports|consultation||all|||||
TML-04|What was my timeline for Asthma?|X|conditions,timeline|clinical_documents|Asthma||all|||||
CMP-01|How has my cholesterol changed over time?|D||labs|Cholesterol||all|||||COMPARISON
CMP-02|Compare my blood test results between 2023 and 2025|D||labs|||interval||2023-01-01|2025-12-31||COMPARISON
CMP-03|How did my blood pressure change?|D||clinical_documents,reports|blood pressure||all|||||COMPARISON
CMP-04|Compare my medication dosage over time|X|medications|prescriptions||dosage|all|||||COMPARISON
"""
MODES = {"X": "CROSS_DOMAIN", "S": "STRUCTURED_ONLY", "D": "DOCUMENT_ONLY", "A": "AMBIGUOUS_CLARIFY", "U": "UNROUTABLE"}
SCHEMA = (
    "case_id string, query_text string, routing_mode string, structured_domains array<string>, document_domains array<string>,"
    " target_entity string, requested_attributes array<string>, temporal_scope string, anchor_year int, start_date date,"
    " end_date date, superlative string, question_intent string, clarification_required boolean, is_safety boolean,"
    " checks_intent boolean, ref_date date"
)


def _golden(spark):
    def many(text):
        return text.split(",") if text else []

    def day(text):
        return datetime.date.fromisoformat(text) if text else None

    rows = []
    for line in GOLDEN.strip().splitlines():
        c = line.split("|")
        rows.append((
            c[0], c[1], MODES[c[2]], many(c[3]), many(c[4]), c[5] or None, many(c[6]), c[7], int(c[8]) if c[8] else None,
            day(c[9]), day(c[10]), c[11] or None, c[12] or "QUERY", c[2] == "A", c[0].startswith("SAF"),
            c[0][:3] in ("SUP", "TML", "CMP"), REF,
        ))
    return spark.createDataFrame(rows, SCHEMA)


def test_golden_gates(spark):
    expected = _golden(spark)
    assert expected.count() == 70
    actual = un.annotate(expected.select("case_id", "query_text", "ref_date"))
    gates = {r.metric: (r.passed, r.total) for r in vl.conformance(expected, actual, "case_id").collect()}
    assert gates["routing_conformance"] == (66, 66)
    assert gates["false_unroutable"][0] == 0
    assert gates["clarification_recall"] == (4, 4)
    assert gates["clarification_precision"] == (4, 4)
    assert gates["false_clarification"][0] == 0
    assert gates["temporal_valid"] == (10, 10)
    assert gates["temporal_invalid"] == (2, 2)
    assert gates["superlative"] == (8, 8)
    assert gates["comparison"] == (4, 4)
    assert gates["timeline_routing"] == (4, 4)


def test_safety_cases(spark):
    flagged = _golden(spark).where(un.safety_triggered(F.col("query_text"))).select("case_id").collect()
    assert sorted(r.case_id for r in flagged) == ["SAF-01", "SAF-02", "SAF-03", "SAF-04"]


def test_relative_spans_and_validation(spark):
    rows = [
        ("Labs in the past 10 days", datetime.date(2026, 9, 14), REF, None),
        ("Labs in the last 2 months", datetime.date(2026, 7, 26), REF, None),
        ("Most recent labs over the past 3 months", datetime.date(2026, 6, 26), REF, "latest"),
        ("Any symptoms lately", None, None, "latest"),
    ]
    df = spark.createDataFrame([(i, r[0], REF) for i, r in enumerate(rows)], "n int, query_text string, ref_date date")
    got = {r.n: (r.start_date, r.end_date, r.superlative) for r in un.annotate(df).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}
    texts = spark.createDataFrame([("a",), ("  ",), ("x" * 1001,), ("fine",)], "t string")
    errors = [r.e for r in texts.select(un.validation_error(F.col("t")).alias("e")).collect()]
    assert errors == ["too_short", "blank", "too_long", None]
