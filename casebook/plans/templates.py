"""Question templates with the targets they must be understood as.

The texts drive the inquiries view; the expected fields are the oracle's independent statement of
each target (the Spark side always runs the annotator).
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    text: str
    structured: tuple = ()
    document: tuple = ()
    entity: str | None = None
    attributes: tuple = ()
    scope: str = "all"
    start: str | None = None
    end: str | None = None
    raw: str | None = None
    superlative: str | None = None
    intent: str = "QUERY"
    mode: str = "CROSS_DOMAIN"


_RX = ("prescriptions",)
_VISITS = ("clinical_documents", "reports")
_MED = ("medications",)
_CON = ("conditions",)
_CD = ("clinical_documents",)
_S, _D, _X = "STRUCTURED_ONLY", "DOCUMENT_ONLY", "CROSS_DOMAIN"

TEMPLATES = (
    Template("Who prescribed the Lisinopril I use and at which dose?", _MED, ("prescriptions", "clinical_documents"),
             "Lisinopril", ("dosage", "physician_name")),
    Template("Tell me the dosage of my Metformin", _MED, _RX, "Metformin", ("dosage",)),
    Template("Am I taking any Atorvastatin?", _MED, _RX, "Atorvastatin", (), "current"),
    Template("Which medications was I given in 1998?", _MED, _RX, None, (), "interval",
             "1998-01-01", "1998-12-31", "in 1998"),
    Template("Do I have any Hypertension?", _CON, _CD, "Hypertension", (), "current"),
    Template("Was I once diagnosed with Asthma?", _CON, _CD, "Asthma", (), "historical"),
    Template("Was hypertension noted for me between 1996 and 1997?", _CON, _CD, "Hypertension", (), "interval",
             "1996-01-01", "1997-12-31", "between 1996 and 1997"),
    Template("Do I have any Peanut allergy?", ("allergies",), _CD, "Peanut", (), "current"),
    Template("Did a Latex allergy of mine show up in 2021?", ("allergies",), _CD, "Latex", (), "interval",
             "2021-01-01", "2021-12-31", "in 2021"),
    Template("Which blood group is mine?", ("profile",), (), None, ("blood_group",), mode=_S),
    Template("Which symptoms have I logged?", ("symptoms",), (), None, (), "current", mode=_S),
    Template("Which symptoms did I write down in 2024?", ("symptoms",), (), None, (), "interval",
             "2024-01-01", "2024-12-31", "in 2024", mode=_S),
    Template("Tell me the status of each of my health goals", ("goals",), (), None, ("status",), mode=_S),
    Template("Lay out my whole timeline", ("timeline",), (), mode=_S),
    Template("Lay out the timeline of past goals of mine", ("timeline", "goals"), (), mode=_S),
    Template("Lay out a timeline of my Asthma symptoms", ("conditions", "timeline", "symptoms"), _CD, "Asthma"),
    Template("Which entry is the latest on my timeline?", ("timeline",), (), None, (), superlative="latest", mode=_S),
    Template("Which entry with a dosage came first on my timeline?", ("timeline",), _RX, None, ("dosage",),
             superlative="first"),
    Template("Which current goals of mine are on the timeline?", ("timeline", "goals"), (), None, (), "current",
             mode=_S),
    Template("Give me the latest cholesterol value of mine", (), ("labs",), "Cholesterol", (), superlative="latest", mode=_D),
    Template("Give me my first measurement of blood pressure", (), _VISITS, "blood pressure", (),
             superlative="first", mode=_D),
    Template("Give me the newest prescription of mine", (), _RX, None, (), superlative="latest", mode=_D),
    Template("Give me the latest lab report of mine in 2022", (), ("reports", "clinical_documents", "labs"), None, (),
             "interval", "2022-01-01", "2022-12-31", "in 2022", "latest", mode=_D),
    Template("How high was my cholesterol in 2023?", (), ("labs",), "Cholesterol", (), "interval",
             "2023-01-01", "2023-12-31", "in 2023", mode=_D),
    Template("Give me the physician name on my papers", (), ("prescriptions", "clinical_documents"), None,
             ("physician_name",), mode=_D),
    Template("Give me a contact number for the clinic", (), _VISITS, None, ("clinic", "contact_number"), mode=_D),
    Template("How often is my prescription to be taken and at which dose?", (), _RX, None,
             ("dosage", "frequency"), mode=_D),
    Template("Which findings did the chest scan of mine give?", (), ("reports", "clinical_documents"), mode=_D),
    Template("Give me LDL results and the dosage", (), ("prescriptions", "labs"), "LDL", ("dosage",), mode=_D),
    Template("How has cholesterol changed over time for me?", (), ("labs",), "Cholesterol", (),
             intent="COMPARISON", mode=_D),
    Template("Compare the dosage of each medication over time", _MED, _RX, None, ("dosage",), intent="COMPARISON"),
    Template("How did blood pressure change for me?", (), _VISITS, "blood pressure", (), intent="COMPARISON", mode=_D),
    Template("Compare all my symptoms over time", ("symptoms",), (), None, (), intent="COMPARISON", mode=_S),
    Template("Compare the status of my Hypertension over time", _CON, _CD, "Hypertension", ("status",),
             intent="COMPARISON"),
    Template("Which condition was the first one diagnosed?", _CON, _CD, None, (), superlative="first"),
    Template("Give me the earliest medication dosage recorded, and its clinic", _MED,
             ("prescriptions", "clinical_documents", "reports"), None, ("dosage", "clinic"), superlative="first"),
    Template("Give me the latest dose and frequency of Lisinopril", _MED, _RX, "Lisinopril",
             ("dosage", "frequency"), superlative="latest"),
    Template("Lay out my medical history and everything on file", ("conditions", "medications"),
             ("clinical_documents", "reports", "prescriptions", "labs"), None, (), "historical"),
    Template("So how am I doing these days?", mode="AMBIGUOUS_CLARIFY"),
    Template("Which values did the blood test give on February 30, 2024?", (), ("labs",), None, (), "interval",
             raw="on february 30, 2024", mode="UNROUTABLE"),
    Template("After severe chest pain yesterday I passed out", mode="UNROUTABLE"),
    Template("Which river runs through the middle of Vienna?", mode="UNROUTABLE"),
    Template("Compare my events with my conditions over time", ("conditions", "timeline"),
             ("clinical_documents", "reports", "labs"), None, (), intent="COMPARISON"),
    Template("Were any of my GERD medicines stopped lately?", ("medications", "conditions"),
             ("prescriptions", "clinical_documents"), "GERD", ("status",), superlative="latest"),
)
