"""Word lists, lookup tables, messages and formats results must agree with."""

# --- fixed values: question word lists -------------------------------------------------------
PROVIDER = (
    "physician", "doctor", "prescriber", "clinician", "provider", "specialist", "cardiologist",
    "surgeon", "who signed", "who wrote", "who prescribed", "who put me on", "who started me on",
)
MEDICATION_RECORD = (
    "medications", "medication", "medicine", "medicines", "drug", "drugs", "pill", "pills", "refill",
    "taking", "lisinopril", "albuterol", "metformin", "atorvastatin", "ibuprofen", "amoxicillin",
    "omeprazole",
)
MEDICATION_DOCUMENT = (
    "prescription", "prescriptions", "rx", "prescribed", "medication document", "dose", "dosage",
)
CONSULTATION = (
    "doctor say", "doctor note", "doctor letter", "consultation", "consultation note", "recommendation",
    "discharge instructions", "advice", "visit note", "clinic note", "referral", "referral letter",
    "discharge summary", "hospital letter",
)
DIAGNOSTIC = (
    "report", "reports", "scan", "mri", "x-ray", "xray", "ct", "ct scan", "ultrasound", "echo",
    "echocardiogram", "ecg", "ekg", "imaging", "radiology", "pathology", "biopsy", "findings",
    "impression",
)
LAB = (
    "lab", "labs", "lab report", "blood test", "blood work", "test result", "test results", "panel",
    "lipid panel", "metabolic panel", "creatinine", "hba1c", "glucose", "cholesterol", "ldl", "hdl",
    "triglyceride", "vitamin d", "vitamin b12", "tsh", "thyroid", "cbc", "complete blood count",
    "urine", "urinalysis", "ferritin", "sodium", "potassium",
)
CONDITION = (
    "condition", "conditions", "diagnosis", "diagnosed with", "asthma", "diabetes", "hypertension",
    "high blood pressure", "depression", "anxiety", "gerd", "copd", "arthritis",
)
ALLERGY = (
    "allergy", "allergies", "allergic", "allergic to", "reaction to", "peanut", "penicillin", "sulfa",
    "latex", "hives", "anaphylaxis",
)
PROFILE = ("blood type", "blood group", "height", "biological sex", "date of birth", "profile")
BROAD = (
    "my records", "medical records", "medical history", "health summary", "recent documents",
    "recent visits", "everything on file",
)
VITALS = ("vitals", "vital signs", "vital sign")
TIMELINE = ("timeline",)
EVENT = ("event", "events", "health events")
GOAL = ("goal", "goals")
SYMPTOM = ("symptom", "symptoms")
CLINIC = ("clinic", "hospital", "facility", "practice", "health center", "medical center")
VAGUE = (
    "recently", "lately", "a while ago", "how am i doing", "tell me something useful",
    "what should i know", "hello", "hi", "hey", "can you help me", "what's up", "whats up",
    "greetings", "good morning", "good afternoon", "good evening",
)
VAGUE_RECENCY = ("recently", "lately", "a while ago")

DOSAGE_WORDS = ("dosage", "dose", "strength", "amount", "how much")
BLOOD_GROUP_WORDS = ("blood type", "blood group")
STATUS_WORDS = ("status", "active", "stopped", "discontinued", "resolved")
FREQUENCY_WORDS = ("frequency", "how often", "schedule", "interval")
NOTES_WORDS = (
    "doctor say", "doctor note", "consultation", "advice", "recommendation", "instructions",
)
CONTACT_WORDS = ("phone", "phone number", "telephone", "contact", "fax", "call")
PHYSICIAN_WORDS = (
    "physician", "doctor", "prescriber", "clinician", "provider", "who signed", "who wrote",
    "who prescribed", "who put me on", "who started me on",
)

LATEST_WORDS = ("latest", "newest", "most recent")
FIRST_WORDS = ("first", "earliest", "oldest", "initial")
CURRENT_WORDS = ("current", "currently", "taking", "active", "now", "present")
HISTORICAL_WITH_SUPERLATIVE = (
    "discontinued", "resolved", "stopped", "history", "historical", "previously", "in the past",
)
HISTORICAL_WORDS = (
    "past", "historical", "history", "was", "diagnosed", "previously", "stopped", "discontinued",
    "resolved",
)
LAST_YEAR_WORDS = ("last year", "past year")
THIS_YEAR_WORDS = ("this year", "current year")

# --- fixed values: entity dictionary, canonical spelling --------------------------------------
MEDICATION_ENTITIES = (
    "Lisinopril", "Albuterol", "Metformin", "Atorvastatin", "Ibuprofen", "Amoxicillin", "Omeprazole",
)
CONDITION_ENTITIES = (
    "Asthma", "Diabetes", "Hypertension", "GERD", "Depression", "High blood pressure", "Anxiety",
    "COPD", "Arthritis",
)
ALLERGY_ENTITIES = ("Peanut", "Penicillin", "Latex", "Sulfa")
ANALYTE_ENTITIES = (
    "Creatinine", "HbA1c", "Vitamin D", "Cholesterol", "LDL", "HDL", "TSH", "Glucose",
)
VITAL_ENTITIES = ("blood pressure", "vital signs", "vitals")
ENTITIES = (
    MEDICATION_ENTITIES + CONDITION_ENTITIES + ALLERGY_ENTITIES + ANALYTE_ENTITIES + VITAL_ENTITIES
)

# --- fixed values: date and intent patterns ---------------------------------------------------
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3,
    "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
MONTH_ALTERNATION = "|".join(MONTHS)
PAST_DAYS = r"(past|last)\s+(\d+)\s+days?"
PAST_MONTHS = r"(past|last)\s+(\d+)\s+months?"
BETWEEN_YEARS = r"between\s+(\d{4})\s+and\s+(\d{4})"
ISO_DATE = r"(\d{4})-(\d{2})-(\d{2})"
CALENDAR_DATE = r"(on\s+)?(" + MONTH_ALTERNATION + r")\s+(\d{1,2}),?\s+(\d{4})"
MONTH_YEAR = r"\b(" + MONTH_ALTERNATION + r")\s+(\d{4})\b"
IN_YEAR = r"in\s+(\d{4})"
BARE_YEAR = r"\b(20\d{2})\b"
RELATIVE_SPAN = r"\b(past|last|recent)\s+(?:\d+\s+)?(?:days?|months?|weeks?|years?)\b"
COMPARISON = (
    r"\bcompare\b",
    r"\bcomparison\b",
    r"\bhow (has|have|did)\b.*?\b(change|changed)\b",
    r"\b(change|changed)\b.*?\bover time\b",
    r"\bdifference between\b",
    r"\btrends?\b",
    r"\bprogression\b",
    r"\bover time\b",
)

# --- fixed values: acute-symptom patterns -----------------------------------------------------
SAFETY = (
    r"\b(severe|crushing|radiating|intense|acute)\s+(chest\s+pain|chest\s+pressure|chest\s+tightness)\b",
    r"\b(chest\s+pain|chest\s+pressure|chest\s+tightness).{0,40}\b(severe|crushing|radiating|intense|acute)\b",
    r"\b(sudden|unilateral|one-sided|one\s+sided|left-sided|right-sided)\s+(weakness|numbness|paralysis)\b",
    r"\bfacial\s+(droop|drooping)\b",
    r"\b(face|mouth)\s+(droops|drooping|drooped)\b",
    r"\b(severe|acute|sudden)\s+(breathing\s+difficulty|shortness\s+of\s+breath|dyspnea)\b",
    r"\bcan'?t\s+breathe\b",
    r"\bgasping\s+for\s+air\b",
    r"\bthroat\s+(is\s+)?closing\b",
    r"\btrouble\s+breathing.{0,40}\b(hives|swelling)\b",
    r"\b(difficulty|trouble)\s+breathing.{0,40}\b(hives|swelling)\b",
    r"\b(hives|swelling).{0,40}\b(difficulty|trouble)\s+breathing\b",
    r"\banaphylaxis\b",
    r"\banaphylactic\b",
    r"\bthroat\s+swelling\b",
    r"\b(sudden\s+)?loss\s+of\s+consciousness\b",
    r"\bpassed\s+out\b",
    r"\bfainted\b",
    r"\bblacked\s+out\b",
    r"\bcollapsed\b",
    r"\bsevere\s+(head\s+trauma|head\s+injury|blow\s+to\s+the\s+head)\b",
    r"\bhead\s+(trauma|injury).{0,40}\b(severe|bad|bleeding|loss\s+of\s+consciousness)\b",
    r"\bhit\s+my\s+head.{0,40}\b(hard|passed\s+out|fainted)\b",
    r"\b(kill|hurt|harm)\s+myself\b",
    r"\bcommit\s+suicide\b",
    r"\bend\s+my\s+life\b",
    r"\bwant\s+to\s+die\b",
)
SAFETY_ADVISORY = (
    "Your inquiry mentions symptoms that may require prompt medical evaluation. "
    "Please seek professional medical care. If you believe this may be an emergency, "
    "contact your local emergency services. This system does not assess symptom "
    "severity, perform clinical triage, or provide medical diagnoses."
)
CLARIFICATION_PROMPT = (
    "Could you please specify which aspect of your health records you would "
    "like to review (such as your medications, lab results, conditions, or "
    "recent doctor visits)?"
)
UNROUTABLE_ANSWER = "Your query could not be matched to medical records."

# --- fixed values: domains, document types, recall variants -----------------------------------
STRUCTURED_DOMAINS = (
    "conditions", "medications", "allergies", "symptoms", "goals", "profile", "timeline",
)
DOCUMENT_DOMAINS = ("labs", "reports", "prescriptions", "clinical_documents")
DOMAIN_DOCUMENT_TYPES = {
    "labs": ("lab_report",),
    "reports": ("diagnostic_report",),
    "prescriptions": ("prescription",),
    "clinical_documents": ("discharge_summary", "medical_record", "other"),
}
DOCUMENT_TYPES = (
    "lab_report", "prescription", "diagnostic_report", "discharge_summary", "medical_record", "other",
)
LEXICAL_VARIANTS = {
    "cholesterol": ("cholesterol", "total cholesterol", "chol"),
    "blood pressure": ("blood pressure", "bp"),
}
CONTEXT_DOMAINS = (
    "profile", "conditions", "medications", "allergies", "symptoms", "goals", "recent_timeline_events",
)

# --- fixed values: attribute labels and limits ------------------------------------------------
ATTRIBUTE_LABELS = {
    "physician_name": "physician name",
    "dosage": "dosage",
    "clinic": "clinic or facility name",
    "consultation_notes": "consultation notes or doctor recommendations",
    "contact_number": "contact phone number",
    "frequency": "medication frequency",
    "status": "status",
    "blood_group": "blood group",
    "systolic": "systolic",
    "diastolic": "diastolic",
    "pulse": "pulse",
    "ldl": "LDL",
    "hdl": "HDL",
    "iron": "Iron",
    "ferritin": "Ferritin",
    "trigger": "trigger",
}
BOUNDED_QUALIFIER = (
    "Note: This summary highlights key milestone dates (Baseline, Intermediate, "
    "and Latest). Additional qualified dated candidates were identified in the "
    "evaluated evidence set and are not shown in this summary."
)
DENSE_CANDIDATES = 10
LEXICAL_CANDIDATES = 10
DEFAULT_TOP_K = 3
MAX_TOP_K = 5
PASSAGE_BUDGET = 4
MAX_PASSAGE_CHARS = 1200
MAX_PASSAGES = 5
MAX_EXCERPT_CHARS = 6000
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
EMBEDDING_BATCH = 50
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"
