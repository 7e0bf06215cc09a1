"""Patterns, word lists and limits that results depend on."""

# Months, and the three kinds of date in a text, in the order that breaks ties.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_NUMERIC = r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})\b"
DATE_DAY_FIRST = rf"\b(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})\b"
DATE_MONTH_FIRST = rf"\b({MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
PIVOT_YEAR = 50

# A personal name of up to four words.
NAME = r"([A-Z][a-zA-Z\-'.]+(?:[ \t]+[A-Z][a-zA-Z\-'.]+){0,3})"
PLAIN_NAME = r"([A-Z][a-zA-Z\-']+(?:[ \t]+[A-Z][a-zA-Z\-']+){0,3})"
TITLE = r"(?:Dr\.?|A/Prof\.?|Prof\.?|Mr\.?|Ms\.?|Physiotherapist)?"
# Author: signature block, sender line, any title that no "Dear" precedes.
AUTHOR_SIGNATURE = rf"(?:Yours\s+sincerely|Kind\s+regards|Regards|Yours\s+faithfully|Signed|Dictated\s+by|On\s+behalf\s+of)\s*,?\s*\n+(?:\([^)]*\)\s*\n+)?{TITLE}\s*{NAME}"
AUTHOR_SENDER = rf"(?:Clinical\s+Notes\s+of|From:)\s*{TITLE}\s*{NAME}"
AUTHOR_TITLE = rf"(?<!Dear\s)(?<!Dear\sDr\.\s)(?<!Dear\sDr\s)(?<!Dear\sA/Prof\.\s)(?<!Dear\sA/Prof\s)(?:Dr\.?|A/Prof\.?|Prof\.?|Mr\.?|Ms\.?)\s+{NAME}"
RADIOLOGIST_SIGNED = r"^Dr\s+([A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){1,3})\s*\nElectronically signed"
RADIOLOGIST_LINE = r"^Dr\s+([A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){1,3})\s*$"
RADIOLOGY_DATE = rf"(?:^|\b)(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTHS}|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{{4}})\b"

# Document types in declaration order.
DOCUMENT_TYPES = {
    "specialist_letter": r"(?:Dear\s+(?:Dr|Sybille|Doctor|Prof))|(?:Re:\s+.*DOB)|(?:Yours\s+sincerely)|(?:Kind\s+regards)",
    "clinical_notes": r"(?:Clinical\s+Notes)|(?:Date\s*\|?\s*Clinical\s*Notes)|(?:<th>Date</th>\s*<th>Clinical)",
    "referral_letter": r"(?:Thank\s+you\s+for\s+(?:referring|seeing))|(?:Please\s+accept\s+this\s+referral)|(?:I\s+am\s+referring)",
    "physiotherapy_report": r"(?:Physiotherap)|(?:ROM\b)|(?:range\s+of\s+motion)|(?:exercises?\s+program)",
    "medicolegal_report": r"(?:medico.?legal)|(?:independent\s+medical)|(?:IME\b)|(?:claim\s+number)",
    "radiology_report": r"(?:MR(?:I)?\s+(?:OF\s+|scan|report|findings|both|spine))|(?:CT\s+(?:OF\s+|scan))|(?:X[ -]?RAY)|(?:ultrasound\s+report)|(?:imaging\s+findings)|(?:Laboratory:\s*I-?MED\s+Radiology)|(?:Name of Test:\s*(?:MRI|CT|X[ -]?RAY))",
}
RADIOLOGY_TITLE = r"\b(?:CT\s+OF|MR(?:I)?\s+OF|MRI\s+BOTH|X[ -]?RAY)\b"
RADIOLOGY_PART = r"\b(?:Findings|Conclusion|Impression)\s*:"

# Section types in order of precedence.
SECTION_TYPES = {
    "clinical_findings": r"(?:On\s+examination)|(?:Clinical\s+findings)|(?:Physical\s+examination)|(?:range\s+of\s+motion)",
    "history": r"(?:Past\s+(?:History|Medical))|(?:Current\s+Problems)|(?:Presenting\s+complaint)|(?:History\s+of\s+(?:present|injury))",
    "medications": r"(?:Current\s+Medications?)|(?:Medications?:)|(?:Prescribed)",
    "diagnosis": r"(?:Diagnosis|Impression|Assessment|Conclusion)",
    "treatment_plan": r"(?:Treatment\s+Plan)|(?:Recommendations?)|(?:I\s+have\s+recommended)|(?:Management\s+plan)",
    "allergies": r"(?:Allergies?:?\s)|(?:Nil\s+Known)",
    "correspondence": r"(?:Dear\s+)|(?:To\s+whom)|(?:ELECTRONIC\s+TRANSMISSION)",
}
PATIENT = (
    rf"Re:\s+{PLAIN_NAME}\s+DOB",
    rf"Re:\s+(?:Mr|Mrs|Ms|Miss)\.?\s+{PLAIN_NAME}",
    rf"Patient(?:\s+Name)?:\s*{PLAIN_NAME}",
)

# Where sections begin (and, for the last, end); with the flags that each needs.
REPORT_TITLE = r"(?im)^(?:CT\s+OF\s+.+|MR(?:I)?\s+OF\s+.+|MRI\s+BOTH\s+HIPS)$"
SECTION_STARTS = (
    r"(?m)^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\s+Letter",
    r"(?im)^Dear\s+(?:Dr|Prof|Mr|Ms|Mrs)",
    r"(?im)^ELECTRONIC\s+TRANSMISSION",
    r"(?m)^Re:\s+",
    r"(?im)^Clinical\s+Notes\s+of",
    r"(?i)Scanned\s+Document\s+\(\s*'",
)
SIGNED_LINE = r"(?im)^Electronically signed[^\n]*$"

# Words in lower case: whatever a pattern matches holds one of its words.
REPORT_TITLE_WORDS, SIGNED_LINE_WORDS = ("ct", "mr"), ("electronically",)
SECTION_START_WORDS = (("letter",), ("dear",), ("electronic",), ("re:",), ("clinical",), ("scanned",))
AUTHOR_SIGNATURE_WORDS = ("sincerely", "regards", "faithfully", "signed", "dictated", "behalf")
AUTHOR_SENDER_WORDS = ("clinical", "from:")
AUTHOR_TITLES = ("Dr", "Prof", "Mr", "Ms")
DOCUMENT_TYPE_WORDS = {
    "specialist_letter": ("dear", "re:", "sincerely", "regards"),
    "clinical_notes": ("clinical",),
    "referral_letter": ("thank", "referral", "referring"),
    "physiotherapy_report": ("physiotherap", "rom", "range", "exercise"),
    "medicolegal_report": ("medico", "independent", "ime", "claim"),
    "radiology_report": ("mr", "ct", "ray", "ultrasound", "imaging", "laboratory", "name of test"),
}
RADIOLOGY_PART_WORDS = ("findings", "conclusion", "impression")
SECTION_TYPE_WORDS = {
    "clinical_findings": ("examination", "findings", "range"),
    "history": ("past", "current", "presenting", "history"),
    "medications": ("medication", "prescribed"),
    "diagnosis": ("diagnosis", "impression", "assessment", "conclusion"),
    "treatment_plan": ("plan", "recommend"),
    "allergies": ("allerg", "nil"),
    "correspondence": ("dear", "whom", "electronic"),
}
PATIENT_WORDS = (("re:",), ("re:",), ("patient",))
# Where the words above are common: whatever the pattern matches holds one of these, too.
DOCUMENT_TYPE_ALSO = {"medicolegal_report": ("legal", "medical", "ime", "number"), "clinical_notes": ("notes", "<th>date")}
# The letters that a match begins with; a place is tested for them first, before all alternatives of a pattern.
DOCUMENT_TYPE_FIRST = {"specialist_letter": "dryk", "clinical_notes": "cd<", "referral_letter": "tpi", "physiotherapy_report": "pre", "medicolegal_report": "mic", "radiology_report": "mcxuiln"}
SECTION_TYPE_FIRST = {"clinical_findings": "ocpr", "history": "pch", "medications": "cmp", "diagnosis": "diac", "treatment_plan": "trim", "allergies": "an", "correspondence": "dte"}
AUTHOR_SIGNATURE_FIRST, AUTHOR_SENDER_FIRST = "ykrsdo", "cf"
LEAST_SECTION, CHUNK_SIZE, CHUNK_OVERLAP, RADIOLOGY_SIZE = 200, 800, 100, 6000

# Clinic line and reference number.
CLINIC = r"^(?:Clinic|Practice|Facility|Hospital|Medical Centre|Health Service)\s*:\s*(\S[^\n]{1,120})$"
REFERENCE = r"\b(?:Ref(?:erence)?|Claim|Accession)(?:\s*(?:No|Number)\.?)?\s*:\s*[A-Z0-9][A-Z0-9._/\-]*"
DOB = r"(?:DOB|Date of Birth)\s*:?\s*(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})"
IGNORED_NAMES = "circuit|landing|road|street|highway|avenue|drive|court|tel|phone|ref|dear|patient|client|address|mobile|medicare|age|gentleman|wife|son|letter|referral"
INJURIES = (
    r"(?:diagnosis|injury|injuries)\s+(?:of|is|was|were)\s+([^.\n]{5,100})",
    r"(?:diagnosed|sustained)\s+(?:with|a)\s+([^.\n]{5,100})",
    r"Re:\s+[^.\n]+?(?:DOB|Date of Birth)[^.\n]*?\n([^.\n]{5,100})",
    r"diagnosis\s*:\s*([^.\n]{5,100})",
    r"injury\s*:\s*([^.\n]{5,100})",
)
# words in lower case: whatever a pattern matches holds one of its words
INJURY_WORDS = (("diagnosis", "injury", "injuries"), ("diagnosed", "sustained"), ("re:",), ("diagnosis",), ("injury",))
NAMED_INJURIES = "glenohumeral dislocation|bankart lesion|slap repair|slap tear|supraspinatus tear|biceps tendonitis|disc herniation|whiplash|sciatica|abdominal strain|rotator cuff tear"
GENERIC_INJURIES = "injury/condition|our client|condition|the client"

# Chronology: documented dates, signals, exclusions.
SHORT_MONTHS = MONTHS + "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DOCUMENTED = {
    "iso": r"(?:19|20)\d{2}-[01]\d-[0-3]\d",
    "numeric": r"[0-3]?\d[./-][01]?\d[./-](?:19|20)\d{2}",
    "dmy": rf"[0-3]?\d(?:st|nd|rd|th)?\s+(?:{SHORT_MONTHS})\.?\s+(?:19|20)\d{{2}}",
    "mdy": rf"(?:{SHORT_MONTHS})\.?\s+[0-3]?\d(?:st|nd|rd|th)?,?\s+(?:19|20)\d{{2}}",
    "month": rf"(?:{SHORT_MONTHS})\.?\s+(?:19|20)\d{{2}}",
    "year": r"(?:19|20)\d{2}",
}
# every kind begins with a digit or the first letters of a month; that is looked for first, being the cheapest
DOCUMENTED_DATE = r"(?i)(?=[0-9]|ja|fe|ma|ap|ju|au|se|oc|no|de)\b(?:" + "|".join(DOCUMENTED.values()) + r")\b"
DURATION = r"(?<!\d)(?:\d{1,3}(?:\s*[–—-]\s*\d{1,3})?)\s*/\s*(?:52|12|7|24)(?!\d)"
EVENT_SIGNAL = r"\b(?:accident|admitted|admission|assessment|attended|capacity|certificate|claim|complain(?:ed|s)?|consult(?:ation|ed)?|diagnos(?:is|ed)|discharg(?:e|ed)|doctor|examin(?:ation|ed)|fracture|headache|hospital|imaging|impairment|injur(?:y|ed)|injection|investigation|medication|mri|operation|pain|physio(?:therapy)?|procedure|reported|review(?:ed)?|scan|specialist|surgery|symptom|treatment|unfit|work(?:cover)?|x-?ray|ultrasound|prescri(?:be|bed|ption)|referr(?:al|ed))\b"
NON_EVENT = r"\b(?:date of birth|birthdate|d\.?o\.?b\.?|items? (?:exported|from)|subpoena generated|printed on|expiry date|civil procedure act|phone|fax|tel:|training/courses?|qualification/course|employer name|job title|driver'?s licence|medical records? from|request for (?:a )?copy|following up on (?:our|the) (?:previous )?request|consultation notes? [–—-]|workplace injury rehabilitation (?:and compensation )?act|entitled to compensation|proceedings for damages)\b"
YEAR_SIGNAL = r"\b(?:accident|admitted|ceased|commenced|diagnosed|felt|injur(?:y|ed)|pain|prescribed|reported|returned|surgery|symptom|treated|treatment|valium|work-related)\b"
BIRTH_PREFIX = r"(?:date of birth|birthdate|d\.?o\.?b\.?)\s*:?[\s\w,/-]*$"
YEAR_EXCLUDED = r"(?:\+61|@|\b(?:act|section|division|course|certificate)\b)"
HISTORICAL = r"\b(?:history|historical|prior|previous|ago|in around|in about)\b"
INFERENCE = r"\b(likely|presumably|apparently|probably|routine|suggests that)\b"
EXCLUDED_ROLES = ("date_of_birth", "duration", "review_interval", "administrative_metadata")
DATE_ROLES = ("event_date", "encounter_date", "report_authored_date", "result_date", "order_date", "historical_event_date", "document_header_date", "date_of_birth", "relative_date", "duration", "review_interval", "administrative_metadata", "ambiguous")
PLACEHOLDERS = ("missing-value phrase", "missing value phrase")
NOT_GIVEN = ("Not documented in the available text", "Not applicable—administrative event")
GROUNDING_STOP_WORDS = ("with", "from", "that", "this", "were", "been", "into", "after", "before", "available", "documented", "text", "patient", "event")
VISIT_HEADER = r"(?im)^(?=(?:surgery|telehealth|telephone|non visit|consultation|home visit)?\s*(?:consultation\s*)?recorded by:\s*[^\n]+\s+visit date:\s*[0-3]?\d[./-][01]?\d[./-](?:19|20)\d{2})"
VISIT_HEADER_WORDS = ("recorded by:",)  # in lower case
EVENT_TYPES = (
    ("Investigation/imaging", "mri|x-ray|xray|ct |ultrasound|scan|imaging"),
    ("Procedure/treatment", "surgery|operation|procedure|injection"),
    ("Administrative/work capacity", "claim|insurer|workcover|compensation|capacity"),
)
OTHER_EVENT = "Dated record event"
MISSING = "Not documented in the available text"
BATCH_CHARS, FAST_BATCH_CHARS, FAST_BATCH_CHUNKS, BATCH_OVERHEAD = 48_000, 12_000, 3, 600
NEAR_EVENT = 0.72

# Answers and evidence.
CANONICAL_DATE = r"\b(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])\b|\b(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d{2}\b"
SOURCE_TAG = r"(?i)\[sources?\s*:?\s*(\d+(?:\s*,\s*\d+)*)\]"
INDIRECT = "index|attachment list|document review"
SUBSTANTIVE = "history of injury|presenting complaint|symptom|diagnos|examination|clinical finding|treatment|medication|work capacity|return to work|prognosis|radiology|impression|assessment"
BROAD = "comprehensive|complete|all records|every record|chronology|timeline|entire history|full history"
COMPARISON = "compare|difference|conflict|inconsisten|versus| vs "
MULTIPART = r"(?i)(?:^|\s)(?:\([a-z]\)|[a-z]\)|\d+[.)])\s"
CORPUS_CLAIM = r"(?i)\b(?:documents?|records?|excerpts?)\b[^.]{0,100}\b(?:primarily|mostly|largely)\b[^.]{0,80}\b(?:index|indices|administrative|lack(?:ing)? substantive|insubstantial)"
DATE_ERROR_CLAIM = r"(?i)\b(?:date|dates|metadata)\b[^.]{0,120}\b(?:likely|probably|apparently|appear(?:s)? to be)\b[^.]{0,80}\b(?:error|placeholder|ocr|template|default)"
OUTPUT_TOKENS = (1536, 2560, 4096)
IMAGING_WORDS = "radiolog|imaging|ct |mri|x-ray"
IMAGING_TERMS = ("CT OF THE LUMBOSACRAL SPINE", "MR OF THORACOLUMBAR AND SACRAL SPINE", "MRI BOTH HIPS", "Conclusion:")
PRIMARY_SCORE, NAMED_SCORE, PRIMARY_FLOOR = 0.95, 0.84, 0.99
MMR_LAMBDA = 0.7

# Query facets by kind of search.
FACETS = {
    "analytical": (
        "chronology and temporal relationship",
        "objective clinical findings and investigations",
        "pre-existing conditions and baseline function",
        "treating practitioner opinions and recommendations",
        "independent or expert opinions",
        "alternative explanations, intervening events, and contrary evidence",
        "functional course, work capacity, treatment response, and prognosis",
    ),
    "free_qa": (
        "primary records and findings directly responsive to each part of the question",
        "explicit opinions, contrary evidence, and material limitations",
    ),
    "expert": (
        "precise alleged incident, occupational exposure, duties, dose, duration, and mechanism",
        "contemporaneous symptom onset, chronology, reporting consistency, and baseline function",
        "primary imaging, pathology, examination findings, diagnoses, and differential diagnoses",
        "pre-existing conditions, natural history, prior symptoms, and prior treatment",
        "treating and independent causation opinions, reasoning, qualifications, and assumptions",
        "alternative causes, intervening events, contrary evidence, and evidentiary inconsistencies",
        "treatment response, longitudinal function, work capacity, prognosis, and subsequent course",
        "missing or referenced records material to causation, diagnosis, or the legal threshold",
    ),
    "judge": (
        "jurisdiction, cause of action, statutory test, governing authority, burden, and standard",
        "pleadings, questions referred, concessions, and each party's material contention",
        "chronology, agreed facts, disputed facts, contemporaneous records, and admissions",
        "witness and expert opinions, factual assumptions, methodology, conflicts, and limitations",
        "medical causation, legal causation, pre-existing conditions, contribution, and alternatives",
        "documentary reliability, corroboration, inconsistency, missing evidence, and evidentiary weight",
        "damages, work capacity, treatment, prognosis, mitigation, and functional consequences",
        "procedural history, prior findings, requested relief, orders, and disposition",
    ),
}
FACET_LEAD = "\nEvidence focus: "
# Modes: the facet set (none: one plain search), least number of hits, score threshold, whether hits are reranked.
MODES = {
    "free_qa": ("free_qa", 16, 0.15, False),
    "expert_analysis": ("expert", 50, 0.05, True),
    "judge_analysis": ("judge", 50, 0.05, True),
    "causation": ("analytical", 50, 0.05, True),
    "prognosis": ("analytical", 50, 0.05, True),
    "work_capacity": ("analytical", 50, 0.05, True),
    "treatment_planning": ("analytical", 50, 0.05, True),
    "timeline": (None, 50, 0.05, False),
    "injury_summary": (None, 50, 0.05, False),
    "inconsistency_finder": (None, 50, 0.05, False),
    "medication_tracker": (None, 50, 0.05, False),
}
NO_RETRIEVAL_MODE, DEFAULT_MODE = "general_knowledge", "free_qa"
FACET_HITS = (8, 20)  # least and most hits of one facet's search
NAMED_HITS = (12, 24)  # least and most hits that are found by named terms

# Log lines of the workers and of indexing.
WORKER_HEAD = "Worker ID"
WORKER_COLUMNS = {3: ["Worker ID", "finished", "started"], 4: ["Worker ID", "errored", "finished", "started"]}
PAGE_TOTALS = {
    "completed": (r"Completed pages:\s*([\d,]+)", r"completed_pages\s+([\d.]+)"),
    "failed": (r"Failed pages:\s*([\d,]+)", r"failed_pages\s+([\d.]+)"),
}
STAGE_MARKS = (
    ("prepare", ("Initiated", "Creating new case", "Adding to existing case", "Copied", "Registering case metadata")),
    ("upload", ("Uploaded", "Uploading to object storage")),
    ("chunk", ("Created", "Chunking documents")),
    ("embed", ("Embedding and indexing", "Embedding chunks", "[PROGRESS:embedding:")),
    ("index", ("[PROGRESS:indexing:",)),
    ("done", ("Successfully indexed", "Successfully uploaded", "✅ Done.")),
)
CHUNKS_CREATED = r"Created \*\*?(\d+)\*\*? chunk"
CHUNKS_TO_INDEX = r"indexing \*\*?(\d+)\*\*? chunks"
STAGE_COUNTER = r"\[PROGRESS:{}:(\d+)/(\d+)\]"

# Chronologies as text.
NO_FILE = "Indexed case record"
CHRONOLOGY_TITLE = "## Comprehensive Medicolegal Chronology"
SHORT_COLUMNS = "| Date | Provider/Facility | Event Summary | Intervention/Plan | Source |"
LONG_COLUMNS = "| Date | Provider/Facility | Presenting Symptoms | Diagnosis | Investigations/Findings | Intervention/Plan | Source |"
INCOMPLETE_HEAD = "\n> ⚠️ **INCOMPLETE CHRONOLOGY:** Not every indexed source unit completed successfully."
ULTRA_FAST_NOTE = "> ⚡ Whole-case dated-text index with bounded semantic filtering. It may not resolve implicit dates or separate multiple events described in one excerpt."
MISSED_DOCUMENTS = "> ⚠️ **Incomplete chronology:** One or more indexed documents contained no auditable source chunks."
FAILED_BATCHES = "> ⚠️ **Incomplete chronology:** One or more source batches could not be extracted. Do not rely on this output as a complete record audit."
WARNED_ENTRIES = "> ⚠️ Entries with incomplete or invalid dates, or potentially inferential language, require source review."

# A client's name in a text, in the order in which the forms are tried.
_WORDS = r"[A-Z][a-zA-Z\-'`]+(?:\s+[A-Z][a-zA-Z\-'`]+)"
NAMES_IN_TEXT = (
    rf"Re:\s*(?:Mr|Mrs|Ms|Dr|Prof)?\.?\s*({_WORDS}{{1,3}})",
    rf"Client\s+({_WORDS}{{1,3}})",
    rf"Patient\s*:?\s*({_WORDS}{{1,3}})",
    rf"({_WORDS}{{1,2}})\s+(?:DOB|Date of Birth)",
)
NAME_IN_TEXT_WORDS = ("Re:", "Client", "Patient", "DOB", "Date of Birth")
UNKNOWN_CLIENT, NO_DOB = "Unknown Client", "—"
