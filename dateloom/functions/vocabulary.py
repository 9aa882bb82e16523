"""Fixed values of the date domain: words, patterns and tables that results depend on."""

from __future__ import annotations

# Month names; the first three letters and "sept" are read too.
MONTHS = "January February March April May June July August September October November December".split()
ROMAN = "I II III IV V VI VII VIII IX X XI XII".split()
MONTH_NUMBER = (
    {m.lower(): i for i, m in enumerate(MONTHS, 1)} | {m[:3].lower(): i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
)
ROMAN_NUMBER = {r.lower(): i for i, r in enumerate(ROMAN, 1)}

# Words that name a date's field.
FIELD_WORDS: dict[str, list[str]] = {
    "expiry": ["expiry", "expiration", "expires", "exp", "use before", "valid until", "shelf life"],
    "manufacture": ["manufacture", "manufactured", "manufacturing", "mfg", "mfd", "production", "packed"],
    "retest": ["retest", "re-test", "re test"],
    "release": ["release", "release date", "date of release"],
    "qa_check": ["qa", "qc", "quality", "check", "inspection", "reviewed", "verified", "released"],
    "audit": ["audit", "supplier visit", "vendor review"],
    "received": ["received", "arrival", "delivered"],
    "document": ["document", "issue date", "issued", "date of issue", "printed", "report date"],
}

# Words that OCR misreads, and the characters it reads for digits and roman numerals.
MISREAD_WORDS = {
    "exp1ry": "expiry",
    "exp1ration": "expiration",
    "manufacturc": "manufacture",
    "mfg.": "mfg:",
    "q.c.": "qc",
}
DIGIT_LOOKALIKES = {"O": "0", "I": "1", "l": "1", "S": "5", "B": "8"}
ROMAN_LOOKALIKES = {"1": "I", "l": "I", "|": "I", "L": "I"}

# What vetoes a numeric month and year as a quantity.
UNITS = (
    "ng ug µg μg mcg mg g kg ml µl μl ul l nm um µm μm mm cm cfu ppm ppb iu unit units count counts tablet tablets "
    "capsule capsules vial vials dose doses"
).split()

# The taxonomy, families in order with their types in order.
TAXONOMY: dict[str, tuple[str, list[str]]] = {
    "product": (
        "Product / batch",
        "manufacture_date expiry_date retest_date packaging_date release_date sampling_date test_date analysis_report_date".split(),
    ),
    "document": (
        "Document control",
        "effective_date issue_date version_date approval_date review_date next_review_date superseded_date".split(),
    ),
    "signature": ("Signature", ["signature_date"]),
    "legal": (
        "Legal / regulatory",
        (
            "certificate_issue_date certificate_valid_until notarization_date apostille_date legalization_date "
            "translation_certification_date authorization_date"
        ).split(),
    ),
    "audit": ("Audit / inspection", "inspection_date audit_date next_audit_date capa_due_date".split()),
    "logistics": ("Logistics", "shipping_date receipt_date".split()),
    "other": ("Other", "other_date unknown".split()),
}
TYPE_LABELS = {"capa_due_date": "CAPA due date", "certificate_valid_until": "Certificate valid until", "unknown": "Unknown"}
FAMILY_OF = {t: f for f, (_, types) in TAXONOMY.items() for t in types}
TYPES = list(FAMILY_OF)

# Rule labels that decide the type by themselves.
STRONG_TYPES = {
    "expiry": "expiry_date",
    "manufacture": "manufacture_date",
    "audit": "audit_date",
    "received": "receipt_date",
    "retest": "retest_date",
    "release": "release_date",
}

# Number words of the loose parser.
UNIT_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen"
).split()
ORDINAL_WORDS = (
    "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth "
    "fifteenth sixteenth seventeenth eighteenth nineteenth"
).split()
TEN_WORDS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
TENTH_WORDS = "twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split()
FILLER_WORDS = frozenset("the day of this on in year our lord a d and".split())

# Discard reasons.
UNKNOWN_ID = "unknown candidate id"
NOT_IN_TAXONOMY = "date type not in taxonomy"
DUPLICATE_LABEL = "duplicate label for the same candidate"
UNPARSED = "could not parse the text as one date"
NOT_FOUND = "not found in the page text"
DIFFERENT = "printed text reads as a different date"
NOT_A_READING = "resolved value is not one of the candidate readings"
NO_EVIDENCE = "resolved value given without evidence"
ONLY_REPEATS = "evidence only repeats the date"
NO_ORDER = "evidence does not show the day/month order"
NOT_ON_PAGE = "evidence not found on the page"
OFFLINE_CONFIDENCE = 0.5
