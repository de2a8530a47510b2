"""Vocabularies, weights, thresholds and patterns that define the results."""

# Folding of typographic characters.
QUOTES_FROM, QUOTES_TO = "‘’‚‛“”„«»", "''''\"\"\"\"\""
DASHES_FROM, DASHES_TO = "‐‑‒–—―", "------"
SPACE = r"[\s   -     　﻿]"

# Block types.
LIST_MARK = r"(?i)^([-•·*]|\(?[a-z]\)|\(?[ivx]+\))\s+"
NUMBERED_HEADING = r"^(\d+(?:\.\d+)*)\.?\s+(.{0,90})$"
LEADING_MARKER = r"(?i)^\s*(?:\d+(?:\.\d+)*|[a-z]|[ivxlc]+)[.)]\s+"
HEADING_NUMBER = r"^(\d+(?:\.\d+)*)[.)]?\s*"
RUNNER_CHARS, RUNNER_PAGES, RUNNER_SHARE = 90, 3, 0.6
SUPPORTED = ("pdf", "docx", "txt", "md")
UPLOAD_BYTES = 80 * 1024 * 1024
SCAN_CHARS, DOCX_PAGE_CHARS, OCR_CONFIDENT = 40, 2600, 0.75

# Alignment.
W_HEADING, W_CONTENT, W_ENTITY, W_POSITION, W_NUMBERING = 0.30, 0.30, 0.15, 0.15, 0.10
SECTION_THRESHOLD, BLOCK_THRESHOLD, MOVE_THRESHOLD = 0.42, 0.50, 0.85
W_LEXICAL, W_TERMS = 0.45, 0.55
COMPARE_CHARS = 3000
ARBITRATION_MARGIN, ARBITRATION_CASES, ARBITRATION_RIVALS = 0.06, 6, 3
STOP_WORDS = (
    "a an and any are as at be been by for from in into is it its of on or per shall "
    "that the this to upon which will with within without all such other than then there "
    "these those have has had not no but if when where whereas hereby herein thereof "
    "may must should can each either both same more most less least only also"
).split()
SUFFIXES = ("ies", "ing", "ed", "es", "s")
HEADING_FAMILIES = (
    ("scope", "scope of work", "scope of services", "services", "services to be provided", "project scope", "deliverables", "work", "statement of work"),
    ("pricing", "price", "prices", "fees", "commercial terms", "charges", "costs", "consideration", "compensation", "remuneration"),
    ("payment", "payment terms", "payments", "invoicing", "invoices", "billing"),
    ("timeline", "delivery", "schedule", "timetable", "milestones", "term", "duration", "project timeline", "delivery schedule"),
    ("termination", "cancellation", "termination rights", "exit"),
    ("liability", "limitation of liability", "indemnity", "indemnification", "warranties", "warranty", "damages"),
    ("confidentiality", "non disclosure", "nda", "confidential information"),
    ("renewal", "extension", "auto renewal", "automatic renewal"),
    ("governing law", "jurisdiction", "dispute resolution", "disputes", "arbitration", "applicable law"),
    ("responsibilities", "obligations", "duties", "client responsibilities", "supplier responsibilities", "roles and responsibilities"),
    ("support", "maintenance", "support and maintenance", "service levels", "sla"),
    ("intellectual property", "ip", "ownership", "data ownership", "rights"),
    ("data protection", "privacy", "gdpr", "personal data"),
    ("insurance", "cover", "coverage"),
    ("exclusivity", "non compete", "exclusive rights"),
    ("training", "onboarding", "knowledge transfer"),
)

# Numbers in words.
UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}

# Money.
CURRENCY_SYMBOLS = {"₦": "NGN", "$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY"}
CURRENCY_CODES = {
    "ngn": "NGN", "naira": "NGN", "usd": "USD", "dollars": "USD", "dollar": "USD", "gbp": "GBP", "pounds": "GBP",
    "pound": "GBP", "eur": "EUR", "euros": "EUR", "euro": "EUR", "kes": "KES", "zar": "ZAR", "ghs": "GHS",
}
MULTIPLIERS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9}
GLYPHS = {"NGN": "₦", "USD": "$", "GBP": "£", "EUR": "€", "JPY": "¥"}

# Roles of percentages, dates and durations; the first that occurs counts.
RATE_CONTEXT = r"(?i)\b(interest|late\s+payment|per\s+annum|p\.a\.|apr)\b"
PERCENT_CONTEXTS = (
    ("upfront", "upfront"), ("up front", "upfront"), ("in advance", "upfront"), ("deposit", "deposit"),
    ("on completion", "on_completion"), ("discount", "discount"), ("vat", "tax"), ("tax", "tax"),
    ("commission", "commission"), ("interest", "interest"), ("penalt", "penalty"),
)
PERCENT_CATEGORY = {
    "upfront": "PAYMENT_TERMS", "deposit": "PAYMENT_TERMS", "on_completion": "PAYMENT_TERMS", "interest": "PAYMENT_TERMS",
    "penalty": "PAYMENT_TERMS", "discount": "PRICING", "tax": "PRICING", "commission": "PRICING",
}
PERCENT_LABEL = {
    "upfront": "Upfront payment share", "deposit": "Deposit", "on_completion": "Payment on completion", "discount": "Discount",
    "tax": "Tax rate", "commission": "Commission", "interest": "Interest rate", "penalty": "Penalty rate", "general": "Percentage",
}
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6,
    "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10,
    "november": 11, "nov": 11, "december": 12, "dec": 12,
}
DATE_KINDS = (
    ("commenc", "start"), ("start", "start"), ("effective", "start"), ("begin", "start"), ("expir", "end"), ("end", "end"),
    ("terminat", "end"), ("deliver", "delivery"), ("complet", "delivery"), ("go-live", "delivery"), ("renew", "renewal"),
    ("milestone", "milestone"), ("due", "due"),
)
DURATION_UNITS = {
    "day": "days", "days": "days", "business day": "days", "business days": "days", "week": "weeks", "weeks": "weeks",
    "month": "months", "months": "months", "year": "years", "years": "years", "hour": "hours", "hours": "hours",
    "calendar day": "days", "calendar days": "days", "working day": "days", "working days": "days",
}
DAYS_PER = {"hours": 1 / 24, "days": 1.0, "weeks": 7.0, "months": 30.0, "years": 365.0}
PAYMENT_CONTEXT = r"(?i)\b(invoice|invoices|payment|paid|pay|payable|remit|settle|settlement)\b"
NOTICE_CONTEXT = r"(?i)\b(notice|notify|terminat|cancel)\w*\b"
DURATION_KINDS = (
    ("support", "support"), ("maintenance", "support"), ("warrant", "warranty"), ("deliver", "delivery"), ("complet", "delivery"),
    ("implement", "delivery"), ("renew", "renewal"), ("confidential", "confidentiality"), ("term of", "term"), ("cure", "cure"),
    ("remedy", "cure"),
)
DURATION_CATEGORY = {"PAYMENT_PERIOD": "PAYMENT_TERMS", "NOTICE_PERIOD": "TERMINATION", "DURATION": "DURATION"}
DURATION_LABEL = {
    "payment": "Payment period", "notice": "Notice period", "support": "Support period", "warranty": "Warranty period",
    "delivery": "Delivery period", "renewal": "Renewal period", "confidentiality": "Confidentiality period", "term": "Term",
    "cure": "Cure period", "general": "Duration",
}

# Obligations.
MODALITY_STRENGTH = {
    "must": 7, "shall": 6, "is required to": 6, "are required to": 6, "required": 6, "agrees to": 5, "undertakes to": 5,
    "will": 4, "is responsible for": 4, "are responsible for": 4, "should": 3, "may": 2, "is permitted to": 2,
    "are permitted to": 2, "is entitled to": 2, "are entitled to": 2, "can": 2, "at its discretion": 1, "optional": 1,
    "recommended": 2, "endeavour": 2, "endeavor": 2, "reasonable efforts": 2,
}
ROLES = (
    "supplier", "vendor", "client", "customer", "contractor", "consultant", "provider", "service provider", "company",
    "partner", "licensee", "licensor", "buyer", "seller", "purchaser", "employer", "employee", "tenant", "landlord",
    "lessee", "lessor", "agency", "developer", "either party", "each party", "both parties", "parties", "party",
)
FREQUENCY = r"\b(hourly|daily|weekly|fortnightly|bi-weekly|monthly|quarterly|semi-annually|annually|yearly|per\s+(?:day|week|month|quarter|year))\b"
NEGATION = r"^\s*(not|never|no longer|refrain from)\b"

# Categories of changes.
CATEGORY_WEIGHT = {
    "PRICING": 4, "PAYMENT_TERMS": 4, "TERMINATION": 4, "LIABILITY": 4, "SCOPE": 3, "DATES": 3, "DURATION": 3,
    "OBLIGATIONS": 3, "RESPONSIBILITIES": 3, "RIGHTS": 3, "RENEWAL": 3, "CONFIDENTIALITY": 3, "GOVERNING_TERMS": 3,
    "WORDING": 1, "FORMATTING": 0,
}
CATEGORY_KEYWORDS = (
    ("PRICING", ("price", "pricing", "fee", "fees", "cost", "charge", "rate card", "discount", "commission", "deposit", "tax", "vat", "penalty", "total contract value", "consideration")),
    ("PAYMENT_TERMS", ("payment", "invoice", "invoices", "payable", "paid", "upfront", "instalment", "installment", "milestone payment", "remit", "interest on late")),
    ("TERMINATION", ("terminate", "termination", "cancel", "cancellation", "notice period", "breach", "wind down", "exit")),
    ("LIABILITY", ("liability", "liable", "indemnif", "damages", "warrant", "guarantee", "force majeure", "cap on")),
    ("CONFIDENTIALITY", ("confidential", "non-disclosure", "nda", "proprietary information", "data protection", "personal data", "gdpr", "privacy", "data processing")),
    ("RENEWAL", ("renew", "renewal", "extension", "auto-renew", "evergreen")),
    ("GOVERNING_TERMS", ("governing law", "jurisdiction", "arbitration", "dispute resolution", "venue", "applicable law")),
    ("SCOPE", ("scope", "deliverable", "deliverables", "service", "services", "training", "support", "maintenance", "exclusion", "excluded", "included", "workshop", "report", "reporting", "sla")),
    ("DATES", ("date", "deadline", "commence", "effective", "expiry", "expire", "go-live", "milestone", "schedule")),
    ("RESPONSIBILITIES", ("responsible", "responsibilit", "accountable", "owner", "assign", "delegate", "duties", "point of contact")),
)
ENTITY_CATEGORY = {
    "MONEY": "PRICING", "PERCENT": "PRICING", "INTEREST_RATE": "PAYMENT_TERMS", "PAYMENT_PERIOD": "PAYMENT_TERMS",
    "NOTICE_PERIOD": "TERMINATION", "DATE": "DATES", "DURATION": "DURATION", "OBLIGATION": "OBLIGATIONS",
}
FALLBACK_TYPES = ("MONEY", "DATE", "DURATION", "PERCENT", "PAYMENT_PERIOD", "NOTICE_PERIOD", "INTEREST_RATE")
MODALITY_HINTS = (
    "shall", "must", "may", "will", "should", "required", "obliged", "entitled", "permitted", "responsible", "agrees",
    "undertakes", "reasonable", "endeavour", "endeavor", "discretion", "sole", "where applicable", "if requested",
    "as needed", "subject to", "at its option", "best efforts", "not", "no longer", "exclusive",
)
SEMANTIC_LEAST, SEMANTIC_PLAIN, SEMANTIC_PASSAGES = 0.04, 0.18, 80
FALLBACK_NOTE = "Detected by value comparison within the section; the surrounding wording was rewritten too heavily to align paragraph by paragraph."

# Confidence, importance and evaluation.
W_ALIGNMENT, W_DIFF, W_EXTRACTION, W_SEMANTIC = 0.20, 0.25, 0.30, 0.25
CONFIDENT, LIKELY = 0.80, 0.55
HIGH, MEDIUM, BIG_PERCENT, BIG_DAYS, BIG_STRENGTH = 4, 2, 10, 14, 2
KEY_CHANGES = 12
SEVERITY = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 2, "LOW": 1}
DETECTORS = ("text_diff", "structured_extraction", "semantic_analysis", "section_alignment")
REVIEW_STATUSES = ("unreviewed", "confirmed", "false_alert", "needs_discussion", "resolved")
