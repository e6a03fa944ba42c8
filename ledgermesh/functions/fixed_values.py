"""Word lists, labels and limits the results depend on."""

from __future__ import annotations

# --- Fixed values: tickers and companies -----------------------------------
PLACEHOLDER_TICKERS = ["", "-", "--", "------------", "*", "—", "N/A", "NA", "NAN", "NONE", "NULL"]
CASH_TICKERS = ["CASH", "USD", "US DOLLAR"]
EXCLUDED_HOLDING_TERMS = [
    "cash", "money market", "treasury", "collateral", "future", "futures",
    "swap", "option", "derivative", "receivable", "payable",
]
EQUITY_ASSET_CLASSES = ["equity", "stock"]
UNIVERSES = ["SPX", "NDX", "SOX", "RUSSELL1000", "RUSSELL2000"]

# --- Fixed values: relationships -------------------------------------------
ROLE_CATEGORIES = ["EXECUTIVE", "BOARD"]
EDGE_TYPES = ["CEO_OF", "CFO_OF", "CHAIRMAN_OF", "BOARD_OF", "EXECUTIVE_OF"]
FILING_EDGE_TYPES = ["CEO_OF", "CFO_OF", "EXECUTIVE_OFFICER_OF", "BOARD_OF"]
ID_PREFIXES = ["MR", "MS", "MRS", "DR", "SIR", "DAME"]
ID_SUFFIXES = ["JR", "SR", "II", "III", "IV", "CPA", "CFA", "PHD", "MD", "ESQ"]
BATCH_ID_PREFIX = "grok_rel_"
INPUT_COST_PER_MILLION = 1.25
OUTPUT_COST_PER_MILLION = 2.50

# --- Fixed values: person names in filings ---------------------------------
HONORIFIC_PREFIXES = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "dame"]
HONORIFIC_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "phd", "ph.d", "md", "m.d", "esq"]
NAME_STOPWORDS = [
    "board of directors", "chief executive officer", "chief financial officer",
    "executive officer", "principal executive officer", "principal financial officer",
    "principal accounting officer", "annual report", "annual meeting",
    "table of contents", "corporate governance", "audit committee",
    "compensation committee", "nominating committee", "stock ownership",
    "united states", "new york", "san jose", "silicon valley", "our board",
    "the board", "class i", "class ii", "class iii",
]
FILING_LABELS = [
    "business", "risk factors", "unresolved staff comments", "properties",
    "legal proceedings", "mine safety disclosures",
    "market for registrant common equity", "selected financial data",
    "management discussion and analysis",
    "quantitative and qualitative disclosures about market risk",
    "financial statements and supplementary data",
    "changes in and disagreements with accountants", "controls and procedures",
    "directors executive officers and corporate governance",
    "executive compensation",
    "security ownership of certain beneficial owners and management",
    "certain relationships and related transactions",
    "principal accountant fees and services",
    "exhibits and financial statement schedules", "form 10 k summary",
    "segment reporting", "income taxes", "revenue recognition", "goodwill",
    "share based compensation", "stock based compensation",
    "fair value measurements", "derivative instruments",
    "commitments and contingencies", "subsequent events",
]
ORGANIZATION_TERMS = [
    "company", "corporation", "inc", "incorporated", "limited", "ltd", "plc",
    "group", "holdings", "technologies", "semiconductor", "committee", "board",
    "section", "item",
]
DOCUMENT_TERMS = ["agreement", "plan", "act", "policy", "exhibit", "schedule", "compensation"]
DOCUMENT_PHRASES = [
    "stock unit", "restricted stock", "restricted stock unit",
    "deferred restricted stock unit", "securities exchange act",
]
TITLE_ONLY_PHRASES = [
    "executive vice president", "chief financial officer",
    "chief executive officer", "president", "director",
]
TITLE_WORDS = [
    "acting", "assistant", "chief", "chair", "chairman", "chairperson", "co",
    "corporate", "director", "executive", "financial", "general", "independent",
    "interim", "lead", "legal", "officer", "president", "principal", "secretary",
    "senior", "treasurer", "vice",
]
CONNECTOR_WORDS = ["and", "or", "the", "for", "with", "from", "of", "in", "to", "by", "as"]
BOILERPLATE_PAIRS = [("officer", "pursuant"), ("executive", "pursuant"), ("officer", "requirements")]
SIGNER_TITLE_STARTERS = [
    "chair", "chairman", "chairperson", "chief", "president", "executive",
    "senior", "vice", "director",
]
SIGNATURE_LABELS = ["title", "name", "date", "signature"]
EXECUTIVE_TITLE_MARKS = [
    "executive officer", "chief ", "president", "principal accounting officer",
    "general counsel", "corporate secretary", "treasurer",
    "executive vice president", "senior vice president",
]
BOARD_TABLE_MARKS = ["nominee", "board", "election", "committee", "age"]

# --- Fixed values: patterns (Java regular expressions) ---------------------
NAME_CAPTURE = r"[A-Z][a-zA-Z'’.-]+(?:\s+(?:[A-Z]\.|[A-Z][a-zA-Z'’.-]+)){1,4}"
TAXONOMY_TAG = (
    r"(?i)^(?:[a-z][a-z0-9-]*:)?[a-z][a-z0-9]*(?:_[a-z0-9]++)++$"
    r"|^(?:us-gaap|dei|srt|country|currency):"
)
ITEM_HEADING = r"(?i)\bItem\s+([0-9]{1,2}[A-Z]?)\s*[.:\-–—]"
ITEM_SECTION_ENDS = ["11", "12", "13", "14", "15"]
EXECUTIVE_CONTEXT = r"(?i)executive\s+officers?"
SIGNATURES_HEADING = r"(?i)\bSIGNATURES\b"
EXCHANGE_ACT_ANCHOR = (
    r"(?i)pursuant\s+to\s+the\s+requirements\s+of\s+the\s+securities"
    r"\s+exchange\s+act\s+of\s+1934"
)
SIGNER_TITLE = (
    r"(?i)(?:chief\s+executive\s+officer|chief\s+financial\s+officer"
    r"|principal\s+executive\s+officer|principal\s+financial\s+officer"
    r"|\bCEO\b|\bCFO\b|\bdirector\b)"
)
CEO_TITLE = r"(?:President\s+and\s+)?Chief\s+Executive\s+Officer|CEO"
CFO_TITLE = r"Chief\s+Financial\s+Officer|CFO"
OFFICER_TITLE_MARKS = (
    "Chief|CEO|CFO|President|Vice President|General Counsel|Secretary|Treasurer|Executive Officer"
)

# --- Fixed values: limits ---------------------------------------------------
SIGNATURE_SECTION_CHARS = 45000
MIN_ITEM_SECTION_CHARS = 500
EXECUTIVE_WINDOW_CHARS = 5000
SIGNER_LOOKBACK_CHARS = 220
SIGNER_LOOKAHEAD_CHARS = 180
PRICE_SESSIONS_KEPT = 250
BACKFILL_DAYS = 430
INCREMENTAL_DAYS = 14
SEARCH_ROWS = 25

# --- Fixed values: HTML entities decoded by name ----------------------------
