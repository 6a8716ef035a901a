"""Thresholds and word lists that the operators share."""

from __future__ import annotations

from dataclasses import dataclass

MATCH_THRESHOLD, CONFIRM_SCORE, SUBSTRING_SCORE = 70, 85, 95
WINDOW_DAYS, LOOKBACK_DAYS = 180, 365
RECHECK_DAYS, RECHECK_LIMIT = 7, 12
CANDIDATES, CANDIDATES_LARGE = 2000, 5000
ARTICLE_CAP, ARTICLE_AGE_DAYS = 50, 7
MAIL_MESSAGES, MAIL_DAYS = 50, 2
CHOW_DAYS, CHOW_BACKFILL_DAYS = 90, 365
MIN_CHARS, MIN_WORDS, MAX_CHARS, MAX_PAGE_CHARS = 150, 100, 8000, 10000
CSV_ROWS, DIGEST_ROWS, TOP_STATES = 5000, 50, 10

# Results depend on them.
ACQUISITION_STEMS = [
    "acqui", "purchas", "sold", "sale", "deal", "transaction",
    "portfolio", "operator", "ownership", "financ", "invest",
    "buys", "buyer", "seller", "closes", "closing",
]
UNKNOWN_WORDS = ["null", "none", "unknown", "unnamed", "undisclosed"]
LARGE_STATES = ["CA", "TX", "FL", "NY", "PA", "OH", "IL"]
GENERIC_OPERATORS = [
    "third-party operator", "third party operator", "undisclosed operator",
    "unnamed operator", "existing operator", "current operator",
    "affiliated operator", "ensign-affiliated", "management company",
]
KEY_SUFFIXES = [" LLC", " INC", " CORP", " LTD", " LP", " L.P.", " L.L.C.", " PLLC", " REIT"]
NAME_SUFFIXES = [
    r"\bLLC\b", r"\bL\.L\.C\.\b", r"\bINC\b", r"\bINC\.\b", r"\bINCORPORATED\b",
    r"\bCORP\b", r"\bCORPORATION\b", r"\bLTD\b", r"\bL\.T\.D\.\b", r"\bLP\b",
    r"\bL\.P\.\b", r"\bPLLC\b", r"\bP\.L\.L\.C\.\b", r"\bREIT\b", r"\bCO\b",
    r"\bPTY\b", r"\bOPCO\b",
]
DISPLAY_NAMES = {
    "COMMUNICARE HEALTH SERVICES": "Communicare Health Services",
    "WELLTOWER INC": "Welltower",
    "SABRA HEALTH CARE REIT INC": "Sabra Health Care REIT",
    "CARETRUST REIT INC": "CareTrust REIT",
    "OMEGA HEALTHCARE INVESTORS INC": "Omega Healthcare Investors",
    "THE ENSIGN GROUP INC": "The Ensign Group",
    "GENESIS HEALTHCARE INC": "Genesis Healthcare",
    "BROOKDALE SENIOR LIVING INC": "Brookdale Senior Living",
}
LOWER_WORDS = ["of", "the", "and", "at", "in", "for", "to", "a", "an"]
STAGES = ["detected", "pending_cms", "confirmed", "verified", "dismissed", "unresolved"]
SOURCE_TYPES = ["rss", "edgar", "googlenews", "chow"]
ARTICLE_TAGS = ["nav", "footer", "script", "style", "aside"]
FILING_TAGS = ["script", "style", "nav", "footer"]


@dataclass(frozen=True)
class FeedFilter:
    """What a reader of the feed may ask for; None leaves a condition out."""

    state: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    source_type: str | None = None
    search: str | None = None
    offset: int = 0
    limit: int = 20
