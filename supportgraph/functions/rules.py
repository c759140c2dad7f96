"""Validation rules of a question analysis, and the search gate, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category codes with the topics they stand for.
CATEGORIES = [
    ("cat_001", "Login, permissions, and account access issues"),
    ("cat_002", "Response quality, accuracy, and relevance problems"),
    ("cat_003", "Functionality requests or feature availability questions"),
    ("cat_004", "External system, API, and tool connections"),
    ("cat_005", "Usage guidance, best practices, and learning resources"),
    ("cat_006", "Speed, reliability, and system performance issues"),
    ("cat_007", "Technical bugs, errors, and unexpected behavior"),
    ("cat_008", "User profiles, settings, preferences, billing"),
    ("cat_009", "Missing, unclear, or inadequate documentation"),
]
CATEGORY_CODES = [code for code, _ in CATEGORIES]

# Limits and messages of the analysis record.
TITLE_MAX_CHARS = 100
TITLE_MAX_WORDS = 10
TITLE_TOO_LONG = "Title should have at most 100 characters"
TITLE_TOO_MANY_WORDS = "Title should not exceed 10 words"
TITLE_MISSING = "Title is missing"
DESCRIPTION_EMPTY = "Description cannot be empty"
CATEGORY_UNKNOWN = "Category is not one of the known codes"
FALLBACK_TITLE = "Error"

SPACE = r"[\s\p{Z}]+"
_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(text: Column) -> Column:
    """The text without white space at either end, Unicode spaces included."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def title_ok(title: Column) -> Column:
    return F.coalesce(
        (F.length(title) <= TITLE_MAX_CHARS) & (F.size(words(title)) <= TITLE_MAX_WORDS),
        F.lit(False),
    )


def description_ok(description: Column) -> Column:
    return F.coalesce(strip(description) != "", F.lit(False))


def category_ok(category: Column, codes: list[str] = CATEGORY_CODES) -> Column:
    return category.isNull() | category.isin(codes)


def analysis_error(
    title: Column, description: Column, category: Column, codes: list[str] = CATEGORY_CODES
) -> Column:
    """Message of the first rule that fails, null when the record is valid."""
    return (
        F.when(~category_ok(category, codes), CATEGORY_UNKNOWN)
        .when(title.isNull(), TITLE_MISSING)
        .when(F.length(title) > TITLE_MAX_CHARS, TITLE_TOO_LONG)
        .when(F.size(words(title)) > TITLE_MAX_WORDS, TITLE_TOO_MANY_WORDS)
        .when(~description_ok(description), DESCRIPTION_EMPTY)
    )


# Wording that calls for a search of past tickets: problems, bugs, access, how-to and features.
SEARCH_WORDS = [
    "access", "bugs?", "can'?t", "cannot", "crash(es|ed|ing)?", "denied", "errors?",
    "fail(s|ed|ing|ure)?", "features?", "freez(e|es|ing)", "how (can|do|should|to)", "issues?",
    "log ?in", "not work(ing)?", "password", "permissions?", "problems?", "slow", "timeouts?",
    "upload", "wrong",
]

# Wording of greetings, thanks and general questions, which need no search on their own.
SMALL_TALK = [
    "bye", "goodbye", "good (morning|afternoon|evening)", "hello", "hey", "hi", "how are you",
    "thank(s| you)", "what is", "who are you",
]


def _any_word(patterns: list[str]) -> str:
    return "(^|[^a-z])(" + "|".join(patterns) + ")([^a-z]|$)"


SEARCH_PATTERN = _any_word(SEARCH_WORDS)
SMALL_TALK_PATTERN = _any_word(SMALL_TALK)


def reports_problem(question: Column) -> Column:
    return F.coalesce(F.lower(question).rlike(SEARCH_PATTERN), F.lit(False))


def is_small_talk(question: Column) -> Column:
    """True for greetings, thanks and general questions that report no problem."""
    talk = F.coalesce(F.lower(question).rlike(SMALL_TALK_PATTERN), F.lit(False))
    return talk & ~reports_problem(question)


def needs_search(question: Column) -> Column:
    """True when past tickets should be searched: all but small talk and blank text."""
    return description_ok(question) & ~is_small_talk(question)
