"""Text measures, tokens and patterns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't count in the overlap of a query with a text.
OVERLAP_STOPWORDS = "the a an is was were and or for of in to with on at by from as that this patient clinical assessment plan what why how".split()

# Patterns that tell a question's interest in time, in order of precedence.
TEMPORAL_PATTERNS = (
    ("latest", (r"\bmost recent\b", r"\blatest\b", r"\bnewest\b", r"\bcurrent(?:ly)?\b", r"\blast (?:recorded|known|measured|documented|value)\b", r"\bas of (?:now|today)\b")),
    ("trend", (r"\btrend(?:ing|ed)?\b", r"\bover time\b", r"\bprogression\b", r"\bserial\b", r"\bevolution\b", r"\bchang(?:e|ed|ing) over\b", r"\bover the (?:past|last) \w+ (?:days|weeks|months|years)\b")),
    ("recent", (r"\bin the (?:past|last) \d+ (?:days|weeks|months|years)\b", r"\brecent(?:ly)?\b", r"\bthis admission\b", r"\bduring (?:this|the current)\b")),
)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; none of a null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def word_count(text: Column) -> Column:
    """Runs of non-blank characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Estimated tokens: the integer part of 1.3 times the number of words."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("long")


def sentences(text: Column) -> Column:
    """Sentences: cut at blanks after a point, exclamation or question mark."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def squashed(text: Column, length: int = 100) -> Column:
    """The first characters with every run of blanks made one."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, length)


def temporal_mode(question: Column) -> Column:
    """latest, trend or recent, whichever pattern matches first in this order, otherwise all."""
    low, out = F.lower(question), None
    for mode, patterns in TEMPORAL_PATTERNS:
        hit = low.rlike("|".join(patterns))
        out = F.when(hit, mode) if out is None else out.when(hit, mode)
    return out.otherwise("all")


def clean_page_text(text: Column) -> Column:
    """Text of extracted pages without broken words, page headers, copyright lines and page numbers."""
    # The six steps, in this order.
    steps = ((r"(\w)-\n(\w)", "$1$2"), (r"\n{3,}", "\n\n"), (r"(?m)^S\d+\s+Diabetes Care.*$", ""), (r"(?m)^©\s*\d{4}.*$", ""), (r"(?m)^\d+\s*$", ""), (r"[ \t]+", " "))
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def overlap_ratio(query: Column, text: Column) -> Column:
    """Share of the query's distinct words, stop words aside, that the text has; 0 where none are left."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    wanted = F.array_except(words(query), F.array(*map(F.lit, OVERLAP_STOPWORDS)))
    n = F.size(wanted)
    return F.when(n > 0, F.size(F.array_intersect(wanted, words(text))) / n).otherwise(0.0)


def citation_tags(answer: Column) -> Column:
    """Distinct tags such as S3 or L1 that stand in brackets, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"[\[(]([SL]\d+)[\])]"), F.lit(1)))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL characters."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def matches_any_keyword(text: Column, groups: Column) -> Column:
    """Whether any keyword of any group is in the text, whatever the case."""
    return F.exists(F.flatten(groups), lambda k: F.instr(F.lower(text), F.lower(k)) > 0)
