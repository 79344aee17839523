"""The rule-based detector of protected health information: patterns with scores, spans, tags.

All of it are column expressions, so a scan of notes stays in the JVM and one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months and kinds of facility, for the patterns below.
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_FACILITY = r"(?:Hospital|Medical\s+Center|Medical\s+Lab(?:oratory)?|Health\s+Center|Health\s+System|Clinic|Medical\s+Group|Medical\s+Campus|Rehabilitation\s+Center|Surgical\s+Center|Cancer\s+Center|Heart\s+(?:Center|Institute))"
# What is looked for, how sure a match is, and how. Group 1, where there is one, is the value itself.
PATTERNS = (
    ("MEDICAL_RECORD_NUMBER", 0.95, r"(?i)\bMRN[\s:#]*(\d{5,12})\b"),
    ("MEDICAL_RECORD_NUMBER", 0.90, r"(?i)\bmedical\s+record\s*(?:number|no|#)?[\s:#]*(\d{5,12})\b"),
    ("MEDICAL_RECORD_NUMBER", 0.85, r"(?i)\bpatient\s*(?:id|#)[\s:#]*(\d{5,12})\b"),
    ("MEDICAL_RECORD_NUMBER", 0.80, r"(?i)\baccount\s*(?:number|no|#)?[\s:#]*(\d{5,12})\b"),
    ("DATE_TIME", 0.70, r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"),
    ("DATE_TIME", 0.70, r"\b\d{1,2}-\d{1,2}-\d{2,4}\b"),
    ("DATE_TIME", 0.85, rf"(?i)\b(?:{_MONTH})\.?\s+\d{{1,2}},?\s*\d{{2,4}}\b"),
    ("DATE_TIME", 0.85, rf"(?i)\b\d{{1,2}}\s+(?:{_MONTH})\.?\s+\d{{2,4}}\b"),
    ("DATE_TIME", 0.75, r"\b\d{4}-\d{2}-\d{2}\b"),
    ("AGE_OVER_89", 0.92, r"\b(9[0-9]|[1-9]\d{2,})\s*[-–]?\s*(?:year|yr)s?\s*[-–]?\s*old\b"),
    ("AGE_OVER_89", 0.90, r"\b(9[0-9]|[1-9]\d{2,})\s*(?:y/?o|yo)\b"),
    ("AGE_OVER_89", 0.90, r"(?i)\b(?:age|aged)\s*:?\s*(9[0-9]|[1-9]\d{2,})\b"),
    ("DEVICE_ID", 0.90, r"(?i)\b(?:serial|device|UDI|implant)\s*(?:number|no|#|ID)?[\s:#]*[A-Z0-9][A-Z0-9\-]{4,24}\b"),
    ("DEVICE_ID", 0.45, r"\b[A-Z]{2,5}\d[\w\-]{4,20}\b"),
    ("INSURANCE_NUMBER", 0.80, r"(?i)\b(?:insurance|policy|group|member|subscriber)\s*(?:number|no|#|ID)?[\s:#]*([A-Z0-9]{5,20})\b"),
    ("LOCATION", 0.88, rf"\b(?:[A-Z][a-zA-Z']+\s+){{1,5}}{_FACILITY}\b"),
    ("LOCATION", 0.85, rf"\b[A-Z]{{2,6}}\s+{_FACILITY}\b"),
    ("EMAIL_ADDRESS", 1.0, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("US_SSN", 0.85, r"\b\d{3}-\d{2}-\d{4}\b"),
    ("PHONE_NUMBER", 0.75, r"(?<!\d)(?:\+?1[-. ]?)?(?:\(\d{3}\)\s?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\d)"),
    ("IP_ADDRESS", 0.95, r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("URL", 0.60, r"\bhttps?://[^\s<>\"]+"),
    # Names need a trained recogniser; titles and labels find fewer.
    ("PERSON", 0.60, r"\b(?:Dr|Mr|Mrs|Ms)\.?\s+([A-Z][a-zA-Z'-]+(?:\s+[A-Z][a-zA-Z'-]+){0,2})"),
    ("PERSON", 0.60, r"\b(?:Patient Name|Name|Attending|Signed|Dictated by)\s*:\s*(?:Dr\.?\s+)?([A-Z][a-zA-Z'-]+(?:,?\s+[A-Z][a-zA-Z'.-]*){0,3})"),
)
# The tag that takes each type's place.
TAGS = {
    "PERSON": "[PERSON]", "PHONE_NUMBER": "[PHONE]", "EMAIL_ADDRESS": "[EMAIL]", "US_SSN": "[SSN]", "LOCATION": "[LOCATION]", "DATE_TIME": "[DATE]",
    "IP_ADDRESS": "[IP_ADDRESS]", "URL": "[URL]", "MEDICAL_RECORD_NUMBER": "[MRN]", "AGE_OVER_89": "[AGE_OVER_89]", "DEVICE_ID": "[DEVICE_ID]", "INSURANCE_NUMBER": "[INSURANCE]",
}
DEFAULT_THRESHOLD = 0.35


_SPAN = "array<struct<rank:double,longest:int,start:int,end:int,type:string,value:string>>"


#: Signs that stand before and behind a match while a text is taken apart.
MARK, END = "\u0001", "\u0002"


def _matches(text: Column, kind: str, score: float, pattern: str) -> Column:
    """Every match of a pattern as a span, from one pass that sets marks around the matches."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        """A part is what stands before the first match, or a match, END and what follows it."""
        match = F.substring_index(part, END, 1)
        end = acc["at"] + F.length(match)
        span = F.struct(F.lit(-score).alias("rank"), (-F.length(match)).alias("longest"), acc["at"].alias("start"), end.alias("end"), F.lit(kind).alias("type"), match.alias("value"))
        found = F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.when(part.contains(END), found).otherwise(F.struct(F.length(part).alias("at"), acc["out"].alias("out")))

    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{END}"), MARK)
    return F.aggregate(marked, begin, step, lambda acc: acc["out"])


def spans(text: Column, entities: tuple[str, ...] | None = None, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Spans of a text by start, without overlaps: the surer match wins, then the longer, then the earlier. Null for a null text."""
    wanted = [p for p in PATTERNS if p[1] >= threshold and (entities is None or p[0] in entities)]
    plain = F.translate(text, MARK + END, "  ")
    every = F.concat(F.array().cast(_SPAN), *[_matches(plain, *p) for p in wanted])
    free = lambda kept, x: ~F.exists(kept, lambda k: (x["end"] > k["start"]) & (x["start"] < k["end"]))
    kept = F.aggregate(F.array_sort(every), F.array().cast(_SPAN), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return F.when(text.isNotNull(), F.array_sort(kept, lambda a, b: a["start"] - b["start"]))


def tagged_text(text: Column, found: Column) -> Column:
    """``text`` with each span replaced by its type's tag."""
    tags = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), tags[x["type"]]).alias("out"))
    return F.aggregate(found, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def detect(notes: DataFrame, key: str = "note_id", entities: tuple[str, ...] | None = None, threshold: float = DEFAULT_THRESHOLD, keep_values: bool = True) -> DataFrame:
    """(key, entities, redacted) of notes with key and text. Offsets are those of the text before redaction.

    A null text gives null for both. Without ``keep_values`` the found values are left null, so that the trail holds no originals.
    """
    found = notes.select(key, "text", spans(F.col("text"), entities, threshold).alias("found"))
    value = lambda x: x["value"] if keep_values else F.lit(None).cast("string")
    entity = F.transform("found", lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), (-x["rank"]).alias("score"), value(x).alias("original_value")))
    return found.select(key, entity.alias("entities"), tagged_text(F.col("text"), F.col("found")).alias("redacted"))


def entities_of(detected: DataFrame) -> DataFrame:
    """(key, e): a row for each entity. The outer form, since for the other one Spark adds a filter that detects everything twice."""
    return detected.select(detected.columns[0], F.explode_outer("entities").alias("e")).where("e IS NOT NULL")


def entity_histogram(detected: DataFrame) -> DataFrame:
    """(type, n, n_notes)."""
    return entities_of(detected).groupBy("e.type").agg(F.count("*").alias("n"), F.count_distinct(detected.columns[0]).alias("n_notes"))


def recall(expected: DataFrame, redacted: DataFrame, key: str = "note_id") -> DataFrame:
    """(type, n, n_caught, recall): expected values (key, type, value) that the redacted text no longer has."""
    pairs = expected.join(redacted.select(key, "redacted"), key)
    caught = F.instr("redacted", F.col("value")) == 0
    return pairs.groupBy("type").agg(F.count("*").alias("n"), F.count_if(caught).alias("n_caught")).withColumn("recall", F.round(F.col("n_caught") / F.col("n"), 6))


def redact_simple(text: Column) -> Column:
    """Mailboxes, dates and identity numbers by chained replacements, for texts where overlaps don't occur."""
    for pattern, tag in ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), (r"\b\d{4}-\d{2}-\d{2}\b", "[DATE]"), (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", "[DATE]"), (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]")):
        text = F.regexp_replace(text, pattern, tag)
    return text
