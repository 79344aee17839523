"""Notes and guidelines cut into chunks: sections by their headers, then whole sentences packed up to a size.

All of it are column expressions over arrays, so a pass over notes stays in the JVM and gives a row for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import clean_page_text, token_estimate

# Headers of note sections, at the start of a line in any letter case; the first that fits counts.
NOTE_HEADERS = (
    r"CHIEF COMPLAINT", r"HISTORY OF PRESENT ILLNESS", r"HPI", r"PAST MEDICAL HISTORY", r"PMH", r"SOCIAL HISTORY", r"FAMILY HISTORY",
    r"MEDICATIONS", r"MEDICATIONS ON ADMISSION", r"MEDICATIONS ON DISCHARGE", r"ALLERGIES", r"REVIEW OF SYSTEMS", r"ROS",
    r"PHYSICAL EXAM(?:INATION)?", r"PHYSICAL FINDINGS", r"LABORATORY DATA", r"LABS", r"LAB(?:ORATORY)? RESULTS", r"IMAGING", r"RADIOLOGY",
    r"HOSPITAL COURSE", r"BRIEF HOSPITAL COURSE", r"ASSESSMENT AND PLAN", r"ASSESSMENT", r"PLAN", r"A/?P", r"DISCHARGE DIAGNOSIS", r"DISCHARGE DIAGNOSES",
    r"DISCHARGE INSTRUCTIONS", r"DISCHARGE CONDITION", r"DISCHARGE DISPOSITION", r"DISCHARGE MEDICATIONS", r"FOLLOW(?:\s*-?\s*)UP",
    r"FOLLOW UP INSTRUCTIONS", r"PROCEDURES?", r"OPERATIONS?", r"OPERATIVE FINDINGS", r"IMPRESSION", r"FINDINGS", r"CONCLUSION", r"ADDENDUM", r"ATTESTATION",
)
# Headers of the training set's sections, which need a colon.
DISCHARGE_HEADERS = (
    "Name", "Sex", "Service", "Allergies", "Attending", "Chief Complaint", "Major Surgical or Invasive Procedure", "History of Present Illness",
    "Past Medical History", "Social History", "Family History", "Physical Exam", "Pertinent Results", "Brief Hospital Course", "Medications on Admission",
    "Discharge Medications", "Discharge Disposition", "Discharge Diagnosis", "Discharge Condition", "Discharge Instructions", "Followup Instructions",
    "Assessment and Plan", "Hospital Course", "Review of Systems", "Admission Date", "Discharge Date", "Date of Birth",
)
RADIOLOGY_HEADERS = ("EXAMINATION", "INDICATION", "TECHNIQUE", "COMPARISON", "FINDINGS", "IMPRESSION", "CONCLUSION", "HISTORY", "CLINICAL INFORMATION", "CLINICAL HISTORY", "WET READ")
# Forms and words that start a guideline's section.
GUIDELINE_FORMS = (r"(?:Chapter\s+)?\d{1,2}(?:\.\d{1,2}){0,3}\s+[A-Z]", r"[A-Z][A-Z\s]{5,60}$")
GUIDELINE_HEADERS = (
    "RECOMMENDATION", "EVIDENCE", "SUMMARY", "KEY POINTS", "TABLE", "FIGURE", "Introduction", "Background", "Methodology", "Methods", "Results", "Discussion",
    "Screening", "Diagnosis", "Treatment", "Management", "Prevention", "Monitoring", "Assessment", "Classification", "Pharmacotherapy", "Pharmacologic",
    "Nonpharmacologic", "Lifestyle", "Goals", "Targets", "Follow.?up", "Complications", "Comorbidities", "Special Populations", "Older Adults", "Children",
    "Pregnancy", "Hospitalized",
)

LIMIT, OVERLAP, TINY = 384, 64, 50
PLAIN = ("FULL_NOTE", "PREAMBLE")
#: Signs that stand before and behind a header while a text is taken apart.
MARK, END = "\u0001", "\u0002"
_PIECES, _HELD = "array<struct<section:string,text:string>>", "array<struct<s:string,n:int>>"


def header_pattern(headers: tuple[str, ...], colon: bool = False, longest_first: bool = False, whole_words: bool = False) -> str:
    """A pattern for headers at the start of a line; the options mend what the plain order of alternatives gets wrong."""
    names = sorted(headers, key=len, reverse=True) if longest_first else headers
    end = r"\b" if whole_words else ""
    return rf"(?imd)^({'|'.join(names)}){end}\s*{':' if colon else ':?'}"


NOTE_PATTERN = header_pattern(NOTE_HEADERS)
TRAINING_PATTERNS = {"discharge": header_pattern(DISCHARGE_HEADERS, colon=True), "radiology": header_pattern(RADIOLOGY_HEADERS, colon=True)}
CAPS_PATTERN = r"(?md)^([A-Z][A-Z\s]{2,})\s*:"
GUIDELINE_PATTERN = rf"(?imd)^({'|'.join((*GUIDELINE_FORMS, *GUIDELINE_HEADERS))})"


def estimated(text: Column) -> Column:
    return token_estimate(text).cast("int")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _parts(text: Column, pattern: str) -> Column:
    """What stands before the first header, then each header and what follows it, END between them."""
    return F.split(F.regexp_replace(F.translate(text, MARK + END, "  "), pattern, f"{MARK}$1{END}"), MARK)


def sections(parts: Column, text: Column, whole: str = "FULL_NOTE", before: str = "PREAMBLE") -> Column:
    """Array of (section, text) of each section that has any text; a text without headers is one section. ``parts`` are those of ``_parts``."""
    name = lambda h: F.upper(F.regexp_replace(h, r"[:\s]+$", "")) if whole.isupper() else _stripped(h)
    each = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(name(F.substring_index(p, END, 1)).alias("section"), _stripped(F.substring_index(p, END, -1)).alias("text")))
    first = F.array(F.struct(F.lit(before).alias("section"), _stripped(parts[0]).alias("text")))
    found = F.filter(F.concat(first, each), lambda x: x["text"] != "")
    return F.when(F.size(parts) == 1, F.array(F.struct(F.lit(whole).alias("section"), text.alias("text")))).otherwise(found)


def _word_runs(sentence: Column, limit: int, overlap: int) -> Column:
    """Words of an over-long sentence in runs that overlap; each word counts as one token here."""
    words = _words(sentence)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.size(words) - overlap) - 1, F.lit(max(1, limit - overlap)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(limit)), " "))


def pack(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """A section's chunks: itself if small enough, otherwise whole sentences up to the limit, each chunk repeating the last ones before it."""
    kind = f"struct<out:array<string>,held:{_HELD},fresh:boolean>"
    none = F.array().cast(_HELD)
    joined = lambda held: F.array_join(F.transform(held, lambda x: x["s"]), " ")
    total = lambda held: F.aggregate(held, F.lit(0), lambda a, x: a + x["n"])
    state = lambda out, held, fresh: F.struct(out.alias("out"), held.alias("held"), fresh.alias("fresh")).cast(kind)
    flushed = lambda acc: F.when(acc["fresh"], F.concat(acc["out"], F.array(joined(acc["held"])))).otherwise(acc["out"])

    def last_of(held: Column) -> Column:
        """The last sentences of a chunk, as many as the overlap takes."""
        inner = f"struct<items:{_HELD},total:int,open:boolean>"
        more = lambda a, x: a["open"] & (a["total"] + x["n"] <= overlap)
        add = lambda a, x: F.when(more(a, x), F.struct(F.concat(F.array(x), a["items"]).alias("items"), (a["total"] + x["n"]).alias("total"), F.lit(True).alias("open")).cast(inner)).otherwise(F.struct(a["items"].alias("items"), a["total"].alias("total"), F.lit(False).alias("open")).cast(inner))
        return F.aggregate(F.reverse(held), F.struct(none.alias("items"), F.lit(0).alias("total"), F.lit(True).alias("open")).cast(inner), add, lambda a: a["items"])

    def step(acc: Column, x: Column) -> Column:
        sentence, size = x["s"], x["n"]
        over = (F.size(acc["held"]) > 0) & (total(acc["held"]) + size > limit)
        back = last_of(acc["held"])
        # The repeated sentences must leave room for the new one.
        kept = F.when(~over, acc["held"]).when(total(back) + size <= limit, back).otherwise(none)
        plain = state(F.when(over, flushed(acc)).otherwise(acc["out"]), F.concat(kept, F.array(x)), F.lit(True))
        return F.when(size > limit, state(F.concat(flushed(acc), _word_runs(sentence, limit, overlap)), none, F.lit(False))).otherwise(plain)

    begin = state(F.array().cast("array<string>"), none, F.lit(False))
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda t: F.struct(t.alias("s"), estimated(t).alias("n")))
    packed = F.aggregate(sentences, begin, step, flushed)
    return F.when(estimated(text) <= limit, F.array(text)).otherwise(packed)


def _gathered(pieces: Column, tiny: int) -> Column:
    """Tiny pieces are gathered until a large one follows or they are large enough together; at the end they join the last."""
    kind = f"struct<ready:{_PIECES},small:{_PIECES}>"
    none = F.array().cast(_PIECES)
    state = lambda ready, small: F.struct(ready.alias("ready"), small.alias("small")).cast(kind)
    together = lambda small: F.struct(small[0]["section"].alias("section"), F.array_join(F.transform(small, lambda x: x["text"]), "\n").alias("text"))

    def step(acc: Column, piece: Column) -> Column:
        small = F.concat(acc["small"], F.array(piece))
        held = F.when(estimated(together(small)["text"]) >= tiny, state(F.concat(acc["ready"], F.array(together(small))), none)).otherwise(state(acc["ready"], small))
        before = F.when(F.size(acc["small"]) > 0, F.concat(acc["ready"], F.array(together(acc["small"])))).otherwise(acc["ready"])
        return F.when(estimated(piece["text"]) < tiny, held).otherwise(state(F.concat(before, F.array(piece)), none))

    def finish(acc: Column) -> Column:
        ready, last = acc["ready"], F.element_at(acc["ready"], -1)
        joined = F.struct(last["section"].alias("section"), F.concat(last["text"], F.lit("\n"), together(acc["small"])["text"]).alias("text"))
        added = F.when(F.size(ready) > 0, F.concat(F.slice(ready, 1, F.size(ready) - 1), F.array(joined))).otherwise(F.array(together(acc["small"])))
        return F.when(F.size(acc["small"]) > 0, added).otherwise(ready)

    return F.aggregate(pieces, state(none, none), step, finish)


def _rows(texts: DataFrame, key: str, chunks: Column) -> DataFrame:
    """(key, chunk_index, section, text, token_count): the array of chunks, a row for each; a null or empty text gives none."""
    # The outer form: for the other one Spark adds a filter that computes the whole array a second time.
    rows = texts.where("text <> ''").select(key, F.posexplode_outer(chunks).alias("chunk_index", "c"))
    return rows.where("chunk_index IS NOT NULL").select(key, "chunk_index", "c.*")


def chunk_notes(notes: DataFrame, key: str = "note_id", limit: int = LIMIT, overlap: int = OVERLAP, tiny: int = TINY) -> DataFrame:
    """(key, chunk_index, section, text, token_count) of notes with key and text; a null or empty text gives none."""
    # In steps: what is used more than once is a column, so that it is computed once.
    parted = notes.where("text <> ''").select(key, "text", _parts(F.col("text"), NOTE_PATTERN).alias("_parts"))
    pieces = F.flatten(F.transform(sections(F.col("_parts"), F.col("text")), lambda x: F.transform(pack(x["text"], limit, overlap), lambda p: F.struct(x["section"].alias("section"), p.alias("text")))))
    named = lambda x: F.when(x["section"].isin(*PLAIN), x["text"]).otherwise(F.concat(F.lit("["), x["section"], F.lit("] "), x["text"]))
    chunks = F.transform(_gathered(pieces, tiny), lambda x: F.struct(x["section"].alias("section"), named(x).alias("text"), estimated(named(x)).alias("token_count")))
    return _rows(parted, key, chunks)


def training_sections(notes: DataFrame, key: str = "note_id", least: int = 100) -> DataFrame:
    """(key, chunk_index, section, text, token_count): sections of at least ``least`` characters, by the note_type's headers."""
    at = lambda p: _parts(F.col("text"), p)
    parts = F.when(F.col("note_type") == "discharge", at(TRAINING_PATTERNS["discharge"])).when(F.col("note_type") == "radiology", at(TRAINING_PATTERNS["radiology"])).otherwise(at(CAPS_PATTERN))
    parted = notes.where(F.length("text") >= least).select(key, "text", parts.alias("_parts"))
    by_type = sections(F.col("_parts"), F.col("text"), "full_note", "preamble")
    chunks = F.transform(F.filter(by_type, lambda x: F.length(x["text"]) >= least), lambda x: F.struct(x["section"].alias("section"), x["text"].alias("text"), estimated(x["text"]).alias("token_count")))
    return _rows(parted, key, chunks)


def chunk_guidelines(pages: DataFrame, key: str = "doc_id", source: str = "source", limit: int = LIMIT, overlap: int = OVERLAP, tiny: int = TINY) -> DataFrame:
    """(key, chunk_index, section, text, token_count) of cleaned guideline texts.

    Tiny chunks and sections of ten words or fewer are dropped. What stands before the first header counts from 100
    characters on. Tokens are counted without the prefix.
    """
    clean = pages.select(key, clean_page_text(F.col("text")).alias("text"), F.coalesce(source, F.lit("unknown")).alias("source"))
    parts = _parts(F.col("text"), GUIDELINE_PATTERN)
    line = lambda p: F.substring(_stripped(F.substring_index(F.translate(p, END, ""), "\n", 1)), 1, 100)
    each = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(line(p).alias("section"), _stripped(F.substring_index(p, END, -1)).alias("text")))
    first = F.when(F.length(_stripped(parts[0])) > 100, F.array(F.struct(F.lit("Preamble").alias("section"), _stripped(parts[0]).alias("text")))).otherwise(F.array().cast(_PIECES))
    long = F.filter(F.concat(first, each), lambda x: F.size(_words(x["text"])) > 10)
    prefix = lambda x, p: F.concat(F.lit("["), F.col("source"), F.lit("] ["), x["section"], F.lit("] "), p)
    chunks = F.flatten(F.transform(long, lambda x: F.transform(F.filter(pack(x["text"], limit, overlap), lambda p: estimated(p) >= tiny), lambda p: F.struct(x["section"].alias("section"), prefix(x, p).alias("text"), estimated(p).alias("token_count")))))
    return _rows(clean, key, chunks)


def window_chunks(texts: DataFrame, key: str, size: int = 100, stride: int = 80) -> DataFrame:
    """(key, chunk_index, text): runs of ``size`` words, each ``stride`` words after the one before; the last ones may be shorter."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = texts.select(key, words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(stride))
    return rows.select(key, "w", F.posexplode(starts).alias("chunk_index", "at")).select(key, F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ").alias("text"))
