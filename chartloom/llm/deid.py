"""Personal information in free text, found by cues and replaced by typed placeholders.

An Aho-Corasick automaton finds every cue of a text in one pass: at-signs and their spellings, labels, titles,
relations, street words. Each cue starts a small parser that reads outward from it, on one side or both, until the
name, number, address or mailbox ends, and checks its form. Numbers need not pass validity checks. Names found in
a note are then looked for in the rest of it, so that a surname or first name alone is found as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = {"PERSON": "[PERSON]", "PHONE_NUMBER": "[PHONE]", "EMAIL_ADDRESS": "[EMAIL]", "US_SSN": "[SSN]", "MEDICAL_RECORD_NUMBER": "[MRN]", "INSURANCE_NUMBER": "[INSURANCE]", "LOCATION": "[LOCATION]"}
SCHEMA = "field_name string, phi_type string, start_pos int, end_pos int"

# Cues by what follows them.
HEADER_NAMES = ("pt:", "pt.:", "patient:", "patient name", "name:", "patient ", "attending", "attending physician", "provider", "referring", "cc:", "dictated by", "signed", "signed by", "reviewed by", "authored by", "transcribed by", "contact:", "interpreter", "next of kin", "nok:", "c/o", "emergency contact", "discussed with", "guardian", "care of")
TITLES = ("mr", "mrs", "ms", "miss", "dr", "nurse", "prof", "rn", "sister", "doctor", "md", "np", "pa")
RELATIONS = ("son", "daughter", "wife", "husband", "spouse", "brother", "sister", "mother", "father", "neighbour", "neighbor", "partner", "aunt", "uncle", "niece", "nephew", "friend", "cousin", "grandson", "granddaughter", "grandmother", "grandfather", "fiance", "fiancee", "stepson", "stepdaughter", "roommate", "landlord", "girlfriend", "boyfriend", "carer", "caregiver", "guardian", "parent", "twin", "mum", "mom", "dad", "godmother", "colleague", "widow", "widower")
MRN_CUES = ("mrn", "mr#", "mr #", "mr no", "med rec no", "med rec #", "medical record", "hospital no", "unit no", "hospital number", "unit number", "chart no", "record no", "patient id")
SSN_CUES = ("ssn", "social security", "soc sec", "soc. sec", "ss#", "ss #", "identity", "identification", "national id", "tax id", "taxpayer id", "id number", "id no")
INSURANCE_CUES = ("member id", "insurance id", "policy", "plan number", "plan no", "subscriber", "member number", "member no", "member #", "group number", "insurance no", "insurance number", "claim no", "health plan")
PHONE_CUES = ("phone", "fax", "callback", "cell", "pager", "tel", "called on", "reached at", "mobile", "call ", "contact number", "ph:")
ADDRESS_CUES = ("address", "addr", "lives at", "living at", "resides at", "residing at", "residence", "domiciled at", "home at", "house at", "stays at", "staying at", "mail to", "send to", "located at", "picked up from", "brought in from")
STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "boulevard", "blvd", "court", "ct", "terrace", "ter", "place", "pl", "way", "close", "crescent", "parkway", "pkwy", "square", "sq", "circle", "highway", "hwy", "trail", "gardens", "grove", "mews", "row", "walk", "hill", "rise", "heights", "gate", "quay", "alley", "plaza", "path", "loop", "pike", "expressway", "green", "park", "view")
#: Street words that stand before the name, and those that end it.
STREETS_FIRST, STREETS_LAST = ("rue", "avenue", "calle", "via", "plaza", "boulevard"), ("weg", "straße", "strasse", "str.", "gasse", "platz", "allee")
BOXES = ("po box", "p.o. box", "p. o. box", "p.o.box", "pobox")
EMAIL_CUES = ("@", "(at)", "[at]", "{at}", " at ")

_UP = r"\p{Lu}"
_WORD = rf"(?:{_UP}['’]?[\p{{L}}'’]*\p{{L}}(?:-{_UP}['’]?[\p{{L}}'’]+)*)"
_INITIAL = rf"(?:{_UP}\.?(?![\p{{L}}\p{{N}}'’.]))"
_PART = rf"(?:{_WORD}|{_INITIAL})"
_GAP = r"[ \t]+"
_TITLE = r"(?:(?i:mr|mrs|ms|miss|dr|nurse|prof|rn|doctor|md|np)\b\.?,?[ \t]+)*"
#: Words that end a name though they are capitalised.
_STOP = r"(?!(?:MD|RN|NP|PA|DO|PhD|CRNA|LPN|PA-C|The|His|Her|Was|Is|Has|On|Of|In|At|And|Phone|Fax|Cell|Addr|Address|MRN|SSN|DOB|Attending|Provider|Signed|Dictated|Electronically|Discussed|Interpreter|Prior|Claim|Results|Portal|Contact|Callback|Pager|Pharmacy|Lives|Resides|Moved|Next|Mr|Mrs|Ms|Dr|Son|Identity|Room|Lot|NDC|Flat|Apt|Box|Home|Old|Physician|Name|Patient|None|No|Not|Unknown|Note|Report|Summary)\b)"
_FULL = rf"(?:{_STOP}{_WORD},[ \t]+{_STOP}{_WORD}(?:{_GAP}{_STOP}{_PART}){{0,2}}\.?(?=[ \t]*(?:[,;.)<\n/(]|$))|{_STOP}{_PART}(?:{_GAP}{_STOP}{_PART}){{0,3}})"
_NAME = re.compile(_FULL)
_LOWER_NAME = re.compile(rf"(?:\p{{L}}\.[ \t]+)?[\p{{L}}'’-]{{2,}}(?:,?[ \t]+[\p{{L}}'’-]+\.?){{0,3}}(?=[ \t]*(?:\n|$|,))")
_AFTER_HEADER = re.compile(rf"[ \t]*(?:physician|name|md|by|contact|provider)?[ \t]*(?:[:#–-]|\bis\b)?[ \t]*{_TITLE}", re.I)
_AFTER_RELATION = re.compile(r",?[ \t]+(?:(?:and|named|called|is)[ \t]+)?(?:(?i:mr|mrs|ms|miss|dr)\b\.?[ \t]+)?", 0)
_AFTER_TITLE = re.compile(r"\.?[ \t]+(?:(?i:dr|prof|nurse|rn)\b\.?[ \t]+)?")
_AFTER_NUMBER = re.compile(r"[ \t]*(?:(?:(?:number|no|num|id|record|card|security|ssn|phone|fax|on|at|is|was|ends|of|confirmed|verified|checked|established|by|as|with)\b|#|\(ssn\))[ \t]*)*[.:#)-]*[ \t]*", re.I)
_SSN = re.compile(r"\d{3}([-. ]?)\d{2}\1\d{4}(?![\d-])")
_MRN = re.compile(r"(?:[A-Z]{1,3}-?)?(?:\d{2}(?: \d{2}){3}|\d{3}-\d{2}-\d{2,3}|\d{5,10})(?![\d-])")
_INSURANCE = re.compile(r"(?=[A-Z0-9-]*\d)[A-Z0-9]{2,}(?:-[A-Z0-9]{2,})*(?![\w-])")
#: Digit groups that start a phone number's parser without any label: a country code, an area code, groups of 3, 3 and 4 or of 3 and 4, ten digits.
_DIGITS = re.compile(r"(?<![\d\p{L}.,/-])(?:\+\d|\(\d{3}\)[ -]?\d{3}|(?:1[-. ])?\d{3}(?:[-./]\d{3}[-./ ]|[ ]\d{3}[-.])\d{4}(?![\d-])|[2-9]\d{2}[ ][2-9]\d{2}[ ]\d{4}(?![\d-]|[ .]\d)|[2-9]\d{2}[2-9]\d{6}(?![\d\p{L}-])|\d{3}[-.]\d{4}(?![\d-]|[./]\d))")
_PHONE = re.compile(r"(?<![\d\p{L}-])(?:\+\d{1,3}[ .-]?\(?\d{2,5}\)?(?:[ .-]?\d{2,4}){1,4}|(?:1[-. ])?(?:\(\d{3}\)[ -]?|\d{3}[-./ ]?)\d{3}[-./ ]?\d{4}|\d{3}[-. ]\d{4})(?![\d])(?:[ ]?(?:ext\.?|x|extension)[ ]?\d{1,6})?")
_BARE_PHONE = re.compile(r"(?:\+?\d[\d ()./-]{5,18}\d)(?:[ ]?(?:ext\.?|x)[ ]?\d{1,6})?")
_LOCAL = re.compile(r"[\p{L}\p{N}][\p{L}\p{N}._%+'-]*")
_DOMAIN = re.compile(r"[ \t]*[\p{L}\p{N}-]+(?:(?:\.|[ \t]+dot[ \t]+|[ \t]*[\[(]dot[\])][ \t]*)[\p{L}\p{N}-]+)+", re.I)
_TOWN = rf"(?:,[ \t]*{_UP}[\p{{L}}'’-]+(?:[ \t]{_UP}[\p{{L}}'’-]+)?(?:,[ \t]*[A-Z]{{2}}[ \t]+\d{{5}}(?:-\d{{4}})?)?)?"
_UNIT = r"(?:,?[ \t]*(?:(?:Apt|Unit|Suite|Ste|Room|Floor|Flat|APT|UNIT|SUITE)\.?[ \t]*#?[\p{N}]+[A-Z]?|#[ ]?\d+[A-Z]?))?"
_HOUSE = r"(?<![\w-])\d{1,5}(?:-?[A-Z]\b)?"
_SIDE = r"(?:(?:[NSEW]\.?|North|South|East|West|Old|Upper|Lower|New|Great|Little|NORTH|SOUTH|EAST|WEST|OLD|UPPER|LOWER)[ \t]+)?"
_FLAT = r"(?:(?:Flat|Apt|Unit|Suite|FLAT|APT|UNIT|SUITE)\.?[ ]?\d+[A-Z]?,[ ]*)?"
#: What stands before a street word, read backwards from it, and what may follow an address.
_BEFORE_STREET = re.compile(rf"{_FLAT}{_HOUSE}[ \t]+{_SIDE}(?:{_UP}[\p{{L}}'’-]+[ \t]+){{1,3}}$")
_BEFORE_FIRST = re.compile(rf"{_HOUSE},?[ \t]+$")
_AFTER_FIRST = re.compile(rf"[ \t]+(?:(?i:de|du|des|del|la|las|los|le)[ \t]+)*{_UP}[\p{{L}}'’-]+")
_AFTER_LAST = re.compile(r"[ \t]+\d+[a-z]?\b")
_BOX = re.compile(r"[ \t]+\d+")
_REST = re.compile(rf"{_UNIT}{_TOWN}")
#: An address without a street word, after a label only.
_LABELLED = re.compile(rf"[ \t]*(?:is|was)?[ \t]*[:#-]?[ \t]*({_FLAT}{_HOUSE}[ \t]+{_SIDE}{_UP}[\p{{L}}'’-]+(?:[ \t]+{_UP}[\p{{L}}'’-]+){{0,3}}{_UNIT}{_TOWN})")
#: Short words that are no names though they begin with a capital.
_SHORT = frozenset("a an the in on of at by he we it so no or if as to do be my up is was has his her him she all any but can day for may new not now old one our out per see son two use who why you yes am pm id er ed or ct mr ms dr md rn np pa bp hr us uk".split())
_WORDS = re.compile(r"[\p{L}][\p{L}'’-]*\p{L}")
#: Signs that tie a word to the one before or after it, as in a mailbox.
_JOINED, _FOLLOWED = frozenset("@._+-"), frozenset("@_-")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    cues: dict[str, set[str]] = {}
    groups = {"header": HEADER_NAMES, "title": TITLES, "relation": RELATIONS, "mrn": MRN_CUES, "ssn": SSN_CUES, "insurance": INSURANCE_CUES, "phone": PHONE_CUES, "address": ADDRESS_CUES, "street": STREETS, "first": STREETS_FIRST, "last": STREETS_LAST, "box": BOXES, "email": EMAIL_CUES}
    for kind, words in groups.items():
        for w in words:
            cues.setdefault(w, set()).add(kind)
    for w, kinds in cues.items():
        auto.add_word(w, (w, tuple(sorted(kinds))))
    auto.make_automaton()
    return auto


def _lower(text: str) -> str:
    """Lower case of the same length, so that positions agree."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _line_start(text: str, at: int) -> int:
    return text.rfind("\n", 0, at) + 1


def find_places(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of every place of personal information in ``text``, by position, without overlaps."""
    low = _lower(text)
    hits: list[tuple[int, int, str]] = []  # places
    names: list[tuple[int, int]] = []
    numbered: dict[str, list[tuple[int, int]]] = {"mrn": [], "ssn": [], "insurance": [], "phone": []}
    word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    for last, (cue, kinds) in _automaton().iter(low):
        start, end = last - len(cue) + 1, last + 1
        inside = cue[0].isalpha() and word(start - 1)
        open_end = cue[-1].isalpha() and word(end)
        for kind in kinds:
            if inside and kind != "last" or open_end and kind not in ("insurance", "mrn"):
                continue
            if kind == "email":
                hits += _email(text, start, end, cue)
            elif kind in numbered:
                numbered[kind].append((start, end))
            elif kind in ("street", "first", "last", "box", "address"):
                hits += _address(text, start, end, kind)
            else:
                names += _name(text, start, end, cue, kind)
    numbered["phone"] += [(m.start(), m.start()) for m in _DIGITS.finditer(text)]
    hits += [(*_span(text, s, e, _SSN), "US_SSN") for s, e in numbered["ssn"] if _span(text, s, e, _SSN)]
    hits += [(*_span(text, s, e, _MRN), "MEDICAL_RECORD_NUMBER") for s, e in numbered["mrn"] if _span(text, s, e, _MRN)]
    hits += [(*_span(text, s, e, _INSURANCE), "INSURANCE_NUMBER") for s, e in numbered["insurance"] if _span(text, s, e, _INSURANCE)]
    for s, e in numbered["phone"]:
        if s == e:  # the digits themselves are the cue
            hits += [(m.start(), m.end(), "PHONE_NUMBER") for m in (_PHONE.match(text, s),) if m]
        elif (span := _span(text, s, e, _PHONE) or _span(text, s, e, _BARE_PHONE)) and sum(c.isdigit() for c in text[span[0] : span[1]]) >= 7:
            hits.append((*span, "PHONE_NUMBER"))
    rank = {"EMAIL_ADDRESS": 0, "MEDICAL_RECORD_NUMBER": 1, "US_SSN": 1, "INSURANCE_NUMBER": 1, "LOCATION": 2, "PHONE_NUMBER": 3, "PERSON": 4}
    hits += [(s, e, "PERSON") for s, e in names]
    kept = _without_overlaps(hits, rank)
    return sorted(kept + _again(text, kept))


def _span(text: str, start: int, end: int, form: re.Pattern) -> tuple[int, int] | None:
    gap = _AFTER_NUMBER.match(text, end)
    m = form.match(text, gap.end() if gap else end)
    return (m.start(), m.end()) if m else None


def _without_overlaps(hits: list[tuple[int, int, str]], rank: dict[str, int]) -> list[tuple[int, int, str]]:
    """Of overlapping places the one with the surer kind of cue, then the longer, then the earlier."""
    taken, kept = [], []
    for s, e, kind in sorted(set(hits), key=lambda h: (rank[h[2]], h[0] - h[1], h[0])):
        if all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            kept.append((s, e, kind))
    return kept


def _address(text: str, start: int, end: int, kind: str) -> list[tuple[int, int, str]]:
    """The address around a street word or box, or behind a label, if there is one."""
    if kind == "address":
        m = _LABELLED.match(text, end)
        return [(m.start(1), m.end(1), "LOCATION")] if m else []
    line = max(_line_start(text, start), start - 100)
    if kind == "last":  # the end of a longer word with its house number behind it
        while start > line and text[start - 1].isalpha():
            start -= 1
        tail = _AFTER_LAST.match(text, end) if text[start].isupper() and end - start > 4 else None
        begin = start
    elif kind == "box":
        tail, begin = _BOX.match(text, end), start
    else:
        before = (_BEFORE_STREET if kind == "street" else _BEFORE_FIRST).search(text[line:start])
        tail = before and (re.compile(r"\.?") if kind == "street" else _AFTER_FIRST).match(text, end)
        begin = line + before.start() if before else start
    if not tail:
        return []
    return [(begin, _REST.match(text, tail.end()).end(), "LOCATION")]


def _email(text: str, start: int, end: int, cue: str) -> list[tuple[int, int, str]]:
    domain = _DOMAIN.match(text, end)
    if not domain:
        return []
    if cue == " at " and " dot " not in text[domain.start() : domain.end()].lower():
        return []
    i = start
    while i > 0 and text[i - 1] in " \t":
        i -= 1
    if start - i > 2:
        return []
    j = i
    while j > 0 and (text[j - 1].isalnum() or text[j - 1] in "._%+'-"):
        j -= 1
    while j < i and not text[j].isalnum():
        j += 1
    return [(j, domain.end(), "EMAIL_ADDRESS")] if j < i else []


def _name(text: str, start: int, end: int, cue: str, kind: str) -> list[tuple[int, int]]:
    if kind == "header":
        if cue == "patient " and not text[start:end].startswith("PATIENT"):
            return []
        if cue in ("pt:", "name:", "patient:", "patient name", "patient ", "provider", "attending", "signed", "attending physician") and text[_line_start(text, start) : start].strip() and cue not in ("signed", "attending", "attending physician", "provider"):
            return []
        gap = _AFTER_HEADER.match(text, end)
        at = gap.end() if gap else end
        if at == end and cue[-1].isalpha():
            return []
        m = _NAME.match(text, at)
        if m is None and (text[at - 1 : at] in " \t" and cue in ("pt:", "name:", "patient:", "patient name", "patient ")):
            m = _LOWER_NAME.match(text, at)
        return [(m.start(), m.end())] if m and _plausible(m.group()) else []
    gap = (_AFTER_TITLE if kind == "title" else _AFTER_RELATION).match(text, end)
    if not gap:
        return []
    if kind == "title" and not text[start:end][0].isupper():
        return []
    m = _NAME.match(text, gap.end())
    return [(m.start(), m.end())] if m and _plausible(m.group()) else []


def _plausible(name: str) -> bool:
    """Whether any part is longer than an initial and no lone credential or common short word."""
    return any(len(w) > 2 or len(w) == 2 and w[0].isupper() and w[1].islower() and w.lower() not in _SHORT for w in re.split(r"[\s,.]+", name))


def _again(text: str, kept: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further places of the surnames and first names found, in their form or in capitals."""
    words = {w for s, e, kind in kept if kind == "PERSON" for w in _WORDS.findall(text[s:e]) if w[0].isupper()}
    # Short names are found again in their own form only, and not where they are common words.
    words = {v for w in words if len(w) > 3 for v in (w, w.title(), w.upper())} | {w for w in words if len(w) <= 3 and w.lower() not in _SHORT}
    if not words:
        return []
    taken = sorted((s, e) for s, e, _ in kept)
    found, i = [], 0
    for m in _WORDS.finditer(text):
        word, start, end = m.group(), m.start(), m.end()
        if word not in words:
            # A possessive ends with the name.
            if word[-2:] not in ("'s", "’s") or word[:-2] not in words:
                continue
            end -= 2
        if text[start - 1 : start] in _JOINED and start or text[end : end + 1] in _FOLLOWED and end < len(text) or text[start - 1 : start].isnumeric() or text[end : end + 1].isnumeric():
            continue
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i == len(taken) or taken[i][0] >= end:
            if found and text[found[-1][1] : start].strip(" ,") == "" and start - found[-1][1] <= 2:
                found[-1] = (found[-1][0], end, "PERSON")
            else:
                found.append((start, end, "PERSON"))
    return found


def redact(text: str, places: list[tuple[int, int, str]]) -> str:
    """``text`` with each place replaced by its type's placeholder and nothing else changed."""
    out, at = [], 0
    for s, e, kind in places:
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*out, text[at:]])


_PLACES = "array<struct<phi_type:string,start_pos:int,end_pos:int>>"


def _scan(fields: tuple[str, ...]):
    kind = pa.list_(pa.struct([("phi_type", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            for f in fields:
                texts = batch.column(names.index(f)).to_pylist()
                found = [None if t is None else find_places(t) for t in texts]
                columns.append(pa.array([None if p is None else [{"phi_type": k, "start_pos": s, "end_pos": e} for s, e, k in p] for p in found], kind))
                columns.append(pa.array([None if p is None else redact(t, p) for t, p in zip(texts, found)], pa.string()))
                names += [f"{f}_places", f"{f}_redacted"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _scanned(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    extra = ", ".join(f"`{f}_places` {_PLACES}, `{f}_redacted` string" for f in fields)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_scan(fields), f"{own}, {extra}")


def deidentify(notes: DataFrame, key: str = "note_id", fields: tuple[str, ...] = ("original_text", "text")) -> DataFrame:
    """(key, fields, and <field>_places and <field>_redacted of each), one row for each distinct input row.

    Whole texts of any length are scanned. A null text gives null places and a null redaction, an empty one no
    places and itself. Placeholders already set are left alone. Other columns of ``notes`` are dropped.
    """
    return _scanned(notes.select(key, *fields).distinct(), key, fields)


def phi_places(notes: DataFrame, key: str = "note_id", fields: tuple[str, ...] = ("original_text", "text")) -> DataFrame:
    """(key, field_name, phi_type, start_pos), distinct: each place of personal information in each field.

    The texts aren't shuffled: repeated rows are scanned where they lie and give the same places.
    """
    found = _scanned(notes.select(key, *fields), key, fields)
    per_field = [F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_places").alias("places")) for f in fields]
    places = found.select(key, F.explode(F.array(*per_field)).alias("f")).select(key, "f.field_name", F.explode("f.places").alias("p"))
    return places.select(key, "field_name", "p.phi_type", "p.start_pos").distinct()
