"""Places of personal information in written examples, honest text, and the round trip of a redaction."""

import pytest

from chartloom.llm import deid

CASES = [
    ("Pt: Anna K. Velmere\nMRN: H1234567\n", [("PERSON", "Anna K. Velmere"), ("MEDICAL_RECORD_NUMBER", "H1234567")]),
    ("PATIENT VELMERE, ANNA\nSSN: 912 34 5678", [("PERSON", "VELMERE, ANNA"), ("US_SSN", "912 34 5678")]),
    ("Attending: Dr. O'Brandt-Weller, MD\n", [("PERSON", "O'Brandt-Weller")]),
    ("His wife Marta, phone (320) 555-0179 ext. 49.", [("PERSON", "Marta"), ("PHONE_NUMBER", "(320) 555-0179 ext. 49")]),
    ("Son T. Velmere can be reached at +44 1632 960105.", [("PERSON", "T. Velmere"), ("PHONE_NUMBER", "+44 1632 960105")]),
    ("Portal login anna_70 @ mail.example today.", [("EMAIL_ADDRESS", "anna_70 @ mail.example")]),
    ("Results were sent to a.velmere(at)mail dot example dot org.", [("EMAIL_ADDRESS", "a.velmere(at)mail dot example dot org")]),
    ("Lives at 8854-B North Larkmill St, Apt 4, Ridge, QZ 12345.", [("LOCATION", "8854-B North Larkmill St, Apt 4, Ridge, QZ 12345")]),
    ("Home address: P.O. Box 1133, Ridge\nMember ID: 9JJ6-AJ66", [("LOCATION", "P.O. Box 1133, Ridge"), ("INSURANCE_NUMBER", "9JJ6-AJ66")]),
    ("Moved to Larkweg 47 since spring.", [("LOCATION", "Larkweg 47")]),
    ("Mr. Velmere was seen. Later Velmere went home.", [("PERSON", "Velmere"), ("PERSON", "Velmere")]),
    ("Prior chart (MRN 22 74 44 23) was merged. Claim under policy QCC-4107-999 is pending.", [("MEDICAL_RECORD_NUMBER", "22 74 44 23"), ("INSURANCE_NUMBER", "QCC-4107-999")]),
    ("Identity confirmed by 994-49-5304. Callback 555-0126 on file.", [("US_SSN", "994-49-5304"), ("PHONE_NUMBER", "555-0126")]),
    # Nothing of these comes from the given notes.
    ("Ring (212) 867-5309 or 617-482-9911.", [("PHONE_NUMBER", "(212) 867-5309"), ("PHONE_NUMBER", "617-482-9911")]),
    ("Daughter: 617 482 9911, office 617.482.9911, night 6174829911 x12.", [("PHONE_NUMBER", "617 482 9911"), ("PHONE_NUMBER", "617.482.9911"), ("PHONE_NUMBER", "6174829911 x12")]),
    ("He lives at 14 Harcourt Gardens, Leeds.", [("LOCATION", "14 Harcourt Gardens, Leeds")]),
    ("Found near 3-C Upper Mill Lane, Flat 2, on Monday. Residing at 22 Ashgrove, Bath.", [("LOCATION", "3-C Upper Mill Lane, Flat 2"), ("LOCATION", "22 Ashgrove, Bath")]),
    ("Home is 7, rue de la Paix, Lyon; work is Goethestraße 12a.", [("LOCATION", "7, rue de la Paix, Lyon"), ("LOCATION", "Goethestraße 12a")]),
    ("Seen by Dr. Li and Mr. Wu.", [("PERSON", "Li"), ("PERSON", "Wu")]),
    ("Seen by Dr. Lee. Lee agreed, LEE did not sign.", [("PERSON", "Lee"), ("PERSON", "Lee")]),
    ("Her identity number is 321-54-9876; identity was verified by 321-54-9877.", [("US_SSN", "321-54-9876"), ("US_SSN", "321-54-9877")]),
    ("Policy # ATD491341615 and claim under policy BYD-9541-100.", [("INSURANCE_NUMBER", "ATD491341615"), ("INSURANCE_NUMBER", "BYD-9541-100")]),
]
HONEST = [
    "Babinski sign absent, Romberg steady, Apgar 9 and 6. Crohn disease in remission; Whipple procedure 7 years ago.",
    "A 19 French Foley catheter was placed and 12 Lead tracing obtained at 3 pm.",
    "NDC 8747-1717-86 dispensed, device software 7.5.96 installed, lot 6955-15, dose ratio 8/25/269 on 2150-03-04.",
    "Tablets x3 @ bedtime, pump rate 17 mL @ 3 hourly checks. Order 893046 at 12:10.",
    "Pt: [PERSON]\nMRN: <MEDICAL_RECORD_NUMBER>\nMr. ___ lives at [LOCATION], phone [**Phone**], mail <EMAIL_ADDRESS>.",
    "Values 140 110 100 3000 and 7 482 991, ratio 120/80/4000, code 12345-678-90, serial 123456789012, on 2150.03.04 at 10:20.",
    "Her son. It was late. Dr. No was not said, Mr. and Mrs. were. Room 12 Lead A, 5 Green tablets, 3 Way stopcock.",
    "His spouse reported that night sweats began. Her family agreed. Blood pressure 120/80.",
    "",
]


@pytest.mark.parametrize("text,want", CASES)
def test_found(text, want):
    places = deid.find_places(text)
    assert [(k, text[s:e]) for s, e, k in places] == want
    clean = deid.redact(text, places)
    assert all(v not in clean for _, v in want) and deid.find_places(clean) == []


@pytest.mark.parametrize("text", HONEST)
def test_honest(text):
    assert deid.find_places(text) == []


def test_rest_of_the_text_is_unchanged():
    text = "".join(t for t, _ in CASES)
    places, at, kept = deid.find_places(text), 0, []
    for s, e, _ in places:
        kept.append(text[at:s])
        at = e
    clean = deid.redact(text, places)
    for part in [*kept, text[at:]]:
        assert part in clean
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))


def test_spark(spark):
    schema = "note_id bigint, original_text string, text string, phi_type string, places int"
    long = "No pleural effusion was seen. " * 20_000 + "Mr. Velmere was seen."
    rows = [(1, CASES[0][0], None, "c", 1), (1, CASES[0][0], None, "c", 1), (2, None, "Callback 555-0126 on file.", "c", 1), (3, long, "", "c", 1), (None, None, None, "c", 1)]
    got = {tuple(r) for r in deid.phi_places(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "original_text", "PERSON", 4), (1, "original_text", "MEDICAL_RECORD_NUMBER", 25), (2, "text", "PHONE_NUMBER", 9), (3, "original_text", "PERSON", len(long) - len("Velmere was seen."))}
    assert deid.phi_places(spark.createDataFrame([], schema)).count() == 0
