"""Made pages of every kind, and honest lists that look like them."""

import random

from chartloom.llm import spam

DRUGS = "digoxin warfarin heparin sertraline metformin apixaban insulin lisinopril".split()
SCHEMA = "doc_id bigint, text string, lang string, ratio int, usual string, n_chars bigint"


def pages():
    rng = random.Random(1)
    d = lambda: rng.choice(DRUGS)
    t = lambda: rng.choice(["buy", "cheap", "order now", "price", "best", "no prescription", "fast shipping", "online"])
    some = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(500)]
    small = "the of and to with was in for on is by after from".split()

    def prose(n):
        return " ".join(" ".join(rng.choice(small) if rng.random() < 0.4 else rng.choice(some) for _ in range(rng.randrange(6, 16))).capitalize() + "." for _ in range(n))

    bad = [
        " ".join(f"{d()} {t()}" for _ in range(150)), ", ".join(f"{d()} {t()}" for _ in range(100)), "\n".join(f"http://shop{rng.randrange(99)}.example/{d()}-buy.html" for _ in range(40)),
        " ".join(f"[{d()} {t()}](http://x{rng.randrange(99)}.test/{rng.randrange(9999)})" for _ in range(40)), "\n".join(f'<a href="//a{rng.randrange(99)}.test">{d()}</a>' for _ in range(40)),
        "\n".join(f"{d().upper()} {rng.randrange(9, 500)}mg x{rng.randrange(120)} {t()} ${rng.randrange(9, 200)}.99 SKU{rng.randrange(99999)} HOT" for _ in range(40)),
        " ".join(f"#{d()}{rng.choice(['Buy', 'Cheap', 'Price'])}" for _ in range(80)), " > ".join(rng.choice(["Home", "Shop", "Cart", "Blog", d().title()]) for _ in range(90)),
        prose(4) + "\n" + " ".join(f"{d()} {t()}" for _ in range(150)), " ".join(f"{d()} {rng.choice(['kaufen', 'Preis', 'günstig', 'ohne Rezept', 'Apotheke'])}" for _ in range(120)),
    ]
    good = [
        prose(20), "\n".join(f"{i}. {d().title()} {rng.randrange(5, 500)} mg by mouth every {rng.randrange(4, 12)} hours" for i in range(40)),
        "\n".join(f"{i:02d}:00 BP {rng.randrange(90, 180)}/{rng.randrange(50, 100)} HR {rng.randrange(60, 120)} SpO2 {rng.randrange(88, 100)}% lungs clear" for i in range(24)),
        "\n".join(f"creatinine\t{rng.randrange(10, 90) / 10}\tmg/dL\tH" for _ in range(40)), prose(15) + " See http://guideline.example/page for more.",
        " ".join("Warfarin was given and warfarin was stopped before warfarin was given again." for _ in range(30)), "n/a", prose(12) + "\n" + " ".join(f"{d()} {t()}" for _ in range(20)),
        "\n".join(f"{i}. Velmere A, Orrin B. Trial of {d()}. J Med {rng.randrange(1990, 2024)};{rng.randrange(99)}:{rng.randrange(999)}-{rng.randrange(999)}." for i in range(30)), prose(6) + "\nBuy and sell are words. " + prose(4),
    ]
    return bad, good, [prose(rng.randrange(5, 40)) for _ in range(60)]


def test_kinds(spark):
    bad, good, rest = pages()
    rows = [(i, x) for i, x in enumerate(bad)] + [(100 + i, x) for i, x in enumerate(good)] + [(200 + i, x) for i, x in enumerate(rest)]
    rows += [(900, None), (901, ""), (902, "   "), (None, bad[0]), rows[0], (903, "cheap " * 200_000)]
    df = spark.createDataFrame([(i, t, None, 1, "c", None) for i, t in rows], SCHEMA)
    got = [r.doc_id for r in spam.spam_pages(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {*range(len(bad)), None, 903}


def test_blocks_hold_the_text():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "x" * 700, "\n", "end. "]) for _ in range(rng.randrange(400)))
        parts = spam.blocks_of(text)
        assert "".join(parts) == text and all(len(p) <= 1500 for p in parts)


def test_empty(spark):
    assert spam.spam_pages(spark.createDataFrame([], SCHEMA)).count() == 0


WORDS = {
    "it": ("amlodipina ramipril metformina digoxina".split(), ["prezzo", "comprare", "migliore", "sconto", "farmacia"]), "nl": ("amlodipine ramipril metformine digoxine".split(), ["kopen", "goedkoop", "korting", "bestellen", "zonder recept"]),
    "unlisted": ("premium wholesale handbag watches".split(), ["bargain", "outlet", "luxury", "replica", "clearance"]),
}


def test_words_and_languages_that_no_list_has(spark):
    rng = random.Random(3)
    _, _, rest = pages()
    pair = lambda k: f"{rng.choice(WORDS[k][0])} {rng.choice(WORDS[k][1])}"
    towns = [a + b for a in ("Oak", "Ash", "Elm", "Fir", "Bay") for b in ("ton", "ville", "ford", "mere")]
    bad = [sep.join(pair(k) for _ in range(120)) for k in WORDS for sep in (" ", ", ", " | ", "\n")]
    bad += [" ".join(f"Premium handbag {rng.choice(['near', 'in', '-'])} {rng.choice(towns)}." for _ in range(60)), "\n".join(f"* {pair('nl')} {rng.choice(towns).lower()}{rng.randrange(99)}.winkel.nl" for _ in range(40))]
    bad.append(" ".join(f"[{pair('it')}](http://a{rng.randrange(99)}.test/{rng.randrange(999)})" for _ in range(40)) + ".")
    # Lines of keywords among sentences, the keywords being the greater part.
    bad.append("\n".join(x for i in range(12) for x in (" ".join(pair("it") for _ in range(14)), rest[i].split(".")[0] + ".")))
    good = ["\n".join(x for i in range(12) for x in (pair("it"), rest[i].split(".")[0] + "."))]
    good += ["\n".join(f"{rng.choice('sodium potassium glucose urea'.split())} {rng.randrange(10, 900) / 10} mmol/L" for _ in range(50)), " ".join(f"{h}: denies {rng.choice('pain fever cough rash itching'.split())}, {rng.choice('swelling fatigue dizziness'.split())}." for h in "Heart Lungs Skin Neck Back Joints Head Eyes Abdomen Throat".split())]
    rows = [*enumerate(bad), *enumerate(good, 100), *enumerate(rest, 200)]
    got = {r.doc_id for r in spam.spam_pages(spark.createDataFrame([(i, t, None, 1, "c", None) for i, t in rows], SCHEMA)).collect()}
    assert got == set(range(len(bad)))


def test_the_ratio_decides(spark):
    bad, _, rest = pages()
    df = spark.createDataFrame([(i, t, None, 1, "c", None) for i, t in [*enumerate(bad), *enumerate(rest, 200)]], SCHEMA)
    found = [spam.spam_pages(df, redundant=r).count() for r in (0.0, 0.3, 0.75)]
    assert found[0] == 0 and found[0] < found[1] < found[2] == len(bad)
