"""Spellings of measurement units and numbers in laboratory texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings in use for a unit, besides its own, in lower case and without blanks.
SPELLINGS = {
    "mg/dl": ("mgs/dl", "mg%", "mg/100ml", "mgpercent"),
    "g/dl": ("gm/dl", "gms/dl", "g/100ml", "gm%", "g%"),
    "g/l": ("gm/l", "gms/l"),
    "mmol/l": ("mm", "millimol/l"),
    "umol/l": ("um",),
    "nmol/l": ("nm",),
    "pmol/l": ("pm",),
    "mmhg": ("mm(hg)", "torr"),
    "kpa": ("kilopascal", "kilopascals"),
    "units": ("phunits", "ph", "au"),
    "10^9/l": ("10e9/l", "10*9/l", "x10^9/l", "x10e9/l", "x10*9/l", "g/l(giga)", "giga/l", "gpt/l"),
    "k/ul": ("x10^3/ul", "10^3/ul", "10*3/ul", "10e3/ul", "thou/ul", "thousand/ul", "x10e3/ul"),
    "cells/ul": ("#/ul", "/ul", "/mm3", "cells/mm3", "percumm", "/cumm"),
    "degc": ("°c", "c", "celsius", "degreesc"),
    "degf": ("°f", "f", "fahrenheit", "degreesf"),
    "l/l": ("fraction",),
    "%": ("percent", "pct"),
    "u/l": ("units/l", "iu/l"),
    "ratio": ("inr", "index"),
    "mosm/kg": ("mosmol/kg",),
    "mmol/mol": ("mmol/molhb",),
    "uiu/ml": ("uu/ml",),
    "ukat/l": (),
}


def spellings(unit: Column) -> Column:
    """The keys under which ``unit`` may be written: its own, listed ones, and those made by rule; none of a null.

    The rules: a micro prefix is u, mc or micro; a slash may be the word per; a litre may be written out.
    """
    own = F.lower(F.regexp_replace(F.translate(unit, "µμ", "uu"), " ", ""))
    listed = F.create_map(*[x for k, v in SPELLINGS.items() if v for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    more = lambda found, of: F.concat(found, F.flatten(F.transform(found, of)))
    micro = lambda x: F.when(x.startswith("u") & x.contains("/") & ~x.startswith("units"), F.array(*[F.concat(F.lit(p), F.substring(x, 2, 1000)) for p in ("mc", "micro")])).otherwise(none)

    def written_out(x: Column) -> Column:
        a, b = F.substring_index(x, "/", 1), F.substring_index(x, "/", -1)
        one = (F.length(x) - F.length(F.translate(x, "/", "")) == 1) & ~x.startswith("/")
        mcl = F.when(x.endswith("/ul"), F.array(F.concat(a, F.lit("/mcl")))).otherwise(none)
        per = F.when(one, F.array(F.concat(a, F.lit("per"), b))).otherwise(none)
        litre = F.when(one & (b == "l"), F.array(*[F.concat(a, F.lit(w)) for w in ("perliter", "perlitre", "/liter", "/litre")])).otherwise(none)
        return F.concat(mcl, per, litre)

    found = F.concat(F.array(own), F.coalesce(listed[own], none))
    return F.when(unit.isNull(), none).otherwise(F.array_distinct(more(more(found, micro), written_out)))


def unit_key(text: Column) -> Column:
    """The key under which a unit's spelling is looked up: lower case, plain u for micro, no blanks."""
    return F.lower(F.translate(text, "µμ \t\n ", "uu"))


#: A sign or words of comparison, the number, and what follows it.
NUMBER = r"^\s*(<=?|>=?|≤|≥|(?i:less than|greater than|more than|below|above|under|over)\b)?\s*([-+]?(?:\d[\d,]*\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*(.*?)\s*$"


def number_of(text: Column) -> Column:
    """The number of a result text as a double, or null.

    A comma followed by exactly three digits after one to three digits other than a lone zero separates
    thousands; any other single comma is a decimal comma.
    """
    raw = F.regexp_extract(text, NUMBER, 2)
    plain = (
        F.when(raw.rlike(r"^[-+]?[1-9]\d{0,2}(,\d{3})+(\.\d*)?$"), F.regexp_replace(raw, ",", ""))
        .when(raw.rlike(r"^[-+]?\d*,\d+$"), F.regexp_replace(raw, ",", "."))
        .otherwise(raw)
    )
    return plain.try_cast("double")
