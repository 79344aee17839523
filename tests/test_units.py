"""Units named in texts, units inferred from ranges with known truth, and rows without hints."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chartloom.functions.units import number_of, spellings
from chartloom.operators import units

LABS = "labevent_id bigint, subject_id int, itemid int, charttime timestamp_ntz, value string, valuenum double, valueuom string, ref_range_lower double, ref_range_upper double, priority string, comments string, uom string, num double, cand string, p double"
FACTORS = "itemid int, uom string, factor double, shift double, cand string"
ITEMS = "itemid int, label string, fluid string, category string, common_uom string, possible_low double, possible_high double, loaded_at timestamp_ntz"
GLUCOSE = [(1, "mg/dL", 1.0, 0.0, "z"), (1, "mmol/L", 18.016, 0.0, "z"), (1, "g/L", 100.0, 0.0, "z"), (2, "deg C", 1.0, 0.0, "z"), (2, "deg F", 0.555556, -17.777778, "z"), (3, "U/L", 1.0, 0.0, "z")]
DICTIONARY = [(1, "Glucose", "Blood", "Chemistry", "mg/dL", 8.0, 2200.0, datetime(2100, 1, 1)), (2, "Temperature", None, None, "deg C", 19.0, 46.0, None), (3, None, "Blood", "Chemistry", "U/L", None, None, datetime(2100, 1, 1))]


def tables(spark, labs):
    return spark.createDataFrame(labs, LABS), spark.createDataFrame(GLUCOSE, FACTORS), spark.createDataFrame(DICTIONARY, ITEMS)


def lab(i, item, value, num, uom=None, low=None, high=None, comments=None):
    return (i, 1, item, datetime(2150, 1, 1), value, num, uom, low, high, None, comments, "clash", 0.0, "clash", 0.5)


@pytest.mark.parametrize("text,want", [("4.26", 4.26), ("2,03", 2.03), ("11,500", 11500.0), ("0,854", 0.854), ("< 3", 3.0), ("LESS THAN 0.5 mg/dL", 0.5), (" -1 ", -1.0), ("1e3", 1000.0), ("QNS", None), ("", None), (None, None)])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(number_of(F.col("t"))).first()[0] == want


def test_spellings(spark):
    df = spark.createDataFrame([("µmol/L",), ("cells / uL",), ("U/L",), ("%",), (None,)], "u string")
    got = [set(r[0] or ()) for r in df.select(spellings(F.col("u"))).collect()]
    assert {"umol/l", "um", "mcmol/l", "micromol/l", "umolperl", "umol/litre", "micromolperliter"} <= got[0] and {"cells/ul", "/mm3", "cells/mcl", "cellsperul"} <= got[1]
    assert got[2] == {"u/l", "units/l", "iu/l", "uperl", "unitsperl", "iuperl", *(f"{a}{b}" for a in ("u", "units", "iu", "mc", "micro") for b in ("/liter", "/litre", "perliter", "perlitre")), "mc/l", "micro/l", "mcperl", "microperl"} and got[3] == {"%", "percent", "pct"} and got[4] == set()


def test_named_units(spark):
    labs = [
        lab(1, 1, "5", 5.0, "mmol / L"), lab(2, 1, "5 mmol / L", 5.0, "UNK"), lab(3, 1, "90", 90.0, None, None, None, "Outside lab, mg/dl"), lab(4, 1, "5mM (rpt)", None, " "),
        lab(5, 1, ">0.9 g/L H", None), lab(6, 2, "98.6", 98.6, "Fahrenheit"), lab(7, 1, "QNS", None, "mmol/L"), lab(8, 9, "5", 5.0, "mmol/L"), lab(9, 1, "90", 90.0), lab(1, 1, "5", 5.0, "mmol / L"),
        lab(10, 1, "5", 5.0, None, None, None, "Result reported in mmol/L."), lab(11, 3, "5 U/L", 5.0), lab(None, 1, "5", 5.0, "mM"), lab(12, None, None, None), lab(13, 1, "x" * 100_000, None),
    ]
    out = {r.labevent_id: r for r in units.resolve_units(*tables(spark, labs)).collect()}
    named = {k: (r.uom, r.decision) for k, r in out.items()}
    assert named[1] == named[2] == named[4] == named[10] == ("mmol/L", "stated") and named[3] == ("mg/dL", "stated") and named[5] == ("g/L", "stated") and named[6] == ("deg F", "stated")
    assert named[7][1] == named[8][1] == named[12][1] == named[13][1] == "none" and named[9] == ("mg/dL", "default") and named[11] == ("U/L", "stated")
    found = sorted((r.labevent_id or 0, r.uom) for r in units.other_units(*tables(spark, labs)).collect())
    assert found == [(0, "mmol/L"), (1, "mmol/L"), (2, "mmol/L"), (4, "mmol/L"), (5, "g/L"), (6, "deg F"), (10, "mmol/L")]
    common = {r.labevent_id: r.value_common for r in units.common_values(*tables(spark, labs)).collect()}
    assert abs(common[1] - 90.08) < 1e-6 and abs(common[6] - 37.0) < 1e-3


def test_texts_are_read_only_where_none_before_names_the_unit(spark):
    """In the plan a row's comments are looked into only under the condition that valueuom and value named nothing."""
    labs, factors, _ = tables(spark, [lab(1, 1, "5", 5.0, "mmol/L", None, None, "Outside lab, mg/dl")])
    stated = units.stated_units(labs, units.candidate_units(factors))
    assert [(r.uom, r.hint) for r in stated.collect()] == [("mmol/L", "valueuom")]
    lines = [x for x in stated._jdf.queryExecution().optimizedPlan().toString().split("\n") if "regexp_extract(comments" in x]
    assert lines and all("c_uom" in x.split("regexp_extract(comments")[0] and "c_value" in x.split("regexp_extract(comments")[0] for x in lines)


RANGES = {"mg/dL": (70.0, 140.0), "mmol/L": (3.89, 7.77), "g/L": (0.7, 1.4), "deg C": (36.0, 38.0), "deg F": (96.8, 100.4)}


def hidden_labs(seed, n=1500):
    """Results of two items, of which three in ten hide their unit; the truth by labevent_id."""
    rng = random.Random(seed)
    factor = {u: (f, s) for _, u, f, s, _ in GLUCOSE}
    labs, truth = [], {}
    for i in range(n):
        item = rng.choice([1, 2])
        u = rng.choice(["mg/dL", "mmol/L", "g/L"] if item == 1 else ["deg C", "deg F"])
        x = rng.gauss(100, 15) if item == 1 else rng.gauss(37, 0.4)
        v = round((x - factor[u][1]) / factor[u][0], 3)
        hidden = rng.random() < 0.3
        truth[i] = (u, hidden)
        labs.append(lab(i, item, str(v), v, None if hidden else u, *RANGES[u]))
    return labs, truth


def test_inferred_units_have_held_out_accuracy(spark):
    labs, truth = hidden_labs(5)
    out = units.resolve_units(*tables(spark, labs)).collect()
    asked = [r for r in out if truth[r.labevent_id][1]]
    sure = [r for r in asked if r.decision == "inferred"]
    assert len(out) == 1500 and {r.decision for r in asked} <= {"inferred", "review"}
    assert len(sure) > 0.9 * len(asked) and sum(r.uom == truth[r.labevent_id][0] for r in sure) > 0.99 * len(sure)


def test_every_named_result_counts_in_the_model(spark, monkeypatch):
    """All of 50,000 different named results with a range reach the model, and so do copies of one number."""
    kinds = {"subject_id": "int", "itemid": "int", "charttime": "timestamp_ntz", "value": "string", "valueuom": "string", "priority": "string", "comments": "string"}
    fixed = {"subject_id": "1", "itemid": "1", "valueuom": "'mg/dL'", "valuenum": "90 + least(id, 49999) / 1000.0D", "ref_range_lower": "70.0D", "ref_range_upper": "140.0D"}
    labs = spark.range(50_100).selectExpr("id AS labevent_id", *[f"CAST({fixed.get(c, 'NULL')} AS {kinds.get(c, 'double')}) AS {c}" for c in {**kinds, **fixed}])
    seen = []
    monkeypatch.setattr(units, "train_unit_model", lambda labelled, **_: seen.append(labelled.where("label = 1").selectExpr("sum(weight)", "count(*)").first()))
    units.resolve_units(labs, *tables(spark, [])[1:])
    assert [tuple(r) for r in seen] == [(50_100.0, 50_000)]


def test_units_after_a_logged_load(spark, tmp_path):
    from chartloom.sources import writers

    labs, _ = hidden_labs(6, 300)
    path = str(tmp_path / "labs")
    assert writers.load_logged(spark, str(tmp_path / "log"), "labs", "made", lambda: tables(spark, labs)[0], path) == 300
    found = units.resolve_units(spark.read.parquet(path), *tables(spark, [])[1:])
    assert found.where("decision = 'inferred'").count() > 50


def test_many_answers_change_the_plan_only(spark):
    labs, _ = hidden_labs(7, 400)
    labs += [lab(1000 + i, 1, "5", 5.0) for i in range(5)] + [lab(2000, None, None, None), lab(None, 1, "5.5", 5.5, None, 3.89, 7.77)]
    few, many = (sorted(map(repr, units.resolve_units(*tables(spark, labs), max_answers=m).drop("p").collect())) for m in (100_000, 3))
    assert few == many and len(few) == len(labs)


def test_units_that_look_alike_go_to_review(spark):
    # Two units of nearly the same size, used equally often: neither number nor range tells them apart.
    rng = random.Random(8)
    factors = spark.createDataFrame([(1, "a", 1.0, 0.0, "z"), (1, "b", 1.02, 0.0, "z"), (1, "c", 40.0, 0.0, "z")], FACTORS)
    labs, truth = [], {}
    for i in range(1500):
        u, hidden = rng.choice("aabbc"), rng.random() < 0.3
        x = round(rng.gauss(100, 15) / {"a": 1.0, "b": 1.02, "c": 40.0}[u], 3)
        truth[i] = (u, hidden)
        labs.append(lab(i, 1, str(x), x, None if hidden else u, *((1.75, 3.5) if u == "c" else (70.0, 140.0))))
    out = units.resolve_units(spark.createDataFrame(labs, LABS), factors, spark.createDataFrame(DICTIONARY, ITEMS)).collect()
    by = {kind: [r for r in out if truth[r.labevent_id][1] and (truth[r.labevent_id][0] == "c") == (kind == "c")] for kind in ("ab", "c")}
    assert sum(r.decision == "review" for r in by["ab"]) > 0.9 * len(by["ab"]) and all(0.2 < r.p < 0.8 for r in by["ab"] if r.decision == "review")
    assert sum(r.decision == "inferred" and r.uom == "c" for r in by["c"]) > 0.9 * len(by["c"])
    found = {r.labevent_id for r in units.other_units(spark.createDataFrame(labs, LABS), factors, spark.createDataFrame(DICTIONARY, ITEMS)).collect()}
    assert not found & {r.labevent_id for r in out if r.decision == "review"}


def test_probabilities_are_calibrated(spark):
    labs, _ = hidden_labs(9)
    rows = units.unit_calibration(*tables(spark, labs)).collect()
    n = sum(r.n for r in rows)
    assert n > 100 and sum(r.n * r.brier for r in rows) / n < 0.05 and all(abs(r.mean_p - r.share_right) < 0.15 for r in rows if r.n > 30)
    assert units.unit_calibration(*tables(spark, [])).count() == 0


def test_empty(spark):
    labs, factors, items = tables(spark, [])
    assert units.resolve_units(labs, factors, items).count() == 0
    some = tables(spark, [lab(1, 1, "5", 5.0, "mmol/L", 3.0, 7.0)])[0]
    assert units.resolve_units(some, factors.limit(0), items.limit(0)).first().decision == "none"
