"""Orphan references against a plain loop, with nulls, repeats, hot keys and empty tables."""

import random
from datetime import datetime, timedelta

from chartloom.operators import orphans

LABS = "labevent_id bigint, hadm_id int, itemid int, charttime timestamp_ntz, storetime timestamp_ntz, reason string, bucket int"
DX = "hadm_id int, seq_num int, loaded_at timestamp_ntz, kind string"
ADM = "hadm_id int, loaded_at timestamp_ntz, deleted_at timestamp_ntz, count int"
ITEMS = "itemid int, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
T0 = datetime(2150, 1, 1)


def brute(labs, dx, adm, items):
    def state(rows):
        by = {}
        for k, at, gone in rows:
            if k is not None:
                by.setdefault(k, []).append((at, gone is not None))
        low = datetime.min
        return {k: (max((a or low, g) for a, g in v)[1], min((a for a, _ in v if a), default=None)) for k, v in by.items()}

    states = {"hadm_id": state([r[:3] for r in adm]), "itemid": state(items)}
    out = set()

    def judge(table, field, key, row, at, arrival):
        if key is None:
            return
        s = states[field].get(key)
        reason = "missing" if s is None else "deleted" if s[0] else "late" if s[1] and arrival and s[1] > arrival else None
        if reason:
            out.add((table, field, row, key, at.strftime("%Y-%m") if at else None, reason))

    for i, h, it, ct, st, *_ in labs:
        row = None if i is None else str(i)
        judge("labevents", "hadm_id", h, row, ct, st or ct)
        judge("labevents", "itemid", it, row, ct, st or ct)
    for h, seq, at, _ in dx:
        judge("diagnoses_icd", "hadm_id", h, None if seq is None else f"{h}:{seq}", at, at)
    return out


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: T0 + timedelta(days=rng.randrange(900))
    adm = [(rng.choice([k, k + 1_000_000]), day(), rng.choice([None, None, None, day()]), 1) for k in range(60) for _ in range(rng.choice([1, 1, 2]))] + [(None, day(), None, 1), (7, None, None, 1)]
    items = [(k, day(), rng.choice([None, None, day()])) for k in (61001, 61002, 61003, 61003)]
    labs = [(i, rng.choice([None, 5, 5, 5, rng.randrange(-3, 70)]), rng.choice([None, 61001, 61002, 61003, 69999]), rng.choice([None, day()]), rng.choice([None, day()]), "x", 1) for i in range(600)]
    labs += labs[:40] + [(None, 999, 61001, day(), None, "x", 1)]
    dx = [(rng.choice([None, *range(70)]), rng.choice([None, 1, 2, 3]), rng.choice([None, day()]), "k") for _ in range(300)]
    frames = spark.createDataFrame(labs, LABS), spark.createDataFrame(dx, DX), spark.createDataFrame(adm, ADM), spark.createDataFrame(items, ITEMS)
    found = orphans.lab_and_diagnosis_orphans(*frames)
    want = brute(labs, dx, adm, items)
    assert rows(found) == want and found.count() == len(want)
    report = {tuple(r)[:4]: r.n_rows for r in orphans.orphan_report(found).collect()}
    assert sum(report.values()) == len(want)


def test_many_keys_and_hot_keys_change_the_plan_only(spark):
    refs = spark.range(3000).selectExpr("'p' AS parent", "if(id % 3 = 0, 6, id % 11) AS ref_key", "timestamp_ntz'2150-01-01' AS arrival", "id AS row_id")
    parents = {"p": orphans.parent_ranges(spark.createDataFrame([(k, T0 + timedelta(days=k - 4), T0 if k == 2 else None) for k in range(6)], "k int, at timestamp_ntz, gone timestamp_ntz"), "k", "at", "gone", 4)}
    few = {tuple(r) for r in orphans.find_orphans(refs, parents, width=4).collect()}
    for more in ({"max_keys": 3, "hot_rows": 500}, {"max_keys": 3, "hot_rows": 10**6}):
        assert {tuple(r) for r in orphans.find_orphans(refs, parents, width=4, **more).collect()} == few
    reason = lambda k: "missing" if k > 5 else "deleted" if k == 2 else "late" if k == 5 else None
    key = lambda i: 6 if i % 3 == 0 else i % 11
    assert few == {("p", key(i), i, reason(key(i))) for i in range(3000) if reason(key(i))}


def test_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (LABS, DX, ADM, ITEMS)]
    assert orphans.lab_and_diagnosis_orphans(*empty).count() == 0
    one = spark.createDataFrame([(1, 2, 3, T0, None, "x", 1)], LABS)
    assert {r.reason for r in orphans.lab_and_diagnosis_orphans(one, *empty[1:]).collect()} == {"missing"}
