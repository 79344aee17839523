"""Implausible readings against rules written as plain loops, and long series cut into blocks."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from chartloom.operators import spikes

SCHEMA = "labevent_id bigint, subject_id bigint, itemid bigint, charttime timestamp_ntz, num double, unit bigint, x double, low double, high double, block int, own string, count int"


def series(subject, values, start, hours=12, unit=1):
    t0 = datetime(2150, 1, 1)
    return [(start + i, subject, 61, t0 + timedelta(hours=hours * i), v, unit, v, 10.0, 1000.0, 9, "clash", 1) for i, v in enumerate(values)]


def found(spark, rows, **more):
    df = spikes.implausible(spark.createDataFrame(rows, SCHEMA), **more)
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_kinds(spark):
    rng = random.Random(1)
    normal = lambda n, level=100.0: [round(rng.gauss(level, 2), 2) for _ in range(n)]
    spiky = normal(30)
    spiky[10], spiky[20], spiky[21] = 160.0, 41.0, 40.0
    shifted = normal(15) + normal(15, 160.0)
    drift = [100.0 + 2 * i + rng.gauss(0, 1) for i in range(40)]
    stuck = normal(14) + [101.5] * 6 + normal(6)
    five = normal(14) + [101.5] * 5 + normal(6)
    short = normal(5) + [500.0] + normal(5)
    wild = normal(20)
    wild[3], wild[15] = 5.0, 5000.0
    edge = normal(20)
    edge[0] = 500.0
    twice = normal(20)
    twice[7] = twice[8] = 170.0
    triple = normal(10) + [180.0, 182.0, 181.0] + normal(10)
    rows = sum((series(i, v, i * 1000) for i, v in enumerate([spiky, shifted, drift, stuck, five, short, wild, edge, triple, twice])), [])
    rows += rows[:60]  # delivered again
    rows += [(None, 1, 61, None, 1.0, 1, 1.0, None, None, 9, "c", 1), (9_999, None, None, None, None, None, None, None, None, 9, "c", 1), (9_998, 77, 61, None, 5.0, 1, 5.0, None, None, 9, "c", 1)]
    want = {(10, "spike"), (20, "spike"), (21, "spike"), (9007, "spike"), (9008, "spike"), (6003, "impossible"), (6015, "impossible")} | {(3014 + i, "stuck") for i in range(6)}
    assert found(spark, rows) == want


def test_stuck_needs_one_unit(spark):
    rng = random.Random(2)
    values = [round(rng.gauss(50, 3), 2) for _ in range(20)]
    values[8:14] = [50.0] * 6
    rows = series(1, values, 0)
    assert {r for r in found(spark, rows) if r[1] == "stuck"} == {(i, "stuck") for i in range(8, 14)}
    rows[10] = rows[10][:5] + (2,) + rows[10][6:]
    assert not {r for r in found(spark, rows) if r[1] == "stuck"}


def test_blocks_agree_with_the_whole(spark):
    rng = random.Random(4)
    values = [round(rng.gauss(100, 2), 2) for _ in range(1500)]
    for i in range(25, 1480, 90):
        values[i] = 150.0
    values[700:708] = [99.0] * 8
    rows = series(1, values, 0, hours=3)
    whole = found(spark, rows)
    assert whole == found(spark, rows, block_rows=100) and len([r for r in whole if r[1] == "spike"]) == len(range(25, 1480, 90))
    assert {(i, "stuck") for i in range(700, 708)} <= whole


def test_blocks_take_the_scatter_of_the_whole_series(spark):
    rng = random.Random(5)
    values = [round(rng.gauss(300, 1 if i < 430 else 12), 2) for i in range(821)]  # the last block has 21 readings
    for i in range(20, 810, 37):
        values[i] += 18.0 if i < 430 else 130.0
    for i in range(200, 330):
        values[i] = 5000.0 + i  # a stretch without any possible reading, longer than a block and its margin
    for hours in (0, 6):  # all within one day, or four a day
        rows = series(1, values, 0, hours=hours)
        rows += rows[100:300]  # delivered again
        whole = found(spark, rows)
        assert found(spark, rows, block_rows=100) == whole and len([r for r in whole if r[1] == "spike"]) > 5
    grid = [float(rng.choice([50, 50, 50, 50, 51])) if i < 150 else round(rng.gauss(50, 3), 2) for i in range(400)]
    for i in range(10, 390, 23):
        grid[i] = 90.0
    rows = series(2, grid, 5000, hours=5)
    assert found(spark, rows, block_rows=100) == found(spark, rows)


def test_model_keeps_clear_cases():
    rng = np.random.default_rng(7)
    key = np.repeat(np.arange(200), 40)
    x = np.round(rng.normal(100, 3, len(key)), 2)
    hit = rng.random(len(key)) < 0.01
    x[hit] += 60
    spike, stuck, p = spikes.flag_series(key, x, x, np.ones(len(x)), np.full(len(x), -np.inf), np.full(len(x), np.inf))
    inner = np.ones(len(x), bool)
    inner[::40] = inner[39::40] = False
    assert (spike & ~hit).sum() == 0 and (spike & hit & inner).sum() >= 0.95 * (hit & inner).sum() and not stuck.any()
    assert ((p[spike] >= 0.5) & (p[spike] <= 1 + 1e-9)).all()


def test_the_model_decides():
    """Posteriors choose the rows: another bound gives other rows, and the distance or the run alone gives wrong ones."""
    rng = np.random.default_rng(11)
    key = np.repeat(np.arange(300), 60)
    x = np.round(rng.normal(100, 3, len(key)), 1)
    truth_spike, truth_stuck = np.zeros(len(key), bool), np.zeros(len(key), bool)
    for s in range(300):
        at = s * 60 + int(rng.integers(8, 20))
        x[at] += 8.2 * 3 if s % 2 else 60
        truth_spike[at] = s % 2 == 0
        at = s * 60 + int(rng.integers(24, 34))
        x[at : at + 3] += 90  # three together are no spike
        at = s * 60 + int(rng.integers(40, 50))
        n = 5 + s % 2
        x[at : at + n] = x[at]
        truth_stuck[at : at + n] = n == 6
    ends = (np.full(len(x), -np.inf), np.full(len(x), np.inf))
    flags = lambda **k: spikes.flag_series(key, x, x, np.ones(len(x)), *ends, **k)
    spike, stuck, _ = flags()
    clear = truth_spike & (np.arange(len(x)) % 60 > 0)
    assert (spike & clear).sum() == clear.sum() and (stuck & truth_stuck).sum() >= 0.97 * truth_stuck.sum()
    strict, eager = flags(bound=0.9999), flags(bound=0.01)
    assert (strict[0] & ~spike).sum() == 0 and (strict[0] | strict[1]).sum() < (spike | stuck).sum() <= (eager[0] | eager[1]).sum()
    # Without the model: whatever lies far from both sides, and whatever repeats the number before or after it.
    m = spikes._measures(key, x, x, np.ones(len(x)), *ends, spikes.RUN)
    scatter = (spikes._totals(key, x, m, 300, spikes.RUN).level / spikes.USUAL_OFF)[key]
    far = m.apart > 8 * scatter
    precise = lambda found, truth: (found & truth).sum() / max(found.sum(), 1)
    borderline = spike & ~truth_spike & (m.lone > 7 * scatter)  # those placed at 8.2
    assert precise(far, truth_spike) < 0.5 and precise(spike & ~borderline, truth_spike) > 0.97
    assert precise(m.run_length > 1, truth_stuck) < 0.6 and precise(stuck, truth_stuck) > 0.97


def test_a_series_has_its_own_model():
    rng = np.random.default_rng(12)
    x = np.concatenate([np.round(rng.normal(50, 2, 400), 1), rng.choice([50.0, 51.0, 52.0], 400)])
    key = np.repeat([0, 1], 400)
    x[np.arange(20, 390, 10)] += 60
    ends = (np.full(800, -np.inf), np.full(800, np.inf))
    m = spikes._measures(key, x, x, np.ones(800), *ends, spikes.RUN)
    whole = spikes._totals(key, x, m, 2, spikes.RUN)
    away, sums = spikes._away(m, whole, key), None
    for _ in range(2):
        fitted = spikes._fit(sums, whole.n)
        sums = spikes._sums(m, *spikes._model(m, away, key, fitted, 8.0), key, 2)
    fitted = spikes._fit(sums, whole.n)
    assert 0.07 < fitted.spikes[0] < 0.12 and fitted.spikes[1] < 0.005 and fitted.repeats[1] > 0.25 > 0.15 > fitted.repeats[0]


def test_empty(spark):
    assert found(spark, []) == set()
    assert spikes.implausible(spark.createDataFrame([], SCHEMA)).where(F.lit(True)).count() == 0
