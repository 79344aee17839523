"""Implausible readings of a series: spikes, stuck runs and impossible values.

A series is one source's (here one patient's and item's) readings by time. Each series has a hidden Markov model with the
states normal, spike (of one or two readings), stuck (of six or more) and out of range. Its emissions are how far a reading
lies from the level before and after, in units of the series' own scatter, whether it repeats the number before it, and
the hard bounds. How often a series has spikes, stuck runs and readings out of range, how often normal readings repeat
themselves and how heavy the tail of their scatter is are fitted to each series in a few rounds of expectation and
maximisation, and the forward-backward probabilities decide the flags.

Series longer than ``block_rows`` are cut into blocks by position, each with a margin of readings from its neighbours, so a
long series' model never lands in one task; the model's memory is far shorter than the margin. What is judged by the whole
series (scatter, grid, share of repeats, the rounds of fitting) is summed over its blocks and handed back to each of them,
so the cut changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators.units import MAX_FACTOR_ROWS, resolve_units
from chartloom.sources.tables import broadcast_if_small, cut

MARGIN = 64
SIDE = 5
#: Median distance from the median of the neighbours, and 85 % quantile of the smaller distance from either side, of normal readings with scatter 1.
USUAL_OFF, HIGH_APART = 0.72, 1.27
HIGH, RUN = 0.85, 6
#: A spike lies more than so many scatters from the level.
TIMES = 8.0
#: Rounds of fitting a series' model.
ROUNDS = 2
#: More long series than this are joined without a broadcast.
MAX_SERIES = 500_000
#: States: normal, first and second reading of a spike, the first to RUN-th and later readings of a stuck run, out of range.
NORMAL, SPIKE, SECOND, STUCK, OUT = 0, 1, 2, 3, 3 + RUN
STATES = OUT + 1


def _transitions() -> np.ndarray:
    """Probabilities of the next state; the row of the normal state is each series' own."""
    m = np.zeros((STATES, STATES))
    m[SPIKE, [NORMAL, SECOND, STUCK, OUT]] = 0.75, 0.20, 0.02, 0.03
    m[SECOND, [NORMAL, SPIKE, STUCK, OUT]] = 0.93, 0.02, 0.02, 0.03
    for k in range(STUCK, STUCK + RUN - 1):
        m[k, k + 1] = 1.0
    m[STUCK + RUN - 1, [NORMAL, SPIKE, STUCK + RUN - 1, OUT]] = 0.08, 0.01, 0.90, 0.01
    m[OUT, [NORMAL, SPIKE, STUCK, OUT]] = 0.77, 0.01, 0.02, 0.20
    return m


NEXT = _transitions()
#: A series doesn't end within the first readings of a stuck run.
END = np.ones(STATES)
END[STUCK : STUCK + RUN - 1] = 0.0
SCHEMA = "labevent_id long, reading_kind string, posterior double"
MEASURES = "subject_id long, itemid long, off double, apart double, size double, near boolean, tie boolean, loose boolean"
SERIES = ["subject_id", "itemid"]
#: Columns of a series' totals: see Totals.
TOTALS = ("level", "high_apart", "size", "near", "tie", "loose", "n")
#: What a round of fitting sums up: expected spikes, stuck runs, readings out of range, normal readings, those that repeat, those in the tail.
SUMS = ("spikes", "runs", "outs", "normal", "repeats", "tail")
SUM_SCHEMA = "subject_id long, itemid long, " + ", ".join(f"{c} double" for c in SUMS)


def _sides(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Medians of up to SIDE values before and after each position within its series, and of both sides together."""
    at = np.arange(len(x))
    before = np.full((len(x), SIDE), np.nan)
    after = before.copy()
    for k in range(1, SIDE + 1):
        ok = at - k >= start
        before[ok, k - 1] = x[at[ok] - k]
        ok = at + k < end
        after[ok, k - 1] = x[at[ok] + k]
    return _row_median(before), _row_median(after), _row_median(np.hstack([before, after]))


def _second_nearest(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The second smallest distance to the two values before and the two after: small only where three or more lie together."""
    at = np.arange(len(x))
    far = np.full((len(x), 4), np.inf)
    for j, k in enumerate((-2, -1, 1, 2)):
        ok = (at + k >= start) & (at + k < end)
        far[ok, j] = np.abs(x[at[ok] + k] - x[ok])
    return np.partition(far, 1, axis=1)[:, 1] if len(x) else np.zeros(0)


def _row_median(m: np.ndarray) -> np.ndarray:
    """Medians of rows in which nan marks places without a value; nan for rows without any."""
    n = (~np.isnan(m)).sum(1)
    s = np.sort(m, axis=1)
    row = np.arange(len(m))
    low, high = s[row, np.maximum(n - 1, 0) // 2], s[row, np.minimum(n // 2, m.shape[1] - 1)]
    return np.where(n > 0, (low + high) / 2, np.nan)


def _by_series(values: np.ndarray, series: np.ndarray, n: int, q: float = 0.5) -> np.ndarray:
    """A quantile of the values of each series, nan where it has none."""
    order = np.lexsort((values, series))
    count = np.bincount(series, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    v = values[order]
    pick = lambda p: v[np.minimum(first + np.floor(p).astype(int), max(len(v) - 1, 0))]
    if not len(v):
        return np.full(n, np.nan)
    out = (pick((count - 1).clip(0) * q) + pick(np.minimum((count - 1).clip(0) * q + 0.5, (count - 1).clip(0)))) / 2
    return np.where(count > 0, out, np.nan)


def _posteriors(emit: np.ndarray, rows: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Forward-backward over all series at once, in groups of similar length: probability of each state.

    ``rows`` has each series' probabilities of the state after a normal reading, which also begin it.
    """
    out = np.empty_like(emit)
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        top = max(int(length[order[at]] * 1.25), 32)
        stop = np.searchsorted(length[order], top, side="right")
        stop = min(max(stop, at + 1), at + max(1, 400_000 // top))
        group = order[at:stop]
        at = stop
        t = int(length[group].max())
        pos = start[group][:, None] + np.arange(t)[None, :]
        real = np.arange(t)[None, :] < length[group][:, None]
        e = np.where(real[..., None], emit[np.where(real, pos, 0)], 0.0)
        p = np.exp(e - e.max(-1, keepdims=True)) + 1e-300
        own, forward = rows[group], np.empty_like(p)
        forward[:, 0] = p[:, 0] * own
        forward[:, 0] /= forward[:, 0].sum(-1, keepdims=True)
        for i in range(1, t):
            last = forward[:, i - 1]
            f = (last @ NEXT + last[:, :1] * own) * p[:, i]
            forward[:, i] = f / f.sum(-1, keepdims=True)
        back = np.tile(END, (len(group), 1))
        for i in range(t - 1, -1, -1):
            post = forward[:, i] * back
            forward[:, i] = post / post.sum(-1, keepdims=True)
            seen = back * p[:, i]
            nxt = seen @ NEXT.T
            nxt[:, 0] = (seen * own).sum(-1)
            back = np.where(real[:, i : i + 1], nxt / nxt.sum(-1, keepdims=True), END)
        out[pos[real]] = forward[real]
    return out


class Measures(NamedTuple):
    """What each reading shows by itself and its neighbours; off, apart, lone and usual are those of the possible readings."""

    run_length: np.ndarray
    same: np.ndarray
    outside: np.ndarray
    inside: np.ndarray
    off: np.ndarray
    apart: np.ndarray
    lone: np.ndarray
    usual: np.ndarray
    near: np.ndarray


class Totals(NamedTuple):
    """Numbers of whole series: median off, high quantile of apart, median size; readings near a neighbour, tied, in no run, and all."""

    level: np.ndarray
    high_apart: np.ndarray
    size: np.ndarray
    near: np.ndarray
    tie: np.ndarray
    loose: np.ndarray
    n: np.ndarray


def _measures(series: np.ndarray, x: np.ndarray, number: np.ndarray, unit: np.ndarray, low: np.ndarray, high: np.ndarray, run: int) -> Measures:
    same = np.zeros(len(x), bool)
    same[1:] = (series[1:] == series[:-1]) & (number[1:] == number[:-1]) & (unit[1:] == unit[:-1])
    group = np.cumsum(~same) - 1
    run_length = np.bincount(group)[group]
    outside = (x < low) | (x > high)
    inside = np.flatnonzero(~outside)
    s, v = series[inside], x[inside]
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.array([], int)
    size = np.diff(np.concatenate([edge, [len(s)]])).astype(int)
    start, end = np.repeat(edge, size), np.repeat(edge + size, size)
    before, after, around = _sides(v, start, end)
    off = np.abs(v - around)
    usual = ~np.isnan(off) & (run_length[inside] < run)
    apart = np.nan_to_num(np.minimum(np.abs(v - before), np.abs(v - after)), nan=0.0)  # without a side there is no level to be away from
    lone = _second_nearest(v, start, end)
    near = np.zeros(len(x), bool)
    near[1:] = (series[1:] == series[:-1]) & (np.abs(x[1:] - x[:-1]) <= 0.002 * np.abs(x[1:]))
    near[:-1] |= near[1:]
    return Measures(run_length, same, outside, inside, off, apart, lone, usual, near)


def _totals(series: np.ndarray, x: np.ndarray, m: Measures, n: int, run: int) -> Totals:
    s, loose = series[m.inside], m.run_length < run
    return Totals(
        _by_series(m.off[m.usual], s[m.usual], n), _by_series(m.apart[m.usual], s[m.usual], n, HIGH), _by_series(np.abs(x[m.inside]), s, n),
        np.bincount(series, m.near, n), np.bincount(series[(m.run_length > 1) & loose], minlength=n), np.bincount(series[loose], minlength=n), np.bincount(series, minlength=n),
    )


class Fitted(NamedTuple):
    """A series' own numbers: rates of spikes, stuck runs and readings out of range, of repeats, and the weight of the tail."""

    spikes: np.ndarray
    runs: np.ndarray
    outs: np.ndarray
    repeats: np.ndarray
    tail: np.ndarray


def _fit(sums: dict[str, np.ndarray] | None, n: np.ndarray) -> Fitted:
    """The numbers that a round's sums give, held by 50 readings' worth of what is usual; those alone before the first round.

    A number repeated for a whole run is stuck by definition, so neither rare runs nor a coarse grid may explain it away:
    the rate of runs isn't fitted below its start, nor that of repeats above 0.3.
    """
    rate = lambda c, usual, of: (usual * 50 + (sums[c] if sums else 0.0)) / (50 + of) if sums else np.full(len(n), usual)
    normal = sums["normal"] if sums else n
    return Fitted(rate("spikes", 0.01, n), np.maximum(rate("runs", 0.02, n), 0.02), rate("outs", 0.005, n), np.clip(rate("repeats", 0.05, normal), 0.02, 0.3), np.clip(rate("tail", 1e-3, normal), 1e-4, 0.2))


def _emissions(m: Measures, away: np.ndarray, series: np.ndarray, fitted: Fitted, times: float) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities of what each reading shows in each state, share of the tail in that of a normal one)."""
    tail = fitted.tail[series]
    body, heavy = np.log1p(-tail) - 0.5 * away * away, np.log(tail) - away
    near = np.logaddexp(body, heavy)
    # Spikes lie beyond ``times`` scatters, with an edge of a twentieth of one, and anywhere there.
    spike = np.log(0.02) - 0.5 * (np.maximum(times - away, 0.0) / 0.05) ** 2
    repeat = fitted.repeats[series]
    tied = np.where(m.same, np.log(repeat), np.log1p(-repeat))
    emit = np.full((len(series), STATES), -700.0)
    emit[:, NORMAL] = np.where(m.outside, -700.0, near + tied)
    emit[:, SPIKE] = np.where(m.outside, -700.0, spike + tied)
    emit[:, SECOND] = np.where(m.outside, -700.0, spike + np.log(0.5))
    # A stuck run begins with a new number, which may lie anywhere, and then only repeats it.
    anywhere = np.maximum(np.where(m.outside, -9.0, near), -4.0)
    emit[:, STUCK] = np.where(m.same, -700.0, anywhere + np.log1p(-repeat))
    emit[:, STUCK + 1 : OUT] = np.where(m.same, np.log(0.99) + anywhere, -700.0)[:, None]
    emit[:, OUT] = np.where(m.outside, tied, -700.0)
    return emit, np.exp(heavy - near)


def _away(m: Measures, whole: Totals, series: np.ndarray) -> np.ndarray:
    """How many scatters each reading lies from the level before and after; 0 where it is out of range or three or more lie together."""
    scatter = whole.level / USUAL_OFF
    # Numbers on a coarse grid mostly repeat themselves and have a median of next to nothing: a high quantile then tells their scatter.
    scatter = np.where((whole.near > 0.5 * whole.n) | (whole.level == 0), np.fmax(scatter, whole.high_apart / HIGH_APART), scatter)
    scatter = np.where(np.nan_to_num(scatter) > 0, scatter, np.maximum(np.nan_to_num(whole.size) * 0.005, 1e-9))
    away = np.zeros(len(series))
    away[m.inside] = np.minimum(np.minimum(m.apart, m.lone) / scatter[series[m.inside]], 1e6)
    return away


def _model(m: Measures, away: np.ndarray, series: np.ndarray, fitted: Fitted, times: float) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each state, share of the tail) of each reading."""
    rows = np.zeros((len(fitted.spikes), STATES))
    rows[:, SPIKE], rows[:, STUCK], rows[:, OUT] = fitted.spikes, fitted.runs, fitted.outs
    rows[:, NORMAL] = 1.0 - rows.sum(1)
    emit, tail = _emissions(m, away, series, fitted, times)
    first = np.flatnonzero(np.concatenate([[True], series[1:] != series[:-1]]))
    return _posteriors(emit, rows, first, np.diff(np.concatenate([first, [len(series)]]))), tail


def _sums(m: Measures, post: np.ndarray, tail: np.ndarray, series: np.ndarray, n: int, own: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """SUMS of each series, over its own readings where a part of the others is only a margin."""
    w = np.ones(len(series)) if own is None else own.astype(float)
    add = lambda v: np.bincount(series, v * w, n)
    normal = post[:, NORMAL]
    return dict(zip(SUMS, (add(post[:, SPIKE]), add(post[:, STUCK]), add(post[:, OUT]), add(normal), add(normal * m.same), add(normal * tail))))


def flag_series(series: np.ndarray, x: np.ndarray, number: np.ndarray, unit: np.ndarray, low: np.ndarray, high: np.ndarray, times: float = TIMES, shortest: int = 12, run: int = RUN, bound: float = 0.5, rounds: int = ROUNDS, totals: Totals | None = None, sums: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spike, stuck, posterior) of readings sorted by series and time; x in the common unit, number as recorded.

    A reading is a spike or stuck if the series' model gives those states at least ``bound``. The model is fitted in
    ``rounds`` rounds; ``totals`` and the last round's ``sums`` are those of the whole series where the readings are only a
    part of it. Series of fewer than ``shortest`` readings have neither.
    """
    n = int(series.max()) + 1 if len(series) else 0
    spike, stuck, posterior = np.zeros(len(x), bool), np.zeros(len(x), bool), np.zeros(len(x))
    if not n:
        return spike, stuck, posterior
    m = _measures(series, x, number, unit, low, high, run)
    whole = totals or _totals(series, x, m, n, run)
    away = _away(m, whole, series)
    if sums is None and totals is None:
        for _ in range(rounds):
            sums = _sums(m, *_model(m, away, series, _fit(sums, whole.n), times), series, n)
    post, _ = _model(m, away, series, _fit(sums, whole.n), times)
    p_spike, p_stuck = post[:, SPIKE] + post[:, SECOND], post[:, STUCK:OUT].sum(1)
    long_enough = (whole.n >= shortest)[series]
    spike, stuck = long_enough & (p_spike >= bound), long_enough & (p_stuck >= bound)
    return spike, stuck, np.where(spike, p_spike, np.where(stuck, p_stuck, post[:, OUT]))


def _flag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _by_key(batches, _flag_table)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _by_key(batches, _measure_table)


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _by_key(batches, _sum_table)


def _by_key(batches: Iterator[pa.RecordBatch], of: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Sorted readings in, what ``of`` makes of them out. A series that a batch may not end in waits for the next one."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if t.num_rows < 50_000:
            rest = t
            continue
        key = _keys(t)
        last = np.flatnonzero(key[1:] != key[:-1])
        if not len(last):
            rest = t
            continue
        rest = t.slice(last[-1] + 1)
        yield from of(t.slice(0, last[-1] + 1))
    if rest is not None and rest.num_rows:
        yield from of(rest)


def _keys(t: pa.Table) -> np.ndarray:
    parts = np.stack([t.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("subject_id", "itemid", "block")])
    change = np.concatenate([[True], (parts[:, 1:] != parts[:, :-1]).any(0)]) if t.num_rows else np.array([], bool)
    return np.cumsum(change) - 1


def _fresh(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """``t`` with redelivered rows once, and the numbers of its series."""
    key = _keys(t)
    ids = t.column("labevent_id").to_numpy()
    fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (key[1:] != key[:-1])])
    return t.filter(pa.array(fresh)), key[fresh]


def _of_series(t: pa.Table, key: np.ndarray) -> tuple[Totals | None, dict[str, np.ndarray] | None]:
    """The totals and sums of whole series that came with their rows, if any."""
    first = pa.array(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])))
    take = lambda names: [t.column(c).take(first).fill_null(np.nan).to_numpy() for c in names]
    return Totals(*take(TOTALS)) if "n" in t.column_names else None, dict(zip(SUMS, take(SUMS))) if SUMS[0] in t.column_names else None


def _flag_table(t: pa.Table) -> Iterator[pa.RecordBatch]:
    t, key = _fresh(t)
    ids = t.column("labevent_id").to_numpy()
    totals, sums = _of_series(t, key)
    spike, stuck, p = flag_series(key, *_readings(t), totals=totals, sums=sums)
    own = t.column("own").to_numpy(zero_copy_only=False)
    for kind, which in (("spike", spike & own), ("stuck", stuck & own)):
        if which.any():
            yield pa.RecordBatch.from_pydict({"labevent_id": ids[which], "reading_kind": [kind] * int(which.sum()), "posterior": p[which]})


def _sum_table(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """A round of fitting: one row of sums for each block."""
    t, key = _fresh(t)
    totals, sums = _of_series(t, key)
    m = _measures(key, *_readings(t), RUN)
    away, n = _away(m, totals, key), int(key.max()) + 1
    out = _sums(m, *_model(m, away, key, _fit(sums, totals.n), TIMES), key, n, t.column("own").to_numpy(zero_copy_only=False))
    first = pa.array(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])))
    yield pa.RecordBatch.from_arrays([*[t.column(c).take(first).combine_chunks() for c in SERIES], *map(pa.array, out.values())], [*SERIES, *SUMS])


def _readings(t: pa.Table) -> list[np.ndarray]:
    return [t.column(c).fill_null(fill).to_numpy() for c, fill in (("x", np.nan), ("num", np.nan), ("unit", 0), ("low", -np.inf), ("high", np.inf))]


def _measure_table(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row for each of the blocks' own readings; off and apart only of usual ones, size only of possible ones."""
    values = _readings(t)
    m = _measures(_keys(t), *values, RUN)
    off, apart, size = (np.full(t.num_rows, np.nan) for _ in range(3))
    off[m.inside[m.usual]], apart[m.inside[m.usual]], size[m.inside] = m.off[m.usual], m.apart[m.usual], np.abs(values[0][m.inside])
    loose = m.run_length < RUN
    columns = [*[t.column(c).combine_chunks() for c in SERIES], *[pa.array(v, from_pandas=True) for v in (off, apart, size)], *[pa.array(v) for v in (m.near, (m.run_length > 1) & loose, loose)]]
    out = pa.table(columns, names=[*SERIES, "off", "apart", "size", "near", "tie", "loose"])
    yield from out.filter(t.column("own")).to_batches()


def _numbered(hot: DataFrame) -> DataFrame:
    """``hot`` with pos, the place in its series, and ipos, the number of possible readings before it (null for others).

    Places are counted within days and added to the days' totals, so that no task sorts more than a day of a series.
    """
    day = hot.dropDuplicates([*SERIES, "charttime", "labevent_id"]).withColumns({"day": F.to_date("charttime"), "ok": (~F.coalesce((F.col("x") < F.col("low")) | (F.col("x") > F.col("high")), F.lit(False))).cast("int")})
    day = cut(day)
    before = Window.partitionBy(*SERIES).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    days = day.groupBy(*SERIES, "day").agg(F.count("*").alias("n"), F.sum("ok").alias("n_ok"))
    days = days.select(*[F.col(c).alias(f"_{c}") for c in (*SERIES, "day")], total("n").alias("pos_0"), total("n_ok").alias("ipos_0"))
    within = Window.partitionBy(*SERIES, "day").orderBy("charttime", "labevent_id").rowsBetween(Window.unboundedPreceding, 0)
    places = day.withColumns({"k": F.row_number().over(within), "k_ok": F.sum("ok").over(within)})
    placed = places.join(days, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*SERIES, "day")])
    pos, ipos = F.col("pos_0") + F.col("k") - 1, F.when(F.col("ok") == 1, F.col("ipos_0") + F.col("k_ok") - 1)
    return placed.withColumns({"pos": pos, "ipos": ipos}).drop(*[f"_{c}" for c in (*SERIES, "day")], "day", "ok", "k", "k_ok", "pos_0", "ipos_0")


def _blocks(hot: DataFrame, block_rows: int) -> DataFrame:
    """``hot`` with block and own: cut by place, with margins of the readings around a block (own = false).

    A margin holds MARGIN readings and, where those are impossible, also the nearest MARGIN possible ones, however far they lie.
    """
    rows = cut(_numbered(hot).withColumn("block", F.floor(F.col("pos") / block_rows).cast("int")))
    blocks = rows.groupBy(*SERIES, "block").agg(F.count("ipos").alias("n_ok"))
    upto = F.sum("n_ok").over(Window.partitionBy(*SERIES).orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumns({"ok_end": upto, "ok_start": upto - F.col("n_ok"), "start": F.col("block").cast("long") * block_rows, "end": (F.col("block").cast("long") + 1) * block_rows})
    around = lambda a, b: F.explode(F.concat(F.sequence(F.col(a) - MARGIN, F.col(a) - 1), F.sequence(F.col(b), F.col(b) + MARGIN - 1)))
    key = [*SERIES, F.col("block").alias("to")]
    at = rows.join(blocks.select(*key, around("start", "end").alias("pos")), [*SERIES, "pos"])
    at_ok = rows.join(blocks.select(*key, around("ok_start", "ok_end").alias("ipos")), [*SERIES, "ipos"]).where("block <> to")
    margins = at.unionByName(at_ok).dropDuplicates([*SERIES, "to", "pos"]).withColumns({"block": F.col("to"), "own": F.lit(False)}).drop("to")
    return rows.withColumn("own", F.lit(True)).unionByName(margins).drop("pos", "ipos")


def _series_totals(measures: DataFrame) -> DataFrame:
    """TOTALS of each series: the quantiles are picked by rank, exactly as ``_by_series`` does."""
    counts = measures.groupBy(*SERIES).agg(*[F.count_if(c).cast("double").alias(c) for c in ("near", "tie", "loose")], F.count("*").cast("double").alias("n"))
    kinds = (("off", "level", 0.5), ("apart", "high_apart", HIGH), ("size", "size", 0.5))
    values = measures.select(*SERIES, F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), F.lit(q).alias("q"), F.col(c).alias("value")) for c, name, q in kinds])).alias("v")).select(*SERIES, "v.*").where("value IS NOT NULL")
    most = values.groupBy(*SERIES, "kind").agg((F.count("*") - 1).alias("most"))
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy(*SERIES, "kind").orderBy("value")) - 1).join(broadcast_if_small(most, MAX_SERIES), [*SERIES, "kind"])
    p = F.col("most") * F.col("q")
    pick = lambda place: F.max(F.when(F.col("rank") == F.floor(place), F.col("value")))
    picked = ranked.groupBy(*SERIES, "kind").agg(((pick(p) + pick(F.least(p + 0.5, F.col("most").cast("double")))) / 2).alias("value"))
    wide = picked.groupBy(*SERIES).agg(*[F.max(F.when(F.col("kind") == name, F.col("value"))).alias(name) for _, name, _ in kinds])
    return counts.join(wide, SERIES, "left").select(*SERIES, *TOTALS)


def implausible(readings: DataFrame, block_rows: int = 8192) -> DataFrame:
    """(labevent_id, reading_kind), distinct: spikes, stuck runs and impossible readings.

    ``readings`` has labevent_id, subject_id, itemid, charttime, num (as recorded), unit (its number), x (in the
    common unit) and the bounds low and high, null where there is none. Readings without number are left out;
    those without time come first; equal times go by labevent_id; copies of a labevent_id count once. A series
    has its impossible readings at any length, the rest from twelve readings on. Series of more than ``block_rows``
    readings are cut into blocks, which changes the work's layout but not what is found.
    """
    readings = readings.select("labevent_id", *SERIES, "charttime", "num", "unit", "x", "low", "high").where("labevent_id IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    outside = readings.where("x < low OR x > high").select("labevent_id", F.lit("impossible").alias("reading_kind"))
    # At most one row for each block_rows readings.
    long = broadcast_if_small(cut(readings.groupBy(*SERIES).count().where(F.col("count") > block_rows).select(*SERIES)), MAX_SERIES)
    columns = ["labevent_id", "x", "num", "unit", "low", "high", "own"]
    key = [*SERIES, "block"]
    placed = lambda df: df.repartition(*key).sortWithinPartitions(*key, "charttime", "labevent_id")
    whole = readings.join(long, SERIES, "left_anti").withColumns({"block": F.lit(0), "own": F.lit(True)})
    flags = placed(whole).select(*key, *columns).mapInArrow(_flag_batches, SCHEMA)
    if not long.isEmpty():
        parts = cut(_blocks(readings.join(long, SERIES), block_rows))
        totals = cut(_series_totals(cut(placed(parts).select(*key, *columns).mapInArrow(_measure_batches, MEASURES))))
        known, more = parts.join(broadcast_if_small(totals, MAX_SERIES), SERIES), TOTALS
        for _ in range(ROUNDS):
            sums = placed(known).select(*key, *columns, *more).mapInArrow(_sum_batches, SUM_SCHEMA).groupBy(*SERIES).agg(*[F.sum(c).alias(c) for c in SUMS])
            known, more = parts.join(broadcast_if_small(totals.join(cut(sums), SERIES), MAX_SERIES), SERIES), (*TOTALS, *SUMS)
        flags = flags.unionByName(placed(known).select(*key, *columns, *more).mapInArrow(_flag_batches, SCHEMA))
    return outside.unionByName(flags.select("labevent_id", "reading_kind")).distinct()


def lab_readings(labevents: DataFrame, factors: DataFrame, items: DataFrame) -> DataFrame:
    """Readings of ``labevents`` for ``implausible``: in common units, without results behind a comparison sign.

    The bounds are those of the item's version with the latest loaded_at. Rows of items that ``items`` doesn't
    have are left out.
    """
    units = resolve_units(labevents, factors, items).where("num IS NOT NULL AND NOT compared")
    bounds = items.where("itemid IS NOT NULL").groupBy("itemid").agg(F.max_by(F.struct(F.col("possible_low").alias("low"), F.col("possible_high").alias("high")), "loaded_at").alias("b"))
    rows = units.join(broadcast_if_small(bounds, MAX_FACTOR_ROWS), "itemid").select(
        F.col("labevent_id").cast("long").alias("labevent_id"), F.col("subject_id").cast("long").alias("subject_id"), F.col("itemid").cast("long").alias("itemid"),
        "charttime", F.col("num").cast("double").alias("num"), F.xxhash64("factor", "shift").alias("unit"), (F.col("num") * F.col("factor") + F.col("shift")).alias("x"), F.col("b.low").alias("low"), F.col("b.high").alias("high"),
    )
    return cut(rows)
