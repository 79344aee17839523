"""Cross-split overlaps against comparing every pair."""

import random

import numpy as np

from chartloom.llm import overlap
from chartloom.llm.words import words_of

SCHEMA = "example_id bigint, split_name string, source string, query string, positive string, norm string, class_key int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def plain_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        assert overlap.common_length(a, b) == plain_common(a, b)


def make(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda: [rng.choice(vocabulary[:40] if rng.random() < 0.4 else vocabulary) for _ in range(rng.randrange(40, 110))]
    rows, n = [], 0

    def add(split, words, shout=False):
        nonlocal n
        t = ", ".join(words) + "." if shout else " ".join(words)
        rows.append((n, split, rng.choice(["a", None]), "q", t.upper() if shout else t))
        n += 1

    for k in range(60):
        base = text()
        add(rng.choice(["train", "TRAIN"]), base)
        if k % 3 == 0:
            other = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 9))):
                i = rng.randrange(len(other))
                other[i] = rng.choice(["typo" + str(rng.randrange(10_000)), rng.choice(vocabulary)])
            add(rng.choice(["val", "validation", "Test"]), other, shout=k % 2 == 0)
        if k % 5 == 0:
            add(rng.choice(["val", "test"]), text())
    rows += [(900, "train", None, None, None), (901, "val", None, "q", ""), (902, "test", "a", "q", "?!"), (903, None, "a", "q", rows[0][4]), (904, "holdout", "a", "q", rows[0][4]), (905, "val", "a", "q", rows[0][4]), (906, "val", "a", "q", rows[0][4])]
    return rows + rows[:3]


def test_against_every_pair(spark):
    rows = make()
    side = lambda s: "train" if (s or "").lower() == "train" else "eval" if (s or "").lower() in overlap.EVALUATION else None
    want = set()
    for a in rows:
        for b in rows:
            if side(a[1]) == "train" and side(b[1]) == "eval" and words_of(a[4]) and overlap.agreement(words_of(a[4]), words_of(b[4])) >= 0.85:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = [(r.example_id_a, r.example_id_b) for r in overlap.cross_split_pairs(frame(spark, rows)).select("example_id_a", "example_id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 15
    report = overlap.overlap_report(frame(spark, rows)).collect()
    assert sum(r.n_pairs for r in report) == len(got) and {r.split for r in report} == {"val", "test"}


def test_no_pair_at_the_bound_is_lost(spark):
    """10 to 15 % of the words differ and are rarer than those in common."""
    rng = random.Random(6)
    usual, rare = [f"w{i}" for i in range(60)], [f"r{i}" for i in range(400)]
    rows, want = [], set()
    for k in range(150):
        n = rng.randrange(45, 149)
        base = [rng.choice(usual) for _ in range(n)]
        other = list(base)
        changed = rng.sample(range(n), n - -(-85 * n // 100))
        for i in changed:
            base[i], other[i] = rng.sample(rare, 2)
        rows += [(k, "train", "s", "q", " ".join(base)), (1000 + k, "val", "s", "q", " ".join(other))]
        assert overlap.agreement(base, other) >= 0.85
        want.add((k, 1000 + k))
    rows += [(5000, "train", "s", "q", "a b c d e f"), (5001, "test", "s", "q", "a b c x d e f"), (5002, "train", "s", "q", "a b c d e"), (5003, "val", "s", "q", "a a a a a a a b"), (5004, "train", "s", "q", "a a a a a a a c")]
    got = {(r.example_id_a, r.example_id_b) for r in overlap.cross_split_pairs(frame(spark, rows)).collect()}
    assert got == want | {(5000, 5001), (5003, 5004)}
    all_rows = make(9)
    side = lambda s: "train" if (s or "").lower() == "train" else "eval" if (s or "").lower() in overlap.EVALUATION else None
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in all_rows for b in all_rows if side(a[1]) == "train" and side(b[1]) == "eval" and words_of(a[4]) and overlap.agreement(words_of(a[4]), words_of(b[4])) >= 0.85}
    assert {(r.example_id_a, r.example_id_b) for r in overlap.cross_split_pairs(frame(spark, all_rows)).collect()} == want


def test_hot_class_and_very_long_text(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(i, "train", "s", "q", "the same short text of a few words") for i in range(300)] + [(1000, "val", "s", "q", "The same: short text, of a few words"), (1001, "test", "s", "q", long), (1002, "train", "s", "q", long + " more")]
    got = {(r.example_id_a, r.example_id_b) for r in overlap.cross_split_pairs(frame(spark, rows)).collect()}
    assert got == {(i, 1000) for i in range(300)} | {(1001, 1002)}


def test_segments_within_the_radius():
    """Texts that agree in 85 % or more of the words differ in fewer segments than there are, whatever their lengths."""
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(1, 160)
        a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        b, changes = a.tolist(), int(0.15 * n + 1e-9)
        for _ in range(changes):
            how, i = rng.randrange(2), rng.randrange(len(b))
            b[i : i + 1] = [rng.getrandbits(64)] if how else []
        b = np.array(b, np.uint64)
        if not len(b) or overlap.agreement(a.tolist(), b.tolist()) < 0.85:
            continue
        count = overlap.segments(overlap.length_class(n), 0.85)
        x, y = (overlap.segment_codes(overlap.numbered(v), count) for v in (a, b))
        assert (x != y).sum() <= count - 2 and overlap.longest(overlap.length_class(n)) >= n
        apart = int(np.bitwise_count((overlap.sketch(overlap.numbered(a)) ^ overlap.sketch(overlap.numbered(b))).view(np.uint64)).sum())
        assert apart <= len(a) + len(b) - 2 * 0.85 * max(len(a), len(b)) + 1e-6


def test_all_pairs_of_every_band_and_hot_segments(spark):
    """Recall in bands of agreement, with texts of few words so that most segments are shared by many, split and unsplit alike."""
    rng = random.Random(8)
    rows, words = [], {}
    for k in range(240):
        n, low = rng.randrange(20, 120), 0.85 + 0.03 * (k % 5)
        base = [rng.choice("the of and to with was in for".split()) if rng.random() < 0.5 else f"w{rng.randrange(30)}" for _ in range(n)]
        other = list(base)
        for i in rng.sample(range(n), int((1 - low - 0.02 * rng.random()) * n)):
            other[i] = f"w{rng.randrange(30)}"
        rows += [(k, "train", "s", "q", " ".join(base)), (1000 + k, "val", "s", "q", " ".join(other))]
        words[k], words[1000 + k] = base, other
    want = {(a, b): x for a in range(240) for b in range(1000, 1240) if (x := overlap.agreement(words[a], words[b])) >= 0.85}
    bands = [sum(lo <= x < lo + 0.03 for x in want.values()) for lo in (0.85, 0.88, 0.91, 0.94, 0.97)]
    assert min(bands) > 10
    members = overlap._members(frame(spark, rows))
    for hot in (0, 3, 10**9):
        got = overlap.class_pairs(members, hot_pairs=hot)
        ids = members.select("class_key", "example_id")
        pairs = got.join(ids.toDF("class_e", "e"), "class_e").join(ids.toDF("class_t", "t"), "class_t").select("t", "e").collect()
        assert {(r.t, r.e) for r in pairs} == {p for p in want if words[p[0]] != words[p[1]]}


def test_empty(spark):
    assert overlap.cross_split_pairs(frame(spark, [])).count() == 0 and overlap.overlap_report(frame(spark, [])).count() == 0
