"""Leaks against looking for every run of words, and the guarantee of the index."""

import random

import numpy as np

from chartloom.llm import leaks
from chartloom.llm.words import words_of


def brute(docs, items, n=15):
    grams = {}
    for i, p in items:
        w = words_of(p)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words_of(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def test_fingerprint_is_a_majority():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 40).astype(np.uint64)
    for window in (1, 5, 15, 16):
        bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
        want = [np.packbits(bits[i : i + window].sum(0) > window // 2).view(np.uint64)[0] for i in range(40 - window + 1)]
        assert leaks.fingerprints(leaks.running_bits(words), window).tolist() == [int(x) for x in want]
    assert len(leaks.fingerprints(leaks.running_bits(words[:3]), 15)) == 0


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    (index,), _ = leaks._index([(i, " ".join(f"w{rng.integers(50)}" for _ in range(30))) for i in range(40)], leaks.every_window, 15, 3)
    prints = index.prints[rng.integers(len(index.prints), size=500)].copy()
    for k in range(500):
        for b in rng.integers(64, size=rng.integers(6)):
            prints[k] ^= np.uint64(1) << np.uint64(b)
    place, row = index.near(prints)
    want = {(i, j) for i in range(500) for j in range(len(index.prints)) if (int(prints[i]) ^ int(index.prints[j])).bit_count() <= 3}
    assert set(zip(place.tolist(), row.tolist())) == want


def make():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(10, 60))) + ".") for i in range(30)]
    items += [(90, None), (None, items[0][1]), (91, ""), (92, items[3][1]), items[0]]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randrange(0, 150))]
        if d % 2:
            source = words_of(items[rng.randrange(30)][1])
            a = rng.randrange(max(1, len(source) - 14))
            part = source[a : a + rng.choice([13, 14, 15, 16, 30])]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        t = ("\n" if d % 3 else ", ").join(w)
        docs.append((d, t.upper() if d % 5 == 0 else t))
    return docs + [(500, None), (501, ""), (None, items[0][1]), docs[1]], items


def test_against_every_run_of_words(spark):
    docs, items = make()
    want = brute([d for d in docs if d[0] is not None and d[1]], [i for i in items if i[0] is not None and i[1]])
    d = spark.createDataFrame([(*x, 1, "c") for x in docs], "doc_id bigint, text string, item_id int, similarity string")
    i = spark.createDataFrame([(*x, "s", 1) for x in items], "item_id bigint, passage string, set_name string, doc_id int")
    got = [(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i).collect()]
    assert len(want) > 25 and sorted(got) == sorted(want)
    blocks = [(r.doc_id, r.item_id) for r in leaks.near_windows(d, i, pass_words=200).where("same_words").collect()]
    assert sorted(blocks) == sorted(want)
    assert leaks.leaked_items(d.limit(0), i).count() == 0 and leaks.leaked_items(d, i.limit(0)).count() == 0


def test_near_copies_of_whole_passages(spark):
    """Recall of planted near copies, against comparing every window of the passage's size."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 140)))) for i in range(150)]
    docs = []
    for d, (i, p) in enumerate(items):
        w = p.split(" ")
        for k in rng.sample(range(len(w)), rng.choice([0, 1, 1, 1, 2, 2, 3]) if len(w) > 60 else rng.choice([0, 1])):
            w[k] = word()
        docs.append((d, " ".join([word() for _ in range(rng.randrange(60))] + w + [word() for _ in range(rng.randrange(60))])))
    docs += [(1000 + d, " ".join(word() for _ in range(200))) for d in range(50)]
    hashes = leaks.Hashes()
    words = [hashes.of(p) for _, p in items]
    weights, want = leaks.Weights(words), set()
    for size, rows in leaks.whole_windows(words, 15).items():
        for i, places in rows:
            assert size <= len(words[i]) <= leaks.STEP * size + 1
            own = hashes.of(docs[i][1])
            for a in places:
                if any(weights.similarity(words[i][a : a + size], own[k : k + size]) >= 0.8 for k in range(len(own) - size + 1)):
                    want.add((i, items[i][0]))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks.near_items(d, i).collect()}
    assert got <= want and len(want) > 110 and len(got) >= 0.95 * len(want)
    exact = {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i).collect()}
    assert len(got - exact) > 2 or exact >= got


def test_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    text = "filler " * 70_000 + passage + " filler" * 70_000
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    i = spark.createDataFrame([(5, passage)], "item_id bigint, passage string")
    assert [tuple(r) for r in leaks.leaked_items(d, i).collect()] == [(5, 1, 1.0)] or [(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i).collect()] == [(1, 5)]
