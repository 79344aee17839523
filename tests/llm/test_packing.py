"""Containers hold every token once, within capacity, with little left over."""

import random

import pytest

from chartloom.llm import packing as P


@pytest.fixture(scope="module")
def encoding():
    return P.encoder(P.TOKENIZER)


def test_long_texts_count_as_a_whole(encoding, monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "x9", "foo,", "bar.\n", "über", "  two", "don't", "日本"]) for _ in range(3000))
    whole = len(encoding.encode_ordinary(text))
    monkeypatch.setattr(P, "STRETCH", 50)
    assert P.count_tokens(text, encoding) == whole
    assert P.count_tokens("a" * 1000, encoding) == len(encoding.encode_ordinary("a" * 1000))


def test_windows_best_fit_and_bound():
    rng = random.Random(2)
    w, closed = P.Windows(100, 8), []
    for i in range(3000):
        closed += w.place(n := rng.randrange(1, 101), [(i, 0, 0, n)])
        assert len(w.order) <= 8
    every = closed + list(w.items.values())
    used = [sum(x[3] for x in c) for c in every]
    assert max(used) <= 100 and sorted(x[0] for c in every for x in c) == list(range(3000))
    assert sum(used) > 0.9 * 100 * len(used)


def test_spark(spark, encoding):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["patient", "was", "seen", "with", "fever", "and", "dyspnea"]) for _ in range(rng.randrange(1, 900))) for _ in range(400)]
    texts += ["word " * 5000, "", None, "a", "a"]
    rows = [(i, t, 5, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id", 1, "c", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container_id int, items string, used string").repartition(7)
    out = P.pack_texts(df, open_windows=4, merge=2).collect()
    by, need = {}, {i: len(encoding.encode_ordinary(t)) for i, t, *_ in rows if t}
    got = {}
    for r in out:
        by[r.container_id] = by.get(r.container_id, 0) + r.n_tokens
        got.setdefault(r.doc_id, []).append((r.piece_index, r.start_token, r.n_tokens))
    assert max(by.values()) <= 2048 and set(got) == set(need)
    for i, pieces in got.items():
        pieces.sort()
        assert sum(n for _, _, n in pieces) == need[i] and (len(pieces) == 1) == (need[i] <= 2048)
        assert all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
    assert sum(by.values()) > 0.93 * 2048 * len(by)
    assert P.pack_texts(df.limit(0)).count() == 0
