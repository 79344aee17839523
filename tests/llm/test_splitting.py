"""Pieces keep their limits, hold the whole text, and end where the text lets them."""

from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import splitting as S


def count(text):
    return int(1.3 * len(text.split()))


def check(text, limit=384, overlap=64):
    pieces = S.split_text(text, "X", limit, overlap)
    if count(text) <= limit:
        assert pieces == []
        return pieces
    assert len(pieces) > 1
    words = [w for _, _, c, e, _ in pieces for w in text[c:e].split()]
    assert words == text.split()
    for k, (_, s, c, e, n) in enumerate(pieces):
        assert n == count(text[s:e]) <= limit and s <= c < e and count(text[s:c]) <= overlap
        if k:
            assert s >= pieces[k - 1][1] and pieces[k - 1][3] <= c
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", "end.", "stop!", "\n\n", "\n", "HEADER:\n", "x;", "été", " "]), max_size=900), st.integers(20, 60), st.integers(0, 15))
def test_any_text(parts, limit, overlap):
    check(" ".join(parts), limit, overlap)


def test_estimates():
    for n in range(2000):
        assert S.estimate(n) == int(1.3 * n)
        assert S.estimate(S.most_words(n)) <= n < S.estimate(S.most_words(n) + 1)


def test_boundaries():
    sentence = "one two three four five six seven eight nine ten."
    text = "\n\n".join(" ".join([sentence] * 10) for _ in range(10))
    pieces = check(text)
    assert all(text[c - 2 : c] == "\n\n" for _, _, c, _, _ in pieces[1:])
    assert all(text[s:c].startswith("one") for _, s, c, _, _ in pieces[1:])
    headed = "FINDINGS:\n" + " ".join([sentence] * 24) + "\nIMPRESSION:\n" + " ".join([sentence] * 24)
    assert [p[0] for p in check(headed)] == ["FINDINGS", "IMPRESSION"]
    assert check("w " * 5000) and check("w" * 1_000_000) == []


def test_spark(spark):
    schema = "chunk_id bigint, section string, text string, token_count int, pieces int, n_pieces int"
    big = "Some words here. " * 200
    rows = [(1, " PLAN ", big, None, 1, 1), (1, " PLAN ", big, 7, 1, 1), (2, None, big, 3, 1, 1), (3, "", None, 1, 1, 1), (4, "A", "", 999, 1, 1), (5, "A", "word " * 296, 999, 1, 1), (6, "A", "word " * 297, 1, 1, 1), (None, "A", big, 1, 1, 1)]
    out = S.split_oversized(spark.createDataFrame(rows, schema)).collect()
    assert {r.chunk_id for r in out} == {1, 2, 6, None} and {r.section for r in out if r.chunk_id == 1} == {"PLAN"} and {r.section for r in out if r.chunk_id == 2} == {"FULL_NOTE"}
    assert len([r for r in out if r.chunk_id == 1]) == next(r.n_pieces for r in out if r.chunk_id == 1)
    assert S.split_oversized(spark.createDataFrame([], schema)).count() == 0


def test_any_blanks_part_words(spark):
    """Words parted by blanks that plain expressions don't know are counted as well before a text is passed on."""
    kinds = ["\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "\u2028", " \n"]
    rows = [(i, None, "".join(f"w{j}" + b for j in range(n))) for i, (b, n) in enumerate((b, n) for b in kinds for n in (297, 296))]
    df = spark.createDataFrame(rows, "chunk_id bigint, section string, text string")
    want = {i for i, _, t in rows if S.estimate(len(S.RUN.findall(t))) > 384}
    assert {r.chunk_id for r in S.split_oversized(df).select("chunk_id").collect()} == want and len(want) >= 5
