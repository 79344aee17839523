"""Search within a scope, its modes, and questions as typed."""

import random
from datetime import datetime

from chartloom.operators import lexical, search, vector

CHUNK = "chunk_id bigint, note_id bigint, subject_id int, hadm_id int, note_type string, text string, rank int"
QUESTION = "query_id bigint, query string, subject_id int, hadm_id int, note_type string, mode string, chunk_id int"


def tables(spark):
    text = "heparin infusion was started for thrombosis and potassium was low "
    rows = [(i, i // 2, i % 4, i % 8, "discharge" if i % 3 else "radiology", text + f"word{i} " * 3, 1) for i in range(40)]
    rows += [(90, None, None, None, None, text, 1), (91, 99, 1, None, None, None, 1), rows[0]]
    times = [(i, datetime(2150, 1, 1 + i)) for i in range(20)]
    return spark.createDataFrame(rows, CHUNK), spark.createDataFrame(times, "note_id bigint, charttime timestamp_ntz")


def test_scope_holds_in_every_row(spark):
    chunks, times = tables(spark)
    asked = [(1, "heparin thrombosis", None, None, None, "all", 1), (2, "heparin thrombosis", 3, None, None, None, 1), (3, "heparin thrombosis", None, 5, None, "latest", 1), (4, "heparin latest thrombosis", 2, None, "discharge", None, 1), (5, "heparin", 77, None, None, None, 1), (6, None, None, None, None, None, 1)]
    found = search.search(spark.createDataFrame(asked, QUESTION), chunks, times).collect()
    at = {r.chunk_id: r for r in chunks.collect()}
    by = {q: [r for r in found if r.query_id == q] for q in range(1, 7)}
    assert all(at[r.chunk_id].subject_id == 3 for r in by[2]) and all(at[r.chunk_id].hadm_id == 5 for r in by[3]) and all(at[r.chunk_id].subject_id == 2 and r.note_type == "discharge" for r in by[4])
    assert len(by[1]) == len(by[2]) == 10 and len(by[3]) == 5 and by[5] == [] and by[6] == [] and {r.mode for r in by[4]} == {"latest"}
    assert all(sorted(r.rank for r in v) == list(range(1, len(v) + 1)) for v in by.values())


def test_scope_comes_before_the_ranking(spark):
    """A patient's chunks are found though sixty and more of others score higher."""
    rows = [(i, i, 1, 1, "d", "heparin thrombosis", 1) for i in range(100)] + [(500, 500, 2, 2, "d", "heparin thrombosis " + "filler " * 80, 1)]
    chunks = spark.createDataFrame(rows, CHUNK)
    asked = spark.createDataFrame([(1, "heparin thrombosis", 2, None, None, None, 1)], QUESTION)
    assert [r.chunk_id for r in lexical.two_pass(asked, chunks, scoped=True).collect()] == [500]
    v = "array(1.0F, 0.0F)"
    near = vector.vector_top(asked.selectExpr("*", f"{v} AS vector"), chunks.selectExpr("*", f"{v} AS vector"), scoped=True)
    assert [r.chunk_id for r in near.collect()] == [500]


def test_empty(spark):
    chunks, times = tables(spark)
    assert search.search(spark.createDataFrame([], QUESTION), chunks, times).count() == 0
    one = spark.createDataFrame([(1, "heparin")], "query_id bigint, query string")
    assert search.search(one, chunks.limit(0), times.limit(0)).count() == 0 and search.search(one, chunks, times).count() == 10


def test_typed_questions(spark):
    lines = [(1, "p:123 what is the potassium? /recent"), (2, "trend of /Oldest creatinine"), (3, "p:x no patient"), (4, " p:7  both /oldest /recent "), (5, None), (6, "")]
    out = {r.query_id: tuple(r)[1:] for r in search.parse_questions(spark.createDataFrame(lines, "query_id bigint, line string")).collect()}
    assert out[1] == ("what is the potassium?", 123, "recent") and out[2] == ("trend of creatinine", None, "trend") and out[3] == ("p:x no patient", None, None)
    assert out[4] == ("both", 7, "recent") and out[5] == (None, None, None) and out[6] == ("", None, None)


def shuffled(spark):
    """Bytes that the session's stages have shuffled so far."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_and_pairs_of_common_words_are_not_shuffled(spark):
    rng = random.Random(4)
    texts = ["heparin thrombosis " + " ".join(f"{rng.getrandbits(64):x}" for _ in range(300)) for _ in range(400)]
    chunks = spark.createDataFrame([(i, i, i % 40, i, "d", t, 1) for i, t in enumerate(texts)], CHUNK)
    times = spark.createDataFrame([(i, datetime(2150, 1, 1)) for i in range(400)], "note_id bigint, charttime timestamp_ntz")
    asked = [(i, "heparin thrombosis", i % 40 if i % 2 else None, None, None, None, 1) for i in range(400)]
    before = shuffled(spark)
    found = search.search(spark.createDataFrame(asked, QUESTION), chunks, times).collect()
    assert shuffled(spark) - before < sum(map(len, texts)) / 2
    by = {}
    for r in found:
        by.setdefault(r.query_id, set()).add((r.chunk_id, r["rank"]))
    assert len(by) == 400 and all(len(v) == 10 for v in by.values()) and all(by[i] == by[0] for i in range(0, 400, 2))
    assert all({c for c, _ in by[i]} == set(range(i % 40, 400, 40)) for i in range(1, 400, 2))


def test_blocks_and_note_types_of_wide_questions(spark):
    """Questions of all patients go in blocks over the chunks, limited to a note type or not; copies of a chunk_id make no other chunk less."""
    rows = [(i, i, i % 7, i, "a" if i % 3 else "b", "heparin thrombosis " * (1 + i % 4) + "renal failure filler " * (i % 5), 1) for i in range(200)]
    chunks = spark.createDataFrame([*rows, (7, 7, 0, 7, "a", "heparin thrombosis", 1)], CHUNK)
    asked = spark.createDataFrame([(1, "heparin thrombosis", None, None, None, None, 1), (2, "heparin kidney failure", None, None, "b", None, 1), (3, "heparin", 3, None, "b", None, 1)], QUESTION)
    words, vocabulary = lexical.numbered(lexical.query_words(asked))
    held = lexical.with_copies(lexical.word_lists(chunks, vocabulary, ("chunk_id", *lexical.SCOPE)))
    one, all_at_once = ([sorted(map(str, lexical.scoped_two_pass(asked, words, held, len(vocabulary), block=b).collect()))] for b in (1, 4096))
    assert one == all_at_once
    found = lexical.two_pass(asked, chunks, scoped=True).collect()
    plain = lexical.two_pass(asked, chunks).where("query_id = 1").collect()
    kinds = {r.chunk_id: (r.subject_id, r.note_type) for r in chunks.collect()}
    score = lambda rs: sorted((r.chunk_id, r["pass"], round(r.score, 9), r["rank"]) for r in rs)
    assert score(r for r in found if r.query_id == 1) == score(plain) and len(plain) == 60
    by = {q: [kinds[r.chunk_id] for r in found if r.query_id == q] for q in (2, 3)}
    assert by[2] and {k for _, k in by[2]} == {"b"} and by[3] and set(by[3]) == {(3, "b")}
