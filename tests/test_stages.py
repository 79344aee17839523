"""Stages of retrieval, measures and mining on small made rows: arithmetic, ties, nulls and empty input."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chartloom.functions import coerce, text, vectors
from chartloom.operators import answering, chunking, cohort, fusion, judging, labs, lexical, metrics, mining, models, redaction, vector

T0 = datetime(2150, 1, 1)


def ranked(spark, ids):
    return spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id bigint, chunk_id bigint, rank bigint")


def test_fusion_arithmetic(spark):
    f = {r.chunk_id: r for r in fusion.reciprocal_rank_fusion(ranked(spark, [10, 20]), ranked(spark, [20, 30])).collect()}
    assert f[20].raw == pytest.approx(1 / 62 + 1.2 / 61 + 0.5 / 61) and f[10].raw == pytest.approx(1 / 61) and f[30].raw == pytest.approx(1.2 / 62)
    assert [f[c].rank for c in (20, 30, 10)] == [1, 2, 3] and f[20].score == 1.0 and f[10].score == 0.0 and f[20].sources == "both"
    old = {r.chunk_id: r.score for r in fusion.fusion_v1(ranked(spark, [10]), ranked(spark, [])).collect()}
    assert old == {10: pytest.approx(1 / 61)}


def results(spark):
    rows = [(1, 1, 100, 7, T0, 0.5, 1), (1, 2, 100, 7, T0 + timedelta(days=334), 0.4, 2), (1, 3, 200, 7, None, 0.3, 3), (1, 4, 300, 8, T0 + timedelta(days=9), 0.2, 4), (1, 5, 100, 7, T0 - timedelta(days=100), 0.1, 5)]
    return spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, note_id bigint, subject_id bigint, charttime timestamp_ntz, score double, rank bigint")


def test_time(spark):
    order = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    df = results(spark)
    assert order(fusion.temporal(df, "all")) == [1, 2, 3, 4, 5]
    assert order(fusion.temporal(df, "oldest_first")) == [5, 1, 4, 2, 3]
    recent = fusion.temporal(df, "recent")
    assert 5 not in order(recent) and 3 in order(recent)
    latest = {r.chunk_id: r for r in fusion.temporal(df, "latest").collect()}
    assert latest[1].score == pytest.approx(0.5 + 0.2 * 0.5 ** (334 / 180)) and latest[1].days_ago == 334.0 and latest[3].score == 0.3 and latest[4].score == pytest.approx(0.4)
    anchor = spark.createDataFrame([(7, T0 + timedelta(days=400))], "subject_id bigint, anchor timestamp_ntz")
    assert {r.chunk_id: r.days_ago for r in fusion.temporal(df, "latest", reference=anchor).collect()}[1] == 400.0
    assert order(fusion.dedup_notes(df)) == [1, 2, 3, 4]


def test_context(spark):
    chunks = spark.createDataFrame([(1, i, f"t{i}", n) for i, n in enumerate([300, 350, 100, 500])], "note_id bigint, chunk_index int, text string, tokens bigint")
    asked = chunks.withColumn("chunk_id", F.col("chunk_index").cast("bigint"))
    got = {r.chunk_id: (r.context_text, r.context_tokens) for r in fusion.context_windows(asked, chunks).collect()}
    # The budget stops at the first that doesn't fit, even before the chunk itself.
    assert got == {0: ("t0", 300), 1: ("t0", 300), 2: ("t1\nt2", 450), 3: ("t2\nt3", 600)}
    assert {r.chunk_id: r.context_text for r in fusion.context_windows(asked, chunks, anchor_first=True).collect()}[1] == "t1"
    blocks = spark.createDataFrame([(1, r, "a" * n, None, None) for r, n in enumerate([9000, 10, 10])] + [(2, 1, " ", "x", T0), (2, 2, "body", "x", T0)], "query_id bigint, rank bigint, context_text string, note_type string, charttime timestamp_ntz")
    out = {r.query_id: r for r in fusion.source_blocks(blocks).collect()}
    assert out[1].n_sources == 1 and out[2].block == "[S1] note_type=x | charttime=2150-01-01\nbody"


def test_rerank_falls_back(spark):
    df = results(spark).withColumn("l", F.col("chunk_id").cast("double"))
    assert [r.chunk_id for r in fusion.rerank(df, F.col("l"), 2).orderBy("rank").collect()] == [5, 4]
    low = fusion.rerank(df, F.col("l") * 0 - 3, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in low] == [1, 2] and all(r.fallback for r in low)


def test_measures(spark):
    rows = [("a", 1, r, c, int(g >= 2), g) for r, (c, g) in enumerate([(1, 3), (2, 0), (3, 2)], 1)] + [("b", 1, 1, 9, 0, 0)]
    runs = spark.createDataFrame(rows, "config string, query_id bigint, rank bigint, chunk_id bigint, rel int, grade int")
    m = {r.config: r for r in metrics.ir_metrics(runs).collect()}
    assert m["a"].precision == pytest.approx(2 / 3) and m["a"].recall == pytest.approx(2 / 3) and m["a"].mrr == 1 and m["a"].ndcg == pytest.approx(1.5 / (1 + 1 / 1.584962500721156)) and m["b"].ndcg == 0 == m["b"].mrr
    p = {r.config: r for r in metrics.pooled_metrics(runs, metrics.pool(runs)).collect()}
    assert p["a"].recall == 1 and p["a"].ndcg == pytest.approx((7 + 3 / 2) / (7 + 3 / 1.584962500721156)) and p["b"].recall == 0
    wins = {r.config: r.wins for r in metrics.head_to_head(metrics.pooled_metrics(runs, metrics.pool(runs)), ["b", "a"]).collect()}
    assert wins == {"a": 1}


def test_temporal_measures(spark):
    times = [T0 + timedelta(days=d) for d in (0, 1, 2, 3, 4)]
    make = lambda name, order: [(name, 1, k + 1, 1, times[i], i // 3) for k, i in enumerate(order)]
    runs = spark.createDataFrame(make("up", [0, 1, 2, 3, 4]) + make("down", [4, 3, 2, 1, 0]) + make("mixed", [2, 4, 0, 1, 3]) + [("one", 1, 1, 1, T0, 0), ("none", 1, 1, 1, None, 0)], "config string, query_id bigint, rank bigint, grade int, charttime timestamp_ntz, hadm_id int")
    m = {r.config: r for r in metrics.temporal_metrics(runs).collect()}
    assert (m["up"].hit1, m["up"].hit3, m["up"].newest_rank, m["up"].monotonic) == (0, 0, 5, 1.0)
    assert (m["down"].hit1, m["down"].newest_rank, m["down"].monotonic) == (1, 1, 0.0) and (m["mixed"].hit3, m["mixed"].monotonic) == (1, 0.75)
    assert m["one"].monotonic is None and "none" not in m and m["up"].same_admission == 0.4


@pytest.mark.parametrize("raw,want", [('{"score": 2}', 2), ('```json\n{"score": "3"}\n```', 3), ('x {"rating": 1,} y', 1), ('{"relevance": 9}', 3), ('{"score": "2 of 3"}', 2), ('{"score": -4}', 0), ("none", None), ("", None), (None, None), ('{"score": 2.5}', 2)])
def test_judge_answers(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(judging.parse_answer(F.col("r"))).first()[0] == want


def test_votes_and_cache(spark):
    votes = spark.createDataFrame([([3, 1],), ([2, None, 0],), ([None],), ([],), (None,)], "v array<int>").select(judging.median_vote(F.col("v")).alias("m"))
    assert [r.m for r in votes.collect()] == [3, 2, None, None, None]
    pairs = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "b"), (None, None)], "query string, text string")
    cache = pairs.where("text = 'a'").select(judging.pair_key(F.col("query"), F.col("text")).alias("key"), F.lit(1).alias("score")).distinct()
    out = {(r.query, r.text): (r.score, r.cached) for r in judging.judge_pairs(pairs, cache, lambda q, t: F.lit('{"score": 3}')).collect()}
    assert out == {("q", "a"): (1, True), ("q", "b"): (3, False), (None, None): (3, False)}


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    modes = {"latest potassium": "latest", "creatinine trend over time": "trend", "recent labs": "recent", "most recent trend": "latest", "allergies": "all"}
    assert all(one(text.temporal_mode(F.lit(q))) == m for q, m in modes.items())
    assert one(text.clean_page_text(F.lit("treat-\nment\n\n\n\n12\n© 2020 X\nS15 Diabetes Care  12\na   b "))) == "treatment\n\n\na b"
    assert one(text.overlap_ratio(F.lit("What is the heparin dose"), F.lit("Heparin given"))) == 0.5 and one(text.overlap_ratio(F.lit("what is the"), F.lit("x"))) == 0.0
    assert one(text.citation_tags(F.lit("a [S3] b (L1) [S3] [X2]"))) == ["S3", "L1"]
    assert one(coerce.safe_int(F.lit("12.7"))) == 12 and one(coerce.strict_int(F.lit("12.7"))) is None and one(coerce.safe_float(F.lit("x"))) is None
    assert one(coerce.guideline_diagnosis(F.lit(" i509"), F.lit(10))) and one(coerce.guideline_diagnosis(F.lit("4280"), F.lit(None).cast("int"))) and not one(coerce.guideline_diagnosis(F.lit("E109"), F.lit(10))) and one(coerce.guideline_diagnosis(F.lit(None).cast("string"), F.lit(9))) is False
    assert [one(labs.short_number(F.lit(x))) for x in (0.5, 1234567.0, 100.0, 0.00012, 3.14159265)] == ["0.5", "1234570", "100", "0.00012", "3.14159"]
    assert one(vectors.valid_vector(F.array(F.lit(0.0), F.lit(0.0)))) is False and one(vectors.valid_vector(F.array(F.lit(float("nan"))))) is False
    assert one(coerce.lenient_timestamp(F.lit("2150-03-04T05:06:07Z"))) == datetime(2150, 3, 4, 5, 6, 7) and one(coerce.lenient_timestamp(F.lit("NaT"))) is None and one(coerce.lenient_timestamp(F.lit("3.4.2150"))) is None


def test_vector_search(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)] + [(500, None), (501, [0.0, 0.0, 0.0]), (502, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "chunk_id bigint, vector array<float>")
    q = df.where("chunk_id IN (3, 4, 501)").withColumnRenamed("chunk_id", "query_id")
    got = vector.vector_top(q, df, 5, block=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank) for r in got] == [(a, b) for a in (3, 4) for b in range(1, 6)] and [r.chunk_id for r in got][:5] == [3, 38, 73, 108, 143]
    assert vector.vector_top(q.limit(0), df).count() == 0 and vector.vector_top(q, df.limit(0)).count() == 0
    near = vector.lsh_top(q, df, 5).count()
    assert near == 10


def test_lexical(spark):
    chunks = spark.createDataFrame([(1, "edema of both legs and edema"), (2, "legs legs"), (3, "edema only here"), (4, None)], "chunk_id bigint, text string").withColumn("note_id", F.col("chunk_id")).withColumn("chunk_index", F.lit(0))
    q = spark.createDataFrame([(1, "edema legs"), (2, "swollen legs"), (3, ""), (4, "unheard")], "query_id bigint, query string")
    two = {(r.query_id, r.chunk_id): r["pass"] for r in lexical.two_pass(q, chunks).collect()}
    assert two[(1, 1)] == 1 and (1, 2) not in two and two[(2, 1)] == 2 and two[(2, 3)] == 2
    assert {r.query_id for r in lexical.bm25(q, chunks).collect()} == {1, 2}
    assert {(r.query_id, r.chunk_id): r.score for r in lexical.cover_density(q, chunks).collect()} == {(1, 1): pytest.approx(2 / 4 + 2 / 3)}
    assert lexical.bm25(q, chunks.limit(0)).count() == 0


def test_chunking(spark):
    sentence = "The patient was seen in clinic and the plan was made today."
    many = " ".join([sentence] * 90)
    df = spark.createDataFrame([(1, many), (2, "word " * 2000), (3, "short text"), (4, many + " " + "word " * 600 + ". " + sentence)], "id int, t string")
    packed = {r.id: r.p for r in df.select("id", chunking.pack(F.col("t")).alias("p")).collect()}
    estimate = lambda t: int(len(t.split()) * 1.3)
    assert len(packed[1]) > 1 and all(sum(estimate(x + ".") for x in p.split(".") if x.strip()) <= 384 for p in packed[1]) and packed[1][1].startswith(sentence)
    assert len(packed[2]) > 1 and all(len(p.split()) <= 384 for p in packed[2]) and packed[3] == ["short text"] and packed[4][-1] == sentence
    note = "intro text\nALLERGIES: none\nHOSPITAL COURSE:\n" + " ".join([sentence] * 40)
    notes = spark.createDataFrame([(1, note, None), (2, "tiny", "x"), (3, None, None), (4, "", None), (5, "Findings: " + "a " * 60 + "\nImpression: " + "b " * 60, "radiology")], "note_id bigint, text string, note_type string")
    out = [tuple(r)[2:] for r in chunking.chunk_notes(notes).where("note_id = 1").orderBy("chunk_index").collect()]
    assert out[0][0] == "PREAMBLE" and "none" in out[0][1] and out[1][1].startswith("[HOSPITAL COURSE] The patient")
    assert [tuple(r) for r in chunking.chunk_notes(notes).where("note_id IN (2, 3, 4)").collect()] == [(2, 0, "FULL_NOTE", "tiny", 1)]
    got = [(r.section, r.text) for r in chunking.training_sections(notes).where("note_id = 5").orderBy("chunk_index").collect()]
    assert got == [("Findings", ("a " * 60).strip()), ("Impression", ("b " * 60).strip())]


def test_redaction(spark):
    note = "MRN: 1234567 seen 01/15/2150 by Dr. Anna Velmere, mail a.b@c.org, SSN 912-34-5678, 93-year-old. Serial number: SPN3-2024-AK. Springfield Memorial Hospital."
    df = spark.createDataFrame([(1, note), (2, None), (3, ""), (4, "911-22-3333" + " é 01/15/2150" * 3)], "note_id bigint, text string")
    found = {r.note_id: r for r in redaction.detect(df).collect()}
    kinds = {e.type for e in found[1].entities}
    assert found[4].redacted == "[SSN]" + " é [DATE]" * 3 and [e.start for e in found[4].entities] == [0, 14, 27, 40]
    assert {"MEDICAL_RECORD_NUMBER", "DATE_TIME", "PERSON", "EMAIL_ADDRESS", "US_SSN", "AGE_OVER_89", "DEVICE_ID", "LOCATION"} <= kinds
    assert "1234567" not in found[1].redacted and found[2].redacted is None and found[3].entities == []
    assert all(note[e.start : e.end] == e.original_value for e in found[1].entities)
    expected = spark.createDataFrame([(1, "SSN", "912-34-5678"), (1, "X", "seen")], "note_id bigint, type string, value string")
    assert {r.type: r.recall for r in redaction.recall(expected, redaction.detect(df)).collect()} == {"SSN": 1.0, "X": 0.0}


CHUNK = "chunk_id bigint, subject_id int, hadm_id int"
EXAMPLE = "example_id bigint, subject_id int, hadm_id int, positive_id bigint"


def test_negatives(spark):
    chunks = spark.createDataFrame([(i, i % 20, i % 60) for i in range(240)] + [(900, None, None)], CHUNK)
    codes = spark.createDataFrame([(h, f"c{h % 4}") for h in range(60)] + [(h, "rare") for h in (3, 7)] + [(None, "c1"), (3, None)], "hadm_id int, icd_code string")
    examples = spark.createDataFrame([(1, 3, 3, 63), (2, None, None, None), (3, 5, 5, None), (4, 99, 7, 7)], EXAMPLE)
    out = mining.hard_negatives(examples, chunks, codes, pool=10).collect()
    by = {e: sorted((r for r in out if r.example_id == e), key=lambda r: r.place) for e in (1, 2, 3, 4)}
    assert all(len(v) == 5 or e == 2 for e, v in by.items()) and [r.neg_type for r in by[1]][:3] == ["same_patient", "same_code", "same_code"]
    at = {r.chunk_id: r for r in chunks.collect()}
    assert all(at[r.chunk_id].hadm_id != 3 for r in by[1]) and len({r.chunk_id for r in by[1]}) == 5 and 63 not in {r.chunk_id for r in by[1]}
    assert [r.neg_type for r in by[4]].count("same_code") == 3 and all(at[r.chunk_id].hadm_id % 4 == 3 for r in by[4] if r.neg_type == "same_code")
    again = mining.hard_negatives(examples, chunks, codes, pool=10).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_negatives_beside_a_large_admission(spark):
    chunks = spark.createDataFrame([(i, 7, 1) for i in range(1000)] + [(2000, 7, 2), (2001, 8, 3), (2002, 9, 4)], CHUNK)
    codes = spark.createDataFrame([(1, "hot"), (2, "x"), (3, "hot"), (4, "hot")], "hadm_id int, icd_code string")
    examples = spark.createDataFrame([(1, 7, 1, None)], EXAMPLE)
    got = {(r.chunk_id, r.neg_type) for r in mining.hard_negatives(examples, chunks, codes).collect()}
    assert got == {(2000, "same_patient"), (2001, "same_code"), (2002, "same_code")}


def test_every_chunk_can_become_a_negative(spark):
    """No chunk of a frequent code is out of reach: many examples together draw far more than one pool."""
    chunks = spark.createDataFrame([(i, i, i) for i in range(2000)], CHUNK)
    codes = spark.createDataFrame([(i, "hot") for i in range(2000)], "hadm_id int, icd_code string")
    examples = spark.createDataFrame([(i, i, i, i) for i in range(600)], EXAMPLE)
    out = mining.hard_negatives(examples, chunks, codes, pool=20).where("neg_type = 'same_code'")
    assert out.select("chunk_id").distinct().count() > 400 and out.groupBy("example_id").count().where("count = 3").count() == 600


def test_mined_examples(spark):
    text = lambda k: " ".join(["elevated potassium workup and management of the patient", *(f"w{k}x{j}" for j in range(20))])
    chunks = spark.createDataFrame([(i, i % 5, i % 15, text(i)) for i in range(45)], CHUNK + ", text string")
    queries = spark.createDataFrame([(3, "lab", "elevated potassium workup and management"), (3, "lab", "nothing that occurs anywhere"), (99, "lab", "elevated potassium workup")], "hadm_id int, query_type string, query string")
    codes = spark.createDataFrame([(h, "c") for h in range(15)], "hadm_id int, icd_code string")
    (row,) = mining.mined_examples(queries, chunks, codes).collect()
    assert row.hadm_id == 3 and row.positive_chunk_id in (3, 18, 33) and len(row.negatives) == 5 and row.query_type == "lab" and row.positive == text(row.positive_chunk_id)
    assert all(int(n.chunk_id) % 15 != 3 and n.text == text(int(n.chunk_id)) for n in row.negatives) and float(row.metadata["overlap"]) >= 0.2
    assert mining.mined_examples(queries, chunks.where("chunk_id IN (3, 4)"), codes).count() == 0  # fewer than two negatives


def test_answers(spark):
    asked = spark.createDataFrame([(1, "q", "[L1] Potassium 4", ""), (2, "q", "", "[S1] x\nHe slept well. More."), (3, "q", "", "")], "key bigint, question string, labs string, notes string")
    out = {r.key: r for r in answering.grounded_answers(asked).collect()}
    assert out[1].answer == "Potassium 4 [L1]" and out[1].grounded and out[2].answer == "He slept well. [S1]" and out[2].has_valid_citation and out[3].refused and not out[3].grounded
    made_up = answering.grounded_answers(asked, lambda q, l, n: F.lit("see [S9]")).where("key = 1").first()
    assert made_up.grounded and not made_up.has_valid_citation


def test_models(spark):
    df = spark.createDataFrame([(1, "heparin dose"), (2, None), (3, "")], "id bigint, text string")
    v = {r.id: r.v for r in df.select("id", models.embedder()(F.col("text")).alias("v")).collect()}
    assert len(v[1]) == models.DIMENSIONS and any(v[1]) and not any(v[2]) and not any(v[3])
    s = {r.id: r.s for r in df.select("id", models.scorer()(F.lit("heparin"), F.col("text")).alias("s")).collect()}
    assert s[1] == 3.0 and s[2] == -3.0


def test_cohort_options(spark):
    p = spark.createDataFrame([(1, 40), (2, 40), (3, 10), (None, 50)], "subject_id int, anchor_age int")
    a = spark.createDataFrame([(s, s * 10 + k) for s in (1, 2, 3) for k in range(3)], "subject_id int, hadm_id int")
    n = spark.createDataFrame([(s, "discharge") for s in (1, 2, 3)], "subject_id int, note_type string")
    none = spark.createDataFrame([], "subject_id int, icd_code string, icd_version int")
    assert cohort.select_cohort(p, a, n, none).count() == 0
    assert [r.subject_id for r in cohort.select_cohort(p, a, n, none, open_if_no_diagnosis=True).collect()] == [1, 2]
    parts = cohort.split_by_hash(spark.range(2000), "id").groupBy("part").count().collect()
    assert {r.part for r in parts} == {"train", "val"} and 140 < min(r["count"] for r in parts) < 260
