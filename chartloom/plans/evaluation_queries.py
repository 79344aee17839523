"""Queries of laboratory answers, measures, judgements, chunking, redaction, mining and answering, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.operators import answering, chunking, fusion, judging, labs, metrics, mining, redaction
from chartloom.operators.lexical import QUESTION_WORDS, STOPWORDS
from chartloom.plans import retrieval_queries as R
from chartloom.sources.tables import cut, table

CONFIGS = ["bm25_only", "vector_only", "rrf_only"]


def all_questions(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_passages").select(F.col("query").alias("question")).unionByName(table(s, d, "training_examples").select(F.col("query").alias("question")))
    return q.where("question IS NOT NULL").distinct()


def lab_router(s: SparkSession, d: str) -> DataFrame:
    return labs.route_questions(all_questions(s, d), table(s, d, "d_labitems"))


def lab_series(s: SparkSession, d: str) -> DataFrame:
    return labs.lab_series(table(s, d, "labevents"), table(s, d, "d_labitems")).drop("shown")


def lab_series_latest(s: SparkSession, d: str) -> DataFrame:
    return labs.lab_series(table(s, d, "labevents"), table(s, d, "d_labitems"), from_end=True).select("subject_id", "label", "n_shown", "first_time", "last_time")


def lab_blocks(s: SparkSession, d: str) -> DataFrame:
    return labs.lab_blocks(labs.lab_series(table(s, d, "labevents"), table(s, d, "d_labitems"))).select("subject_id", "label", "block")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Training examples as questions about the patient of their positive's note."""
    notes = table(s, d, "deid_results").where("note_id IS NOT NULL").groupBy("note_id").agg(F.max("subject_id").alias("subject_id"))
    ex = table(s, d, "training_examples").where("query IS NOT NULL").select(F.col("example_id").alias("key"), F.col("query").alias("question"), F.element_at(F.split("positive_chunk_id", "_"), 2).try_cast("bigint").alias("note_id")).distinct()
    return ex.join(notes, "note_id").where("subject_id IS NOT NULL").select("key", "question", "subject_id")


def lab_questions(s: SparkSession, d: str) -> DataFrame:
    asked = cut(_asked(s, d))
    return labs.answer_lab_questions(asked, labs.route_questions(asked, table(s, d, "d_labitems")), table(s, d, "labevents"))


def _criteria(query: Column) -> Column:
    """A question's own words as keywords, a group each."""
    words = F.array_except(T.tokens(query), F.array(*map(F.lit, (*STOPWORDS, *QUESTION_WORDS))))
    return F.transform(words, lambda w: F.array(w))


def runs(s: SparkSession, d: str) -> DataFrame:
    """(config, query_id, category, rank, chunk_id, rel, grade, charttime, hadm_id): three configurations, ten deep, judged by keywords."""
    rows = R.hybrid(s, d)
    ranked = F.array(F.struct(F.lit("bm25_only").alias("config"), F.col("lexical_rank").alias("place")), F.struct(F.lit("vector_only").alias("config"), F.col("vector_rank").alias("place")), F.struct(F.lit("rrf_only").alias("config"), F.col("rank").alias("place")))
    long = rows.withColumn("r", F.explode(ranked)).where("r.place IS NOT NULL AND r.place <= 10")
    meta = table(s, d, "eval_passages").where("item_id % 20 = 0 AND query IS NOT NULL").groupBy(F.col("item_id").alias("query_id")).agg(F.max("query").alias("query"), F.max("category").alias("category"))
    groups = _criteria(F.col("query"))
    found = F.size(F.filter(F.flatten(groups), lambda k: F.instr(F.lower("text"), k) > 0))
    long = long.select("query_id", "chunk_id", "text", "charttime", "hadm_id", F.col("r.config").alias("config"), F.col("r.place").alias("rank")).join(meta, "query_id")
    return long.select("config", "query_id", "category", "rank", "chunk_id", T.matches_any_keyword(F.col("text"), groups).cast("int").alias("rel"), F.least(F.lit(3), found).alias("grade"), "charttime", "hadm_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "mrr", "ndcg")})


def keyword_judge(s: SparkSession, d: str) -> DataFrame:
    return runs(s, d).select("config", "query_id", "rank", "chunk_id", "rel", "grade")


def ir_metrics(s: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.ir_metrics(runs(s, d)))


def _pooled(s: SparkSession, d: str) -> DataFrame:
    r = cut(runs(s, d))
    return metrics.pooled_metrics(r, metrics.pool(r))


def pooled_metrics(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_pooled(s, d))


def config_rollup(s: SparkSession, d: str) -> DataFrame:
    r = cut(runs(s, d))
    m = metrics.pooled_metrics(r, metrics.pool(r)).join(r.groupBy("query_id").agg(F.max("category").alias("category")), "query_id")
    return _rounded(metrics.mean_metrics(m))


def head_to_head(s: SparkSession, d: str) -> DataFrame:
    return metrics.head_to_head(_pooled(s, d), CONFIGS)


def temporal_runs(s: SparkSession, d: str) -> DataFrame:
    """The fused results under each way of looking at time, as configurations, ten deep."""
    base = cut(fusion.dedup_notes(R.hybrid(s, d)).join(R.questions(s, d), "query_id"))
    found = F.size(F.filter(F.flatten(_criteria(F.col("query"))), lambda k: F.instr(F.lower("text"), k) > 0))
    base = base.withColumn("grade", F.least(F.lit(3), found))
    parts = [fusion.temporal(base, m).withColumn("config", F.lit(m)).where("rank <= 10").select("config", "query_id", "rank", "grade", "charttime", "hadm_id") for m in ("all", "latest", "trend")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def temporal_metrics(s: SparkSession, d: str) -> DataFrame:
    m = metrics.temporal_metrics(temporal_runs(s, d))
    return m.withColumns({c: F.round(c, 6) for c in ("monotonic", "same_admission")})


def temporal_lift(s: SparkSession, d: str) -> DataFrame:
    return metrics.temporal_lift(metrics.temporal_metrics(temporal_runs(s, d)))


def _overlap_judge(query: Column, text: Column) -> Column:
    """A deterministic judge: a JSON answer in a code fence, with a grade by the share of shared words."""
    grade = F.floor(T.overlap_ratio(query, text) * 3.999)
    return F.concat(F.lit('```json\n{"score": '), grade.cast("string"), F.lit(', "reason": "shared words",}\n```'))


def judged_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = table(s, d, "training_examples").where("query IS NOT NULL AND positive IS NOT NULL").select("query", F.col("positive").alias("text"), "query_type")
    keyed = pairs.withColumn("key", judging.pair_key(F.col("query"), F.col("text")))
    cache = keyed.where("substring(key, 1, 1) < '4'").select("key", F.lit(2).alias("score")).distinct()
    return judging.judge_pairs(pairs.drop("query_type"), cache, _overlap_judge)


def judge_cached(s: SparkSession, d: str) -> DataFrame:
    return judged_pairs(s, d).select("key", "score", "cached")


def tolerant_json(s: SparkSession, d: str) -> DataFrame:
    """The judge's answers about every example, as models write them (fenced, in prose, with a comma too many), read back."""
    rows = table(s, d, "training_examples").where("query IS NOT NULL AND positive IS NOT NULL").select("example_id", "query", "positive").distinct()
    g = F.floor(T.overlap_ratio(F.col("query"), F.col("positive")) * 3.999).cast("string")
    forms = [F.concat(F.lit('```json\n{"score": '), g, F.lit(',}\n```')), F.concat(F.lit('As asked: {"rating": "'), g, F.lit(' of 3"}.')), F.concat(F.lit('{"relevance": '), g, F.lit("}"))]
    raw = F.element_at(F.array(*forms), F.pmod(F.length("positive"), F.lit(3)) + 1)
    return rows.select("example_id", judging.parse_answer(raw).alias("score"))


def median_votes(s: SparkSession, d: str) -> DataFrame:
    """The median of three judges of every example: the share of shared words cut off, rounded, and only where all are shared."""
    rows = table(s, d, "training_examples").where("query IS NOT NULL AND positive IS NOT NULL").select("example_id", F.round(T.overlap_ratio(F.col("query"), F.col("positive")), 9).alias("o")).distinct()
    votes = F.array(F.floor(F.col("o") * 3.999).cast("int"), F.floor(F.col("o") * 3 + 0.5).cast("int"), F.when(F.col("o") >= 1, 3))
    return rows.select("example_id", judging.median_vote(votes).alias("vote"))


def token_estimates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def sentence_split(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("sentence").alias("sentence_md5"))


def window_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.window_chunks(table(s, d, "documents").where("text IS NOT NULL"), "doc_id").select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


def _note_texts(s: SparkSession, d: str) -> DataFrame:
    """Distinct notes, in as many partitions as are set: few bytes, but much work for each, so they shouldn't be coalesced by size."""
    notes = table(s, d, "deid_results").where("note_id IS NOT NULL").select("note_id", "note_type", F.col("original_text").alias("text"))
    return notes.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), *notes.columns).distinct()


def section_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_notes(_note_texts(s, d))


def training_sections(s: SparkSession, d: str) -> DataFrame:
    return chunking.training_sections(_note_texts(s, d))


def guideline_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_guidelines(table(s, d, "documents").where("note_type = 'guideline'"))


def cleaned_pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("note_type = 'guideline' AND text IS NOT NULL").select("doc_id", F.md5(T.clean_page_text(F.col("text"))).alias("text_md5"))


def phi_entities(s: SparkSession, d: str) -> DataFrame:
    found = redaction.detect(_note_texts(s, d))
    return redaction.entities_of(found).select("note_id", "e.type", "e.start", "e.end", "e.score")


def phi_redacted(s: SparkSession, d: str) -> DataFrame:
    return redaction.detect(_note_texts(s, d), keep_values=False).select("note_id", "redacted")


def phi_histogram(s: SparkSession, d: str) -> DataFrame:
    return redaction.entity_histogram(redaction.detect(_note_texts(s, d)))


def phi_simple(s: SparkSession, d: str) -> DataFrame:
    return _note_texts(s, d).select("note_id", F.md5(redaction.redact_simple(F.col("text"))).alias("redacted_md5"))


MAILBOX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def phi_recall(s: SparkSession, d: str) -> DataFrame:
    """Mailboxes and identity numbers of the originals that an earlier redaction removed."""
    rows = table(s, d, "deid_results").where("note_id IS NOT NULL AND original_text IS NOT NULL AND text IS NOT NULL").select("note_id", "original_text", "text").distinct()
    values = F.array(F.struct(F.lit("EMAIL_ADDRESS").alias("type"), F.regexp_extract_all("original_text", F.lit(MAILBOX), F.lit(0)).alias("v")), F.struct(F.lit("US_SSN").alias("type"), F.regexp_extract_all("original_text", F.lit(r"\b\d{3}-\d{2}-\d{4}\b"), F.lit(0)).alias("v")))
    expected = rows.select("note_id", F.explode(values).alias("x")).select("note_id", "x.type", F.explode("x.v").alias("value"))
    return redaction.recall(expected, rows.select("note_id", F.col("text").alias("redacted")))


def lab_pseudo_queries(s: SparkSession, d: str) -> DataFrame:
    first = mining.first_abnormal_labs(table(s, d, "labevents"), table(s, d, "d_labitems"))
    return first.select("hadm_id", "label", "labevent_id", F.explode(mining.lab_queries(F.col("label"), F.col("valuenum"), F.col("low"), F.col("high"))).alias("query"))


def diagnosis_pseudo_queries(s: SparkSession, d: str) -> DataFrame:
    """Queries of the five leading diagnoses; the tables have no titles, so the code stands for its own."""
    seq = F.when(F.coalesce("seq_num", F.lit(0)) == 0, 99).otherwise(F.col("seq_num"))
    dx = table(s, d, "diagnoses_icd").where((seq <= 5) & F.col("icd_code").isNotNull()).select("hadm_id", "icd_code", "icd_version").distinct()
    return dx.select("hadm_id", F.explode(mining.diagnosis_queries(F.col("icd_code"), F.concat(F.lit("Condition "), "icd_code"), F.col("icd_version"))).alias("query"))


def keyword_overlap(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "training_examples").where("query IS NOT NULL AND positive IS NOT NULL")
    return rows.select("example_id", F.round(T.overlap_ratio(F.col("query"), F.col("positive")), 6).alias("overlap")).distinct()


def best_positive(s: SparkSession, d: str) -> DataFrame:
    best = mining.best_chunks(lab_pseudo_queries(s, d).select("query", "hadm_id"), R.all_chunks(s, d).where("hadm_id IS NOT NULL"))
    return best.withColumn("overlap", F.round("overlap", 6))


def _codes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "diagnoses_icd").select("hadm_id", "icd_code")


def hard_negatives(s: SparkSession, d: str) -> DataFrame:
    """Negatives of every example; a chunk's codes are all diagnoses of its admission."""
    chunks = cut(R.all_chunks(s, d).select("chunk_id", "note_id", "chunk_index", "subject_id", "hadm_id"))
    place = chunks.groupBy("note_id").agg(F.max("subject_id").alias("subject_id"), F.max("hadm_id").alias("hadm_id"))
    part = F.split("positive_chunk_id", "_")
    at = chunks.groupBy("note_id", F.col("chunk_index").alias("index")).agg(F.min("chunk_id").alias("positive_id"))
    ex = table(s, d, "training_examples").where("example_id IS NOT NULL").select("example_id", F.try_element_at(part, F.lit(2)).try_cast("bigint").alias("note_id"), F.try_element_at(part, F.lit(3)).try_cast("int").alias("index")).dropDuplicates(["example_id"])
    return mining.hard_negatives(ex.join(place, "note_id", "left").join(at, ["note_id", "index"], "left"), chunks, _codes(s, d))


def mined_examples(s: SparkSession, d: str) -> DataFrame:
    """Examples made from abnormal results (one question each) and leading diagnoses (two questions each)."""
    first = mining.first_abnormal_labs(table(s, d, "labevents"), table(s, d, "d_labitems"))
    by_lab = first.select("hadm_id", F.lit("lab").alias("query_type"), mining.lab_queries(F.col("label"), F.col("valuenum"), F.col("low"), F.col("high"))[0].alias("query"))
    seq = F.when(F.coalesce("seq_num", F.lit(0)) == 0, 99).otherwise(F.col("seq_num"))
    dx = table(s, d, "diagnoses_icd").where((seq <= 5) & F.col("icd_code").isNotNull()).select("hadm_id", "icd_code", "icd_version").distinct()
    by_dx = dx.select("hadm_id", F.lit("diagnosis").alias("query_type"), F.explode(F.slice(mining.diagnosis_queries(F.col("icd_code"), F.concat(F.lit("Condition "), "icd_code"), F.col("icd_version")), 1, 2)).alias("query"))
    made = mining.mined_examples(by_lab.unionByName(by_dx), R.all_chunks(s, d), _codes(s, d))
    return made.select("hadm_id", "query", "query_type", "positive_chunk_id", F.size("negatives").alias("n_negatives"), F.array_join(F.array_distinct("negatives.neg_type"), ",").alias("kinds"))


def false_negatives(s: SparkSession, d: str) -> DataFrame:
    """How many negatives of the given examples the judge finds relevant (2 or 3), by kind; a share above 15 % asks for a review."""
    rows = table(s, d, "training_examples").where("query IS NOT NULL").select("query", F.explode("negatives").alias("n")).where("n.text IS NOT NULL").select("query", F.col("n.text").alias("text"), F.col("n.neg_type").alias("neg_type")).distinct()
    return mining.false_negatives(rows.withColumn("score", judging.parse_answer(_overlap_judge(F.col("query"), F.col("text")))))


def triplets(s: SparkSession, d: str) -> DataFrame:
    return mining.triplets(table(s, d, "training_examples")).select("query", F.md5("positive").alias("positive_md5"), F.md5("negative").alias("negative_md5"), "neg_type")


def labelled_pairs(s: SparkSession, d: str) -> DataFrame:
    return mining.labelled_pairs(table(s, d, "training_examples")).select("query", F.md5("document").alias("document_md5"), "label")


def dataset_stats(s: SparkSession, d: str) -> DataFrame:
    return mining.dataset_stats(table(s, d, "training_examples"))


def _audited(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "training_examples").where("query IS NOT NULL AND positive IS NOT NULL").select("example_id", "query_type", "query", "positive").distinct()
    return rows.select("example_id", "query_type", F.coalesce(judging.parse_answer(_overlap_judge(F.col("query"), F.col("positive"))), F.lit(-1)).alias("score"))


def audit_distribution(s: SparkSession, d: str) -> DataFrame:
    return mining.audit_distribution(_audited(s, d))


def audit_verdict(s: SparkSession, d: str) -> DataFrame:
    return mining.audit_verdict(_audited(s, d))


def audit_breakdown(s: SparkSession, d: str) -> DataFrame:
    return mining.audit_breakdown(_audited(s, d), "query_type")


def answers(s: SparkSession, d: str) -> DataFrame:
    """Questions with their sources and the answer drawn from these: about a patient from the patient's series, others from retrieved notes."""
    asked = cut(_asked(s, d))
    items = labs.route_questions(asked, table(s, d, "d_labitems")).select("question", "itemid").distinct()
    names = table(s, d, "d_labitems").where("itemid IS NOT NULL AND label IS NOT NULL").groupBy("itemid").agg(F.max_by("label", F.struct("loaded_at", "label")).alias("label"))
    series = labs.lab_blocks(labs.lab_series(table(s, d, "labevents"), table(s, d, "d_labitems"))).select("subject_id", "label", "block")
    wanted = asked.join(items, "question").join(names, "itemid").select("key", "subject_id", "label").distinct().join(series, ["subject_id", "label"])
    numbered = wanted.groupBy("key").agg(F.array_sort(F.collect_list("block")).alias("bs"))
    block = numbered.select("key", F.array_join(F.transform("bs", lambda b, i: F.concat(F.lit("[L"), (i + 1).cast("string"), F.lit("] "), b)), "\n").alias("labs"))
    by_labs = asked.join(block, "key", "left").select("key", "question", F.coalesce("labs", F.lit("")).alias("labs"), F.lit("").alias("notes"))
    sources = fusion.source_blocks(R._with_context(s, d)).select("query_id", "block")
    by_notes = R.questions(s, d).join(sources, "query_id", "left").select(F.col("query_id").alias("key"), F.col("query").alias("question"), F.lit("").alias("labs"), F.coalesce("block", F.lit("")).alias("notes"))
    return answering.grounded_answers(by_labs.unionByName(by_notes))


def grounded_answers(s: SparkSession, d: str) -> DataFrame:
    return answers(s, d).select("key", "question", "answer", "grounded", "refused", "has_valid_citation")


def sweep_summary(s: SparkSession, d: str) -> DataFrame:
    return answering.sweep_summary(answers(s, d))


def cited_sources(s: SparkSession, d: str) -> DataFrame:
    """The chunks that the answers cite, by their tags."""
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = R._with_context(s, d).where(F.trim(F.coalesce("context_text", F.lit(""))) != "").withColumn("n", F.row_number().over(w))
    sources = rows.select(F.col("query_id").alias("key"), F.concat(F.lit("S"), F.col("n").cast("string")).alias("tag"), "chunk_id")
    return answering.cited_sources(answers(s, d), sources)


def _sampled(rows: DataFrame, n: int, *key: str) -> DataFrame:
    draw = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key]))
    return rows.orderBy(draw, *key).limit(n)


def audit_sample(s: SparkSession, d: str) -> DataFrame:
    """400 positives and 100 negatives for an audit, drawn by a hash."""
    rows = table(s, d, "training_examples").where("example_id IS NOT NULL").select("example_id", "negatives").distinct()
    yes = _sampled(rows.select("example_id").distinct(), 400, "example_id").select("example_id", F.lit(None).cast("string").alias("chunk_id"), F.lit("positive").alias("kind"))
    no = rows.select("example_id", F.explode("negatives.chunk_id").alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()
    return yes.unionByName(_sampled(no, 100, "example_id", "chunk_id").withColumn("kind", F.lit("negative")))


def audit_negatives(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "training_examples").where("query IS NOT NULL").select("query", F.explode("negatives").alias("n")).where("n.text IS NOT NULL").select("query", F.col("n.text").alias("text"), F.col("n.neg_type").alias("neg_type")).distinct()
    return mining.audit_breakdown(rows.withColumn("score", judging.parse_answer(_overlap_judge(F.col("query"), F.col("text")))), "neg_type")


def chunks_per_source(s: SparkSession, d: str) -> DataFrame:
    texts = table(s, d, "documents").where("text IS NOT NULL")
    return chunking.window_chunks(texts, "doc_id").join(texts.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


def temporal_patients(s: SparkSession, d: str) -> DataFrame:
    """The two patients with the most times, then notes, of those with at least four notes at three times."""
    notes = table(s, d, "deid_results").where("subject_id IS NOT NULL AND note_id IS NOT NULL").groupBy("subject_id").agg(F.countDistinct("note_id").alias("n_notes"), F.countDistinct("charttime").alias("n_times"))
    return notes.where("n_notes >= 4 AND n_times >= 3").orderBy(F.desc("n_times"), F.desc("n_notes"), "subject_id").limit(2)


QUERIES = {f.__name__: f for f in (
    lab_router, lab_series, lab_series_latest, lab_blocks, lab_questions, keyword_judge, ir_metrics, pooled_metrics, config_rollup, head_to_head, temporal_metrics,
    temporal_lift, judge_cached, tolerant_json, median_votes, token_estimates, sentence_split, window_chunks, section_chunks, training_sections, guideline_chunks,
    cleaned_pages, phi_entities, phi_redacted, phi_histogram, phi_simple, phi_recall, lab_pseudo_queries, diagnosis_pseudo_queries, keyword_overlap, best_positive,
    hard_negatives, mined_examples, false_negatives, triplets, labelled_pairs, dataset_stats, audit_distribution, audit_verdict, audit_breakdown, grounded_answers, sweep_summary,
    cited_sources, audit_sample, audit_negatives, chunks_per_source, temporal_patients,
)}

_q = R._quoted
_CONCEPTS = "(VALUES " + ", ".join(f"({_q(c)}, {_q(k)})" for c, ks in labs.CONCEPTS.items() for k in ks) + ") AS t(concept, keyword)"
_ALLQ = "SELECT DISTINCT question FROM (SELECT query AS question FROM eval_passages UNION ALL SELECT query FROM training_examples) WHERE question IS NOT NULL"
_ASKED = """SELECT DISTINCT example_id AS key, query AS question, n.subject_id FROM training_examples e JOIN (SELECT note_id, max(subject_id) AS subject_id FROM deid_results WHERE note_id IS NOT NULL GROUP BY note_id) n
 ON n.note_id = try_cast(split_part(positive_chunk_id, '_', 2) AS BIGINT) WHERE query IS NOT NULL AND n.subject_id IS NOT NULL"""
_ROUTE = f"""kw AS (SELECT DISTINCT keyword, itemid, coalesce(lower(fluid), '') = 'blood' AS blood FROM d_labitems JOIN {_CONCEPTS} ON contains(lower(label), keyword) WHERE itemid IS NOT NULL),
 byk AS (SELECT DISTINCT keyword, itemid FROM (SELECT *, bool_or(blood) OVER (PARTITION BY keyword) AS any_blood FROM kw) WHERE blood OR NOT any_blood),
 routed AS (SELECT DISTINCT question, concept, itemid FROM asked JOIN {_CONCEPTS} ON regexp_matches(lower(question), '(^|[^a-z])' || concept || '([^a-z]|$)') JOIN byk USING (keyword))"""
_LABELS = "labels AS (SELECT itemid, arg_max(label, (loaded_at, label)) AS label FROM d_labitems WHERE itemid IS NOT NULL AND label IS NOT NULL GROUP BY itemid)"
_SERIES = f"""WITH {_LABELS}, r AS (SELECT DISTINCT subject_id, labevent_id, itemid, charttime, valuenum, valueuom, flag FROM labevents WHERE valuenum IS NOT NULL),
 l AS (SELECT r.*, label, coalesce(trim(flag) <> '', false) AS abnormal, row_number() OVER (PARTITION BY subject_id, label ORDER BY charttime NULLS FIRST, labevent_id NULLS FIRST) AS k, row_number() OVER (PARTITION BY subject_id, label ORDER BY charttime DESC NULLS LAST, labevent_id DESC NULLS LAST) AS back FROM r JOIN labels USING (itemid))"""
_CRIT = f"list_filter(list_distinct({R.sql_tokens('query')}), lambda x: NOT list_contains([{R._IGNORED}], x))"
_META = "meta AS (SELECT item_id AS query_id, max(query) AS query, max(category) AS category FROM eval_passages WHERE item_id % 20 = 0 AND query IS NOT NULL GROUP BY item_id)"
_RUNS = R.with_ctes(R._HYBRID, "") + f""", {_META}, long AS (SELECT query_id, chunk_id, text, charttime, hadm_id, 'bm25_only' AS config, lexical_rank AS rank FROM hyb UNION ALL SELECT query_id, chunk_id, text, charttime, hadm_id, 'vector_only', vector_rank FROM hyb
 UNION ALL SELECT query_id, chunk_id, text, charttime, hadm_id, 'rrf_only', rank FROM hyb), runs AS (SELECT config, query_id, category, rank, chunk_id, hits, CAST(hits > 0 AS INTEGER) AS rel, CAST(least(3, hits) AS INTEGER) AS grade, charttime, hadm_id FROM
 (SELECT long.*, category, len(list_filter({_CRIT}, lambda k: contains(lower(text), k))) AS hits FROM long JOIN meta USING (query_id) WHERE rank <= 10))"""
_IR = """, g AS (SELECT config, query_id, sum(rel) FILTER (rank <= 5) AS hits, count(rel) FILTER (rank <= 5) AS n, min(rank) FILTER (rel = 1) AS first, sum(rel / log2(rank + 1)) FILTER (rank <= 5) AS dcg FROM runs GROUP BY config, query_id)"""
_POOLED = """, pool AS (SELECT query_id, chunk_id, max(grade) AS grade FROM runs GROUP BY query_id, chunk_id), ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(place + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS place FROM pool) WHERE place <= 5 GROUP BY query_id),
 relevant AS (SELECT query_id, count(*) FILTER (grade >= 2) AS nr FROM pool GROUP BY query_id), run_lists AS (SELECT config, query_id, sum(CAST(grade >= 2 AS INT)) FILTER (rank <= 5) AS hits, count(*) FILTER (rank <= 5) AS n, min(rank) FILTER (rank <= 5 AND grade >= 2) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 5) AS dcg FROM runs GROUP BY config, query_id),
 pm AS (SELECT config, query_id, coalesce(hits / n, 0.0) AS precision, CASE WHEN nr > 0 THEN least(1.0, coalesce(hits, 0) / nr) ELSE 0.0 END AS recall, coalesce(1.0 / first, 0.0) AS mrr, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM run_lists JOIN relevant USING (query_id) JOIN ideal USING (query_id))"""
_TEMPORAL = R.with_ctes([*R._HYBRID, "aged"], "") + f""", {_META}, based AS (SELECT aged.*, {R._BOOST} AS boosted, CAST(least(3, len(list_filter({_CRIT}, lambda k: contains(lower(text), k)))) AS INTEGER) AS grade FROM aged JOIN meta USING (query_id)),
 modes AS (SELECT 'all' AS config, query_id, rank AS place, grade, charttime, hadm_id FROM based UNION ALL SELECT 'latest', query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(boosted, 9) DESC, rank), grade, charttime, hadm_id FROM based
 UNION ALL SELECT 'trend', query_id, row_number() OVER (PARTITION BY query_id ORDER BY charttime NULLS LAST, rank), grade, charttime, hadm_id FROM based),
 dated AS (SELECT config, query_id, row_number() OVER w AS k, lead(charttime) OVER w AS nxt, grade, charttime, hadm_id FROM modes WHERE place <= 10 AND charttime IS NOT NULL WINDOW w AS (PARTITION BY config, query_id ORDER BY place)),
 newest AS (SELECT config, query_id, k AS newest_rank, hadm_id AS newest_adm FROM (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY charttime DESC, k) AS o FROM dated WHERE grade >= 1) WHERE o = 1),
 tm AS (SELECT d.config, d.query_id, count(*) AS n_dated, max(CAST(newest_rank = 1 AS INTEGER)) AS hit1, max(CAST(newest_rank <= 3 AS INTEGER)) AS hit3, max(newest_rank) AS newest_rank, avg(CAST(charttime <= nxt AS INTEGER)) AS monotonic, count(DISTINCT charttime) AS n_dates,
 CASE WHEN max(newest_adm) IS NOT NULL THEN count(*) FILTER (hadm_id = newest_adm) / count(*) END AS same_admission FROM dated d LEFT JOIN newest n ON n.config = d.config AND n.query_id = d.query_id GROUP BY d.config, d.query_id)"""


def _overlap_sql(text: str) -> str:
    want = "list_filter(list_distinct(regexp_split_to_array(lower(query), '\\s+')), lambda x: x <> '' AND NOT list_contains([" + ", ".join(map(_q, T.OVERLAP_STOPWORDS)) + "], x))"
    return f"CASE WHEN len({want}) > 0 THEN len(list_intersect({want}, list_distinct(regexp_split_to_array(lower({text}), '\\s+')))) / len({want}) ELSE 0.0 END"


_KEY = "sha256(concat_ws(chr(0), 'v1', 'stand-in', query, substr(positive, 1, 4000)))"
_AUDIT = f"a AS (SELECT DISTINCT example_id, query_type, query, positive, CAST(floor(({_overlap_sql('positive')}) * 3.999) AS INTEGER) AS score FROM training_examples WHERE query IS NOT NULL AND positive IS NOT NULL)"
_FIRST_LAB = "lab AS (SELECT itemid, arg_max(label, (loaded_at, label)) AS label FROM d_labitems WHERE itemid IS NOT NULL AND trim(label) <> '' GROUP BY itemid), f AS (SELECT hadm_id, label, labevent_id, valuenum, low, high FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id, label ORDER BY charttime NULLS FIRST, labevent_id NULLS FIRST) AS k FROM (SELECT DISTINCT hadm_id, subject_id, itemid, labevent_id, charttime, valuenum, ref_range_lower AS low, ref_range_upper AS high FROM labevents WHERE hadm_id IS NOT NULL AND lower(trim(flag)) = 'abnormal') JOIN lab USING (itemid)) WHERE k = 1)"
_LAB_QUERIES = "SELECT hadm_id, label, labevent_id, unnest(CASE WHEN valuenum > high THEN ['elevated ' || lower(label) || ' workup and management', 'high ' || lower(label) || ' clinical significance'] WHEN valuenum < low THEN ['low ' || lower(label) || ' evaluation and treatment', 'decreased ' || lower(label) || ' clinical significance'] ELSE [lower(label) || ' abnormal result clinical context'] END) AS query FROM f"
_SIMPLE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(original_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b\d{4}-\d{2}-\d{2}\b', '[DATE]', 'g'), '\b\d{1,2}/\d{1,2}/\d{2,4}\b', '[DATE]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[SSN]', 'g')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_MARKED = lambda p: rf"regexp_replace(text, {_q(p.replace('(?imd)', '(?im)').replace('(?md)', '(?m)'))}, chr(1) || '\1' || chr(2), 'g')"
_SECTIONS = f"""WITH n AS (SELECT DISTINCT note_id, note_type, original_text AS text FROM deid_results WHERE note_id IS NOT NULL AND length(original_text) >= 100),
 p AS (SELECT note_id, text, string_split(CASE note_type WHEN 'discharge' THEN {_MARKED(chunking.TRAINING_PATTERNS['discharge'])} WHEN 'radiology' THEN {_MARKED(chunking.TRAINING_PATTERNS['radiology'])} ELSE {_MARKED(chunking.CAPS_PATTERN)} END, chr(1)) AS s FROM n),
 x AS (SELECT note_id, CASE WHEN len(s) = 1 THEN [{{'section': 'full_note', 'text': text}}] ELSE [{{'section': 'preamble', 'text': {_STRIP.format('s[1]')}}}] || list_transform(s[2:], lambda y: {{'section': {_STRIP.format('split_part(y, chr(2), 1)')}, 'text': {_STRIP.format('split_part(y, chr(2), 2)')}}}) END AS s FROM p),
 f AS (SELECT note_id, list_filter(s, lambda y: length(y.text) >= 100) AS s FROM x), u AS (SELECT note_id, i, s[i + 1] AS c FROM (SELECT note_id, s, unnest(range(len(s))) AS i FROM f))"""
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"

SQL = {
    "lab_router": f"WITH asked AS ({_ALLQ}), {_ROUTE} SELECT * FROM routed",
    "lab_series": _SERIES + " SELECT subject_id, label, count(*) AS n_total, count(*) FILTER (abnormal) AS n_abnormal, count(*) FILTER (k <= 80) AS n_shown, arg_min(nullif(trim(valueuom), ''), k) FILTER (k <= 80 AND trim(valueuom) <> '') AS uom, min(charttime) FILTER (k <= 80) AS first_time, max(charttime) FILTER (k <= 80) AS last_time FROM l GROUP BY subject_id, label",
    "lab_series_latest": _SERIES + " SELECT subject_id, label, count(*) FILTER (back <= 80) AS n_shown, min(charttime) FILTER (back <= 80) AS first_time, max(charttime) FILTER (back <= 80) AS last_time FROM l GROUP BY subject_id, label",
    "lab_questions": f"WITH asked AS ({_ASKED}), {_ROUTE}, c AS (SELECT subject_id, itemid, count(*) AS n FROM (SELECT DISTINCT subject_id, itemid, labevent_id FROM labevents WHERE valuenum IS NOT NULL) GROUP BY subject_id, itemid), p AS (SELECT DISTINCT key, subject_id, concept, itemid FROM asked LEFT JOIN routed USING (question)), v AS (SELECT key, count(itemid) AS n_items, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_values FROM (SELECT DISTINCT key, subject_id, itemid FROM p) LEFT JOIN c USING (subject_id, itemid) GROUP BY key) SELECT key, (SELECT count(DISTINCT concept) FROM p WHERE p.key = v.key) AS n_concepts, n_items, n_values, CASE WHEN n_items = 0 THEN 'not a lab question' WHEN n_values = 0 THEN 'no data' ELSE 'data' END AS status FROM v",
    "keyword_judge": _RUNS + " SELECT config, query_id, rank, chunk_id, rel, grade FROM runs",
    "ir_metrics": _RUNS + _IR + " SELECT config, query_id, round(coalesce(hits / n, 0.0), 6) AS precision, round(least(1.0, coalesce(hits / 3, 0.0)), 6) AS recall, round(coalesce(1.0 / first, 0.0), 6) AS mrr, round(CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, CAST(hits AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END, 6) AS ndcg FROM g",
    "pooled_metrics": _RUNS + _POOLED + " SELECT config, query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM pm",
    "config_rollup": _RUNS + _POOLED + ", cats AS (SELECT query_id, coalesce(category, 'none') AS category FROM meta), j AS (SELECT * FROM pm JOIN cats USING (query_id)) SELECT config, category, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM j GROUP BY config, category UNION ALL SELECT config, 'all', count(*), round(avg(precision), 6), round(avg(recall), 6), round(avg(mrr), 6), round(avg(ndcg), 6) FROM j GROUP BY config",
    "head_to_head": _RUNS + _POOLED + f" SELECT config, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ndcg, 9) DESC, list_position([{', '.join(map(_q, CONFIGS))}], config)) AS k FROM pm) WHERE k = 1 GROUP BY config",
    "temporal_metrics": _TEMPORAL + " SELECT config, query_id, n_dated, hit1, hit3, newest_rank, round(monotonic, 6) AS monotonic, n_dates, round(same_admission, 6) AS same_admission FROM tm",
    "temporal_lift": _TEMPORAL + ", m AS (SELECT config, coalesce(avg(hit1), 0.0) AS hit1, coalesce(avg(hit3), 0.0) AS hit3, coalesce(avg(monotonic), 0.0) AS monotonic FROM tm GROUP BY config), b AS (SELECT hit1 AS b1, hit3 AS b3, monotonic AS bm FROM m WHERE config = 'all') SELECT config, round(hit1, 6) AS hit1, round(hit3, 6) AS hit3, round(monotonic, 6) AS monotonic, round(hit1 - coalesce(b1, 0), 6) AS lift_hit1, round(hit3 - coalesce(b3, 0), 6) AS lift_hit3, round(monotonic - coalesce(bm, 0), 6) AS lift_monotonic FROM m LEFT JOIN b ON true",
    "judge_cached": f"SELECT key, CASE WHEN substr(key, 1, 1) < '4' THEN 2 ELSE score END AS score, substr(key, 1, 1) < '4' AS cached FROM (SELECT {_KEY} AS key, max(CAST(floor(({_overlap_sql('positive')}) * 3.999) AS INTEGER)) AS score FROM training_examples WHERE query IS NOT NULL AND positive IS NOT NULL GROUP BY 1)",
    "tolerant_json": f"SELECT example_id, CAST(floor(({_overlap_sql('positive')}) * 3.999) AS INTEGER) AS score FROM (SELECT DISTINCT example_id, query, positive FROM training_examples WHERE query IS NOT NULL AND positive IS NOT NULL)",
    "median_votes": f"SELECT example_id, v[len(v) // 2 + 1] AS vote FROM (SELECT example_id, list_sort(list_filter([CAST(floor(o * 3.999) AS INTEGER), CAST(floor(o * 3 + 0.5) AS INTEGER), CASE WHEN o >= 1 THEN 3 END], lambda x: x IS NOT NULL)) AS v FROM (SELECT DISTINCT example_id, round({_overlap_sql('positive')}, 9) AS o FROM training_examples WHERE query IS NOT NULL AND positive IS NOT NULL))",
    "token_estimates": r"SELECT doc_id, CAST(floor(coalesce(length(regexp_extract_all(text, '\S+')), 0) * 1.3) AS BIGINT) AS tokens FROM documents",
    "sentence_split": r"SELECT doc_id, pos - 1 AS pos, md5(s[pos]) AS sentence_md5 FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents WHERE text IS NOT NULL))",
    "window_chunks": f"SELECT doc_id, i AS chunk_index, md5(array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ')) AS text_md5 FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 80 + 1)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0)",
    "training_sections": _SECTIONS + r" SELECT note_id, i AS chunk_index, c.section AS section, c.text AS text, CAST(floor(length(regexp_extract_all(c.text, '\S+')) * 1.3) AS BIGINT) AS token_count FROM u",
    "cleaned_pages": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^S\d+\s+Diabetes Care.*$', '', 'g'), '(?m)^©\s*\d{4}.*$', '', 'g'), '(?m)^\d+\s*$', '', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents WHERE note_type = 'guideline' AND text IS NOT NULL",
    "phi_simple": f"SELECT note_id, md5({_SIMPLE}) AS redacted_md5 FROM (SELECT DISTINCT note_id, note_type, original_text FROM deid_results WHERE note_id IS NOT NULL)",
    "phi_recall": rf"WITH r AS (SELECT DISTINCT note_id, original_text, text FROM deid_results WHERE note_id IS NOT NULL AND original_text IS NOT NULL AND text IS NOT NULL), e AS (SELECT 'EMAIL_ADDRESS' AS type, text, unnest(regexp_extract_all(original_text, '{MAILBOX}')) AS v FROM r UNION ALL SELECT 'US_SSN', text, unnest(regexp_extract_all(original_text, '\b\d{{3}}-\d{{2}}-\d{{4}}\b')) FROM r) SELECT type, count(*) AS n, count(*) FILTER (NOT contains(text, v)) AS n_caught, round(count(*) FILTER (NOT contains(text, v)) / count(*), 6) AS recall FROM e GROUP BY type",
    "lab_pseudo_queries": f"WITH {_FIRST_LAB} {_LAB_QUERIES}",
    "diagnosis_pseudo_queries": "SELECT hadm_id, unnest(['condition ' || lower(icd_code) || ' clinical course and management', 'what treatment was given for condition ' || lower(icd_code), 'condition ' || lower(icd_code) || ' assessment and plan', CASE WHEN icd_version = 10 THEN 'ICD-10 ' ELSE 'ICD-9 ' END || icd_code || ' condition ' || lower(icd_code)]) AS query FROM (SELECT DISTINCT hadm_id, icd_code, icd_version FROM diagnoses_icd WHERE CASE WHEN coalesce(seq_num, 0) = 0 THEN 99 ELSE seq_num END <= 5 AND icd_code IS NOT NULL)",
    "keyword_overlap": f"SELECT DISTINCT example_id, round({_overlap_sql('positive')}, 6) AS overlap FROM training_examples WHERE query IS NOT NULL AND positive IS NOT NULL",
    "best_positive": R.with_ctes(["chunks"], "") + f", {_FIRST_LAB}, lq AS ({_LAB_QUERIES}), p AS (SELECT DISTINCT query, l.hadm_id, c.chunk_id, c.text FROM lq l JOIN chunks c ON c.hadm_id = l.hadm_id WHERE length(c.text) >= 100), sc AS (SELECT query, hadm_id, chunk_id, {_overlap_sql('text')} AS o FROM p) SELECT query, hadm_id, chunk_id, round(o, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY query, hadm_id ORDER BY round(o, 9) DESC, chunk_id) AS k FROM sc WHERE o >= 0.2) WHERE k = 1",
    "triplets": "SELECT query, md5(positive) AS positive_md5, md5(n.text) AS negative_md5, n.neg_type AS neg_type FROM (SELECT query, positive, unnest(negatives) AS n FROM training_examples)",
    "labelled_pairs": "SELECT query, md5(positive) AS document_md5, 1 AS label FROM training_examples UNION ALL SELECT query, md5(n.text), 0 FROM (SELECT query, unnest(negatives) AS n FROM training_examples)",
    "dataset_stats": "WITH x AS (SELECT 'query_type' AS kind, query_type AS value FROM training_examples UNION ALL SELECT 'neg_type', n.neg_type FROM (SELECT unnest(negatives) AS n FROM training_examples)) SELECT kind, value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY kind), 4) AS pct FROM x GROUP BY kind, value",
    "false_negatives": f"WITH f AS (SELECT DISTINCT query, n.text AS positive, n.neg_type AS neg_type FROM (SELECT query, unnest(negatives) AS n FROM training_examples WHERE query IS NOT NULL) WHERE n.text IS NOT NULL), g AS (SELECT neg_type, CAST(floor(({_overlap_sql('positive')}) * 3.999) AS INTEGER) AS score FROM f) SELECT neg_type, count(*) AS n, count(*) FILTER (score >= 2) AS n_relevant, round(count(*) FILTER (score >= 2) / count(*), 6) AS share, CASE WHEN count(*) FILTER (score >= 2) / count(*) > 0.15 THEN 'review negatives' END AS advice FROM g GROUP BY neg_type",
    "audit_negatives": f"WITH f AS (SELECT DISTINCT query, n.text AS positive, n.neg_type AS neg_type FROM (SELECT query, unnest(negatives) AS n FROM training_examples WHERE query IS NOT NULL) WHERE n.text IS NOT NULL), g AS (SELECT neg_type, CAST(floor(({_overlap_sql('positive')}) * 3.999) AS INTEGER) AS score FROM f) SELECT neg_type, count(*) AS n, round(avg(score), 6) AS mean, round(100.0 * avg(CAST(score >= 2 AS INT)), 4) AS good_pct, CASE WHEN neg_type IN ('lab', 'medication') AND round(avg(score), 6) < 1.5 THEN 'review templates' END AS advice FROM g GROUP BY neg_type",
    "audit_sample": "WITH n AS (SELECT DISTINCT example_id, c.chunk_id AS chunk_id FROM (SELECT example_id, unnest(negatives) AS c FROM training_examples WHERE example_id IS NOT NULL) WHERE c.chunk_id IS NOT NULL) SELECT * FROM (SELECT example_id, CAST(NULL AS VARCHAR) AS chunk_id, 'positive' AS kind FROM (SELECT DISTINCT example_id FROM training_examples WHERE example_id IS NOT NULL) ORDER BY md5(CAST(example_id AS VARCHAR)), example_id LIMIT 400) UNION ALL SELECT * FROM (SELECT example_id, chunk_id, 'negative' AS kind FROM n ORDER BY md5(CAST(example_id AS VARCHAR) || ':' || chunk_id), example_id, chunk_id LIMIT 100)",
    "chunks_per_source": f"SELECT source, CAST(sum((len(w) - 1) // 80 + 1) AS BIGINT) AS n FROM (SELECT source, {_WORDS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0 GROUP BY source",
    "temporal_patients": "SELECT subject_id, count(DISTINCT note_id) AS n_notes, count(DISTINCT charttime) AS n_times FROM deid_results WHERE subject_id IS NOT NULL AND note_id IS NOT NULL GROUP BY subject_id HAVING n_notes >= 4 AND n_times >= 3 ORDER BY n_times DESC, n_notes DESC, subject_id LIMIT 2",
    "audit_distribution": f"WITH {_AUDIT}, c AS (SELECT score, count(*) AS n FROM a GROUP BY score) SELECT CAST(s.score AS INTEGER) AS score, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM a), 4) AS pct FROM range(4) AS s(score) LEFT JOIN c ON c.score = s.score",
    "audit_verdict": f"WITH {_AUDIT}, o AS (SELECT count(*) AS n, round(avg(score), 6) AS mean, round(100.0 * count(*) FILTER (score >= 2) / count(*), 4) AS good_pct, count(*) FILTER (score < 0) AS errors FROM a) SELECT *, CASE WHEN good_pct >= 80 THEN 'GOOD' WHEN good_pct >= 60 THEN 'MODERATE' ELSE 'LOW' END AS verdict FROM o",
    "audit_breakdown": f"WITH {_AUDIT} SELECT query_type, count(*) AS n, round(avg(score), 6) AS mean, round(100.0 * avg(CAST(score >= 2 AS INT)), 4) AS good_pct, CASE WHEN query_type IN ('lab', 'medication') AND round(avg(score), 6) < 1.5 THEN 'review templates' END AS advice FROM a GROUP BY query_type",
}
