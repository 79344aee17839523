"""Mining and auditing of training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.coerce import abnormal_trimmed
from chartloom.functions.text import overlap_ratio
from chartloom.operators.cohort import first_rows
from chartloom.sources.tables import broadcast_if_small, cut

MIN_CHUNK = 100
#: More keys than this are joined to their sizes without a broadcast.
MAX_KEYS = 500_000


def first_abnormal_labs(labevents: DataFrame, items: DataFrame) -> DataFrame:
    """(hadm_id, label, labevent_id, valuenum, low, high): the first abnormal result of each admission and label."""
    labels = items.where("itemid IS NOT NULL AND trim(label) <> ''").groupBy("itemid").agg(F.max_by("label", F.struct("loaded_at", "label")).alias("label"))
    rows = labevents.where(F.col("hadm_id").isNotNull() & abnormal_trimmed(F.col("flag"))).select("hadm_id", "subject_id", "itemid", "labevent_id", "charttime", "valuenum", F.col("ref_range_lower").alias("low"), F.col("ref_range_upper").alias("high")).distinct().join(labels, "itemid")
    return first_rows(rows, ["hadm_id", "label"], [F.col("charttime"), F.col("labevent_id")], 1).drop("place")


# Fixed values in these functions: the wordings of the questions.
def lab_queries(label: Column, value: Column, low: Column, high: Column) -> Column:
    """Questions about an abnormal result, by the side of the range that it lies on."""
    name = F.lower(label)
    above = F.array(F.concat(F.lit("elevated "), name, F.lit(" workup and management")), F.concat(F.lit("high "), name, F.lit(" clinical significance")))
    below = F.array(F.concat(F.lit("low "), name, F.lit(" evaluation and treatment")), F.concat(F.lit("decreased "), name, F.lit(" clinical significance")))
    return F.when(value > high, above).when(value < low, below).otherwise(F.array(F.concat(name, F.lit(" abnormal result clinical context"))))


def diagnosis_queries(code: Column, title: Column, version: Column) -> Column:
    """Questions about a diagnosis."""
    name = F.lower(title)
    coded = F.concat(F.when(version == 10, "ICD-10 ").otherwise("ICD-9 "), code, F.lit(" "), name)
    return F.array(F.concat(name, F.lit(" clinical course and management")), F.concat(F.lit("what treatment was given for "), name), F.concat(name, F.lit(" assessment and plan")), coded)


def procedure_queries(title: Column) -> Column:
    name = F.lower(title)
    return F.array(F.concat(name, F.lit(" procedure details and indication")), F.concat(F.lit("why was "), name, F.lit(" performed")), F.concat(name, F.lit(" post-procedure outcome")))


def medication_queries(drug: Column, route: Column) -> Column:
    name = F.lower(drug)
    base = F.array(F.concat(F.lit("why was "), name, F.lit(" prescribed")), F.concat(name, F.lit(" indication and treatment rationale")))
    return F.when(F.coalesce(route, F.lit("")) != "", F.concat(base, F.array(F.concat(name, F.lit(" "), F.lower(route), F.lit(" clinical context"))))).otherwise(base)


def best_chunks(queries: DataFrame, chunks: DataFrame, least: float = 0.2) -> DataFrame:
    """(query, hadm_id, chunk_id, overlap): of the admission's chunks, the one that shares most words with the query.

    Chunks under 100 characters don't count; ties go to the smaller chunk_id. Chunks of an admission number few.
    """
    pairs = queries.select("query", "hadm_id").distinct().join(chunks.where(F.length("text") >= MIN_CHUNK).select("hadm_id", "chunk_id", "text"), "hadm_id")
    scored = pairs.withColumn("overlap", overlap_ratio(F.col("query"), F.col("text"))).where(F.col("overlap") >= least)
    best = F.max_by(F.struct("chunk_id", "overlap"), F.struct(F.round("overlap", 9), -F.col("chunk_id"))).alias("b")
    return scored.groupBy("query", "hadm_id").agg(best).select("query", "hadm_id", "b.chunk_id", "b.overlap")


def _draw(*columns: str) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]))


def _pool_by_admission(chunks: DataFrame, key: str, n: int) -> DataFrame:
    """Of each key's chunks ``n``, taken from its admissions in turn: whatever admission is left out, half of the pool or all other chunks are there."""
    draw = [_draw("chunk_id"), F.col("chunk_id")]
    turns = first_rows(chunks, [key, "c_hadm"], draw, n).withColumnRenamed("place", "turn")
    return first_rows(turns, [key], [F.col("turn"), *draw], n).drop("place", "turn")


def _candidates(examples: DataFrame, chunks: DataFrame, key: str, pool: int, tier: int) -> DataFrame:
    """(example_id, chunk_id, tier): chunks of the example's key and other admissions.

    A key's chunks are spread over buckets of about ``pool`` each, and an example looks into one of them, so every chunk can
    be drawn and a frequent key costs no more than a rare one. Where the bucket holds none of another admission, the pool
    of the key's admissions in turn has one if there is any.
    """
    rows = chunks.where(F.col(key).isNotNull()).select(key, "chunk_id", F.col("hadm_id").alias("c_hadm")).distinct()
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / pool).alias("buckets"))
    asked = examples.where(F.col(key).isNotNull()).select("example_id", "hadm_id", "positive_id", key).distinct().join(sizes, key)
    bucket = lambda c: F.pmod(F.xxhash64(c, F.lit(tier)), F.col("buckets"))
    by_bucket = asked.withColumn("bucket", bucket("example_id")).join(rows.join(broadcast_if_small(sizes, MAX_KEYS), key).withColumn("bucket", bucket("chunk_id")).drop("buckets"), [key, "bucket"])
    by_turn = asked.join(_pool_by_admission(rows, key, pool), key)
    columns = ["example_id", "chunk_id", "hadm_id", "c_hadm", "positive_id"]
    other = (F.col("c_hadm") != F.col("hadm_id")) | F.col("hadm_id").isNull()
    both = by_bucket.select(*columns).unionByName(by_turn.select(*columns))
    return both.where(other & ~F.col("chunk_id").eqNullSafe(F.col("positive_id"))).select("example_id", "chunk_id", F.lit(tier).alias("tier"))


def hard_negatives(examples: DataFrame, chunks: DataFrame, codes: DataFrame, n: int = 5, pool: int = 20) -> DataFrame:
    """(example_id, chunk_id, neg_type, place): up to ``n`` negatives of each example.

    ``examples`` has example_id, subject_id, hadm_id and positive_id (its own chunk, left out), ``chunks`` has chunk_id, subject_id
    and hadm_id, ``codes`` has hadm_id and icd_code, as many as an admission has. One chunk of the same patient's other admissions comes
    first, then chunks of other admissions that share a code up to three in all, then any chunks, all drawn by hashes. Few
    candidates give few negatives. Null fields are no keys.
    """
    by_code = codes.where("hadm_id IS NOT NULL AND icd_code IS NOT NULL").select("hadm_id", "icd_code").distinct()
    own = chunks.select("chunk_id", "subject_id", "hadm_id").where("chunk_id IS NOT NULL")
    asks = examples.select("example_id", "subject_id", "hadm_id", "positive_id")
    one = _candidates(asks, own, "subject_id", pool, 1)
    two = _candidates(asks.join(by_code, "hadm_id"), own.join(by_code, "hadm_id"), "icd_code", pool, 2)
    everywhere = lambda df: df.withColumn("everywhere", F.lit(0))
    three = _candidates(everywhere(asks), everywhere(own), "everywhere", pool, 3)
    once = one.unionByName(two).unionByName(three).groupBy("example_id", "chunk_id").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("example_id", "tier").orderBy(_draw("example_id", "chunk_id"), "chunk_id")
    ordered = once.withColumn("k", F.row_number().over(w)).where("tier = 3 AND k <= %d OR tier = 1 AND k <= 1 OR tier = 2 AND k <= 3" % n)
    place = Window.partitionBy("example_id").orderBy("tier", "k")
    ranked = ordered.withColumn("place", F.row_number().over(place))
    # Tiers one and two together give three at most.
    kept = ranked.where("(tier < 3 AND place <= 3) OR tier = 3").withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)
    kind = F.element_at(F.array(F.lit("same_patient"), F.lit("same_code"), F.lit("random")), F.col("tier"))
    return kept.select("example_id", "chunk_id", kind.alias("neg_type"), F.col("place").cast("long").alias("place"))


def mined_examples(queries: DataFrame, chunks: DataFrame, codes: DataFrame, least_negatives: int = 2) -> DataFrame:
    """(example_id, query, query_type, hadm_id, positive, positive_chunk_id, negatives, metadata): training examples from records.

    ``queries`` has hadm_id, query_type and query, ``chunks`` chunk_id, subject_id, hadm_id and text. The positive is the
    admission's best chunk, the negatives those of ``hard_negatives``; an example with fewer than ``least_negatives`` is left out.
    """
    asked = queries.where("hadm_id IS NOT NULL AND query IS NOT NULL").groupBy("hadm_id", "query").agg(F.min("query_type").alias("query_type"))
    best = cut(best_chunks(asked, chunks.where("hadm_id IS NOT NULL")).join(asked, ["query", "hadm_id"]).withColumn("example_id", F.xxhash64("query", "hadm_id")))
    place = chunks.select("chunk_id", "subject_id").where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])
    examples = best.join(place, "chunk_id", "left").select("example_id", "subject_id", "hadm_id", F.col("chunk_id").alias("positive_id"))
    texts = chunks.select("chunk_id", "text").where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])
    one = F.struct("place", "text", F.col("chunk_id").cast("string").alias("chunk_id"), "neg_type")
    found = hard_negatives(examples, chunks, codes).join(texts, "chunk_id").groupBy("example_id").agg(F.array_sort(F.collect_list(one)).alias("ns")).where(F.size("ns") >= least_negatives)
    negatives = F.transform("ns", lambda x: F.struct(x["text"].alias("text"), x["chunk_id"].alias("chunk_id"), x["neg_type"].alias("neg_type")))
    rows = best.join(found, "example_id").join(texts.withColumnRenamed("text", "positive"), "chunk_id")
    metadata = F.create_map(F.lit("hadm_id"), F.col("hadm_id").cast("string"), F.lit("overlap"), F.round("overlap", 4).cast("string"))
    return rows.select("example_id", "query", "query_type", "hadm_id", "positive", F.col("chunk_id").alias("positive_chunk_id"), negatives.alias("negatives"), metadata.alias("metadata"))


def triplets(examples: DataFrame) -> DataFrame:
    """(query, positive, negative, neg_type): one row for each negative."""
    return examples.select("query", "positive", F.explode("negatives").alias("n")).select("query", "positive", F.col("n.text").alias("negative"), "n.neg_type")


def labelled_pairs(examples: DataFrame) -> DataFrame:
    """(query, document, label): the positive with 1, each negative with 0."""
    yes = examples.select("query", F.col("positive").alias("document"), F.lit(1).alias("label"))
    no = triplets(examples).select("query", F.col("negative").alias("document"), F.lit(0).alias("label"))
    return yes.unionByName(no)


def dataset_stats(examples: DataFrame) -> DataFrame:
    """(kind, value, n, pct): examples by query_type, negatives by neg_type."""
    types = examples.select(F.lit("query_type").alias("kind"), F.col("query_type").alias("value"))
    kinds = examples.select(F.explode("negatives").alias("n")).select(F.lit("neg_type").alias("kind"), F.col("n.neg_type").alias("value"))
    counts = types.unionByName(kinds).groupBy("kind", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 4))


def audit_distribution(scored: DataFrame) -> DataFrame:
    """(score, n, pct) for 0 to 3, with the scores that don't occur; scores below 0 are errors and left out."""
    valid = scored.where("score >= 0")
    counts = valid.groupBy("score").agg(F.count("*").alias("n"))
    all_scores = scored.sparkSession.range(4).select(F.col("id").cast("int").alias("score"))
    return all_scores.join(counts, "score", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)), 4))


def audit_verdict(scored: DataFrame) -> DataFrame:
    """(n, mean, good_pct, errors, verdict): GOOD from 80 % of scores 2 or 3, MODERATE from 60 %, otherwise LOW."""
    ok = F.col("score") >= 0
    one = scored.agg(F.count_if(ok).alias("n"), F.round(F.avg(F.when(ok, F.col("score"))), 6).alias("mean"), F.round(100.0 * F.count_if(F.col("score") >= 2) / F.count_if(ok), 4).alias("good_pct"), F.count_if(~ok).alias("errors"))
    return one.withColumn("verdict", F.when(F.col("good_pct") >= 80, "GOOD").when(F.col("good_pct") >= 60, "MODERATE").otherwise("LOW"))


def audit_breakdown(scored: DataFrame, key: str) -> DataFrame:
    """(key, n, mean, good_pct, advice): by type; advice for types of laboratory or medication with a mean below 1.5."""
    out = scored.where("score >= 0").groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(100.0 * F.avg((F.col("score") >= 2).cast("int")), 4).alias("good_pct"))
    return out.withColumn("advice", F.when(F.col(key).isin("lab", "medication") & (F.col("mean") < 1.5), "review templates"))


def false_negatives(scored: DataFrame, most: float = 0.15) -> DataFrame:
    """(neg_type, n, n_relevant, share, advice) of judged negatives; advice where more than ``most`` of them are relevant. Scores below 0 are errors."""
    out = scored.where("score >= 0").groupBy("neg_type").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 2).alias("n_relevant"))
    share = F.col("n_relevant") / F.col("n")
    return out.select("neg_type", "n", "n_relevant", F.round(share, 6).alias("share"), F.when(share > most, "review negatives").alias("advice"))
