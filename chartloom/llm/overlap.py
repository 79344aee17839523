"""Training examples of evaluation splits whose positive is also, or almost, in the training split.

Texts that are equal but for case and punctuation form a class, and only its representative is compared. A text's
fingerprint is cut into segments, and each of its words, different for each occurrence, goes into one of them by its hash:
the segment's code is the sum of its words' hashes. A word that only one of two texts has changes one segment, so texts that
agree in a share of the longer one's words lie within a Hamming radius of (1 - share) twice the shorter one's words, in
segments as in the bits of a sketch that each word flips. Two segments more than that radius make sure that two are equal:
texts of the two sides are joined on segments, kept within the radius of the sketches' bits, and verified by the longest
common subsequence of their words. Segments that too many pairs share are joined together with a second one.
Classes are expanded at the end, through an equi-join, or only counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.sources.tables import broadcast_if_small, cut

SKETCH = 256
LANE_NAMES = tuple(f"c{i}" for i in range(SKETCH // 64))
#: Texts are keyed by lengths that grow by this factor: the texts of one length share the number of segments.
STEP = 1.1
#: With more pairs than this on a segment it is joined together with one of the REACH segments after it.
HOT_PAIRS, REACH = 200_000, 32
#: Up to so many segments of both sides are broadcast, so that the others are dropped before a shuffle.
MAX_SHARED = 1_000_000
EVALUATION = {"val": "val", "validation": "val", "valid": "val", "dev": "val", "test": "test"}


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits: one long number holds a whole row of the table."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        match = row & at.get(y, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def agreement(a: list, b: list) -> float:
    """Share of the longer one's words that both have in the same order; 0 where both are empty."""
    longer = max(len(a), len(b))
    return common_length(a, b) / longer if longer else 0.0


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Numbers of a text's words, different for each occurrence of a word: common numbers are common words with their counts."""
    order = np.argsort(hashes, kind="stable")
    run = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    at = np.arange(len(hashes))
    times = np.empty(len(hashes), np.uint64)
    times[order] = at - np.maximum.accumulate(np.where(run, at, 0))
    x = (hashes ^ (times * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sketch(numbers: np.ndarray) -> np.ndarray:
    """SKETCH bits as 64-bit numbers, of which each number flips one."""
    flips = np.bincount((numbers >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH)
    return np.packbits((flips & 1).astype(bool)).view(np.int64)


def length_class(n: int) -> int:
    """The class of texts of ``n`` words: those of up to STEP to its power."""
    k = max(0, math.ceil(math.log(max(n, 1)) / math.log(STEP) - 1e-9))
    return k if n <= longest(k) else k + 1


def longest(k: int) -> int:
    """The most words of a text of class ``k``."""
    return math.floor(STEP**k + 1e-9)


def segments(k: int, least: float) -> int:
    """Two more than the segments in which a text of class ``k`` can differ from one that agrees with it in ``least`` of the words."""
    return math.floor(2 * (1 - least) * longest(k) + 1e-9) + 2


def segment_codes(numbers: np.ndarray, count: int) -> np.ndarray:
    """A code for each of ``count`` segments: odd for one with words, even for one without any."""
    at = ((numbers >> np.uint64(33)) % np.uint64(count)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0])) if len(at) else np.array([], np.int64)
    codes = np.zeros(count, np.uint64)
    if len(first):
        codes[at[order][first]] = np.add.reduceat(numbers[order], first)
    # The segment's place and the number of segments are part of the code, so that only like is joined with like.
    mixed = (codes ^ (np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(count))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(31))) & ~np.uint64(1) | (np.bincount(at, minlength=count) > 0).astype(np.uint64)


def _fingerprints(least: float):
    """Rows of codes: one for each side and length class that a text has to be found in."""
    names = ["class_id", "train", "n", *LANE_NAMES, "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            lengths = np.diff(lists.offsets.to_numpy())
            rows: list[tuple] = []
            for cid, in_train, in_eval, n, end in zip(batch.column("class_id").to_pylist(), batch.column("in_train").to_pylist(), batch.column("in_eval").to_pylist(), lengths.tolist(), np.cumsum(lengths).tolist()):
                numbers = numbered(words[end - n : end])
                bits = sketch(numbers).tolist()
                own = length_class(n)
                # A train text is found in its own class, an evaluation text wherever a train text of a fitting length may be.
                reach = range(length_class(math.ceil(least * n - 1e-9)), length_class(math.floor(n / least + 1e-9)) + 1)
                for train, ks in ((True, [own] if in_train else []), (False, reach if in_eval else [])):
                    rows += [(cid, train, n, *bits, segment_codes(numbers, segments(k, least)).view(np.int64)) for k in ks]
            if rows:
                kinds = [pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * len(LANE_NAMES), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("text_e").to_pylist(), batch.column("text_t").to_pylist())
            found = [agreement(a.split(" "), b.split(" ")) for a, b in texts]
            kept = pa.array([x >= least for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("class_e"), batch.column("class_t"), pa.array(found, pa.float64())], ["class_e", "class_t", "agreement"]).filter(kept)

    return run


def _members(examples: DataFrame) -> DataFrame:
    """(example_id, side, split, source, norm, class_key) of the examples with a split and any word."""
    split = F.lower(F.trim("split_name"))
    named = F.coalesce(*[F.when(split == k, v) for k, v in EVALUATION.items()])
    norm = F.trim(F.regexp_replace(F.lower("positive"), r"[^\p{L}\p{N}]+", " "))
    rows = examples.select(F.col("example_id").cast("long").alias("example_id"), F.when(split == "train", "train").otherwise(named).alias("split"), "source", norm.alias("norm"))
    rows = rows.where("split IS NOT NULL AND norm <> '' AND example_id IS NOT NULL")
    return rows.withColumns({"in_train": F.col("split") == "train", "class_key": F.md5("norm")})


def _shared_segments(codes: DataFrame, hot_pairs: int) -> DataFrame:
    """(train, code, class_id, n, lanes): segments that texts of both sides have, those of too many pairs with a second one."""
    own = ["class_id", "train", "n", *LANE_NAMES]
    row = ["class_id", "train", F.size("codes").alias("count")]
    one = codes.select(*own, F.size("codes").alias("count"), F.posexplode("codes").alias("place", "code")).where("code % 2 <> 0")
    both = one.groupBy("code").agg(F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("e")).where("t > 0 AND e > 0")
    # Only segments that both sides have go on.
    both = cut(both.select("code", (F.col("t") * F.col("e") > hot_pairs).alias("hot")))
    met = one.join(broadcast_if_small(both, MAX_SHARED), "code")
    hot = met.where("hot").select("class_id", "train", "count", "place", "code")
    after = F.slice(F.concat("codes", "codes"), F.col("place") + 2, F.least(F.col("count") - 1, F.lit(REACH)))
    pairs = codes.select(*row, "n", *LANE_NAMES, "codes").join(hot, ["class_id", "train", "count"]).select(*own, F.explode(after).alias("second"), "code")
    pairs = pairs.select(*own, F.xxhash64(F.least("code", "second"), F.greatest("code", "second")).alias("code")).distinct()
    return met.where("NOT hot").select(*own, "code").unionByName(pairs)


def class_pairs(members: DataFrame, least: float = 0.85, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(class_e, class_t, agreement) of different classes, one in an evaluation split and one in train."""
    classes = members.groupBy("class_key").agg(F.first("norm").alias("norm"), F.max("in_train").alias("in_train"), F.max(~F.col("in_train")).alias("in_eval"))
    # Numbered, so that the many rows of segments are short.
    classes = cut(classes.withColumn("class_id", F.monotonically_increasing_id()))
    hashes = F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))
    schema = "class_id bigint, train boolean, n int, " + ", ".join(f"{c} bigint" for c in LANE_NAMES) + ", codes array<bigint>"
    codes = cut(classes.select("class_id", "in_train", "in_eval", hashes.alias("hashes")).mapInArrow(_fingerprints(least), schema))
    keyed = _shared_segments(codes, hot_pairs)
    side = lambda s, keep: keyed.where(keep).select("code", F.col("class_id").alias(f"class_{s}"), F.col("n").alias(f"n_{s}"), *[F.col(c).alias(f"{s}{c}") for c in LANE_NAMES])
    apart = sum((F.bit_count(F.col(f"e{c}").bitwiseXOR(F.col(f"t{c}"))) for c in LANE_NAMES), F.lit(0))
    longer, total = F.greatest("n_e", "n_t"), F.col("n_e") + F.col("n_t")
    may = (F.least("n_e", "n_t") >= longer * F.lit(least) - 1e-6) & (apart <= total - 2 * least * longer + 1e-6)
    near = side("e", ~F.col("train")).join(side("t", F.col("train")), "code").where(may & (F.col("class_e") != F.col("class_t"))).select("class_e", "class_t").distinct()
    text = lambda s: classes.select(F.col("class_id").alias(f"class_{s}"), F.col("norm").alias(f"text_{s}"))
    pairs = near.join(text("e"), "class_e").join(text("t"), "class_t").select("class_e", "class_t", "text_e", "text_t")
    found = pairs.mapInArrow(_verify(least), "class_e bigint, class_t bigint, agreement double")
    key = lambda s: classes.select(F.col("class_id").alias(f"class_{s}"), F.col("class_key").alias(f"key_{s}"))
    return found.join(key("e"), "class_e").join(key("t"), "class_t").select(F.col("key_e").alias("class_e"), F.col("key_t").alias("class_t"), "agreement")


def cross_split_pairs(examples: DataFrame, least: float = 0.85) -> DataFrame:
    """(example_id_a, example_id_b, eval_id, agreement), distinct with a < b: one row of train and one of val or test.

    Split names are read in any letter case; rows with another or no split, a null positive or one without words are
    in no pair. ``source`` and the other columns may be null.
    """
    members = _members(examples).select("example_id", "split", "source", "norm", "in_train", "class_key")
    members = cut(members.distinct())
    e = members.where("NOT in_train").select(F.col("example_id").alias("eval_id"), F.col("class_key").alias("class_e"))
    t = members.where("in_train").select(F.col("example_id").alias("train_id"), F.col("class_key").alias("class_t"))
    near = class_pairs(members, least).join(e, "class_e").join(t, "class_t").select("eval_id", "train_id", "agreement")
    equal = e.join(t, F.col("class_e") == F.col("class_t")).select("eval_id", "train_id", F.lit(1.0).alias("agreement"))
    pairs = equal.unionByName(near).where("eval_id <> train_id")
    return pairs.select(F.least("eval_id", "train_id").alias("example_id_a"), F.greatest("eval_id", "train_id").alias("example_id_b"), "eval_id", "agreement").distinct()


def overlap_report(examples: DataFrame, least: float = 0.85) -> DataFrame:
    """(split, source, n_examples, n_overlapping, n_pairs): how much of each split and source is also in train.

    Pairs are counted class by class and never expanded.
    """
    members = cut(_members(examples).select("example_id", "split", "source", "norm", "in_train", "class_key").distinct())
    rows = members.where("NOT in_train").select(F.col("example_id").alias("eval_id"), "split", "source", F.col("class_key").alias("class_e"))
    ids = members.where("in_train").select("example_id", F.col("class_key").alias("class_t")).distinct()
    e = members.where("NOT in_train").select(F.col("class_key").alias("class_e")).distinct()
    matched = class_pairs(members, least).select("class_e", "class_t").unionByName(e.join(ids.select("class_t").distinct(), F.col("class_e") == F.col("class_t")))
    matched = cut(matched)
    size = matched.join(ids.groupBy("class_t").count(), "class_t").groupBy("class_e").agg(F.sum("count").alias("n"))
    # An id that is in both splits makes no pair with itself.
    itself = rows.join(ids, F.col("eval_id") == F.col("example_id")).join(matched, ["class_e", "class_t"]).groupBy("eval_id", "class_e").agg(F.countDistinct("class_t").alias("self"))
    each = rows.join(size, "class_e", "left").join(itself, ["eval_id", "class_e"], "left").withColumn("n", F.coalesce("n", F.lit(0)) - F.coalesce("self", F.lit(0)))
    per_row = each.groupBy("eval_id", "split", "source").agg(F.sum("n").alias("n"))
    return per_row.groupBy("split", "source").agg(F.count("*").alias("n_examples"), F.count_if(F.col("n") > 0).alias("n_overlapping"), F.sum("n").alias("n_pairs"))
