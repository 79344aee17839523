"""Texts packed into containers of fixed capacity, measured in tokens of a public tokenizer.

Bounded-space online packing: each partition keeps a fixed number of open windows; an item goes to the open window
that it fits best; where it fits none, the fullest is closed and a new one opened. The windows still open at the end
are packed again, those of several partitions together, until one partition is left.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
import regex as re
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.sources.tables import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ITEMS = "array<struct<doc_id:bigint,piece_index:int,start_token:bigint,n_tokens:int>>"
#: A text is encoded in stretches of about so many characters, cut where the tokenizer's own pattern starts a new word, so the tokens are those of the whole.
STRETCH = 200_000


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level encoding of a vocabulary file of ranks."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_CUT = re.compile(r"(?<=[\p{L}\p{N}])(?= \p{L})")


def count_tokens(text: str, encoding: tiktoken.Encoding) -> int:
    """Tokens of the whole text. Between a letter or digit and a blank before a letter a word always ends, so a long text is cut there."""
    if len(text) <= STRETCH:
        return len(encoding.encode_to_numpy(text, disallowed_special=()))
    n, at = 0, 0
    while at < len(text):
        m = _CUT.search(text, at + STRETCH)
        to = m.start() if m else len(text)
        n += len(encoding.encode_to_numpy(text[at:to], disallowed_special=()))
        at = to
    return n


class Windows:
    """At most ``most`` open windows of ``capacity``."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.order: list[tuple[int, int]] = []  # (room left, number), sorted
        self.items: dict[int, list] = {}
        self.number = 0

    def place(self, size: int, items: list) -> list[list]:
        """Put ``items`` of ``size`` into the window with the least sufficient room; returns the windows that this closes."""
        closed = []
        i = bisect_left(self.order, (size, -1))
        if i < len(self.order):
            room, k = self.order.pop(i)
            self.items[k] += items
        else:
            if len(self.order) >= self.most:
                closed.append(self.items.pop(self.order.pop(0)[1]))
            room, k = self.capacity, self.number
            self.number += 1
            self.items[k] = list(items)
        if room == size:
            closed.append(self.items.pop(k))
        else:
            insort(self.order, (room - size, k))
        return closed


_ROW = [("open", pa.bool_()), ("used", pa.int32()), ("items", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece_index", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int32())])))]


def _batch(rows: list[tuple[bool, list]]) -> pa.RecordBatch:
    keys = ("doc_id", "piece_index", "start_token", "n_tokens")
    return pa.RecordBatch.from_arrays(
        [pa.array([o for o, _ in rows], pa.bool_()), pa.array([sum(i[3] for i in w) for _, w in rows], pa.int32()), pa.array([[dict(zip(keys, i)) for i in w] for _, w in rows], _ROW[2][1])],
        [n for n, _ in _ROW],
    )


def _pack(sizes: Iterator[tuple[int, list]], capacity: int, most: int) -> Iterator[pa.RecordBatch]:
    windows, out = Windows(capacity, most), []
    for size, items in sizes:
        out += [(False, w) for w in windows.place(size, items)]
        if len(out) >= 1000:
            yield _batch(out)
            out = []
    # What is still open goes out fullest first.
    out += [(True, windows.items[k]) for _, k in windows.order]
    if out:
        yield _batch(out)


def _pack_texts(path: str, capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path)

        def sizes() -> Iterator[tuple[int, list]]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    n = count_tokens(text.as_py(), encoding) if text.is_valid else 0
                    for k, at in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - at)
                        yield size, [(doc, k, at, size)]

        yield from _pack(sizes(), capacity, most)

    return run


def _pack_windows(capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sizes() -> Iterator[tuple[int, list]]:
            for batch in batches:
                for used, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield used, [(i["doc_id"], i["piece_index"], i["start_token"], i["n_tokens"]) for i in items]

        yield from _pack(sizes(), capacity, most)

    return run


def pack_texts(texts: DataFrame, capacity: int = 2048, open_windows: int = 64, merge: int = 16, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_id, doc_id, piece_index, start_token, n_tokens): which container holds which text, or part of one.

    Only a text of more than ``capacity`` tokens is split, into parts of exactly ``capacity`` and a rest. Null and
    empty texts have no tokens and go nowhere. Repeated rows are packed each. The open windows of ``merge`` partitions
    go together in each round of merging, so a task has at most ``merge * open_windows`` of them.
    """
    schema = f"open boolean, used int, items {ITEMS}"
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND text <> ''")
    packed = cut(rows.mapInArrow(_pack_texts(tokenizer, capacity, open_windows), schema))
    parts, left, closed = packed.rdd.getNumPartitions(), packed.where("open"), [packed.where("NOT open")]
    while parts > 1:
        parts = -(-parts // merge)
        # Windows meet by a hash of what they hold, the same on every attempt, larger ones first.
        by = F.xxhash64("items")
        gathered = left.withColumn("h", by).repartition(parts, "h").sortWithinPartitions(F.desc("used"), "h").select("used", "items")
        packed = cut(gathered.mapInArrow(_pack_windows(capacity, open_windows), schema))
        left = packed.where("open")
        closed.append(packed.where("NOT open"))
    containers = reduce(DataFrame.unionByName, [*closed, left]).withColumn("container_id", F.monotonically_increasing_id())
    return containers.select("container_id", F.explode("items").alias("i")).select("container_id", "i.*")


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(n_containers, n_texts, n_tokens, fill, least): one row; ``least`` is the number of containers without any unused space."""
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    both = used.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens")).join(packed.agg(F.countDistinct("doc_id").alias("n_texts")))
    return both.select("n_containers", "n_texts", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("fill"), F.ceil(F.col("n_tokens") / capacity).alias("least"))


def packing_invariants(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(doc_id, packed_once, split_only_if_over, within_capacity): what must hold of each text."""
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    each = packed.join(used, "container_id").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("n_tokens").alias("total"), F.max("piece_index").alias("last"), F.countDistinct("piece_index").alias("different"),
        F.bool_and(F.col("start_token") == F.col("piece_index") * capacity).alias("in_line"), F.bool_and(F.col("used") <= capacity).alias("within_capacity"),
    )
    once = (F.col("n") == F.col("different")) & (F.col("last") == F.col("n") - 1) & F.col("in_line")
    return each.select("doc_id", once.alias("packed_once"), (F.col("n") == F.ceil(F.col("total") / capacity)).alias("split_only_if_over"), "within_capacity")
