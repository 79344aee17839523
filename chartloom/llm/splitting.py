"""Oversized chunks cut into pieces at natural boundaries.

Recursive bisection: a text over the limit is cut at the strongest boundary near its middle, and so are the halves
that still exceed the limit less the overlap; then each piece gets the end of the piece before it. Boundaries, from
strong to weak: a section header, a paragraph, a sentence, a line, a clause, a blank.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = re.compile(r"\S+")
#: What RUN takes as blanks, for Java.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
HEADER = re.compile(r"^[ \t]*(?:[A-Z][A-Z0-9 /&()'-]{2,60}:?[ \t]*$|[A-Z][A-Z0-9 /&()'-]{2,60}:(?=\s)|#{1,6}[ \t]+\S.*$|(?:[A-Z][\w/&'-]*[ \t]?){1,6}:[ \t]*$)", re.M)
PIECE = "piece_index int, n_pieces int, section string, text string, token_count int, start_pos int, core_start int, end_pos int"


def estimate(words: int) -> int:
    """Estimated tokens of so many runs of non-blank characters: the integer part of 1.3 times their number."""
    return words * 13 // 10


def most_words(tokens: int) -> int:
    """The largest number of words whose estimate is at most ``tokens``."""
    return ((tokens + 1) * 10 - 1) // 13


def _strengths(text: str, starts: np.ndarray, ends: np.ndarray, headers: list[int]) -> np.ndarray:
    """Strength of the boundary before each word: 5 header, 4 paragraph, 3 sentence, 2 line, 1 clause, 0 blank."""
    out = np.zeros(len(starts), np.int8)
    heads = set(headers)
    for i in range(1, len(starts)):
        gap, before = text[ends[i - 1] : starts[i]], text[ends[i - 1] - 1]
        lines = gap.count("\n")
        tail = before if before not in "\"')]»”’" or ends[i - 1] < 2 else text[ends[i - 1] - 2]
        if starts[i] in heads:
            out[i] = 5
        elif lines > 1:
            out[i] = 4
        elif tail in ".!?…。":
            out[i] = 3
        elif lines:
            out[i] = 2
        elif tail in ";,:":
            out[i] = 1
    return out


def split_text(text: str, section: str | None, limit: int = 384, overlap: int = 64) -> list[tuple[str | None, int, int, int, int]]:
    """(section, start, core start, end, tokens) of each piece, or nothing for a text within ``limit``.

    Cores follow one another and hold every word; a piece is its core and before it the last words of the piece
    before, at most ``overlap`` tokens of them, from a sentence's start where one is among them.
    """
    spans = [m.span() for m in RUN.finditer(text)]
    if estimate(len(spans)) <= limit:
        return []
    starts, ends = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    marks = [(m.start() + len(m.group()) - len(m.group().lstrip()), m.group().strip().rstrip(":").lstrip("# ").strip()) for m in HEADER.finditer(text)]
    strength = _strengths(text, starts, ends, [at for at, _ in marks])
    back = most_words(overlap)
    # The sum of both estimates may be one below that of both together.
    room = min(most_words(limit - overlap), most_words(limit) - back)
    levels = [np.flatnonzero(strength >= k) for k in range(5, 0, -1)]
    cuts: list[int] = []
    todo = [(0, len(spans))]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            cuts.append(a)
            continue
        middle, reach = (a + b) / 2, max(1.0, (b - a) / 4)
        at = None
        for places in levels:
            i, j = bisect_left(places, max(a + 1, middle - reach)), bisect_right(places, min(b - 1, middle + reach))
            if i < j:
                near = places[i:j]
                at = int(near[np.argmin(np.abs(near - middle))])
                break
        at = at or round(middle)
        todo += [(at, b), (a, at)]
    pieces = []
    head_at = [h for h, _ in marks]
    for k, a in enumerate(cuts):
        b = cuts[k + 1] if k + 1 < len(cuts) else len(spans)
        first = a
        if k and overlap:
            first = max(a - back, cuts[k - 1])
            inner = [i for i in range(first, a) if strength[i] >= 3]
            first = inner[0] if inner else first
        here = bisect_right(head_at, starts[a]) - 1
        name = marks[here][1] if here >= 0 else section
        pieces.append((name, int(starts[first]), int(starts[a]), int(ends[b - 1]), estimate(b - first)))
    return pieces


def _run(limit: int, overlap: int):
    kind = pa.list_(pa.struct([("section", pa.string()), ("text", pa.string()), ("token_count", pa.int32()), ("start_pos", pa.int32()), ("core_start", pa.int32()), ("end_pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, sections = batch.column(names.index("text")).to_pylist(), batch.column(names.index("section")).to_pylist()
            pieces = [
                [] if t is None else [{"section": n, "text": t[s:e], "token_count": k, "start_pos": s, "core_start": c, "end_pos": e} for n, s, c, e, k in split_text(t, x, limit, overlap)]
                for t, x in zip(texts, sections)
            ]
            keep = [i for i, p in enumerate(pieces) if p]
            rest = batch.take(pa.array(keep, pa.int32())).drop_columns(["text", "section"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([pieces[i] for i in keep], kind)], [*rest.schema.names, "pieces"])

    return run


def split_oversized(chunks: DataFrame, key: str = "chunk_id", limit: int = 384, overlap: int = 64) -> DataFrame:
    """(key, piece_index, n_pieces, section, text, token_count, start_pos, core_start, end_pos) of the chunks over ``limit``.

    Chunks are taken as distinct by key, section and text; token_count of the input isn't looked at. A piece's
    section is the inner header in force where its core starts, otherwise the chunk's, otherwise FULL_NOTE. Null,
    empty and blank texts and those within the limit give no pieces. A single run of characters is never cut.
    """
    # Counted in the JVM, a blank at either end as one run more, so that only what may be over the limit is shuffled and sent to Python.
    may = F.size(F.split("text", BLANKS)) > most_words(limit)
    rows = chunks.where(may).select(key, F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit("FULL_NOTE")).alias("section"), "text").distinct()
    kind = "array<struct<section:string,text:string,token_count:int,start_pos:int,core_start:int,end_pos:int>>"
    found = rows.mapInArrow(_run(limit, overlap), f"`{key}` {rows.schema[key].dataType.simpleString()}, pieces {kind}")
    out = found.select(key, F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece_index", "p"))
    return out.select(key, "piece_index", "n_pieces", "p.*")


def piece_invariants(pieces: DataFrame, key: str = "chunk_id", limit: int = 384, overlap: int = 64) -> DataFrame:
    """(key, core_words, within_limit, overlap_within, counts_right, in_order): what must hold of the pieces of each chunk."""
    words = lambda c: F.size(F.filter(F.split(c, BLANKS), lambda w: w != ""))
    tokens = lambda n: F.floor(n * 13 / 10)
    core = F.col("core_start") - F.col("start_pos")
    each = pieces.select(key, "piece_index", "token_count", "start_pos", "end_pos", "core_start", words(F.col("text")).alias("n"), words(F.substring("text", core + 1, F.length("text"))).alias("core"), words(F.substring("text", F.lit(1), core)).alias("back"))
    return each.groupBy(key).agg(
        F.sum("core").alias("core_words"), F.bool_and(F.col("token_count") <= limit).alias("within_limit"), F.bool_and(tokens(F.col("back")) <= overlap).alias("overlap_within"),
        F.bool_and(F.col("token_count") == tokens(F.col("n"))).alias("counts_right"), F.bool_and((F.col("start_pos") <= F.col("core_start")) & (F.col("core_start") < F.col("end_pos"))).alias("in_order"),
    )
