"""Pages made of keywords, links or product tags instead of sentences.

The sentences of a text are set apart from the rest: runs of words that end with a sentence's sign, unless a text begins
most of its short ones alike. Both parts are cut into blocks, and each block is compressed twice: as it is, with digits made
alike, and as a skeleton, in which longer words, numbers and addresses each become one sign, so that the repeated form of a
list shows whatever its words are. Either size is held against the median of the sentence blocks of its language and length
over the whole corpus. A block outside the sentences that is far more redundant than that is spam, unless it is a record:
plain numbers and quantities, as medication, result and monitoring lists have them, without prices and addresses. A text
is spam if such blocks are its greater part, so the density of sentences decides along with the redundancy.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.sources.tables import broadcast_if_small, cut

# Frequent words that tell a language. A text in another language is held against prose of all of them.
STOPWORDS = {
    "en": "the of and to with was in for on is by after from",
    "de": "der die das und mit wurde bei nicht von im zu des sich",
    "fr": "le la les des et est une dans par du pour sous chez",
    "es": "el los las del con una por para se en es al su",
}

BLOCK = 1000
#: A block shorter than this has too little in it to repeat.
SHORTEST = 160
SCHEMA = "doc_id bigint, prose boolean, lang string, bucket int, n_chars int, ratio double, skeleton double, record double, address double, price double"

_END = re.compile(r"""[.!?…]+["')\]»”]*(?=\s|$)|\n""")
_ADDRESS = re.compile(r"(?:[^\W\d_][\w+.-]*:)?//\S+|(?<![\w@])[^\W_-][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}(?:/\S*)?|#[^\W\d_]\w*")
_PRICE = re.compile(r"[$€£¥]\s?\d[\d.,]*|\b\d[\d.,]*\s?[$€£¥]")
_ITEM = re.compile(r"(?m)^\s*\d{1,3}[.)]\s")
_NUMBER = re.compile(r"(?<![\w.#-])\d+(?:[.,:/;-]\d+)*(?:%|(?=[\s,;.)]|$)|(?=[^\W\d_]{1,5}\b))")
_LONG, _NUMBERS, _HOST = re.compile(rb"[a-z\x80-\xff]{4,}"), re.compile(rb"0[0.,:/]*"), re.compile(rb"\.[a-z]|//")
#: Digits made alike, blanks made alike and ASCII letters in lower case.
_FLAT = bytes(48 if 48 <= c <= 57 else 32 if c in b"\t\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_TELLS: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        _TELLS[_w] = (*_TELLS.get(_w, ()), _lang)


def _language(words: list[str]) -> str:
    scores = Counter(lang for w in words if w in _TELLS for lang in _TELLS[w])
    if not scores:
        return "none"
    best = max(STOPWORDS, key=lambda k: scores[k])
    return best if scores[best] * 25 >= len(words) else "none"


def blocks_of(text: str, size: int = BLOCK) -> list[str]:
    """Blocks of whole lines of at least ``size`` characters, the last one of any length; longer lines are cut at blanks."""
    out, start = [], 0
    while start < len(text):
        if len(text) - start <= size * 3 // 2:
            out.append(text[start:])
            break
        end = text.find("\n", start + size, start + size * 3 // 2)
        if end < 0:
            end = text.find(" ", start + size, start + size * 3 // 2)
        end = start + size * 3 // 2 if end < 0 else end + 1
        out.append(text[start:end])
        start = end
    return out


def _units(text: str) -> Iterator[tuple[str, bool]]:
    """Pieces of ``text`` up to a sentence's sign or a line's end, and whether it was the former; an item's number is no end."""
    start = 0
    for m in _END.finditer(text):
        ended = m.group() != "\n"
        if not ended or not text[start : m.start()].strip().isdigit():
            yield text[start : m.end()], ended
            start = m.end()
    if start < len(text):
        yield text[start:], False


def parted(text: str, fewest: int = 4, most: int = 50, longest: int = 9, often: int = 5, share: float = 0.5) -> tuple[str, str]:
    """(sentences, rest) of a text.

    A sentence ends with a sentence's sign and has ``fewest`` to ``most`` words. One of fewer than ``longest`` words counts
    only if its first two words begin fewer than ``often`` of the text's sentences, or no more than a ``share`` of them.
    """
    units = []
    for unit, ended in _units(text):
        words = unit.split()
        if not words and units:
            units[-1][0] += unit
        else:
            units.append([unit, len(words) if ended and len(words) <= most else 0, " ".join(words[:2]).lower()])
    opened = Counter(o for _, n, o in units if n >= fewest)
    total = opened.total()
    sentences, rest = [], []
    for unit, n, o in units:
        repeated = n < longest and opened[o] >= often and opened[o] > share * total
        (sentences if n >= fewest and not repeated else rest).append(unit)
    return "".join(sentences), "".join(rest)


def skeleton(flat: bytes) -> bytes:
    """A block's form: words of over three letters, numbers and addresses each made alike."""
    if _HOST.search(flat):
        flat = b"\n".join(b" ".join(b"u" if _HOST.search(x) else x for x in line.split(b" ")) for line in flat.split(b"\n"))
    return _NUMBERS.sub(b"0", _LONG.sub(b"w", flat))


def _measures(block: str, prose: bool) -> tuple:
    """(lang, bucket, n_chars, ratio, skeleton, record, address, price) of a block; the last three are numbers for each of its tokens, and 0 in prose."""
    raw = block.encode()
    n = len(raw)
    words = block.lower().split()
    # Thirds of octaves: within one the usual ratio hardly changes with the length.
    bucket = round(3 * (n.bit_length() + n / (1 << n.bit_length())))
    flat = raw.translate(_FLAT)
    size = lambda x: len(zlib.compress(x, 6)) / max(1, n)
    record = address = price = 0.0
    if not prose and n >= SHORTEST:
        tokens = max(1, len(words))
        bare = _ITEM.sub("\n", _PRICE.sub(" ", _ADDRESS.sub(" ", block)))
        record, address, price = len(_NUMBER.findall(bare)) / tokens, len(_ADDRESS.findall(block)) / tokens, len(_PRICE.findall(block)) / tokens
    return _language(words), bucket, len(block), size(flat), size(skeleton(flat)), record, address, price


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 5)
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for prose, part in zip((True, False), parted(text)):
                rows += [(doc, prose, *_measures(block, prose)) for block in blocks_of(part)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])


def block_measures(documents: DataFrame) -> DataFrame:
    """One row for each block of each text's sentences (prose) and of the rest, with ``usual`` and ``usual_skeleton``.

    These are the median ratios of the sentence blocks of its language and length. A block whose language can't be told, or
    whose language has no sentences of that length, is held against those of all languages; a length without any sentences
    has nulls.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("trim(text) <> ''")
    blocks = cut(rows.mapInArrow(_scan, SCHEMA))
    prose = blocks.where("prose")
    medians = lambda p: [F.percentile_approx(c, 0.5, 1000).alias(f"{p}_{c}") for c in ("ratio", "skeleton")]
    # A row for each language and third of an octave of length: at most some hundreds.
    own = broadcast_if_small(cut(prose.where("lang <> 'none'").groupBy("lang", "bucket").agg(*medians("own"))), 10_000)
    overall = broadcast_if_small(cut(prose.groupBy("bucket").agg(*medians("any"))), 10_000)
    joined = blocks.join(own, ["lang", "bucket"], "left").join(overall, "bucket", "left")
    return joined.withColumns({"usual": F.coalesce("own_ratio", "any_ratio"), "usual_skeleton": F.coalesce("own_skeleton", "any_skeleton")}).drop("own_ratio", "any_ratio", "own_skeleton", "any_skeleton")


def spam_pages(documents: DataFrame, redundant: float = 0.75, record: float = 0.08, price: float = 0.05, part: float = 0.5) -> DataFrame:
    """(doc_id, spam_share) of the texts whose greater part is spam.

    A block outside the sentences is spam if either of its ratios is below ``redundant`` times the usual one, and it is no
    record: for each token at least ``record`` plain numbers, fewer than ``price`` prices, and hardly more addresses and tags than
    numbers. Blocks
    of fewer than SHORTEST characters are none, and neither are those of a length without any sentences in the corpus
    unless they are shorter than half of their plain size. Null, empty and blank texts are none. Repeated rows of a doc_id
    count as one text of the same make-up.
    """
    blocks = block_measures(documents)
    relative = F.coalesce(F.least(F.col("ratio") / F.col("usual"), F.col("skeleton") / F.col("usual_skeleton")), 2 * F.col("ratio") * redundant)
    is_record = (F.col("record") >= record) & (F.col("price") < price) & (F.col("address") < 1.25 * F.col("record"))
    bad = ~F.col("prose") & (F.col("n_chars") >= SHORTEST) & (relative < redundant) & ~is_record
    share = blocks.groupBy("doc_id").agg((F.sum(F.when(bad, F.col("n_chars")).otherwise(0)) / F.sum("n_chars")).alias("spam_share"))
    return share.where(F.col("spam_share") > part)
