"""Quality rules: counts of words, symbols, repeated lines and windows, and zstandard compression bands.

A text is kept if the base rules pass and its compression ratio (bytes over compressed bytes) lies in the band of its
length. The whole text has one band; if it is longer than one chunk, each chunk of ``CHUNK`` bytes is compressed on its own, the
last one being the last ``CHUNK`` bytes even where it overlaps the one before, and a text is rejected if more than
``BAD_CHUNKS`` of them leave the chunk band. Repetitive text compresses too well, noise and encoded data too little.

Defined cases: a null text is an empty one: no words, so the base rules fail; repeated rows are judged each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gaugework.llm.common import documents, small_batches
from gaugework.llm.registry import query

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

LEVEL = 3
CHUNK = 4096
CHUNK_BAND = (1.2, 4.0)
BAD_CHUNKS = 0.25
# Up to so many bytes: lowest and highest ratio of the whole text. A frame's header weighs on short texts, and longer
# texts have more to refer back to, so both limits rise with the length.
BANDS = [
    (100, 0.0, 2.5), (250, 0.8, 2.5), (500, 1.0, 2.7), (1_000, 1.15, 2.9), (2_000, 1.25, 3.2), (4_000, 1.35, 3.5),
    (8_000, 1.4, 3.8), (32_000, 1.45, 4.2), (float("inf"), 1.5, 5.0),
]

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()),
])
DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` words that occur twice or more, the first occurrence included.

    Windows are compared by exact ranks: pairs of words get a number each, pairs of these numbers the next, up to the
    window. Sums of random numbers per word find the texts without any repeated window first.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    sums = np.zeros(n, np.uint64)
    for j in range(window):
        sums = sums * np.uint64(0x100000001B3) + mixed[j:j + n]
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    ranks, span = ids, 1
    while span < window:
        step = min(span, window - span)
        pairs = ranks[: len(ranks) - step] * len(words) + ranks[step:]
        ranks, span = np.unique(pairs, return_inverse=True)[1], span + step
    twice = np.bincount(ranks)[ranks] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


class Bands:
    """Compression ratios and the verdict; one compressor per task."""

    def __init__(self, level: int = LEVEL, chunk: int = CHUNK, bands: list = BANDS) -> None:
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.chunk, self.bands = chunk, bands

    def judge(self, raw: bytes) -> tuple[float, int, int, bool]:
        """Ratio of the whole, chunks, chunks outside their band, and whether both lie within the limits."""
        if not raw:
            return 0.0, 0, 0, True
        ratio = len(raw) / len(self.pack(raw))
        low, high = next((a, b) for size, a, b in self.bands if len(raw) <= size)
        chunks = bad = 0
        if len(raw) > self.chunk:
            last = len(raw) - self.chunk
            for at in (*range(0, last, self.chunk), last):
                chunks += 1
                bad += not CHUNK_BAND[0] <= self.chunk / len(self.pack(raw[at:at + self.chunk])) <= CHUNK_BAND[1]
        return ratio, chunks, bad, low <= ratio <= high and bad <= BAD_CHUNKS * chunks


def measure(text: str, bands: Bands) -> tuple:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * n
    ratio, chunks, bad, within = bands.judge(raw)
    return (n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed, not failed and within,
            ratio, chunks, bad)


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``kept``, and what the verdict rests on."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in batches:
            found = [measure(t or "", bands) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found)) or [()] * (len(SCHEMA) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:]))],
                schema=SCHEMA)

    return docs.select(id_column, text_column).mapInArrow(rows, DDL)


@query("op3_compression_bands")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
