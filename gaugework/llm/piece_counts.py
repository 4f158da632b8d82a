"""Token counts of whole texts from counts of their pre-tokens.

A text is cut where no piece of the vocabulary can reach across: before white space, between letters and other characters,
and around line breaks; every piece is checked for that. So a text's tokens are those of its pre-tokens, and the number of
a pre-token's pieces is worked out once, however many documents hold it:

1. One pass over the texts makes blocks: a list of distinct pre-tokens, and per document how often it has each of them, as
   places in that list. They are written once, compressed; a word of every document is one entry a block.
2. Each list is dealt to hash ranges. A range's task meets its part of all lists, counts every distinct pre-token once, and
   answers with one number per entry; no ids are kept.
3. The answers are joined to the block's frequencies, and each document's frequencies times counts are summed.

A block ends after ``BLOCK_WORDS`` distinct pre-tokens, its frequencies are cut every ``BLOCK_ENTRIES`` of them, and ranges
are as many as keep each near ``RANGE_BYTES``; besides these, a task holds one batch of texts. A lost executor costs its
tasks only, as blocks are rows of a written table.

Defined cases: a null or empty text has no tokens and no bytes; a text of any length is one document; each of several rows
with the same id, or without one, is counted by itself; an empty table gives no rows; other columns are not read. Texts
that hold the names of special tokens are ordinary text.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import documents, remembered, small_batches
from gaugework.llm.registry import query
from gaugework.llm.slack_packing import tokenizer_path
from gaugework.session import materialise

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
BLOCK_WORDS = 400_000
BLOCK_ENTRIES = 1_000_000
RANGE_BYTES = 16 << 20
LEAST_RANGES = 64
WORDS_AT_ONCE = 50_000

SPACE, LETTERS = "▁", "A-Za-zÀ-ÖØ-öø-ɏ"
PRE_TOKENS = re.compile(f"[ {SPACE}]*[{LETTERS}]+|[ {SPACE}]*[^ {SPACE}\n{LETTERS}]+|[ {SPACE}]+|\n")
PROBE = "  a  ﬁ é Ａ\t\r x "

BLOCKS = ("block_id long, word_bytes long, words binary, ids array<long>, sizes array<long>, entries array<int>, "
          "frequencies binary")
PARTS = "range int, block_id long, places binary, words binary"
ANSWERS = "block_id long, places binary, counts binary"
COUNTED = "doc_id long, n_bytes long, n_tokens long"


class PieceCounter:
    """The number of pieces of a pre-token."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(self.model.get_piece_size())
                  if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        pieces = (self.model.id_to_piece(i) for i in normal)
        if any(PRE_TOKENS.findall(p) != [p] for p in pieces) or self.model.normalize(PROBE) != f" {PROBE}".replace(" ", SPACE):
            raise ValueError(f"{path} joins or changes characters across the pre-tokens used here")
        self.start = len(self.model.encode("\n"))

    def of(self, words: list[str]) -> np.ndarray:
        """A line break before each word keeps the marker that the vocabulary puts before a text away from it."""
        counts = np.zeros(len(words), np.int64)
        for at in range(0, len(words), WORDS_AT_ONCE):
            found = self.model.encode(["\n" + w for w in words[at:at + WORDS_AT_ONCE]], num_threads=1)
            counts[at:at + len(found)] = [len(ids) - self.start for ids in found]
        return counts


def pre_tokens(text: str) -> list[str]:
    """The parts of a text that the vocabulary sees one by one; a space stands for the marker before the text."""
    return PRE_TOKENS.findall(" " + text) if text else []


def squeezed(values: np.ndarray) -> bytes:
    """32-bit numbers by bytes, all lowest first, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def expanded(raw: bytes) -> np.ndarray:
    import zstandard

    planes = zstandard.ZstdDecompressor().decompress(raw)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def steps(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending places as distances to the one before; each run, of which ``starts`` has the first row, begins anew."""
    out = np.diff(places, prepend=0)
    out[starts] = places[starts]
    return out


def places_of(out: np.ndarray, starts: np.ndarray) -> np.ndarray:
    whole = np.cumsum(out)
    before = (whole - out)[starts]
    return whole - np.repeat(before, np.diff(np.append(starts, len(out))))


def packed_words(words: list[str]) -> bytes:
    """Pre-tokens, none of which holds a line break but the line break itself, which stands as nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress("\n".join("" if w == "\n" else w for w in words).encode())


def opened_words(raw: bytes) -> list[str]:
    import zstandard

    return [w or "\n" for w in zstandard.ZstdDecompressor().decompress(raw).decode().split("\n")]


def frequency_blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     block_words: int = BLOCK_WORDS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Per block a row with its distinct pre-tokens, and rows of documents with their frequencies."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()),
                 pa.binary()]
        names = [f.split()[0] for f in BLOCKS.split(", ")]

        def row(**columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([columns[c]], t) if c in columns else pa.nulls(1, t) for c, t in zip(names, types)], names=names)

        def frequencies() -> pa.RecordBatch:
            rank = np.lexsort((places, np.repeat(np.arange(len(entries)), entries)))
            starts = np.cumsum([0, *entries[:-1]])[np.array(entries) > 0]
            body = np.concatenate([steps(np.array(places, np.int64)[rank], starts), np.array(times, np.int64)[rank]])
            return row(block_id=block, ids=ids, sizes=sizes, entries=entries, frequencies=squeezed(body))

        def listed() -> pa.RecordBatch:
            packed = packed_words(list(words))
            return row(block_id=block, word_bytes=sum(map(len, words)) + len(words), words=packed)

        words, block = {}, uuid.uuid4().int >> 65
        ids, sizes, entries, places, times = [], [], [], array("I"), array("I")
        for batch in batches:
            for doc_id, text, size in zip(*(c.to_pylist() for c in batch.columns)):
                found = Counter(pre_tokens(text)) if text else {}
                ids.append(doc_id)
                sizes.append(size)
                entries.append(len(found))
                number = words.setdefault
                places.extend([number(w, len(words)) for w in found])
                times.extend(found.values())
                full = len(words) >= block_words
                if full or len(places) >= block_entries:
                    yield frequencies()
                    ids, sizes, entries, places, times = [], [], [], array("I"), array("I")
                if full:
                    yield listed()
                    words, block = {}, uuid.uuid4().int >> 65
        if ids:
            yield frequencies()
        if words:
            yield listed()

    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long")
    return materialise(
        docs.select(F.col(id_column).cast("long"), text_column, size.alias("__size")).mapInArrow(cut, BLOCKS),
        "frequencies")


def counted_words(lists: DataFrame, path: str, ranges: int) -> DataFrame:
    """The pieces of every entry of the lists (``block_id``, ``words``), each distinct pre-token counted once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns)):
                words = opened_words(raw)
                of = np.array([zlib.crc32(w.encode()) for w in words], np.int64) % ranges
                order = np.argsort(of, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([of[part[0]]], pa.int32()), pa.array([block], pa.int64()),
                         pa.array([squeezed(steps(part, np.zeros(1, int)))], pa.binary()),
                         pa.array([packed_words([words[i] for i in part])], pa.binary())],
                        names=[f.split()[0] for f in PARTS.split(", ")])

    def count(parts: pa.Table) -> pa.Table:
        counter = remembered(("pieces", path), lambda: PieceCounter(path))
        known: dict[str, int] = {}
        entries = [np.array([known.setdefault(w, len(known)) for w in opened_words(raw)], np.int64)
                   for raw in parts["words"].to_pylist()]
        counts = counter.of(list(known))
        return pa.table({"block_id": parts["block_id"], "places": parts["places"],
                         "counts": pa.array([squeezed(counts[e]) for e in entries], pa.binary())})

    return lists.select("block_id", "words").mapInArrow(deal, PARTS).groupBy("range").applyInArrow(count, ANSWERS)


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                 block_words: int = BLOCK_WORDS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row, by the sentencepiece vocabulary at ``path``."""
    blocks = frequency_blocks(docs, id_column, text_column, block_words, block_entries)
    lists = blocks.filter("words IS NOT NULL")
    ranges = max(LEAST_RANGES, (lists.agg(F.sum("word_bytes")).first()[0] or 0) // RANGE_BYTES)
    bodies = blocks.filter("frequencies IS NOT NULL").select(
        F.col("block_id").alias("block"), "ids", "sizes", "entries", "frequencies")

    def add(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        first = np.zeros(1, int)
        places = [places_of(expanded(raw), first) for raw in answers["places"].to_pylist()]
        pieces = np.zeros(sum(map(len, places)), np.int64)
        for at, raw in zip(places, answers["counts"].to_pylist()):
            pieces[at] = expanded(raw)
        parts = []
        for i in range(bodies.num_rows):
            entries, body = bodies["entries"][i].values.to_numpy(), expanded(bodies["frequencies"][i].as_py())
            ends = np.concatenate([[0], np.cumsum(entries)])
            used = places_of(body[:len(body) // 2], ends[:-1][entries > 0])
            sums = np.concatenate([[0], np.cumsum(pieces[used] * body[len(body) // 2:])])
            parts.append(pa.table({"doc_id": bodies["ids"][i].values, "n_bytes": bodies["sizes"][i].values,
                                   "n_tokens": np.diff(sums[ends])}))
        return pa.concat_tables(parts)

    answers = counted_words(lists, path, ranges)
    return bodies.groupBy("block").cogroup(answers.groupBy("block_id")).applyInArrow(add, COUNTED)


@query("op13_piece_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(documents(spark, sf_dir), tokenizer_path(MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
