"""Best-fit packing of token sequences by minimum bin slack.

A bin is seeded with the longest piece left, then a subset-sum dynamic program over the available lengths, held as the
bits of one integer, finds the fullest combination that still fits. The combination is removed as often as the counts
allow, which is what repeating the same program bin after bin would do. Only counts per length (at most ``capacity``
of them) enter the program; pieces are numbered within their length and find their bin by that number.

Defined cases: a null text is an empty one, which has only the end id; a document longer than ``capacity`` is cut;
repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import string
import sys
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gaugework.llm.common import Memo, documents, numbered, remembered, small_batches
from gaugework.llm.registry import query
from gaugework.session import materialise

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
# Words remembered in each of two generations: some 300 MB a worker, and half of the time saved against 80,000.
KNOWN_WORDS = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


class WordIds:
    """Ids of whole texts, as little-endian bytes, put together from the ids of their words.

    The vocabulary drops white space before it splits words, so a text's ids are the ids of its words between ASCII
    white space, in order. A word of letters before ASCII punctuation is split there by the vocabulary's own rule,
    so its lower-cased letters go straight to the merges; any other word goes through the whole tokenizer. Texts that
    may hold a special token are encoded whole.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self.tokenizer.model
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {i: shown.pre_tokenize_str(chr(i))[0][0] if i < 128 else None for i in range(256)}
        for i in range(0x80, 0x800):  # the second byte of a two-byte letter, and the first one, as the vocabulary shows them
            (text, _), = shown.pre_tokenize_str(chr(i))
            for byte, char in zip(chr(i).encode(), text):
                self.shown[byte] = char
        self.letters, self.tails, self.words = (Memo(f, known_words) for f in (self.merged, self.encode, self.word))

    def encode(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merged(self, lower: str) -> bytes:
        shown = lower.encode().decode("latin-1").translate(self.shown)
        return packed([t.id for t in self.merges.tokenize(shown)])

    def word(self, raw: bytes) -> bytes:
        word = raw.decode()
        core = word.rstrip(string.punctuation)
        lower = core.lower()
        if not lower.isalpha() or not core.isascii() and (
            "\u03a3" in core or max(lower) > "\u07ff" or not unicodedata.is_normalized("NFC", core)
        ):
            return self.encode(word)
        return self.letters[lower] + (self.tails[word[len(core):]] if len(word) > len(core) else b"")

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            if any(s in raw for s in self.special):
                yield self.encode(raw.decode())
            else:
                yield b"".join(map(self.words.__getitem__, raw.split()))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_column: str = "doc_id",
                 text_column: str = "text", known_words: int = KNOWN_WORDS) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text, the end id included, with the crc32 of their ids.

    ``known_words`` bounds what a worker remembers; it changes time and memory, not results.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = remembered(("word ids", path, known_words), lambda: WordIds(path, known_words))
        end, width = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.batch(batch.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_column, text_column).mapInArrow(cut, PIECES)


@dataclass
class Pattern:
    """``times`` bins with the same ``lengths`` (length: how many)."""

    times: int
    lengths: dict[int, int]


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``.

    ``order`` lists the lengths that are left, longest first. Bit s of ``sums`` says that s can be made of the lengths
    seen so far; the program ends early when ``room`` itself can be made.
    """
    mask, sums = (1 << (room + 1)) - 1, 1
    layers: list[tuple[int, int]] = []
    for length in order:
        if length > room:
            continue
        before = sums
        for _ in range(min(counts[length], room // length)):
            grown = sums | (sums << length) & mask
            if grown == sums:
                break
            sums = grown
        layers.append((length, before))
        if sums >> room & 1:
            break
    total, chosen = sums.bit_length() - 1, {}
    for length, before in reversed(layers):
        while not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + 1
            total -= length
    return chosen


def minimum_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bins for so many pieces of each length. Its work depends on the number of different lengths only."""
    counts = Counter({length: n for length, n in histogram.items() if n > 0})
    order, patterns = sorted(counts, reverse=True), []
    while order:
        seed = order[0]
        counts[seed] -= 1
        chosen = Counter(fullest(counts, [x for x in order if counts[x]], capacity - seed))
        counts[seed] += 1
        chosen[seed] += 1
        times = min(counts[length] // n for length, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= n * times
        patterns.append(Pattern(times, dict(chosen)))
        order = [x for x in order if counts[x]]
    return patterns


def place(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length, rows (first number, how many per bin, first bin, offset in the bin), by first number."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    first_bin = 0
    for p in patterns:
        offset = 0
        for length in sorted(p.lengths, reverse=True):
            n = p.lengths[length]
            rows.setdefault(length, []).append((seen[length], n, first_bin, offset))
            seen[length] += n * p.times
            offset += n * length
        first_bin += p.times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``piece`` and ``length``.

    Collected: one count per length, at most ``capacity`` rows.
    """
    pieces = materialise(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places = place(minimum_slack(histogram, capacity))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "number"))
            bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                own, rows = np.flatnonzero(length == value), places[int(value)]
                row = rows[np.searchsorted(rows[:, 0], number[own], "right") - 1]
                local = number[own] - row[:, 0]
                bins[own] = row[:, 2] + local // row[:, 1]
                offsets[own] = row[:, 3] + local % row[:, 1] * value
            kept = batch.select([n for n in batch.schema.names if n != "number"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(bins), pa.array(offsets)],
                                             names=[*kept.schema.names, "sequence_id", "offset"])

    ranked = numbered(pieces, "length", ["doc_id", "piece"], "number", "numbered")
    return ranked.select(*pieces.columns, "number").mapInArrow(put, PLACED)


@query("op7_bin_slack")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(documents(spark, sf_dir), tokenizer_path()))
