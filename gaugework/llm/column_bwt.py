"""Removal of byte strings that an earlier document holds, by column-wise construction of a collection's suffix order.

A collection of strings gets its Burrows-Wheeler transform by inserting one symbol per string each round, from the last to
the first: the transform's symbols, sorted stably, say where the suffixes that are one symbol longer belong, and the
common prefix of two new neighbours is one more than the least common prefix between the symbols they came from. Neighbours
with a common prefix of ``WINDOW`` bytes hold the same string; the least document of each such run decides.

A corpus is no collection of bounded strings, so it is cut into segments first: consecutive windows of ``WINDOW`` bytes whose
least hashed ``MARK``-byte string lies at the same place. A segment has at most 2 * WINDOW - MARK bytes, so there are few
rounds, and equal windows have equal marks, so collections by mark hold all that may match. The collections are the external
files: a table in the shared folder, read range by range, with transform, common prefixes and suffixes of one collection
in memory at a time. A window holds its mark and at least ``REACH`` bytes on one side of it; where these lie in one document
only, counted over all documents, the window stays out. Windows whose own such string lies in very many documents become
single ones, dealt by the window's hash, so that no collection grows with a frequent string; a segment's other windows stay
together under their mark, as what becomes of a window must follow from its own bytes. Equal segments of a block are one,
with its least document.

Defined cases: a null text is an empty one; rows without an id neither remove nor lose anything; of rows with equal texts
the smallest id keeps its text, and rows that repeat an id don't remove one another's bytes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.blocks import (
    BLOCK_BYTES, Block, joined_bytes, key_classes, members, opened, ranges_for, text_blocks, with_parts,
)
from gaugework.llm.common import documents
from gaugework.llm.registry import query
from gaugework.session import materialise

WINDOW = 50
MARK = 20
REACH = (WINDOW - MARK) // 2
HOT_DOCUMENTS = 4096
COLLECTION_BYTES = 1 << 20
LONGEST = 2 * WINDOW - MARK
RESULT = "doc_id long, digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolling(raw: np.ndarray, length: int) -> np.ndarray:
    """A 32-bit hash of the ``length`` bytes from each place on, by doubling."""
    power, span = 0x2C1B3C6D, 1
    have, done, at = raw.astype(np.uint32) + np.uint32(1), None, 0
    while span <= length:
        if length & span:
            if done is None:
                done = have
            else:
                done = done[: len(have) - at] * np.uint32(power) + have[at:]
            at += span
        if 2 * span <= length:
            have = have[:-span] * np.uint32(power) + have[span:]
        power = power * power % 2**32
        span *= 2
    done = done[: len(raw) - length + 1]
    done = (done ^ (done >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (done ^ (done >> np.uint32(13))) * np.uint32(0xC2B2AE35)


def least_place(values: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the least of the next ``width`` 32-bit values lies, the first of equals."""
    least = (values.astype(np.uint64) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        more = width - span
        least = np.minimum(least[: len(least) - more], least[more:])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def keyed(block: Block, start: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each start on."""
    wide = -(-length // 8) * 8
    rows = np.zeros((len(start), wide), np.uint8)
    rows[:, :length] = block.raw[start[:, None] + np.arange(length)]
    words = rows.view("<u8")
    key = np.full(len(start), salt, np.uint64)
    for i in range(words.shape[1]):
        key = mix(key ^ words[:, i])
    return key


class Segments:
    """Segments of a block: document, first byte, number of windows, key and place of the mark.

    A window that starts more than REACH bytes before its mark holds the REACH + 1 bytes before the mark, any other the
    REACH bytes after it. So the first windows of a segment (``n_left``) only match where the mark with the bytes before it
    (``left``) is found again, the others where it is with those after it (``right``).
    """

    FIELDS = ("doc", "first", "windows", "key", "place")

    def __init__(self, block: Block) -> None:
        self.doc = self.first = self.windows = self.place = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if len(block.raw) < WINDOW:
            return
        place = least_place(rolling(block.raw, MARK), WINDOW - MARK + 1)
        ends = np.cumsum(block.lengths)
        whole = np.ones(len(block.raw), bool)  # whether a window starts here; none does in a text's last bytes
        for end, n in zip(ends.tolist(), block.lengths.tolist()):
            whole[end - min(n, WINDOW - 1):end] = False
        whole = whole[: len(place)]
        new, last = whole.copy(), whole.copy()
        turn = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1])
        new[1:] &= turn
        last[:-1] &= turn
        self.first = np.flatnonzero(new)
        if not len(self.first):
            return
        self.windows = np.flatnonzero(last) - self.first + 1
        self.doc, self.place = np.searchsorted(ends, self.first, "right"), place[self.first]
        self.key = keyed(block, self.place, MARK, 4)

    def take(self, which: np.ndarray) -> Segments:
        return self.of(**{f: getattr(self, f)[which] for f in self.FIELDS})

    @classmethod
    def of(cls, **fields: np.ndarray) -> Segments:
        out = object.__new__(cls)
        out.__dict__.update(fields)
        return out

    @property
    def n_left(self) -> np.ndarray:
        return np.clip(self.place - REACH - self.first, 0, self.windows)

    def sides(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments with first windows and their keys, segments with other windows and theirs."""
        left, right = np.flatnonzero(self.n_left > 0), np.flatnonzero(self.n_left < self.windows)
        return (left, keyed(block, self.place[left] - REACH - 1, MARK + REACH + 1, 1),
                right, keyed(block, self.place[right], MARK + REACH, 2))


def marks_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of marks with what is beside them, and the documents of the block that hold each."""
    s = Segments(block)
    left, left_key, right, right_key = s.sides(block)
    key, doc = np.concatenate([left_key, right_key]), s.doc[np.concatenate([left, right])]
    order = np.argsort(key, kind="stable")  # documents stay in order, as no key is of both sides
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    held = new.copy()
    held[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    return key[first], np.add.reduceat(held.astype(np.int64), first) if len(first) else first


def shared_segments(block: Block, classes: np.ndarray) -> tuple[Segments, Segments]:
    """Of each segment the windows whose side of the mark lies in several documents: ordinary ones, and frequent ones."""
    s = Segments(block)
    left, left_key, right, right_key = s.sides(block)
    found = classes[np.unique(np.concatenate([left_key, right_key]), return_inverse=True)[1]] if len(s.key) else classes
    sides = np.zeros((2, len(s.key)), np.uint8)
    sides[0, left], sides[1, right] = found[: len(left)], found[len(left):]
    n_left = s.n_left

    def cut(kind: int) -> Segments:
        has = sides == kind
        first = np.where(has[0], s.first, s.first + n_left)
        windows = np.where(has[0], n_left, 0) + np.where(has[1], s.windows - n_left, 0)
        own = Segments.of(doc=s.doc, first=first, windows=windows, key=s.key, place=s.place)
        return own.take(np.flatnonzero(windows > 0))

    return cut(1), cut(2)


def repeated(totals: np.ndarray, hot: int = HOT_DOCUMENTS) -> np.ndarray:
    """0: one document; 1: some; 2: so many that the windows become single ones."""
    return np.where(totals <= 1, 0, np.where(totals < hot, 1, 2))


def matrix(block: Block, s: Segments) -> np.ndarray:
    """A row per segment: its bytes, zeros up to LONGEST, and its number of windows."""
    columns = np.arange(LONGEST)
    size = s.windows + WINDOW - 1
    at = np.minimum(s.first[:, None] + columns, len(block.raw) - 1)
    out = np.empty((len(s.first), LONGEST + 1), np.uint8)
    out[:, :LONGEST] = np.where(columns < size[:, None], block.raw[at], 0)
    out[:, LONGEST] = s.windows
    return out


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of equal rows, in their order as byte strings, and each row's place among these."""
    flat = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    _, first, which = np.unique(flat, return_index=True, return_inverse=True)
    return first, which


class Shared:
    """A block's distinct segments that may match another document's, by collection."""

    def __init__(self, block: Block, classes: np.ndarray, collections: int) -> None:
        some, hot = shared_segments(block, classes)
        if len(hot.first):
            times = hot.windows
            each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            first = np.repeat(hot.first, times) + each
            single = {"doc": np.repeat(hot.doc, times), "first": first, "windows": np.ones(len(each), np.int64),
                      "key": keyed(block, first, WINDOW, 3), "place": np.repeat(hot.place, times)}
            some = Segments.of(**{f: np.concatenate([getattr(some, f), v]) for f, v in single.items()})
        self.segments = some
        rows = matrix(block, some)
        bits = np.uint64(64 - (collections.bit_length() - 1))
        group = (some.key >> bits).astype(np.int64) if collections > 1 else np.zeros(len(some.key), np.int64)
        order_key = np.concatenate([group.astype(">u4")[:, None].view(np.uint8).reshape(-1, 4), rows], axis=1)
        first, self.which = distinct(order_key) if len(rows) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.rows, self.group = rows[first], group[first]
        self.least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, block.ids[some.doc])


def insert_columns(strings: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of a collection in order: string and length of each, and its common prefix with the one before.

    ``strings`` holds a string per row. Round j inserts the suffixes of length j. The state is the sorted list of the
    suffixes so far, as the symbol before each (the transform, 0 where the string begins) and the common prefix with the
    suffix before it. The transform sorted stably gives, after the empty suffixes, all suffixes in their new order: those
    that are there already, and a new one for each symbol that was set in the round before.
    """
    n = len(sizes)
    present = np.zeros(256, bool)
    present[np.unique(strings)] = True
    narrow = np.uint8 if present.sum() < 256 else np.uint16
    coded = np.cumsum(present).astype(narrow)[strings]  # symbols from 1 on, in the order of the bytes
    symbol = coded[np.arange(n), sizes - 1]
    common, fresh, owner = np.zeros(n, np.uint8), np.arange(n), np.arange(n)
    for length in range(1, int(sizes.max(initial=0)) + 1):
        # where each symbol's suffix belongs; symbols 0 have none
        order = np.argsort(symbol, kind="stable")[np.count_nonzero(symbol == 0):]
        size = n + len(order)
        is_fresh = np.zeros(len(symbol), bool)
        is_fresh[fresh] = True
        slot = np.flatnonzero(is_fresh[order])
        source = order[slot]
        # common prefixes of new neighbours: the least one between their sources, and one more
        is_fresh = np.zeros(len(order) + 1, bool)
        is_fresh[slot] = is_fresh[slot + 1] = True
        at = np.flatnonzero(is_fresh[1:-1]) + 1
        low, high = order[at - 1], order[at]
        same = symbol[low] == symbol[high]
        grown = np.zeros(len(at), np.uint8)
        grown[same] = np.minimum(least_between(common, low[same] + 1, high[same]), 253) + 1
        who = owner[np.searchsorted(fresh, source)]
        left = sizes[who] - length
        before = np.where(left > 0, coded[who, np.maximum(left - 1, 0)], 0).astype(narrow)
        slot += n
        stay = np.ones(size, bool)
        stay[slot] = False
        wider, next_symbol = np.zeros(size, np.uint8), np.empty(size, narrow)
        wider[stay], next_symbol[stay], next_symbol[slot] = common, symbol, before
        wider[at + n] = grown
        symbol, common, fresh, owner = next_symbol, wider, slot, who
    # every string's suffixes, one symbol longer each step, from the finished transform
    owner, depth = np.empty(len(symbol), np.int32), np.empty(len(symbol), np.uint8)
    order = np.argsort(symbol, kind="stable")[np.count_nonzero(symbol == 0):]
    place = np.empty(len(symbol), np.int64)
    place[order] = np.arange(n, len(symbol))
    string, at = np.arange(n), np.arange(n)
    for length in range(int(sizes.max(initial=0)) + 1):
        owner[at], depth[at] = string, length
        more = sizes[string] > length
        string, at = string[more], place[at[more]]
    return owner, depth, common


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high + 1]`` for each pair, from minima over powers of two."""
    out = np.empty(len(low), values.dtype)
    width = high - low + 1
    power = np.frexp(width.astype(np.float64))[1] - 1
    table = values
    for level in range(int(power.max(initial=-1)) + 1):
        if level:
            half = 1 << (level - 1)
            table = np.minimum(table[:-half], table[half:])
        own = np.flatnonzero(power == level)
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << level) + 1])
    return out


def least_documents(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For all windows of the segments ``rows``, one after another, the least document that holds the same window."""
    windows = rows[:, LONGEST].astype(np.int64)
    sizes = windows + WINDOW - 1
    owner, depth, common = insert_columns(rows[:, :LONGEST], sizes)
    begin = np.flatnonzero(common < WINDOW)
    least = np.minimum.reduceat(docs[owner], begin)[np.cumsum(common < WINDOW) - 1] if len(owner) else docs[owner]
    whole = depth >= WINDOW
    first = np.concatenate([[0], np.cumsum(windows)[:-1]]).astype(np.int64)
    out = np.empty(int(windows.sum()), np.int64)
    out[first[owner[whole]] + sizes[owner[whole]] - depth[whole]] = least[whole]
    return out


def packed_places(s: Shared) -> bytes:
    """Where a block's segments lie and which distinct one each is, byte by byte of the numbers."""
    import zstandard

    own = s.segments
    numbers = np.stack([s.which, own.first, own.windows, own.doc]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_places(raw: bytes) -> np.ndarray:
    """(which, first, windows, doc), a row each."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(4, -1).astype(np.int64)


def collection_answers(blocks: DataFrame, collections: int) -> DataFrame:
    """(block_id, range, part): per block and collection, the least document of each window of its distinct segments.

    A part of a range below 0 says where these segments lie in the block, so that they need not be found again. It takes
    the same way, past the collections.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in opened(batch):
                s = Shared(block, joined_bytes(row, "classes"), collections)
                full, first = np.unique(s.group, return_index=True)
                cuts = np.append(first, len(s.group))
                aside = -1 - block.block_id % collections
                yield pa.RecordBatch.from_arrays([
                    pa.array([*full, aside], pa.int32()), pa.array([block.block_id] * (len(full) + 1), pa.int64()),
                    pa.array([*(packed(s.rows[a:b]) for a, b in zip(cuts, cuts[1:])), packed_places(s)], pa.binary()),
                    pa.array([*(s.least[a:b].astype("<i8").tobytes() for a, b in zip(cuts, cuts[1:])), b""], pa.binary()),
                ], names=["range", "block_id", "rows", "docs"])

    def answer(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        if key[0] < 0:
            return parts[["block_id", "range"]].assign(part=parts.rows)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        each = [unpacked(p) for p in parts.rows]
        rows = np.concatenate(each)
        docs = np.concatenate([np.frombuffer(d, "<i8") for d in parts.docs])
        first, which = distinct(rows)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which, docs)
        answers = least_documents(rows[first], least)
        windows = rows[first][:, LONGEST].astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(windows)[:-1]])
        out, at = [], 0
        for own in each:
            mine = which[at:at + len(own)]
            at += len(own)
            times = windows[mine]
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out.append(squeeze(answers[np.repeat(begins[mine], times) + inside].astype("<i8").tobytes()))
        return pd.DataFrame({"block_id": parts.block_id, "range": parts["range"], "part": out})

    sent = blocks.mapInArrow(send, "range int, block_id long, rows binary, docs binary")
    return sent.groupBy("range").applyInPandas(answer, "block_id long, range int, part binary")


def packed(rows: np.ndarray) -> bytes:
    """Segments without their padding: the numbers of windows, then the bytes."""
    windows = rows[:, LONGEST]
    inside = np.arange(LONGEST) < (windows.astype(np.int64) + WINDOW - 1)[:, None]
    return np.array([len(rows)], "<i8").tobytes() + windows.tobytes() + rows[:, :LONGEST][inside].tobytes()


def unpacked(part: bytes) -> np.ndarray:
    n = int(np.frombuffer(part, "<i8", 1)[0])
    rows = np.zeros((n, LONGEST + 1), np.uint8)
    rows[:, LONGEST] = np.frombuffer(part, np.uint8, n, 8)
    inside = np.arange(LONGEST) < (rows[:, LONGEST].astype(np.int64) + WINDOW - 1)[:, None]
    body = np.zeros((n, LONGEST), np.uint8)
    body[inside] = np.frombuffer(part, np.uint8, -1, 8 + n)
    rows[:, :LONGEST] = body
    return rows


def cut_texts(blocks: DataFrame) -> DataFrame:
    """Per distinct text what is removed, and what is left as a digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, row in opened(batch):
                which, first, times, doc = unpacked_places(row["answers"][0])
                least = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(expand(p), "<i8") for p in row["answers"][1:])])
                windows = np.zeros(which.max(initial=-1) + 1, np.int64)
                windows[which] = times
                begins = np.concatenate([[0], np.cumsum(windows)[:-1]]).astype(np.int64)
                inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                found = least[np.repeat(begins[which], times) + inside]
                start = np.repeat(first, times) + inside
                start = start[found < block.ids[np.repeat(doc, times)]]
                change = np.zeros(len(block.raw) + 1, np.int32)
                np.add.at(change, start, 1)
                np.add.at(change, start + WINDOW, -1)
                gone = np.cumsum(change)[:-1] > 0
                rows = []
                for i, (a, n) in enumerate(zip(block.starts.tolist(), block.lengths.tolist())):
                    lost = gone[a:a + n]
                    removed = int(lost.sum())
                    text = block.raw[a:a + n]
                    kept = (text[~lost] if removed else text).tobytes()
                    spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if removed else 0
                    rows.append((int(block.ids[i]), block.digests[16 * i:16 * i + 16], n, removed, spans,
                                 hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["doc_id", "digest", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return blocks.mapInArrow(cut, RESULT)


def repeats_removed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT_DOCUMENTS,
                    block_bytes: int = BLOCK_BYTES, collection_bytes: int = COLLECTION_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row. The last three change sizes, not results."""
    rows = members(docs, id_column, text_column)
    blocks = text_blocks(docs, rows, id_column, text_column, block_bytes)
    # about two keys for sixteen bytes of text, four bytes each
    ranges = ranges_for(blocks, 8 / 16)
    marked = materialise(key_classes(blocks, ranges, marks_of, lambda totals: repeated(totals, hot)), "marked")
    total = marked.agg(F.sum("raw_bytes")).first()[0] or 0
    collections = 1 << max(0, int(total // collection_bytes).bit_length())
    answers = materialise(collection_answers(marked, collections), "answers")
    firsts = cut_texts(with_parts(marked.drop("classes", "classes_range"), answers, "answers")).drop("digest")

    # copies of a text with a smaller id lose every byte if the text has one window; other rows outside the blocks keep all
    copies = rows.filter("doc_id IS NULL OR doc_id <> first_id")
    lost = F.col("doc_id").isNotNull() & (F.col("n_bytes") >= WINDOW)
    others = copies.select(
        "doc_id", "n_bytes", F.when(lost, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(lost, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(lost, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("sha256")).alias("kept_sha256"))
    return firsts.unionByName(others)


SQL = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
    SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS pos, h FROM d WHERE len(h) >= 100
), k AS (
    SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, 100)) AS piece FROM w
), m AS (
    SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY piece) AS first FROM k
), g AS (
    SELECT doc_id, pos, CASE WHEN pos > max(pos) OVER (PARTITION BY doc_id ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 1 ELSE 0 END AS fresh
    FROM m WHERE first < doc_id
), s AS (
    SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM g
), r AS (
    SELECT doc_id, span, min(pos) AS a, max(pos) + 50 AS b FROM s GROUP BY doc_id, span
), c AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM r
), t AS (
    SELECT c.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
           string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS kept
    FROM c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""


@query("op1_column_bwt", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(documents(spark, sf_dir))
