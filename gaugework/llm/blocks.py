"""Distinct texts in compressed blocks, and counts of hashed keys that come back to the blocks they came from.

Rows with equal texts are found by digest, and one of them stands for all. The distinct texts are written once, in blocks
of some megabytes. A pass over the blocks sends each block's distinct keys, sorted, as one binary row per key range; a
range's task sees all blocks' keys and answers with one byte per key, in the same order. So whole columns of keys are
shuffled without a row for each, a key that a third of all documents share is one entry per block, and ranges are sized
by the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import remembered, small_batches
from gaugework.session import materialise, small_side

BLOCK_BYTES = 4 << 20
RANGE_BYTES = 8 << 20

MEMBERS = ["doc_id", "digest", "first_id", "n_bytes", "sha256"]
BLOCKS = "block_id long, n_docs long, raw_bytes long, ids binary, digests binary, lengths binary, body binary"


@dataclass
class Block:
    """Texts as bytes, one after another; ``digests`` has 16 bytes a text."""

    block_id: int
    ids: np.ndarray
    digests: bytes
    lengths: np.ndarray
    raw: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)


def members(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, digest of the text (null: empty), the smallest id with that text, its bytes and SHA-256."""
    raw = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    rows = materialise(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.md5(raw)).alias("digest"),
                    F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha256")),
        "rows",
    )
    # written first, so that a text with very many copies is split among tasks, or joined without a shuffle
    firsts = small_side(rows.groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    joined = rows.join(firsts, "digest", "left")
    return materialise(joined.withColumn("first_id", F.coalesce("first_id", "doc_id")).select(*MEMBERS), "members")


def text_blocks(docs: DataFrame, rows: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the distinct texts of rows with an id. ``rows`` is what ``members`` gave for ``docs``."""
    small_batches(docs.sparkSession)
    copies = small_side(rows.filter("doc_id <> first_id").select("doc_id", "digest").distinct())
    raw = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    texts = (
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.md5(raw)).alias("digest"), raw.alias("raw"))
        .filter("doc_id IS NOT NULL").join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", "digest", "raw")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        remembered("blocks", list)  # nothing; but what ran here before goes
        squeeze = zstandard.ZstdCompressor(level=1).compress
        ids, digests, bodies, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            row = (uuid.uuid4().int >> 65, len(ids), size, np.array(ids, "<i8").tobytes(), b"".join(digests),
                   np.array([len(b) for b in bodies], "<i8").tobytes(), squeeze(b"".join(bodies)))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row],
                names=["block_id", "n_docs", "raw_bytes", "ids", "digests", "lengths", "body"])

        for batch in batches:
            for doc_id, digest, body in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(doc_id)
                digests.append(digest)
                bodies.append(body)
                size += len(body)
                if size >= block_bytes:
                    yield block()
                    ids, digests, bodies, size = [], [], [], 0
        if ids:
            yield block()

    return materialise(texts.mapInArrow(pack, BLOCKS), "blocks")


def opened(batch: pa.RecordBatch) -> Iterator[tuple[Block, dict]]:
    """Blocks of an Arrow batch, and each one's other columns."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    names = batch.schema.names
    for i in range(batch.num_rows):
        row = {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}
        raw = expand(row["body"], max_output_size=max(1, row["raw_bytes"]))
        yield Block(row["block_id"], np.frombuffer(row["ids"], "<i8"), row["digests"],
                    np.frombuffer(row["lengths"], "<i8"), np.frombuffer(raw, np.uint8)), row


def ranges_for(blocks: DataFrame, key_bytes_per_byte: float) -> int:
    """Key ranges, a power of two, such that one range's keys take about RANGE_BYTES."""
    total = (blocks.agg(F.sum("raw_bytes")).first()[0] or 0) * key_bytes_per_byte
    return 1 << max(0, int(total // RANGE_BYTES).bit_length())


def range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of equal top bits begins in sorted 64-bit keys; one more entry for the end."""
    bits = ranges.bit_length() - 1
    if not bits:
        return np.array([0, len(keys)])
    bounds = np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def low_bits(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The 32 bits of a key below those that name its range."""
    return ((keys << np.uint64(ranges.bit_length() - 1)) >> np.uint64(32)).astype("<u4")


def key_classes(blocks: DataFrame, ranges: int, keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray]],
                class_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``blocks`` with ``classes``: a byte for each distinct key of the block, in ascending order of the keys.

    ``keys_of`` gives a block's distinct sorted 64-bit keys and the documents that hold each; ``class_of`` turns totals
    over all blocks into bytes. Keys are told apart by range and 32 bits, so few may share a total with another: classes
    may only guide a search that is exact without them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _ in opened(batch):
                keys, counts = keys_of(block)
                cuts, low = range_cuts(keys, ranges), low_bits(keys, ranges)
                counts = np.minimum(counts, 0xFFFF).astype("<u2")
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int32()), pa.array([block.block_id] * len(full), pa.int64()),
                    pa.array([low[cuts[r]:cuts[r + 1]].tobytes() for r in full], pa.binary()),
                    pa.array([counts[cuts[r]:cuts[r + 1]].tobytes() for r in full], pa.binary()),
                ], names=["range", "block_id", "low", "counts"])

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lows = [np.frombuffer(b, "<u4") for b in rows.low]
        counts = np.concatenate([np.frombuffer(b, "<u2") for b in rows.counts])
        _, which = np.unique(np.concatenate(lows), return_inverse=True)
        classes = class_of(np.bincount(which, counts).astype(np.int64)).astype(np.uint8)[which]
        ends = np.cumsum([len(x) for x in lows])
        return pd.DataFrame({"block_id": rows.block_id, "range": rows["range"],
                             "part": [c.tobytes() for c in np.split(classes, ends[:-1])]})

    sent = blocks.mapInArrow(send, "range int, block_id long, low binary, counts binary")
    back = sent.groupBy("range").applyInPandas(total, "block_id long, range int, part binary")
    return with_parts(blocks, back, "classes")


def with_parts(blocks: DataFrame, back: DataFrame, name: str) -> DataFrame:
    """``blocks`` joined with the parts that came back for each, as an array in the order of ``range``."""
    gathered = back.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("range", "part"))).alias("__parts"))
    return (
        blocks.join(gathered.select("block_id", F.col("__parts.range").alias(f"{name}_range"),
                                    F.col("__parts.part").alias(name)), "block_id", "left")
    )


def joined_bytes(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(row[name] or []), np.uint8)
