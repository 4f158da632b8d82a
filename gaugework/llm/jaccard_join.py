"""Join of documents whose sets of word n-grams have a Jaccard similarity of at least ``percent`` / 100.

Rare-first prefix filtering: n-grams are ordered by the number of documents that hold them (counted over all of them,
in steps of a quarter power of two), then by hash. Two similar sets share an n-gram within their prefixes; n-grams held
by one document can't match and make no row. Pairs must also pass the length filter, the positional filter at a shared
n-gram, and a suffix filter that compares how many n-grams fall into ranges of the hash: 16 bytes a node travel with the
lists, so that this is done inside the join and only pairs that pass meet their sets. A pair is verified once.

Groups of copies never become all pairs. Equal texts are one node. In each list of nodes that share a prefix n-gram, the node
with the longest lists leads, and all others are paired with it; what these links connect needs no further pairs. Then
nodes that are not yet connected with their list's leader are paired with all nodes of other components that pass the filters, so
no link between components is lost; pairs that the first step has tested are left out. Lists' lengths and leaders are written
before they are joined to the rows, so that the rows of a frequent n-gram can be split among tasks.

Defined cases: null texts and texts without words have no n-gram and link with nothing; fewer words than ``n`` make one
n-gram; rows that share an id but not the text are linked by the id; rows without an id have no component, and n-grams
are counted for them only where a row with an id has their text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.llm.blocks import (
    Block, joined_bytes, key_classes, members, opened, ranges_for, text_blocks,
)
from gaugework.llm.common import documents
from gaugework.llm.links import components
from gaugework.llm.registry import query
from gaugework.session import materialise, small_side

WORDS = 3
PERCENT = 90
SUFFIX_RANGES = 16  # a byte of two 64-bit numbers each
SET_BLOCK_BYTES = 2 << 20  # a block's words and n-grams take some twenty times its bytes while it is read
SETS = "node binary, n long, low long, high long, tokens array<long>, places array<int>, grams binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of all words, equal for words equal but for the case of A-Z, and the document of each."""
    raw = block.raw
    upper = (raw >= 65) & (raw <= 90)
    chars = np.where(upper, raw + 32, raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    before = np.concatenate([[False], inside[:-1]])[: len(raw)]
    before[block.starts[block.lengths > 0]] = False
    begins = np.flatnonzero(inside & ~before)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    spot = np.flatnonzero(inside)
    firsts = np.searchsorted(spot, begins)
    lengths = np.diff(np.append(firsts, len(spot)))
    place = np.arange(len(spot)) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), 0x5851F42D4C957F2D, np.uint64))
    sums = np.add.reduceat((chars[spot].astype(np.uint64) + np.uint64(1)) * powers[place], firsts)
    ends = np.cumsum(block.lengths)
    return mix(sums), np.searchsorted(ends, begins, "right")


def block_grams(block: Block, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) of a block, distinct, in ascending order of both."""
    words, doc = block_words(block)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = np.bincount(doc, minlength=len(block.ids))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    key = np.zeros(len(words), np.uint64)
    place = np.arange(len(words)) - first[doc]
    short = count < n
    for j in range(n):
        there = place + j < count[doc]
        follow = np.where(there, np.roll(words, -j), np.uint64(0))
        key = mix(key ^ follow) + np.uint64(j)
    start = (place + n <= count[doc]) | (short[doc] & (place == 0))
    doc, key = doc[start], key[start]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    return doc[new], key[new]


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - (percent * n + 99) // 100 + 1


def rarity(totals: np.ndarray) -> np.ndarray:
    """0 for one document, then steps of a quarter power of two."""
    return np.where(totals <= 1, 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(totals, 1)))))


def prefixed_sets(blocks: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per distinct text: its digest, set size, the prefix n-grams that other texts hold too, with their places.

    The set itself is carried only where there is such an n-gram.
    """

    def keys_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(block_grams(block, n)[1], return_counts=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in opened(batch):
                doc, key = block_grams(block, n)
                rare = joined_bytes(row, "classes")[np.unique(key, return_inverse=True)[1]] if len(key) else key
                sizes = np.bincount(doc, minlength=len(block.ids))
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                order = np.lexsort((key, rare, doc))
                place = np.arange(len(key)) - first[doc]
                shared = (place < prefix_length(sizes, percent)[doc]) & (rare[order] > 0)
                own, tokens, places = doc[shared], key[order][shared].view(np.int64), place[shared]
                cuts = np.searchsorted(own, np.arange(len(block.ids) + 1))
                some = np.diff(cuts) > 0
                per_range = np.bincount(doc * SUFFIX_RANGES + (key >> np.uint64(60)).astype(np.int64),
                                        minlength=SUFFIX_RANGES * len(sizes))
                signature = np.minimum(per_range, 255).astype(np.uint8).view("<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.digests[16 * i:16 * i + 16] for i in range(len(sizes))], pa.binary()),
                    pa.array(sizes, pa.int64()), pa.array(signature[:, 0]), pa.array(signature[:, 1]),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places, pa.int32())),
                    pa.array([key[f:f + s].tobytes() if t else None for f, s, t in zip(first, sizes, some)], pa.binary()),
                ], names=["node", "n", "low", "high", "tokens", "places", "grams"])

    # about one n-gram for six bytes of text, four bytes each
    counted = key_classes(blocks, ranges_for(blocks, 4 / 6), keys_of, rarity)
    return materialise(counted.mapInArrow(cut, SETS), "sets")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets are similar enough, by their intersection."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    held = sets.filter("grams IS NOT NULL").select("node", "grams")
    both = (
        pairs.join(held.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
        .join(held.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(test, "a binary, b binary"), "verified")


def near_enough(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filters for two rows of a list, and the shorter prefix of the smaller set."""
    n, m, i, j = (F.col(f"{s}.{c}") for s, c in ((x, "n"), (y, "n"), (x, "place"), (y, "place")))
    need = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    index = lambda size: size - F.ceil(F.lit(2 * percent) * size / F.lit(100 + percent)) + 1
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - i, m - j) >= need)
        & (((n <= m) & (i < index(n))) | ((m <= n) & (j < index(m))))
        & (n + m - 2 * need >= F.expr(ranges_apart(x, y)))
    )


def ranges_apart(x: str, y: str) -> str:
    """At least so many n-grams are in one of two sets only: differences of the counts per hash range, up to 255 each."""
    count = lambda s, half, k: f"(shiftright({s}.{half}, {8 * k}) & 255)"
    return " + ".join(f"abs({count(x, half, k)} - {count(y, half, k)})" for half in ("low", "high") for k in range(8))


def similar_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of digests that connect exactly what all links connect."""
    facts = ["node", "n", "low", "high"]
    rows = sets.select(*facts, F.explode(F.arrays_zip("tokens", "places")).alias("t")).select(
        F.col("t.tokens").alias("token"), *facts, F.col("t.places").alias("place"))
    lists = materialise(rows.groupBy("token").agg(F.count(F.lit(1)).alias("length")).filter("length > 1"), "lengths")
    rows = materialise(rows.join(lists, "token"), "lists")
    weight = rows.groupBy("node").agg(F.sum("length").alias("weight"))
    rows = materialise(rows.drop("length").join(weight, "node"), "weighted")

    leaders = materialise(rows.groupBy("token").agg(
        F.max_by(F.struct(*facts, "place"), F.struct("weight", "node")).alias("lead")).select("token", "lead.*"), "leaders")
    x, y = rows.alias("x"), leaders.alias("y")
    starred = x.join(y, F.col("x.token") == F.col("y.token")).filter(
        (F.col("x.node") != F.col("y.node")) & near_enough("x", "y", percent))
    tested = distinct_pairs(starred)
    stars = verified(tested, sets, percent)

    roots = materialise(components(stars), "roots")
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    led = materialise(leaders.join(roots, "node", "left").select(
        "token", F.coalesce("root", "node").alias("lead_root")), "led")
    placed = materialise(placed.join(led, "token"), "placed")
    apart = placed.filter("root <> lead_root")
    x, y = apart.alias("x"), placed.alias("y")
    rest = x.join(y, F.col("x.token") == F.col("y.token")).filter(
        (F.col("x.root") != F.col("y.root")) & near_enough("x", "y", percent))
    rest = materialise(distinct_pairs(rest).join(tested, ["a", "b"], "left_anti"), "untested")
    return stars.unionByName(verified(rest, sets, percent))


def distinct_pairs(joined: DataFrame) -> DataFrame:
    return materialise(joined.select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")


def similar_documents(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id",
                      text_column: str = "text", block_bytes: int = SET_BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id for every row, and the digest of its text."""
    rows = members(docs, id_column, text_column)
    sets = prefixed_sets(text_blocks(docs, rows, id_column, text_column, block_bytes), n, percent)
    links = similar_links(sets, percent)
    # rows that share an id are linked by it
    texts = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("digest").alias("a"), F.max("digest").alias("z")).filter("a <> z").select("doc_id", "a")
    by_id = rows.join(texts, "doc_id").filter("digest <> a").select("a", F.col("digest").alias("b"))
    roots = components(links.unionByName(by_id)).withColumnRenamed("node", "digest")

    sizes = sets.groupBy("node").agg(F.max("n").alias("n")).withColumnRenamed("node", "digest")
    texts = (
        rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
        .join(sizes, "digest", "left").join(roots, "digest", "left")
        .withColumn("root", F.coalesce("root", "digest"))
    )
    # a text without words links with nothing, not even with its copies
    texts = materialise(texts.withColumn("n", F.coalesce("n", F.lit(0))), "texts")
    least = texts.groupBy("root").agg(F.min("first").alias("component"))
    answered = texts.join(least, "root").select("digest", "n", "component", "root")
    return rows.join(answered, "digest", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when((F.col("n") == 0) & (F.col("root") == F.col("digest")), F.col("doc_id"))
               .otherwise(F.col("component"))).alias("component_id"), "digest")


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of its smallest id; of rows that share this id, the least text stays.

    Rows without an id all stay.
    """
    found = materialise(similar_documents(docs, n, percent, id_column, text_column).select("doc_id", "component_id"),
                        "components")
    gone = small_side(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    kept = docs.join(gone, F.col(id_column) == F.col("__gone"), "left_anti")
    again = small_side(found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("__again"))
                       .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__again"))
    once = kept.join(again, F.col(id_column) == F.col("__again"), "left_anti")
    least = W.partitionBy(id_column).orderBy(text_column)
    first = (kept.join(again, F.col(id_column) == F.col("__again"), "left_semi")
             .withColumn("__place", F.row_number().over(least)).filter("__place = 1").drop("__place"))
    return once.unionByName(first)


SQL = """
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
           ELSE list_distinct(list_transform(range(1, len(words) - 1),
                                             lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles
    FROM w
), n AS (
    SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s
), t AS (
    SELECT doc_id, unnest(shingles) AS shingle FROM s
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM t a JOIN n na ON na.doc_id = a.doc_id JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    JOIN n nb ON nb.doc_id = b.doc_id AND 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n)
    GROUP BY 1, 2
), e AS (
    SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
    WHERE 100 * p.common >= 90 * (na.n + nb.n - p.common)
), r AS (
    WITH RECURSIVE reach(root, node) AS (
        SELECT doc_id, doc_id FROM n UNION SELECT reach.root, e.b FROM reach JOIN e ON e.a = reach.node
    ) SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT n.doc_id, n.n AS n_shingles, r.root AS component_id FROM n JOIN r ON r.node = n.doc_id
"""


@query("op5_jaccard_join", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
