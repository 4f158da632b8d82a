"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds (multiplies) the
vectors of its letters, each rotated by its place; a document's vector bundles (adds) those of its n-grams, and a
language's prototype bundles its documents, each scaled by the length its vector is expected to have (n-gram vectors
are nearly orthogonal). A document gets the language whose prototype has the largest cosine with it; the score is that
cosine, 0 if it is negative. Letters are lower-cased, everything between letters counts as one space, and the mean of
the prototypes is taken off before comparing.

The vectors are the same on every executor, as they depend on the seed alone. What reaches the driver is one vector per
language. Defined cases: a text that is null or has no letter is ``und`` with score 0; without any labelled row all are
``und``; ties take the first language by name; repeated rows count and are answered each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import documents, remainder, small_batches
from gaugework.llm.registry import query

DIMENSIONS = 512
GRAM = 3
SEED = 20_240_601
UNKNOWN = "und"
KEPT_GRAMS = 16_000
BLOCK = 512

_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Per code point, the code point of its lower-case letter, 0 if it is no letter. Made once per worker."""
    if not _LETTERS:
        every = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                every[i] = ord(c.lower()[0])
        _LETTERS.append(every)
    return _LETTERS[0]


class Vectors:
    """Random vectors of letters and n-grams. At most ``keep`` n-gram vectors are remembered."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED, keep: int = KEPT_GRAMS) -> None:
        self.dimensions, self.gram, self.seed, self.keep = dimensions, gram, seed, keep
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.known = np.empty((1024, dimensions), np.float32)
        self.block = np.empty((BLOCK, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = bits * 2 - 1
        return self.letters[code]

    def bound(self, key: int) -> np.ndarray:
        """The vector of an n-gram, given as its code points in 21 bits each."""
        codes = [(key >> 21 * i) & 0x1FFFFF for i in range(self.gram)]
        out = np.ones(self.dimensions, np.int8)
        for place, code in enumerate(codes):
            out *= np.roll(self.letter(code), place)
        return out

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Where the vectors of these n-grams (at most ``keep``) lie in ``known``."""
        new = [k for k in keys.tolist() if k not in self.row]
        if len(self.row) + len(new) > self.keep:
            self.row.clear()
            new = keys.tolist()
        need = len(self.row) + len(new)
        if need > len(self.known):
            bigger = np.empty((max(need, 2 * len(self.known)), self.dimensions), np.float32)
            bigger[: len(self.row)] = self.known[: len(self.row)]
            self.known = bigger
        for k in new:
            self.known[len(self.row)] = self.bound(k)
            self.row[k] = len(self.row)
        return np.fromiter(map(self.row.__getitem__, keys.tolist()), np.int64, len(keys))

    def bundle(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the vectors of n-grams, however many."""
        out, weights = np.zeros(self.dimensions, np.float32), weights.astype(np.float32)
        for first in range(0, len(keys), self.keep):
            rows, own = self.rows(keys[first:first + self.keep]), weights[first:first + self.keep]
            for at in range(0, len(rows), BLOCK):
                part = rows[at:at + BLOCK]
                block = self.block[: len(part)]
                np.take(self.known, part, axis=0, out=block, mode="clip")
                out += own[at:at + BLOCK] @ block
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Different n-grams of a text and how often each occurs; none if it has no letter."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        lower = letter_table()[np.minimum(codes, 0x10FFFF)]
        if not lower.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lower[lower == 0] = 32
        keep = np.ones(len(lower), bool)
        keep[1:] = (lower[1:] != 32) | (lower[:-1] != 32)
        spaced = np.concatenate([[32], lower[keep], [32]]).astype(np.int64)
        n = max(1, len(spaced) - self.gram + 1)
        key = np.zeros(n, np.int64)
        for place in range(self.gram):
            key |= spaced[place:place + n] << 21 * place
        return np.unique(key, return_counts=True)

    def document(self, text: str) -> np.ndarray | None:
        """The bundle of a text's n-grams as a unit vector; None without a letter."""
        keys, counts = self.grams(text)
        if not len(keys):
            return None
        out = self.bundle(keys, counts)
        norm = float(np.linalg.norm(out))
        return out / norm if norm else out


_VECTORS: dict[tuple, Vectors] = {}


def vectors(dimensions: int, gram: int, seed: int) -> Vectors:
    key = (dimensions, gram, seed)
    return _VECTORS.get(key) or _VECTORS.setdefault(key, Vectors(*key))


def train(rows: DataFrame, text_column: str = "text", lang_column: str = "lang", dimensions: int = DIMENSIONS,
          gram: int = GRAM, seed: int = SEED) -> dict[str, np.ndarray]:
    """A prototype per language from every row with a language and a letter. Collected: one vector per language."""
    small_batches(rows.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = vectors(dimensions, gram, seed), {}
        for batch in batches:
            found: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = own.grams(text)
                if len(keys):
                    found.setdefault(lang, []).append((keys, counts / np.sqrt((counts * counts).sum())))
            for lang, parts in found.items():
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                total = own.bundle(keys, np.bincount(place, np.concatenate([w for _, w in parts])))
                sums[lang] = sums.get(lang, 0) + total.astype(np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)],
                names=["lang", "place", "value"])

    known = rows.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).dropna()
    sums = (
        known.mapInArrow(bundle, "lang string, place int, value double")
        .groupBy("lang", "place").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("sums"))
        .select("lang", "sums.value").collect()
    )
    return {r[0]: np.array(r[1]) for r in sums}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_column: str = "doc_id", text_column: str = "text",
            dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    small_batches(docs.sparkSession)
    names = sorted(prototypes)
    units = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names]).reshape(-1, dimensions)
    middle = units.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    units = units - middle
    units = (units / np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    middle = middle.astype(np.float32)

    def answer(text: str | None) -> tuple[str, float]:
        v = vectors(dimensions, gram, seed).document(text) if text else None
        if v is None or not names:
            return UNKNOWN, 0.0
        v = v - middle
        cosines = units @ v / max(float(np.linalg.norm(v)), 1e-12)
        best = int(cosines.argmax())
        return names[best], min(1.0, max(0.0, float(cosines[best])))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [answer(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return docs.select(id_column, text_column).mapInArrow(rows, "doc_id long, lang_pred string, score double")


@query("op2_hyper_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 4) == 2
    found = predict(docs, train(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
