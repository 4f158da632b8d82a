"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Tokens are runs of letters and digits, lower-cased, and runs of other visible characters. Features are single tokens
and pairs of neighbours, hashed to ``2 ** bits`` places. Three readings of each token are used: the token; its shape
(case and kind of its characters); and ``=`` where it repeats the token before it, so that pairs of unknown words
still say something. A feature's value is 1 + log(count), and a text's features have length 1.

Training takes at most ``sample`` labelled rows, those with the smallest hashed ids. They are dealt to shards of about
``shard_rows`` rows, each shard runs FTRL-proximal over its rows for some epochs, and the shards' weights are averaged.
What reaches the driver is one weight vector per shard, of which the sample's size bounds the number.

Defined cases: a null or empty text has no feature but the bias; labels that are null or have no document are not learnt from;
repeated rows count and are answered each; without any label every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import Memo, documents, remainder, remembered, small_batches, table
from gaugework.llm.registry import query

BITS = 18
SAMPLE = 20_000
SHARD_ROWS = 5_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.05, 0.0
THRESHOLD = 0.3

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
SHAPES = {"upper": 1, "capital": 2, "lower": 3, "number": 4, "mixed": 5, "sign": 6, "signs": 7}
SAME = zlib.crc32(b"\0same")


def _shape(token: str) -> int:
    if not token[0].isalnum():
        kind = "sign" if len(token) == 1 else "signs"
    elif token.isalpha():
        kind = ("lower" if token.islower() else "upper" if token.isupper() and len(token) > 1
                else "capital" if token.istitle() else "mixed")
    else:
        kind = "number" if token.isdigit() else "mixed"
    return zlib.crc32(f"\0{kind}".encode())


def _reading(token: str) -> tuple[int, int]:
    return zlib.crc32(token.lower().encode("utf-8", "replace")), _shape(token)


def _new_readings() -> Memo:
    return Memo(_reading)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending, place 0 is the bias) and values of a whole text."""
    memo = remembered("readings", _new_readings)
    found = [memo[t] for t in TOKEN.findall(text or "")]
    if not found:
        return np.zeros(1, np.int64), np.ones(1)
    word, shape = np.array(found, np.uint64).T
    same = word[1:] == word[:-1]
    second = np.where(same, np.uint64(SAME), word[1:])
    keys = np.concatenate([
        mix(word), mix(shape) + np.uint64(1), mix(mix(word[:-1]) + second),
        mix(mix(shape[:-1]) + np.where(same, np.uint64(SAME), shape[1:]) + np.uint64(2)),
    ])
    places, counts = np.unique(keys % np.uint64(2**bits - 1), return_counts=True)
    values = 1.0 + np.log(counts)
    values /= np.sqrt((values * values).sum())
    return np.concatenate([[0], places.astype(np.int64) + 1]), np.concatenate([[1.0], values])


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


class Ftrl:
    """FTRL-proximal with one learning rate per place."""

    def __init__(self, bits: int = BITS) -> None:
        self.z, self.n = np.zeros(2**bits), np.zeros(2**bits)

    def weights(self, places: np.ndarray) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(places)
        g = (sigmoid(w @ values) - label) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[places] = n + g * g


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, bits: int = BITS,
          epochs: int = EPOCHS, **columns: str) -> np.ndarray:
    """Weights from a bounded sample of the labelled rows: the mean of the shards' weights, by rows."""
    small_batches(docs.sparkSession)
    chosen = chosen_labels(labels, sample, **columns)
    shards = max(1, -(-chosen.count() // shard_rows))
    rows = training_rows(docs, chosen, **columns)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, bits) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()),
                 pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary()), batch.column(2)],
                names=["row_key", "places", "vals", "label"])

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        model, rows = Ftrl(bits), rows.sort_values("row_key", kind="stable")
        for _ in range(epochs):
            for places, values, label in zip(rows.places, rows.vals, rows.label.tolist()):
                model.update(np.frombuffer(places, "<i4"), np.frombuffer(values, "<f4"), label)
        w = model.weights(np.arange(2**bits)).astype("<f4")
        return pd.DataFrame({"n": [len(rows)], "weights": [w.tobytes()]})

    learnt = (
        rows.select("row_key", "text", F.col("label").cast("int")).mapInArrow(
            extract, "row_key long, places binary, vals binary, label int")
        .withColumn("shard", F.pmod("row_key", F.lit(shards)))
        .groupBy("shard").applyInPandas(learn, "n long, weights binary").collect()
    )
    total = sum(r[0] for r in learnt)
    weights = np.zeros(2**bits, np.float32)
    for n, w in learnt:
        weights += np.frombuffer(w, "<f4") * np.float32(n / total)
    return weights


def chosen_labels(labels: DataFrame, sample: int = SAMPLE, label_column: str = "quality",
                  id_column: str = "doc_id", **_: str) -> DataFrame:
    """(row_key, id, label) of at most ``sample`` labelled ids, those with the smallest hash."""
    return (
        labels.select(F.col(id_column).alias("__id"), F.col(label_column).cast("int").alias("label"))
        .filter("__id IS NOT NULL AND label IS NOT NULL").withColumn("row_key", F.xxhash64("__id"))
        .orderBy("row_key", "label").limit(sample)
    )


def training_rows(docs: DataFrame, chosen: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  **_: str) -> DataFrame:
    """The chosen labels with their texts. The sample's size bounds the broadcast."""
    texts = docs.select(F.col(id_column).alias("__doc"), F.col(text_column).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("row_key", "text", "label")


def score(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` by id with ``score``: the chance of label 1, from a sparse dot product with the weights."""
    small_batches(docs.sparkSession)
    bits = int(len(weights)).bit_length() - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                places, values = features(text, bits)
                found.append(sigmoid(float(weights[places] @ values)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.float64())],
                                             names=["doc_id", "score"])

    return docs.select(id_column, text_column).mapInArrow(rows, "doc_id long, score double")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``."""
    small_batches(docs.sparkSession)
    bits, place = int(len(weights)).bit_length() - 1, docs.columns.index(text_column)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (features(t, bits) for t in batch.column(place).to_pylist())
            keep = [sigmoid(float(weights[places] @ values)) >= threshold for places, values in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; learnt from the labels of rows that are not held out."""
    held = remainder("doc_id", 5) == 0
    found = score(docs, train(docs, labels.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "score",
                        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


@query("op4_ftrl_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
