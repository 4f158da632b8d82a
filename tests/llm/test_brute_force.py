"""Predictions, updates, verdicts and partitions recomputed step by step in plain Python."""

import math
import random

import numpy as np
import pytest
import zstandard

from gaugework.llm import compression_bands, ftrl_quality, hyper_language
from gaugework.llm.differencing import difference


def plain_document(v, text):
    """The bundle of a text, n-gram by n-gram, as a unit vector."""
    letters = " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split())
    spaced, out = f" {letters} ", np.zeros(v.dimensions)
    for i in range(len(spaced) - 2):
        gram = np.ones(v.dimensions)
        for place, c in enumerate(spaced[i:i + 3]):
            gram *= np.roll(v.letter(ord(c)).astype(float), place)
        out += gram
    return out / np.linalg.norm(out)


def test_language_is_the_nearest_prototype(spark, prose):
    rng = random.Random(3)
    rows = [(("the cat and the dog ran " * 3) + prose(i, 5), "en") for i in range(4)] + [
        (("der Hund und die Katze lief " * 3) + prose(i, 5), "de") for i in range(4)] + [
        (("le chat et le chien courait " * 3) + prose(i, 5), "fr") for i in range(4)]
    rng.shuffle(rows)
    models = hyper_language.train(spark.createDataFrame(rows, "text string, lang string"), dimensions=256)
    v = hyper_language.Vectors(dimensions=256)
    # documents are scaled by the length that their vectors are expected to have: the root of the squared counts
    sums = {}
    for text, lang in rows:
        keys, counts = v.grams(text)
        sums[lang] = sums.get(lang, 0) + v.bundle(keys, counts).astype(float) / math.sqrt((counts ** 2).sum())
    for lang, own in models.items():
        cosine = own @ sums[lang] / np.linalg.norm(own) / np.linalg.norm(sums[lang])
        assert cosine > 0.999
    mean = np.mean([m / np.linalg.norm(m) for m in models.values()], axis=0)
    texts = ["the dog and the cat", "die Katze und der Hund", "le chien et le chat", prose(80, 12)]
    got = hyper_language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), models, dimensions=256).collect()
    for r in got:
        doc = plain_document(v, texts[r.doc_id]) - mean
        doc /= np.linalg.norm(doc)
        cosines = {}
        for lang, own in models.items():
            centred = own / np.linalg.norm(own) - mean
            cosines[lang] = doc @ centred / np.linalg.norm(centred)
        assert r.lang_pred == max(sorted(cosines), key=cosines.get)
        assert r.score == pytest.approx(max(0.0, max(cosines.values())), abs=2e-3)


def test_ftrl_updates_and_scores(prose):
    """The published per-coordinate recurrence, one number at a time."""
    bits, rng = 10, random.Random(4)
    alpha, beta, l1, l2 = (getattr(ftrl_quality, n) for n in ("ALPHA", "BETA", "L1", "L2"))
    model, z, n = ftrl_quality.Ftrl(bits), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    texts = [prose(rng.randrange(6), 12) + (" good words" if k % 2 else " bad words") for k in range(40)]
    for k, text in enumerate(texts):
        places, values = ftrl_quality.features(text, bits)
        x = dict(zip(places.tolist(), values.tolist()))
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, v in x.items():
            w, g = weight(i), (p - k % 2) * v
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w
            n[i] = old + g * g
        model.update(places, values, k % 2)
    every = np.arange(2 ** bits)
    assert np.allclose(model.weights(every), [weight(i) for i in every.tolist()])
    for text in texts[:4] + ["", "never seen"]:
        places, values = ftrl_quality.features(text, bits)
        dense = np.zeros(2 ** bits)
        dense[places] = values
        score = ftrl_quality.sigmoid(float(model.weights(places) @ values))
        assert score == pytest.approx(1 / (1 + math.exp(-(dense @ model.weights(every)))))


def verdict(text):
    """The documented bands, restated."""
    raw = text.encode()
    packed = lambda b: len(zstandard.ZstdCompressor(level=compression_bands.LEVEL).compress(b))
    if not raw:
        return True
    low, high = next((a, b) for size, a, b in compression_bands.BANDS if len(raw) <= size)
    chunks = []
    if len(raw) > 4096:
        chunks = [raw[i:i + 4096] for i in range(0, len(raw) - 4096, 4096)] + [raw[-4096:]]
    bad = [c for c in chunks if not 1.2 <= 4096 / packed(c) <= 4.0]
    return low <= len(raw) / packed(raw) <= high and len(bad) <= len(chunks) / 4


def test_kept_follows_the_bands(prose):
    rng, bands = random.Random(6), compression_bands.Bands()
    texts = [prose(i, rng.choice([25, 60, 300, 900, 2500])) for i in range(25)]
    texts += [t + " " + "".join(chr(rng.randrange(33, 127)) for _ in range(rng.choice([40, 3000, 9000]))) for t in texts[:12]]
    texts += [t + (" again and again" * rng.choice([5, 400])) for t in texts[:8]] + ["", prose(9, 30_000)]
    for text in texts:
        *_, failed, kept, _, _, _ = compression_bands.measure(text, bands)
        assert kept == (not failed and verdict(text))


def plain_difference(weights, shards):
    """Sums of the partition that differencing leaves, on lists searched from end to end; ties go by age."""
    partial = [[w] + [0] * (shards - 1) for w in sorted(weights, reverse=True)]
    while len(partial) > 1:
        spread = [p[0] - p[-1] for p in partial]
        first = spread.index(max(spread))
        a = partial.pop(first)
        spread.pop(first)
        b = partial.pop(spread.index(max(spread)))
        partial.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return partial[0] if partial else []


@pytest.mark.parametrize("shards", [2, 3, 4, 16])
def test_differencing_step_by_step(shards):
    rng = random.Random(shards)
    for _ in range(40):
        weights = {f"i{k}": rng.choice([rng.randrange(1, 9), rng.randrange(1, 500)]) for k in range(rng.randrange(1, 30))}
        of = difference(weights, shards)
        sums = [sum(w for i, w in weights.items() if of[i] == s) for s in range(shards)]
        assert set(of) == set(weights) and sorted(sums, reverse=True) == plain_difference(list(weights.values()), shards)
