import re
import zlib

import numpy as np
import pytest

from gaugework.llm import ftrl_quality, hyper_language
from gaugework.llm.compression_bands import Bands, measure, quality_rules, repeated_words
from gaugework.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op2_hyper_language"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, frame, odd_rows):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"),
                                   ("no language", None), ("123", "xx")], "text string, lang string")
    models = hyper_language.train(train)
    assert sorted(models) == ["de", "en"]
    got = hyper_language.predict(frame(odd_rows + [(50, "the dog"), (51, "12 !?")]), models).collect()
    answers = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(odd_rows) + 2
    assert answers[1] == answers[2] == answers[8] == answers[51] == ("und", 0.0) and answers[50][0] == "en"
    assert {r.lang_pred for r in hyper_language.predict(frame(odd_rows), {}).collect()} == {"und"}
    assert hyper_language.predict(frame([]), models).count() == 0


def test_bundle_is_the_sum_of_bound_vectors():
    v = hyper_language.Vectors(dimensions=64, keep=5)
    keys, counts = v.grams("Ab ab, cab")
    letters = {c: v.letter(ord(c)).astype(int) for c in "abc "}
    text, want = " ab ab cab ", np.zeros(64)
    for i in range(len(text) - 2):
        want += letters[text[i]] * np.roll(letters[text[i + 1]], 1) * np.roll(letters[text[i + 2]], 2)
    assert np.allclose(v.bundle(keys, counts), want)


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op4_ftrl_quality"](spark, SF).toPandas().merge(
        spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")


def test_quality_held_out(scored):
    held = scored[scored.held_out]
    assert set(held.doc_id) == {d for d in scored.doc_id if zlib.crc32(str(d).encode()) % 5 == 0}
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert (scored.predicted == (scored.score >= 0.3)).all() and (held[held.quality == 1].predicted == 1).mean() > 0.98


def test_quality_odd_rows(spark, frame, odd_rows):
    labels = spark.createDataFrame([(5, 1), (5, 1), (7, 0), (None, 1), (9, None), (77, 1)], "doc_id long, quality int")
    weights = ftrl_quality.train(frame(odd_rows), labels)
    got = ftrl_quality.score(frame(odd_rows), weights).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    kept = ftrl_quality.accepted(frame(odd_rows), weights, 0.0)
    assert kept.count() == len(odd_rows) and kept.columns == frame(odd_rows).columns
    none = ftrl_quality.train(frame(odd_rows), labels.limit(0))
    assert {r.score for r in ftrl_quality.score(frame(odd_rows), none).collect()} == {0.5}


def test_features_are_hashed_counts():
    places, values = ftrl_quality.features("Word word, word")
    assert places[0] == 0 and (np.diff(places) > 0).all() and np.isclose((values[1:] ** 2).sum(), 1)
    assert ftrl_quality.features(None)[0].tolist() == ftrl_quality.features("")[0].tolist() == [0]


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(twice), n < 20 or 100 * len(twice) > 30 * n)


def test_rules(frame, prose, odd_rows):
    again = prose(3, 30)
    rows = [r for r in odd_rows if r[0] != 4] + [(20, f"{again}\n{again}\n x\n x\n"), (21, "a b " * 40), (22, prose(4, 300)),
                                                (23, "<p>#1|2</p> \x1c\x85 w" * 9), (24, prose(1, 12) + " " + again * 3)]
    got = sorted((tuple(r[:7]) for r in quality_rules(frame(rows)).collect()), key=str)
    assert got == sorted(((i, *brute_rules(t)) for i, t in rows), key=str)
    assert quality_rules(frame([])).count() == 0


def test_windows_of_all_texts():
    rng = np.random.default_rng(5)
    for _ in range(60):
        words = [b"%d" % w for w in rng.integers(0, 2, int(rng.integers(0, 40)))]
        text = b" ".join(words).decode()
        assert repeated_words(words) == brute_rules(text)[4]


def test_bands(prose):
    bands, rng = Bands(), np.random.default_rng(1)
    assert measure(prose(1, 400), bands)[6] and measure(prose(2, 9000), bands)[6]
    noise = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 6)) for _ in range(400))
    assert not measure(noise, bands)[6]
    lines = "".join(f"{prose(7, 7)} {i}\n" for i in range(400))
    count, *_, failed, kept, ratio, chunks, bad = measure(lines, bands)
    assert not kept and ratio > 4


def test_noise_at_the_end_is_judged_as_at_the_start(prose):
    rng = np.random.default_rng(2)
    noise = " ".join("".join(chr(c) for c in rng.integers(33, 127, 60)) for _ in range(62))
    words = prose(1, 900)[:3900]
    for text in (f"{words} {noise}", f"{noise} {words}"):
        *_, failed, kept, ratio, chunks, bad = measure(text, Bands())
        assert 4096 < len(text.encode()) < 8192 and 1.4 <= ratio <= 3.8
        assert (failed, kept, chunks, bad) == (False, False, 2, 1)
    assert Bands().judge(prose(1, 3000).encode()[:8192])[1:3] == (2, 0)


def test_clean_documents_stay(scored, spark):
    rules = QUERIES["op3_compression_bands"](spark, SF).toPandas().merge(scored[["doc_id", "quality"]], on="doc_id")
    clean = rules[(rules.quality == 1) & ~rules.base_failed]
    assert clean.kept.all()
