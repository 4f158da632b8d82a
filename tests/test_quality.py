import random

import pytest

from gaugework.functions.text import lcs_length
from gaugework.operators import quality
from gaugework.sources import catalog


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_equals_table():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert lcs_length(a, b) == table_lcs(a, b)


def scores(spark, pairs, **kwargs):
    df = spark.createDataFrame([(str(i), *p) for i, p in enumerate(pairs)], "pair_id string, text string, reference string")
    return [r["rouge_l"] for r in quality.with_rouge_l(df, **kwargs).orderBy("pair_id").collect()]


def test_rouge_values(spark):
    pairs = [("the cat sat", "the cat sat"), ("a b c", "x y z"), ("", "a b"), ("a b", ""),
             ("police kill the gunman", "police killed the gunman"), ("The  CAT, sat!", "the cat sat")]
    assert scores(spark, pairs) == [1.0, 0.0, 0.0, 0.0, 0.75, 1.0]


def test_rouge_uses_whole_texts(spark):
    a = " ".join(f"w{i}" for i in range(20000))
    assert scores(spark, [(a + " tail", "tail")])[0] == pytest.approx(2 / 20002)


def test_rouge_pairs_by_id(spark):
    gen = spark.createDataFrame([("1", "m", "fp16", "a b"), ("2", "m", "fp16", "c"), ("3", "m", "fp16", "d")],
                                "pair_id string, model_name string, quantization string, text string")
    ref = spark.createDataFrame([("1", "a b"), ("2", "x")], "pair_id string, reference string")
    row = quality.rouge_l(gen, ref).first()
    assert (row["rouge_l_score"], row["num_samples"]) == (0.5, 2)


def test_accuracy_with_answer_key(spark):
    rows = [("What is the capital of France?", "It is PARIS."), ("What is the chemical symbol for gold?", "because"),
            ("How many continents are there?", "six"), ("Unknown question?", "paris")]
    df = spark.createDataFrame(rows, "prompt string, text string")
    row = quality.task_accuracy(df, catalog.answer_key(spark), []).first()
    assert (row["task_accuracy"], row["num_correct"], row["num_samples"]) == (0.6667, 2, 3)
    none = quality.task_accuracy(df.filter("prompt like 'Unknown%'"), catalog.answer_key(spark), []).first()
    assert (none["task_accuracy"], none["num_samples"]) == (0.0, 0)
    assert catalog.answer_key(spark).count() == 20


def test_consistency(spark):
    rows = [("m", "p", " yes"), ("m", "p", "yes "), ("m", "q", "a"), ("m", "q", "b"), ("m", "q", "a"), ("m", "once", "x")]
    df = spark.createDataFrame(rows, "model_name string, prompt string, text string")
    row = quality.consistency(df).first()
    assert (row["consistency_score"], row["num_consistent"], row["num_samples"]) == (0.5, 1, 2)


def test_prompts(spark):
    text = " ".join(["word"] * 120)
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id int, text string")
    rows = quality.build_prompts(df).orderBy("template_id").collect()
    assert [(r["doc_id"], r["workload"]) for r in rows] == [(1, "qa"), (1, "qa"), (1, "code_generation")]
    assert rows[0]["prompt"] == f"Q: {text}\nA:"
