"""Token counts against the library's own, text by text."""

import random

import numpy as np
import pytest

from gaugework.llm import piece_counts
from gaugework.llm.queries import QUERIES
from gaugework.llm.slack_packing import tokenizer_path


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(piece_counts.MODEL))


def strange_texts(n):
    """White space of all kinds, markers, combining and wide characters, special names, digits."""
    rng = random.Random(4)
    parts = [" ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "▁", "▁▁", " ", "　", "a", "the", "The", "é", "é", "ﬁ", "中文",
             "😀", "<s>", "</s>", "<unk>", "<0x0A>", "123", "\x00", "​", "ß", "�", "İ", ".", ",", "''", "x" * 70]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("block_words,block_entries", [(400_000, 1_000_000), (50, 1_000_000), (10_000, 1)])
def test_equal_to_the_library(spark, frame, prose, odd_rows, model, block_words, block_entries):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(strange_texts(300))] + [(700 + i, prose(i, 30)) for i in range(60)]
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows]
    got = piece_counts.token_counts(frame(rows), tokenizer_path(piece_counts.MODEL), block_words=block_words,
                                    block_entries=block_entries)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_rows(spark, frame):
    assert piece_counts.token_counts(frame([]), tokenizer_path(piece_counts.MODEL)).count() == 0
    only = piece_counts.token_counts(frame([(1, None), (2, "")]), tokenizer_path(piece_counts.MODEL))
    assert sorted(map(tuple, only.collect())) == [(1, 0, 0), (2, 0, 0)]


def test_each_word_is_counted_once(spark, frame, prose):
    """Documents of four blocks that share their words: a range counts as many words as there are distinct ones."""
    rows = [(i, prose(3 + i % 2, 50)) for i in range(40)]
    blocks = piece_counts.frequency_blocks(frame(rows, parts=4))
    lists = blocks.filter("words IS NOT NULL")
    assert lists.count() == 4
    words = {w for _, t in rows for w in piece_counts.pre_tokens(t)}
    listed = [piece_counts.opened_words(r.words) for r in lists.collect()]
    assert set().union(*listed) == words
    answers = piece_counts.counted_words(lists, tokenizer_path(piece_counts.MODEL), 5).collect()
    assert sum(len(piece_counts.expanded(r.counts)) for r in answers) == sum(map(len, listed))


def test_packing_is_exact():
    words = ["\n", " a", "x", "  ", "\x00", "é"]
    assert piece_counts.opened_words(piece_counts.packed_words(words)) == words
    places, starts = np.array([3, 9, 0, 70_000, 5]), np.array([0, 2, 4])
    assert piece_counts.places_of(piece_counts.steps(places, starts), starts).tolist() == places.tolist()
    values = np.array([0, 1, 255, 256, 70_000, 2 ** 32 - 1])
    assert piece_counts.expanded(piece_counts.squeezed(values)).tolist() == values.tolist()
    assert piece_counts.expanded(piece_counts.squeezed(values[:0])).tolist() == []


def test_query(spark, model):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op13_piece_counts"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(model.encode(r.text or ""))
        assert got.pop(r.doc_id) == (len((r.text or "").encode()), n, n > 4096)
    assert not got
