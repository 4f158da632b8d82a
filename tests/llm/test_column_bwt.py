import hashlib
import random

import numpy as np
import pytest

from gaugework.llm.column_bwt import LONGEST, insert_columns, least_documents, repeats_removed

W = 50


def brute(rows):
    """Straight from the definition, window by window."""
    least = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for k in range(len(raw) - W + 1) if i is not None else ():
            piece = raw[k:k + W]
            least[piece] = min(least.get(piece, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - W + 1) if i is not None else ():
            if least[raw[k:k + W]] < i:
                gone[k:k + W] = b"\1" * W
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), len([x for x in gone.split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def copies(prose):
    rng, rows = random.Random(1), []
    shared = [prose(1000 + k, 30) for k in range(6)]
    for i in range(120):
        text = prose(i, rng.randrange(5, 80))
        for _ in range(rng.randrange(3)):
            piece, at = rng.choice(shared), rng.randrange(len(text))
            cut = rng.randrange(40, len(piece))
            text = text[:at] + piece[:cut] + text[at:]
        rows.append((i * 7 % 131, text))
    rows += [(200 + k, rows[k][1]) for k in range(5)] + [(300, "ab" * 400), (301, "ba" * 90), (302, "x" * 49)]
    return rows


def test_matches_the_definition(frame, copies, odd_rows):
    rows = copies + [(1000 + i if i else i, t) for i, t in odd_rows]
    assert answer(repeats_removed(frame(rows))) == brute(rows)


@pytest.mark.parametrize("sizes", [{"block_bytes": 500, "collection_bytes": 1000}, {"block_bytes": 2000, "hot": 2}])
def test_sizes_do_not_change_results(frame, copies, sizes):
    assert answer(repeats_removed(frame(copies), **sizes)) == brute(copies)


@pytest.mark.parametrize("hot", [3, 8, 20])
def test_frequent_texts_with_edited_tails(frame, prose, hot):
    """A window beside a frequent string meets its equals where what lies on the mark's other side is rare."""
    rng, rows = random.Random(6), []
    licence = prose(1, 40)
    for i in range(40):
        cut = rng.randrange(len(licence) // 2, len(licence))
        rows.append((3 * i, licence + " " + prose(50 + i // 3, 20)))
        rows.append((3 * i + 1, licence[:cut] + "#" + licence[cut + 1:] + " " + prose(50 + i // 3, 20)))
        rows.append((3 * i + 2, prose(900 + i, 12) + licence[cut - rng.randrange(20, 90):] + " " + prose(50 + i // 2, 20)))
    assert answer(repeats_removed(frame(rows), hot=hot, collection_bytes=300)) == brute(rows)


def test_empty_table(frame):
    assert repeats_removed(frame([])).count() == 0


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(15):
        n = int(rng.integers(1, 30))
        base, rows = rng.integers(97, 99, 200).astype(np.uint8), np.zeros((n, LONGEST + 1), np.uint8)
        for i in range(n):
            windows = int(rng.integers(1, LONGEST - W + 2))
            at = int(rng.integers(0, 200 - windows - 49))
            rows[i, : windows + 49], rows[i, LONGEST] = base[at:at + windows + 49], windows
        sizes = rows[:, LONGEST].astype(int) + W - 1
        owner, depth, common = insert_columns(rows[:, :LONGEST], sizes)
        suffixes = [bytes(rows[o, s - d:s]) for o, d, s in zip(owner, depth, sizes[owner])]
        assert suffixes == sorted(suffixes) and len(suffixes) == sizes.sum() + n
        for a, b, c in zip(suffixes, suffixes[1:], common[1:]):
            assert c == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        docs, least = rng.integers(0, 9, n), {}
        pieces = [(i, bytes(rows[i, k:k + W])) for i in range(n) for k in range(rows[i, LONGEST])]
        for i, p in pieces:
            least[p] = min(least.get(p, 99), docs[i])
        assert least_documents(rows, docs).tolist() == [least[p] for _, p in pieces]
