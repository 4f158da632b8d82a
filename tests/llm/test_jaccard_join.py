import random
import re

import pytest

from gaugework.llm import jaccard_join
from gaugework.llm.jaccard_join import one_of_each, similar_documents
from gaugework.llm.links import components


def shingles(text, n=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n=3, percent=90):
    sets, root = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            both = len(sets[a] & sets[b])
            near = sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b])
            if near or rows[a][0] == rows[b][0]:
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(sets[i]), least[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.fixture(scope="module")
def copies(prose):
    """A large group of near copies with 0 to 4 changed words, chains, and single texts."""
    rng, rows = random.Random(4), []
    base = prose(1, 150).split()
    for i in range(70):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        rows.append((1000 - i, " ".join(words)))
    chain = prose(2, 90).split()
    for i in range(12):
        chain[7 * i] = f"link{i}"
        rows.append((2000 + i, " ".join(chain).title() if i % 2 else " ".join(chain)))
    rows += [(3000 + i, prose(100 + i, 30 + i)) for i in range(40)]
    return rows


@pytest.mark.parametrize("block_bytes", [1500, 1 << 22])
def test_components(frame, copies, odd_rows, block_bytes):
    rows = copies + odd_rows
    got = answer(similar_documents(frame(rows), block_bytes=block_bytes))
    want = brute(rows)
    # rows without an id get the size of their set only if another row has the text
    known = {t for i, t in rows if i is not None}
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]
    assert sum(g[0] is None for g in got) == sum(i is None for i, _ in rows) and known


def test_one_of_each(frame, copies, odd_rows):
    rows = copies + odd_rows
    kept = sorted(r.doc_id for r in one_of_each(frame(rows)).collect() if r.doc_id is not None)
    assert kept == sorted({c for d, _, c in brute(rows) if d is not None})
    assert one_of_each(frame(rows)).columns == frame(rows).columns


def test_empty_table(frame):
    assert similar_documents(frame([])).count() == 0


def test_components_of_links(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def pairs_verified(monkeypatch):
    """The pairs that every call of the last test gets."""
    seen, plain = [], jaccard_join.verified

    def verified(pairs, sets, percent):
        seen.append({(bytes(r.a), bytes(r.b)) for r in pairs.collect()})
        return plain(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "verified", verified)
    return seen


def test_no_pair_is_verified_twice(frame, copies, monkeypatch):
    seen = pairs_verified(monkeypatch)
    assert answer(similar_documents(frame(copies))) == brute(copies)
    assert len(seen) == 2 and not seen[0] & seen[1]


def test_templated_texts_make_few_pairs(frame, prose, monkeypatch):
    """One frame, six slots of eight values: all share frequent n-grams, and hardly any two are similar."""
    rng, frames = random.Random(5), [prose(60 + k, 9) for k in range(7)]
    values = [[prose(1000 + 10 * s + v, 4) for v in range(8)] for s in range(6)]
    rows = [(i, " ".join(p for s in range(6) for p in (frames[s], rng.choice(values[s]))) + " " + frames[6]) for i in range(500)]
    seen = pairs_verified(monkeypatch)
    assert answer(similar_documents(frame(rows))) == brute(rows)
    assert sum(map(len, seen)) < 3 * len(rows) and not seen[0] & seen[1]


@pytest.mark.parametrize("n,percent", [(5, 80), (1, 60), (3, 100)])
def test_other_sizes_and_similarities(frame, copies, odd_rows, n, percent):
    rows = copies + [(i, t) for i, t in odd_rows if i != 4]
    assert answer(similar_documents(frame(rows), n, percent)) == brute(rows, n, percent)
