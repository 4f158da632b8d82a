"""Benchmark decontamination: passages within a given edit distance of a benchmark item.

Texts are read as lower-cased words. A CGK walk reads a window of words by random steps: at step j it writes the word it
stands on and moves on if a random bit of (j, word) says so, so that walks over similar windows meet again after an edit,
and the edit distance of windows becomes the Hamming distance of what was written. A repetition of the LSH samples a few
of the steps; windows that agree on all of them are candidates.

Every word of every text starts a window, and so does every word of an item from which the sampled steps end within the
item; a start anywhere makes step 0 as good as any other first sample, so all repetitions take it. Sampled steps lie close
together or further apart, for windows of the sizes of short and long items. One repetition's walk always moves, so that
an exact copy of any searched item is found. Items of at most ``SHORT_WORDS`` words give too few different samples, so they
are found without chance: of one more parts than edits are allowed, at least one is left whole, and each place that holds a
part is a candidate if enough of the item's words lie around it. Windows are followed sample by sample and dropped once the words so far
begin no item's key, which changes no result. Candidates are compared by exact edit distance (bit-parallel, the item
against any stretch of the region). Items of one to four words allow no edit, so their one part is the item itself.

Items are taken in blocks of bounded size, and each block reads the documents once; a block is all that a task gets
besides its documents. Defined cases: null texts and texts without words match nothing, and neither do null items and
items without words; texts of any length are searched whole, some megabytes of them at a time or one text; items that repeat
are each reported; repeated rows are answered each; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import documents, remembered, small_batches, table
from gaugework.llm.registry import query

# Items of up to so many words are searched by their parts.
SHORT_WORDS = 15
SIMILARITY = 0.8
SAMPLED = 5
# Sampled steps must read so many different places of an item, or its key would be a few frequent words.
DIFFERENT = 4
# Repetitions by the smallest and largest distance between sampled steps; a walk reads a word in about two steps.
REPETITIONS = [(1, 1, 1), (2, 3, 4), (3, 6, 4)]
SEED = 77
BLOCK_ITEMS, BLOCK_CHARS = 1000, 4_000_000
PORTION_CHARS = 4_000_000
NO_WORD = np.uint64(0)
AROUND_ROWS = 1 << 16  # candidates whose surroundings are compared at once

FOUND = "doc_id long, item_id long, edits int, item_words int, start_word long, end_word long"

_CHARS: list[np.ndarray] = []


def char_table() -> np.ndarray:
    """Per code point, a random odd number of its lower-case form if it is a letter or digit, else 0. Made once a worker."""
    if not _CHARS:
        lower = np.zeros(0x110000, np.uint64)
        for i in range(0x110000):
            c = chr(i)
            if c.isalnum():
                lower[i] = ord(c.lower()[0])
        _CHARS.append(np.where(lower > 0, mix64(lower + np.uint64(SEED)) | np.uint64(1), np.uint64(0)))
    return _CHARS[0]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """Words of each text as 64-bit numbers, equal for equal lower-cased words and never 0."""
    raw = [(t or "").encode("utf-32-le", "replace") for t in texts]
    chars = char_table()[np.minimum(np.frombuffer(b"".join(r + b"\0\0\0\0" for r in raw), np.uint32), 0x10FFFF)]
    inside = chars != 0
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    chars = chars[inside]
    firsts = np.cumsum(inside)[begins] - 1 if len(begins) else begins
    lengths = np.diff(np.append(firsts, len(chars)))
    place = np.arange(len(chars)) - np.repeat(firsts, lengths)
    if len(begins):
        longest = int(lengths.max())
        powers = np.cumprod(np.full(longest, 0x5851F42D4C957F2D, np.uint64))
        words = mix64(np.add.reduceat(chars * powers[place], firsts)) | np.uint64(1)
    else:
        words = np.zeros(0, np.uint64)
    ends = np.searchsorted(begins, np.cumsum([len(r) // 4 + 1 for r in raw]))
    return np.split(words, ends[:-1]) if len(raw) else []


def bits_of(words: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits per word: the moves of a walk, one for each step. All ones for seed 0."""
    return mix64(words ^ np.uint64(seed)) if seed else np.full(len(words), ~np.uint64(0))


def longer_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (key ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def allowed(n_words: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n_words + 1e-9)


def repetitions(seed: int = SEED, plan: list = REPETITIONS, sampled: int = SAMPLED) -> list[tuple[int, list[int]]]:
    """(seed of the walk's bits, sampled steps from 0 on) of each repetition; seed 0 always moves."""
    rng = np.random.default_rng(seed)
    out = []
    for low, high, times in plan:
        for _ in range(times):
            steps = np.cumsum([0, *rng.integers(low, high + 1, sampled - 1)]).tolist()
            out.append((int(rng.integers(1, 2**63)) if high > 1 else 0, steps))
    return out


def run_keys(x: np.ndarray, length: int) -> np.ndarray:
    """Key of the ``length`` words from each place on; past the end there are none."""
    key = np.zeros(len(x), np.uint64)
    for j in range(length):
        key = longer_key(key, np.concatenate([x[j:], np.zeros(min(j, len(x)), np.uint64)]))
    return key


class Index:
    """Keys of a block's items for all repetitions, and of the parts of short items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY) -> None:
        read = [(i, w) for (i, _), w in zip(items, words_of([t for _, t in items])) if len(w)]
        self.ids, arrays = [i for i, _ in read], [w for _, w in read]
        self.lengths = [len(w) for w in arrays]
        self.edits = [allowed(n, similarity) for n in self.lengths]
        self.patterns = [self.masks(w.tolist()) for w in arrays]
        if not arrays:
            return
        pad = np.zeros(64, np.uint64)
        x = np.concatenate([p for a in arrays for p in (a, pad)])
        self.owner = np.repeat(np.arange(len(arrays)), self.lengths)
        self.place = np.concatenate([np.arange(n) for n in self.lengths])
        at = np.cumsum([0, *(n + len(pad) for n in self.lengths)])[self.owner] + self.place
        self.first = self.filter(longer_key(np.zeros(len(at), np.uint64), x[at]))
        self.tables = []
        for seed, steps in repetitions():
            bits, p, key, keys, places = bits_of(x, seed), at.copy(), np.zeros(len(at), np.uint64), [], []
            for before, step in zip([0, *steps], steps):
                for j in range(before, step):
                    p += ((bits[p] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
                key = longer_key(key, x[p])
                keys.append(key)
                places.append(p.copy())
            moved = (np.diff(places, axis=0) > 0).sum(axis=0) + 1
            own = np.flatnonzero((x[p] != NO_WORD) & (moved >= DIFFERENT))
            ordered = own[np.argsort(keys[-1][own], kind="stable")]
            self.tables.append((seed, steps, [self.filter(k[own]) for k in keys[1:-1]], keys[-1][ordered], ordered))
        self.parts = self.short_parts(arrays)

    def short_parts(self, arrays: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By length of part: a filter of the keys, the keys in order, and the item and first word of each."""
        short = [i for i, n in enumerate(self.lengths) if n <= SHORT_WORDS]
        self.short_words = np.zeros((len(arrays), SHORT_WORDS), np.uint64)
        found: dict[int, list[tuple[int, int]]] = {}
        for i in short:
            self.short_words[i, :self.lengths[i]] = arrays[i]
            cuts = np.linspace(0, self.lengths[i], self.edits[i] + 2).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):
                found.setdefault(b - a, []).append((i, a))
        out = []
        for length, rows in found.items():
            item, word = np.array(rows).T
            key = np.array([run_keys(arrays[i][a:a + length], length)[0] for i, a in rows], np.uint64)
            order = np.argsort(key, kind="stable")
            out.append((length, self.filter(key), key[order], item[order], word[order]))
        return out

    def short_candidates(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """(place in x, word of the item, item) where a part of a short item lies among enough of its words."""
        lengths, edits = np.array(self.lengths), np.array(self.edits)
        for length, seen, last, item, word in self.parts:
            key = run_keys(x, length)
            place = np.flatnonzero(seen[(key & np.uint64(len(seen) - 1)).astype(np.int64)])
            low, high = np.searchsorted(last, key[place], "left"), np.searchsorted(last, key[place], "right")
            ends = np.cumsum(high - low)
            for start in range(0, int(ends[-1]) if len(ends) else 0, AROUND_ROWS):
                nth = np.arange(start, min(start + AROUND_ROWS, int(ends[-1])))
                hit = np.searchsorted(ends, nth, "right")
                which = high[hit] - (ends[hit] - nth)
                at, i, w = place[hit], item[which], word[which]
                slack, n = edits[i], lengths[i]
                begin = at - w - slack
                common = np.zeros(len(at), np.int64)
                around = np.arange(SHORT_WORDS + 2 * int(slack.max()))
                spots = begin[:, None] + around
                inside = (spots >= 0) & (spots < len(x)) & (around < (n + 2 * slack)[:, None])
                near = np.where(inside, x[np.clip(spots, 0, len(x) - 1)], NO_WORD)
                for j in range(SHORT_WORDS):
                    own = self.short_words[i, j]
                    common += (own != NO_WORD) & (near == own[:, None]).any(axis=1)
                kept = common >= n - slack
                yield np.stack([at, w, i])[:, kept]

    @staticmethod
    def filter(keys: np.ndarray) -> np.ndarray:
        """Whether some key ends in these bits; at most a few per cent are set."""
        size = 1 << max(16, min(24, int(len(keys) * 16).bit_length()))
        bits = np.zeros(size, bool)
        bits[(keys & np.uint64(size - 1)).astype(np.int64)] = True
        return bits

    @staticmethod
    def masks(words: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in x, word of the item, item) of windows that agree with one of an item in some repetition."""
        found = []
        key = longer_key(np.zeros(len(x), np.uint64), x)
        starts = np.flatnonzero(self.first[(key & np.uint64(len(self.first) - 1)).astype(np.int64)] & (x != NO_WORD))
        first, last_place = key[starts], len(x) - 1
        for seed, steps, seen, last, owner in self.tables:
            if not len(last):
                continue
            bits, p, start, key = bits_of(x, seed), starts, starts, first
            for c in range(1, len(steps)):
                for j in range(steps[c - 1], steps[c]):
                    p = np.minimum(p + ((bits[p] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64), last_place)
                key = longer_key(key, x[p])
                if c <= len(seen):
                    near = seen[c - 1]
                    keep = np.flatnonzero(near[(key & np.uint64(len(near) - 1)).astype(np.int64)])
                    p, start, key = p[keep], start[keep], key[keep]
            low, high = np.searchsorted(last, key, "left"), np.searchsorted(last, key, "right")
            hit = np.flatnonzero(high > low)
            times = (high - low)[hit]
            which = np.repeat(low[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())
            anchor = owner[which]
            found.append(np.stack([np.repeat(start[hit], times), self.place[anchor], self.owner[anchor]]))
        found += self.short_candidates(x)
        hits = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        return hits[0], hits[1], hits[2]

    def best(self, item: int, words: list[int], low: int, high: int) -> tuple[int, int] | None:
        """(edits, end) of the stretch of ``words[low:high]`` nearest to the item, if near enough; the first of equals."""
        n, masks = self.lengths[item], self.patterns[item]
        top, every = 1 << (n - 1), (1 << n) - 1
        plus, minus, edits, found = every, 0, n, None
        for at in range(low, high):
            eq = masks.get(words[at], 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(xh | plus) & every, plus & xh
            if up & top:
                edits += 1
            elif down & top:
                edits -= 1
            up, down = up << 1 & every, down << 1 & every
            plus, minus = down | ~(xv | up) & every, up & xv
            if edits <= self.edits[item] and (found is None or edits < found[0]):
                found = (edits, at + 1)
        return found

    def search(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        """Per text, (item id, edits, words, start, end) of the items it holds; the end is where the item's last word lies."""
        hits: list[dict[int, tuple]] = [{} for _ in texts]
        if self.ids:
            lists = words_of(texts)
            pad = np.zeros(1, np.uint64)
            x = np.concatenate([p for w in lists for p in (w, pad)] or [pad])
            begins = np.cumsum([0, *(len(w) + 1 for w in lists)])
            place, word, item = self.candidates(x)
            text = np.searchsorted(begins, place, "right") - 1
            tried = np.unique(np.stack([text, item, place - begins[text] - word]), axis=1) if len(text) else []
            held, words = -1, []
            for d, i, start in zip(*(t.tolist() for t in tried)):
                if d != held:
                    held, words = d, lists[d].tolist()
                self.verify(hits[d], i, words, start)
        for found in hits:
            yield sorted((self.ids[i], *h) for i, h in found.items())

    def verify(self, hits: dict[int, tuple], item: int, words: list[int], start: int) -> None:
        n, slack = self.lengths[item], self.edits[item]
        if item in hits and hits[item][0] == 0:
            return
        found = self.best(item, words, max(0, start - slack), min(len(words), start + n + 2 * slack))
        if found and (item not in hits or found < (hits[item][0], hits[item][3])):
            hits[item] = (found[0], n, max(0, found[1] - n), found[1])


def blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    """Items by blocks of at most BLOCK_ITEMS items and about BLOCK_CHARS characters; one block is held at a time."""
    block, chars = [], 0
    rows = items.select(F.col(id_column).cast("long"), text_column).filter(F.col(text_column).isNotNull())
    for item_id, text in rows.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((item_id, text))
        chars += len(text)
    if block:
        yield block


def index_of(block: list[tuple[int, str]], similarity: float) -> Index:
    """The block's index, made once per worker."""
    key = zlib.crc32(repr((block, similarity)).encode("utf-8", "replace"))
    return remembered(("leaks", key), lambda: Index(block, similarity))


def portions(texts: list[str | None]) -> Iterator[slice]:
    """Stretches of a batch with about PORTION_CHARS characters, at least one text each."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t or "") > PORTION_CHARS:
            yield slice(start, i)
            start, chars = i, 0
        chars += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id",
          text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """A row per document row and item that it holds: fewest edits found, and the words where that stretch lies."""
    small_batches(docs.sparkSession)

    def find(block: list[tuple[int, str]]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(block, similarity)
            for batch in batches:
                texts, ids, out = batch.column(1).to_pylist(), batch.column(0).to_pylist(), []
                for part in portions(texts):
                    for doc_id, found in zip(ids[part], index.search(texts[part])):
                        out += [(doc_id, *f) for f in found]
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i in (2, 3) else pa.int64()) for i, c in enumerate(columns)],
                    names=["doc_id", "item_id", "edits", "item_words", "start_word", "end_word"])

        return rows

    found = docs.sparkSession.createDataFrame([], FOUND)
    for i, block in enumerate(blocks(items, item_column, item_text_column)):
        own = docs.select(id_column, text_column).mapInArrow(find(block), FOUND)
        found = own if i == 0 else found.unionByName(own)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text_column: str = "text",
                  item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_column)

    def clean(block: list[tuple[int, str]]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(block, similarity)
            for batch in batches:
                texts, keep = batch.column(place).to_pylist(), []
                for part in portions(texts):
                    keep += [not found for found in index.search(texts[part])]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rows

    for block in blocks(items, item_column, item_text_column):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs


@query("op9_edit_leaks")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
