"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words. The CGK embedding walks over a sequence: step j writes the word at the
walk's place and moves on or stays by a random bit that j and the word decide. Near sequences in edit
distance are so mapped to near strings in Hamming distance, as two walks meet again after an edit.
Items are dealt into classes of about the same size, and a class's walks go over windows of that size.
Bit sampling reads an embedding at a few steps; windows with the samples of an item are candidates.
``WALKS`` embeddings and ``SAMPLINGS`` samplings of each reach the target recall: as walks share the
item's edits they aren't independent, so the numbers are measured, by a test, for each size of item.
Each candidate, with some slack, is verified by its exact edit distance.

Before, windows go that can't be near an item: an item of n words with e edits keeps n - 1 - 2e pairs of
neighbouring words at least, so a window with fewer pairs of its class isn't walked. That loses nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, table, text_or_empty

WORD = re.compile(r"\w+")
#: Edits a word that an item may have, rounded down.
MAX_EDIT_RATE = 0.2
#: Embeddings of a class, samplings of each, and steps a sampling reads: 3 for items under LONG words, else 2.
WALKS, SAMPLINGS, READ, LONG = 16, 8, 3, 48
#: Steps of a walk for each word of the class's smallest item; a step moves on by half a word on average.
STEPS_A_WORD = 1.6
#: The most classes; each holds sizes up to a quarter larger than its smallest.
CLASSES = 31
#: Windows walked at once.
WINDOWS = 4096
#: Items that one pass over the documents looks for; more are looked for in more passes.
ITEMS_PER_PASS = 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def allowed(n: int, rate: float) -> int:
    return int(rate * n + 1e-9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def edit_place(item: list, text: list) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to any part of ``text``, and that part's begin and end."""
    row = np.arange(len(item) + 1)
    cost, begin = row.tolist(), [0] * (len(item) + 1)
    best = (len(item), 0, 0)
    for j, w in enumerate(text):
        diagonal, diagonal_begin = 0, j
        cost[0], begin[0] = 0, j + 1
        for i, x in enumerate(item, 1):
            c, b = diagonal + (x != w), diagonal_begin
            diagonal, diagonal_begin = cost[i], begin[i]
            if diagonal + 1 < c:
                c, b = diagonal + 1, diagonal_begin
            if cost[i - 1] + 1 < c:
                c, b = cost[i - 1] + 1, begin[i - 1]
            cost[i], begin[i] = c, b
        if cost[-1] < best[0]:
            best = (cost[-1], begin[-1], j + 1)
    return best


def least_edits(masks: dict[int, int], size: int, text: list[int]) -> int:
    """The least edit distance of an item to any part of ``text``, by bit vectors; ``masks``: a word's places in the item."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = full, 0, size, size
    for x in text:
        eq = masks.get(x, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(horizontal | up)), up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            best = min(best, score)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
    return best


class Sizes:
    """Items of about one size: walks, samplings and the items that have each sample."""

    def __init__(self, items: list[int], sizes: list[int], rate: float, seed: int) -> None:
        self.items, self.least, self.most = items, min(sizes), max(sizes)
        self.span = self.most + allowed(self.most, rate)
        self.pairs = min(max(0, n - 1 - 2 * allowed(n, rate)) for n in sizes)
        exact = allowed(self.most, rate) == 0
        rng = np.random.default_rng([seed, self.least])
        self.steps = max(1, round(STEPS_A_WORD * self.least))
        read = min(READ if self.least < LONG else READ - 1, self.steps)
        walks, samplings = (4, 2) if exact else (WALKS, SAMPLINGS)
        self.salts = rng.integers(1, 1 << 63, (walks, -(-self.steps // 64)), dtype=np.uint64) | np.uint64(1)
        self.samplings = [[np.sort(rng.choice(self.steps, read, replace=False)) for _ in range(samplings)] for _ in range(walks)]
        # What any walk reads first finds items that no sampling could read whole.
        self.samplings[0].append(np.zeros(1, np.int64))
        self.tables: list[list[tuple]] = []

    def walked(self, w: np.ndarray, starts: np.ndarray, walk: int, hashes: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """The word at each step (rows) of walks from ``starts``; ``places`` gets the places, if it is given."""
        at = starts.astype(np.int64)
        words = np.empty((self.steps, len(at)), np.int64)
        for j in range(self.steps):
            if j % 64 == 0:
                bits = _mixed(hashes * self.salts[walk, j // 64]).view(np.int64)
            x = w.take(at, mode="clip", out=words[j])
            if places is not None:
                places[j] = at
            at += (bits.take(x) >> (j % 64)) & 1
        return words

    def build(self, numbers: list[np.ndarray], hashes: np.ndarray) -> None:
        own = [numbers[k] for k in self.items]
        sizes = np.array([len(x) for x in own])
        w, ends = np.concatenate(own), np.cumsum(sizes)
        left = np.ones(len(own), bool)
        for walk, samplings in reversed(list(enumerate(self.samplings))):
            places = np.empty((self.steps, len(own)), np.int64)
            words = self.walked(w, ends - sizes, walk, hashes, places)
            found = []
            for read in samplings:
                inside = places[read[-1]] < ends
                if len(read) == 1:
                    inside = inside & left  # the last of the first walk: items not read so far
                left &= ~inside
                found.append(self._table(_key(words, read, len(hashes))[inside], np.array(self.items)[inside]))
            self.tables.insert(0, found)

    @staticmethod
    def _table(keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        shift = 64 - max(8, (16 * len(keys)).bit_length())
        filter_ = np.zeros(1 << (64 - shift), bool)
        filter_[(keys * _ODD) >> np.uint64(shift)] = True
        return keys[order], items[order], filter_

    def candidates(self, w: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and start of windows of ``starts`` that have samples of the item."""
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(starts), WINDOWS):
            some = starts[k : k + WINDOWS]
            for walk, (samplings, tables) in enumerate(zip(self.samplings, self.tables, strict=True)):
                words = self.walked(w, some, walk, hashes)
                for read, (keys, items, filter_) in zip(samplings, tables, strict=True):
                    if not len(keys):
                        continue
                    key = _key(words, read, len(hashes))
                    maybe = np.flatnonzero(filter_[(key * _ODD) >> np.uint64(65 - len(filter_).bit_length())])
                    if len(maybe):
                        lo, hi = np.searchsorted(keys, key[maybe]), np.searchsorted(keys, key[maybe], side="right")
                        n = hi - lo
                        place = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
                        found.append((items[place], np.repeat(some[maybe], n)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _key(words: np.ndarray, read: np.ndarray, base: int) -> np.ndarray:
    key = np.zeros(words.shape[1], np.uint64)
    for step in read:
        key = key * np.uint64(base) + words[step].astype(np.uint64)
    return key


class Index:
    """Items by class of size. Words that no item has share number 0."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float = MAX_EDIT_RATE, seed: int = 7) -> None:
        self.rate = edit_rate
        self.items = [(k, w) for k, t in items if (w := words_of(t))]
        self.vocabulary: dict[str, int] = {}
        for _, w in self.items:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.numbers = [np.array([self.vocabulary[x] for x in w], np.int64) for _, w in self.items]
        self.hashes = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed) for x in ["", *self.vocabulary]], np.uint64)
        self.distinct = [set(x.tolist()) for x in self.numbers]
        self.allowed = [allowed(len(x), edit_rate) for x in self.numbers]
        self._masks: dict[int, dict[int, int]] = {}
        self.classes: list[Sizes] = []
        by_size = sorted(range(len(self.items)), key=lambda k: len(self.numbers[k]))
        while by_size:
            least = len(self.numbers[by_size[0]])
            most = max(least, 5 * least // 4) if least > 5 else least
            n = next((j for j, k in enumerate(by_size) if len(self.numbers[k]) > most), len(by_size)) if len(self.classes) + 1 < CLASSES else len(by_size)
            self.classes.append(Sizes(by_size[:n], [len(self.numbers[k]) for k in by_size[:n]], edit_rate, seed))
            self.classes[-1].build(self.numbers, self.hashes)
            by_size = by_size[n:]
        # A bit for each class that has a pair of neighbouring words, by the pair's hash.
        total = sum(map(len, self.numbers))
        self.pair_shift = np.uint64(64 - min(24, max(12, (16 * total).bit_length())))
        self.pairs = np.zeros(1 << (64 - int(self.pair_shift)), np.uint32)
        for c, sizes in enumerate(self.classes):
            for k in sizes.items:
                at = self._pair_places(self.numbers[k])
                self.pairs[at] |= np.uint32(1 << c)

    def _pair_places(self, w: np.ndarray) -> np.ndarray:
        a = w.astype(np.uint64)
        return ((a[:-1] * np.uint64(len(self.hashes)) + a[1:]) * _ODD) >> self.pair_shift

    def starts(self, w: np.ndarray) -> Iterator[tuple[Sizes, np.ndarray]]:
        """For each class the places whose windows have pairs enough."""
        held = self.pairs[self._pair_places(w)]
        held[(w[:-1] == 0) | (w[1:] == 0)] = 0
        for c, sizes in enumerate(self.classes):
            if not sizes.pairs:
                yield sizes, np.flatnonzero(w)
                continue
            sums = np.concatenate([[0], np.cumsum((held >> np.uint32(c)) & np.uint32(1), dtype=np.int32)])
            span = min(sizes.span - 1, len(held))
            upto = np.concatenate([sums[span:], np.full(span, sums[-1], np.int32)])
            yield sizes, np.flatnonzero(upto[: len(sums)] - sums >= sizes.pairs)

    def matches(self, texts: list[str], group: int = 1_500_000) -> list[tuple[int, int, int, int, int]]:
        """Text number, item id, first and last word and edit distance: for each text and item the nearest, if near enough.

        Texts are searched in groups of about ``group`` characters, which bounds what is held at once.
        """
        out, k = [], 0
        while k < len(texts):
            n, size = k, 0
            while n < len(texts) and (n == k or size + len(texts[n]) <= group):
                size += len(texts[n])
                n += 1
            out += [(k + t, *rest) for t, *rest in self._matches(texts[k:n])]
            k = n
        return out

    def masks(self, item: int) -> dict[int, int]:
        if item not in self._masks:
            found: dict[int, int] = {}
            for k, x in enumerate(self.numbers[item].tolist()):
                found[x] = found.get(x, 0) | 1 << k
            self._masks[item] = found
        return self._masks[item]

    def _verify(self, pair: tuple[int, int], words: np.ndarray, first: int, last: int, best: dict) -> None:
        """Puts the place of an item's least edit distance among windows from ``first`` to ``last`` into ``best``."""
        item, text = pair
        size, most = len(self.numbers[item]), self.allowed[item]
        lo = max(0, first - 2 * most - 1)
        region = words[lo : last + size + 2 * most + 1].tolist()
        # Each word that is missing takes an edit.
        if len(self.distinct[item].difference(region)) > most or least_edits(self.masks(item), size, region) > most:
            return
        d, a, b = edit_place(self.numbers[item].tolist(), region)
        if d < best.get((text, item), (size + 1,))[0]:
            best[text, item] = (d, lo + a, lo + b)

    def _matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        get = self.vocabulary.get
        lists = [np.array(list(map(get, words_of(t), repeat(0))), np.int64) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # a zero after each text
        w = np.zeros(int(begin[-1]) + 1, np.int64)
        for b, x in zip(begin, lists, strict=False):
            w[b : b + len(x)] = x
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for sizes_, starts in self.starts(w):
            item, at = sizes_.candidates(w, starts, self.hashes)
            if not len(item):
                continue
            pairs = np.unique(item * len(w) + at)
            item, at = pairs // len(w), pairs % len(w)
            of_text = np.searchsorted(begin, at, side="right") - 1
            held: tuple[int, int] | None = None
            for i, t, from_ in zip(item.tolist(), of_text.tolist(), (at - begin[of_text]).tolist(), strict=True):
                slack = 2 * self.allowed[i] + 1
                if held == (i, t) and from_ - slack <= last + len(self.numbers[i]) + slack:
                    last = from_  # windows that overlap are verified as one
                    continue
                if held:
                    self._verify(held, lists[held[1]], first, last, best)
                held, first, last = (i, t), from_, from_
            self._verify(held, lists[held[1]], first, last, best)
        return [(t, self.items[i][0], a, b, d) for (t, i), (d, a, b) in sorted(best.items())]


def indexes(benchmark: DataFrame, edit_rate: float = MAX_EDIT_RATE, items_per_pass: int = ITEMS_PER_PASS) -> Iterator[Index]:
    """An index for each block of about ``items_per_pass`` items of ``benchmark`` (item_id, text); one at least."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).where("text != ''")
    blocks = max(1, -(-items.count() // items_per_pass))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        yield Index([(r["item_id"], r["text"]) for r in numbered.where(F.col("block") == k).select("item_id", "text").collect()], edit_rate)


def find_contamination(docs: DataFrame, benchmark: DataFrame, edit_rate: float = MAX_EDIT_RATE, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """Where ``docs`` (doc_id, text) hold items of ``benchmark`` (item_id, text), up to ``edit_rate`` edits a word of the item.

    Returns doc_id, item_id, first_word and end_word in the document, item_words and edit_distance: one
    row for each document row and item, the nearest place. Null or empty texts and items without words
    match nothing; null ids stay null; repeated rows are searched one by one; other columns are ignored.
    Whole texts are searched. Items are held in blocks of ``items_per_pass``, one pass over the documents
    each, so what the workers hold is bounded.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = None
    for index in indexes(benchmark, edit_rate, items_per_pass):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            size = {i: len(w) for i, w in index.items}
            names = ["doc_id", "item_id", "first_word", "end_word", "item_words", "edit_distance"]
            for b in batches:
                ids = b.column(0).to_pylist()
                hits = index.matches(b.column(1).to_pylist()) if index.items else []
                cols = list(zip(*((ids[t], i, a, e, size[i], d) for t, i, a, e, d in hits), strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        part = map_arrow(rows, search, "doc_id long, item_id long, first_word long, end_word long, item_words long, edit_distance long")
        found = part if found is None else found.unionByName(part)
    return found


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds a benchmark item, with the item, its place and its edit distance."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
