"""Toxic passages by maximum-scoring segment search.

Fitting: in how many toxic and clean labelled documents each word, and each start of a word, occurs. A
toxic document's words are a mixture of toxic and plain ones, which EM takes apart. How much likelier a
unit is among toxic words than among plain ones, its log-odds, has a Dirichlet prior of half a document
and is drawn to the log-odds of its longest known start, from which it departs only as far as its counts
surely do; so rare and new words have the odds of their starts. A passage is taken to hold a share ``PLAIN`` of plain words, so a word of odds r scores log(PLAIN + (1 - PLAIN) r):
every word has a signed log-odds, whose mean over clean text is below 0, and plain text ends a passage.

Scoring: a linear-time scan over a document's words finds all maximal scoring segments. Under the clean
texts' distribution of scores, the best segment of n words follows an extreme-value law, so a segment
of score S has the expected count E = K n exp(-lambda S); lambda is the root of that distribution's
moment equation, K comes from the best segments of clean labelled texts. Segments with E below a limit
are the significant passages. Their evidence, -log E, is summed and, with that of the best segment,
calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, stored, table, text_or_empty

WORD = re.compile(r"\w+")
#: Starts of words of these lengths are units besides whole words.
START_LENGTHS = range(4, 9)
#: The most labelled documents a model is fitted on, those with the smallest hashes of their ids, and the most rows of one id.
MAX_LABELLED, ROWS_OF_AN_ID = 20_000, 4
#: Units in fewer labelled documents, or in no toxic one and fewer clean ones, have the odds of their starts.
MIN_DOCUMENTS, MIN_CLEAN = 4, 24
#: Standard errors that a unit's log-odds must be apart from its prior's, the log-odds of words without a known start.
Z, UNKNOWN_LOG_ODDS = 3.0, -2.0
#: The share of plain words in a passage, the greatest score, the expected count of a significant passage.
PLAIN, MAX_SCORE, MAX_E = 0.3, 8.0, 0.05
EM_STEPS = 30
#: Scores of words that a worker keeps.
CACHED_WORDS = 300_000


def units(word: str) -> list[str]:
    """A word, and its starts marked by a star, the longest first."""
    return [word, *(word[:n] + "*" for n in reversed(START_LENGTHS) if n < len(word))]


def lowered(text: str) -> str:
    """``text`` in lower case, character by character where that keeps its length."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class Model:
    """Scores of units, the extreme-value law, and weights of a constant, all evidence and the best segment's."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = -1.0
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    _words: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, word: str) -> float:
        return next((self.scores[u] for u in units(word) if u in self.scores), self.other)

    def word_scores(self, words: list[str]) -> list[float]:
        known = self._words
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            new = {w: self.score(w) for w in set(words) if w not in known}
            got = [new[w] if w in new else known[w] for w in words]
            if len(known) + len(new) > CACHED_WORDS:
                known.clear()
            known.update((w, s) for w, s in new.items() if len(w) < 40)
            return got

    def passages(self, text: str) -> tuple[list[tuple[int, int, float, float]], tuple[float, float]]:
        """Significant passages (start, end in characters, score, expected count), and a text's evidence: all, and the best segment's."""
        lower = lowered(text)
        scores = self.word_scores(WORD.findall(lower))
        if not scores or not self.scores:
            return [], (0.0, -30.0)
        base = math.log(self.k * len(scores))
        sums = np.cumsum(np.array(scores))
        best = float((sums - np.minimum(np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]])), 0.0)).max())
        top = max(-30.0, min(30.0, self.lam * best - base))
        if math.exp(-top) > MAX_E:
            return [], (0.0, top)
        found = [(a, b, s, math.exp(max(-700.0, min(50.0, base - self.lam * s)))) for a, b, s in maximal_segments(scores)]
        found = [x for x in found if x[3] <= MAX_E]
        spans = [m.span() for m in WORD.finditer(lower)]
        evidence = sum(self.lam * s - base for _, _, s, _ in found)
        return [(spans[a][0], spans[b][1], s, e) for a, b, s, e in found], (evidence, top)

    def probability(self, evidence: tuple[float, float]) -> float:
        x = sum(w * f for w, f in zip(self.weights, features(evidence), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def features(evidence: tuple[float, float]) -> tuple[float, float, float]:
    return 1.0, math.log1p(evidence[0]), max(-3.0, min(evidence[1], -math.log(MAX_E))) / 3


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in linear time.

    Each candidate keeps the cumulative score before it (left) and through it (right). A new positive
    score joins back to the nearest candidate with a smaller left whose right is smaller too. Candidates
    link to the nearest earlier one with a smaller left, so that each is passed over at most once.
    """
    kept: list[list] = []  # first, last, left, right, link
    total = 0.0
    for k, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        now = [k, k, total, total + s, -1]
        total += s
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= now[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= now[3]:
                break
            now[0], now[2] = kept[j][0], kept[j][2]
            del kept[j:]
            j = len(kept) - 1
        now[4] = j
        kept.append(now)
    return [(a, b, right - left) for a, b, left, right, _ in kept]


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic (1) and clean (0) documents of a batch each unit occurs; documents by label under an empty unit."""
    for b in batches:
        seen = (Counter(), Counter())
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(WORD.findall(lowered(text)))
            seen[label].update({u for w in words for u in units(w)})
            seen[label][""] += 1
            seen[label]["*"] += len(words)
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[u] for u in names], pa.int64()) for c in seen)], ["unit", "clean", "toxic"])


def labelled_texts(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """text and label of at most ``max_labelled`` labelled documents outside the held-out fifth, up to ``ROWS_OF_AN_ID`` rows each."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 != 0").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))  # a grouped limit cuts repeats before the shuffle
    return stored(rows.withColumn("nth", nth).where(F.col("nth") <= ROWS_OF_AN_ID).select("text", "label"), codec="zstd")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from ``labels`` (doc_id, toxic); where no label can be used, it finds nothing toxic."""
    texts = labelled_texts(docs, labels, max_labelled)
    counts = map_arrow(texts, _unit_counts, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # All this is bounded by the labelled sample.
    often = (F.col("toxic") > 0) & (F.col("clean") + F.col("toxic") >= MIN_DOCUMENTS) | (F.col("clean") >= MIN_CLEAN)
    rows = counts.where(often | F.col("unit").isin("", "*")).toArrow()
    found = dict(zip(rows["unit"].to_pylist(), zip(*(rows[c].cast("double").to_pylist() for c in ("clean", "toxic")), strict=True), strict=True))
    if min(found.get("", (0, 0))) == 0:
        return Model()
    model = unit_scores(found)
    _calibrate(model, texts)
    return model


def unit_scores(counts: dict[str, tuple[float, float]]) -> Model:
    """Scores of units from their counts in clean and toxic documents; "*": all words of all documents."""
    names = [u for u in counts if u not in ("", "*")]
    parent = {u: next((p for p in units(u.rstrip("*"))[1:] if len(p) - 1 < len(u.rstrip("*")) and p != u and p in counts), "*") for u in names}
    words = np.array([k for k, u in enumerate(names) if not u.endswith("*")], np.int64)
    c0, c1 = (np.array([counts[u][k] for u in names]) for k in (0, 1))
    plain, toxic = counts["*"]
    share = c0 / plain
    # EM: a toxic document's words are toxic with probability ``mixed``, and then distributed as ``q``.
    e = np.maximum(0.0, c1 - share * toxic)
    for _ in range(EM_STEPS):
        total = max(e[words].sum(), 1e-9)
        mixed, q = total / toxic, e / total
        e = c1 * mixed * q / np.maximum(mixed * q + (1 - mixed) * (c0 + 0.5) / plain, 1e-300)
    total = max(e[words].sum(), 1e-9)
    log_odds = np.log((e + 0.5) / total) - np.log((c0 + 0.5) / plain)
    spread = Z * np.sqrt(1 / (e + 0.5) + 1 / (c0 + 0.5))
    place = {u: k for k, u in enumerate(names)}
    odds = {"*": UNKNOWN_LOG_ODDS}
    for u in sorted(names, key=lambda u: (not u.endswith("*"), len(u))):
        # The start above is the prior; a unit departs from it as far as its own counts are surely apart.
        above, k = odds[parent[u]], place[u]
        apart = log_odds[k] - above
        odds[u] = above + math.copysign(max(0.0, abs(apart) - spread[k]), apart)
    score = lambda x: min(MAX_SCORE, math.log(PLAIN + (1 - PLAIN) * math.exp(min(20.0, x))))
    return Model(scores={u: round(score(odds[u]), 4) for u in names}, other=score(UNKNOWN_LOG_ODDS))


def _calibrate(model: Model, texts: DataFrame) -> None:
    """lambda and K from clean labelled texts, then the weights of the evidence."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if label == 0:
                    seen.update(round(s, 2) for s in model.word_scores(WORD.findall(lowered(text))))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], ["score", "n"])

    dist = map_arrow(texts, tally, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    s, n = np.array([r["score"] for r in dist]), np.array([r["n"] for r in dist], float)
    # A score beyond all of clean text is as rare as one word in it.
    s, n = np.append(s, MAX_SCORE), np.append(n, 1.0)
    lo, hi = 1e-4, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (n * np.exp(mid * s)).sum() < n.sum() else (lo, mid)
    model.lam = lo

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.passages(t)[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in x], pa.float64()) for k in (0, 1)] + [b.column(1)], ["total", "best", "label"])

    # At most the labelled sample: two numbers and a label a document, with K = 1 and then with its own.
    got = map_arrow(texts, evidence, "total double, best double, label int").collect()
    clean = np.array([math.exp(-r["best"]) for r in got if r["label"] == 0 and r["best"] > -30])
    if len(clean):  # K n exp(-lambda S) of the best segment is exponential with mean 1; its median says K
        model.k = float(math.log(2) / max(np.median(clean), 1e-12))
    got = map_arrow(texts, evidence, "total double, best double, label int").collect()
    a, y = np.array([features((r["total"], r["best"])) for r in got]), np.array([r["label"] for r in got], float)
    w = np.zeros(3)
    for _ in range(50):  # Newton steps of a logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 0.1 * w
        w += np.clip(np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(3), grad), -5, 5)
    model.weights = tuple(map(float, w))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and passages of every row of ``docs`` (doc_id, text; others are ignored).

    passages: array of start and end (characters), score and expected count by chance. Null and empty
    texts have no passage and get the score of a text without evidence. Rows are scored one by one,
    repeated or not; null doc_id stays null. Whole texts are scanned, however long.
    """

    held = docs.sparkSession.sparkContext.broadcast(model)  # unpacked once a worker, with the words it has scored

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
        for b in batches:
            found = [model.passages(t) for t in b.column(1).to_pylist()]
            p = [model.probability(x) for _, x in found]
            lists = pa.array([[dict(zip(("start", "end", "score", "expected"), s, strict=True)) for s in spans] for spans, _ in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), lists], ["doc_id", "score", "predicted", "passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(rows, score, "doc_id long, score double, predicted int, passages array<struct<start: int, end: int, score: double, expected: double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, by a model fitted outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
