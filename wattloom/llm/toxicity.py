"""Toxic passages by maximum-scoring segments of token log-odds.

Training, on a bounded sample of labelled documents: every word of at least MIN_DOCS of its
documents has log-odds of occurring in toxic against clean documents, under a Dirichlet
prior that is divided as the classes are; the score is their bound CAUTION standard errors
nearer to 0, so that thin evidence says little either way. Rarer and unknown words score 0.
Log-odds are those of a word's presence: its k-th occurrence in a text counts 1/k of a gain.
Each token costs DRIFT. A linear-time scan finds all maximal scoring segments of a document. Under clean
text segment scores follow an extreme-value law: its scale solves sum p(s) exp(scale * s)
= 1 over clean word frequencies, its offset comes from the best segments of clean
training documents; so each segment has an expected number E in clean text of that
length, and segments of E below SIGNIFICANT count. A document's evidence, the sum of
their -ln E, goes through a logistic curve fitted on the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm import text as tx
from wattloom.session import cut, ship

#: Labelled documents of each class in the training sample, at most.
TRAIN_PER_CLASS = 20_000
#: Least documents of a word with a score.
MIN_DOCS = 5
#: Dirichlet prior of a word in both classes together: a flat part and a share of its count.
FLAT, SHARE = 1.0, 0.02
#: Standard errors taken off log-odds; cost of a token; E of segments that count.
CAUTION, DRIFT, SIGNIFICANT = 1.5, 0.1, 1.0


def held_out(doc_id: Column) -> Column:
    """True for documents that training never sees."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _counts(docs: DataFrame) -> DataFrame:
    """(word, n) documents of docs that contain each word hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 0):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for lo, hi in tx.chunks(texts):
                _, _, _, h, first = tx.words(texts[lo:hi])
                owner = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(first))
                _, once = np.unique(h * np.uint64(0x9E3779B97F4A7C15) + tx.mix(owner), return_index=True)
                w, at = np.unique(h[once], return_inverse=True)
                bad = np.bincount(at, toxic[lo:hi][owner[once].astype(np.int64)], len(w)).astype(np.int64)
                all_ = np.bincount(at, minlength=len(w))
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(bad), pa.array(all_ - bad)], names=["word", "bad", "good"])

    return docs.select("text", "toxic").mapInArrow(run, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


class Model:
    """Scores of words (sorted hashes), the extreme-value law and the logistic curve."""

    def __init__(self, words: np.ndarray, scores: np.ndarray, scale: float = 1.0, offset: float = 0.0, curve: tuple = (0.0, -3.0)):
        self.words, self.scores, self.scale, self.offset, self.curve = words, scores, scale, offset, curve

    def segments(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """Of each text: its words, and its maximal scoring segments (first word, end, score)."""
        _, _, _, h, first = tx.words(texts)
        score = np.full(len(h), -DRIFT)
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            own = np.where(self.words[at] == h, self.scores[at], 0.0)
            up = np.flatnonzero(own > 0)
            own[up] /= _occurrence(h[up], np.searchsorted(first, up, "right"))
            score += own
        total = np.concatenate((np.zeros(1), np.cumsum(score)))
        # neighbours that both gain are one step of the scan; a text's start begins a new one
        gain = score > 0
        begin, end = gain.copy(), gain.copy()
        begin[1:] &= ~gain[:-1]
        end[:-1] &= ~gain[1:]
        edge = first[(first > 0) & (first < len(h))]
        begin[edge] = gain[edge]
        end[edge - 1] = gain[edge - 1]
        a, z = np.flatnonzero(begin), np.flatnonzero(end) + 1
        bounds = np.searchsorted(a, first).tolist()
        own = np.repeat(first[:-1], np.diff(first))[a] if len(a) else a
        steps = list(zip((a - own).tolist(), (z - own).tolist(), total[a].tolist(), total[z].tolist()))
        n = np.diff(first).tolist()
        return [(n[i], maximal_segments(steps[bounds[i] : bounds[i + 1]])) for i in range(len(texts))]

    def expected(self, score: float, words: int) -> float:
        """Expected segments of at least this score in clean text of so many words."""
        return math.exp(min(50.0, math.log(max(words, 1)) + self.offset - self.scale * score))

    def evidence(self, words: int, segments: list[tuple[int, int, float]]) -> float:
        total = 0.0
        for _, _, s in segments:
            e = self.expected(s, words)
            if e < SIGNIFICANT:
                total += min(50.0, -math.log(max(e, 1e-30)))
        return total

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * np.log1p(evidence) + b, -30, 30)))


def _occurrence(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which occurrence of its word in its text each entry is, from 1."""
    mark = tx.mix(words + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mark, kind="stable")
    new = np.flatnonzero(np.diff(mark[order], prepend=mark[order][:1] + np.uint64(1)))
    nth = np.empty(len(words))
    nth[order] = np.arange(len(words)) - np.repeat(new, np.diff(np.append(new, len(words)))) + 1
    return nth


def maximal_segments(steps: list[tuple[int, int, float, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time, of a sequence whose gaining runs are
    given as (first, end, total score before it, and after it) in order (the Ruzzo-Tompa
    scan over runs)."""
    stack: list[tuple[int, int, float, float]] = []
    for new in steps:
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:]
    return [(a, b, y - x) for a, b, x, y in stack]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out. Without documents of
    both classes it knows no word and gives every text the share of toxic labels."""
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut(known)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("labelled"), "labelled").limit(TRAIN_PER_CLASS) for c in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))  # at most 2 * TRAIN_PER_CLASS ids
    texts = cut(docs.where("text is not null").select("doc_id", "text").join(sample, F.col("doc_id") == F.col("labelled")).select("text", "toxic"))
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    prior = math.log(max(share, 1e-3) / max(1 - share, 1e-3))
    if not n.get(0) or not n.get(1):
        return Model(np.zeros(0, np.uint64), np.zeros(0), curve=(0.0, prior))
    counts = cut(_counts(texts))
    # at most (distinct words of the sample's documents) / MIN_DOCS rows
    rows = counts.where(F.col("bad") + F.col("good") >= MIN_DOCS).toArrow()
    words = rows["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    bad, good = (rows[c].to_numpy().astype(float)[order] for c in ("bad", "good"))
    part = n[1] / (n[0] + n[1])
    mass = FLAT + SHARE * (bad + good)
    in_bad, in_good = bad + mass * part, good + mass * (1 - part)
    odds = np.log(in_bad / in_good) - math.log(part / (1 - part))
    score = np.sign(odds) * np.maximum(0, np.abs(odds) - CAUTION * np.sqrt(1 / in_bad + 1 / in_good))
    model = Model(words[order], score)
    model.scale = _scale(score - DRIFT, good / max(float(counts.agg(F.sum("good")).first()[0] or 0), 1.0))
    best = _measured(texts, model, lambda m, words, segs: max((s for _, _, s in segs), default=0.0))
    clean = [(x, w) for toxic, w, x in best if not toxic and w]
    if clean:  # the offset makes the mean number of clean documents with E < 1 what the law says
        excess = sorted(model.scale * x - math.log(w) for x, w in clean)
        model.offset = excess[int(0.99 * (len(excess) - 1))]
    seen = _measured(texts, model, lambda m, words, segs: m.evidence(words, segs))
    toxic = np.array([t for t, _, _ in seen], float)
    weight = np.where(toxic > 0, sizes.get(1, 0) / n[1], sizes.get(0, 0) / n[0])
    model.curve = _logistic(np.log1p(np.array([e for _, _, e in seen])), toxic, weight)
    return model


def _scale(score: np.ndarray, rate: np.ndarray) -> float:
    """The positive root of sum p(s) exp(x * s) = 1."""
    rest = max(0.0, 1 - rate.sum())
    f = lambda x: float((rate * np.exp(np.minimum(x * score, 700))).sum() + rest * math.exp(-x * DRIFT)) - 1
    lo, hi = 1e-6, 5.0
    if f(lo) >= 0 or f(hi) <= 0:
        return 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _measured(texts: DataFrame, model: Model, what) -> list[tuple[int, int, float]]:
    """(toxic, words, what) of each training document: at most 2 * TRAIN_PER_CLASS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 0):
            got = _in_chunks(batch.column(0).to_pylist(), model)
            rows = [(w, what(model, w, s)) for w, s in got]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=["toxic", "words", "x"])

    return [tuple(r) for r in texts.mapInArrow(run, "toxic int, words long, x double").collect()]


def _in_chunks(texts: list[str | None], model: Model) -> list:
    texts = [t or "" for t in texts]
    return [x for lo, hi in tx.chunks(texts) for x in model.segments(texts[lo:hi])]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of one variable, lightly ridged."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, w = weight * (y - p), weight * p * (1 - p) + 1e-9
        g = np.array([(r * x).sum() - 0.01 * a, r.sum()])
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, evidence and the significant passages (first word, words,
    score, expected) of every row. Null and empty texts have no passage."""
    ship(docs.sparkSession)
    schema = "doc_id long, score double, predicted int, evidence double, passages array<struct<first:int,words:int,score:double,expected:double>>"
    passage = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, 1):
            got = _in_chunks(batch.column(1).to_pylist(), model)
            evidence = np.array([model.evidence(w, s) for w, s in got])
            p = model.probability(evidence)
            spots = [[{"first": a, "words": b - a, "score": x, "expected": e} for a, b, x in s if (e := model.expected(x, w)) < SIGNIFICANT] for w, s in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(evidence), pa.array(spots, passage)], names=["doc_id", "score", "predicted", "evidence", "passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted and the passages.

    Labels of held-out documents are never read; several labels of one document count as
    toxic if one does; null labels are ignored. A null doc_id is not held out. Repeated
    rows score alike, extra columns are ignored; no documents give no rows, no labels the
    same low score to every text."""
    model = train(docs, labels)
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "evidence", "passages")


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, each row judged by its own text, in one
    map after the training; null and empty texts have the score of no passage."""
    model = train(docs, labels)

    def civil(texts: list[str | None]) -> list[bool]:
        evidence = np.array([model.evidence(w, s) for w, s in _in_chunks(texts, model)])
        return (model.probability(evidence) < 0.5).tolist()

    return tx.keep_rows(docs, civil)
