"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SIZE = 8
#: Toxic documents that a model learns from, at most about, and twice as many others.
PER_LABEL = 1200
#: Character n-grams of a word, with marks at its ends.
GRAMS = (3, 4, 5)
#: Few words of a toxic text are toxic themselves; averages are scaled up before the softmax.
GAIN = 100.0
ROUNDS, RATE, DECAY = 150, 0.05, 0.01
#: Buckets whose presence in a text depends on its label less than this (chi-square) have no embedding; the first
#: value holds for `PER_LABEL` toxic documents, fewer take a proportional one, but not less than the second.
CHI_SQUARE = (30.0, 12.0)
CACHE = 400_000
WORD = re.compile(r"[^\W_]+")
SLICE = 1 << 20


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of its n-grams."""
    marked = f"<{word}>".encode()
    text = f"<{word}>"
    grams = [text[i : i + n].encode() for n in GRAMS for i in range(len(text) - n + 1)]
    return [crc32(g) % buckets for g in (marked, *grams)]


def _words(text: str | None) -> Iterator[list[str]]:
    """Words in lower case, slice by slice; slices end between words unless a word is longer than a slice."""
    at = 0
    while at < len(text or ""):
        end = min(len(text), at + SLICE)
        while end < len(text) and end < at + 2 * SLICE and not text[end].isspace():
            end += 1
        yield WORD.findall(text[at:end].lower())
        at = end


def shares(text: str | None) -> tuple[list[str], np.ndarray]:
    """The words of a text and their shares in its average; n repeats count as 1 + ln(n)."""
    counts: Counter[str] = Counter()
    for words in _words(text):
        counts.update(words)
    weight = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    return list(counts), weight / max(1.0, weight.sum())


def bag(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights: the mean over words of the mean over each word's subwords."""
    words, share = shares(text)
    parts = [subwords(w, buckets) for w in words]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.fromiter(chain.from_iterable(parts), np.int64, lengths.sum())
    own, inverse = np.unique(flat, return_inverse=True)
    weight = np.bincount(inverse, weights=np.repeat(share / lengths, lengths), minlength=len(own))
    return own.astype(np.int32), weight.astype(np.float32)


def informative(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Buckets whose presence depends on the label."""
    seen = np.stack([np.bincount(np.concatenate([b[0] for b, own in zip(bags, labels) if own == y]), minlength=BUCKETS) for y in (0, 1)])
    rows = np.bincount(labels, minlength=2)[:, None].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = seen.sum(axis=0) * rows / rows.sum()
        chi = ((seen - expected) ** 2 * (1 / expected + 1 / (rows - expected))).sum(axis=0)
    most, least = CHI_SQUARE
    return np.flatnonzero(np.nan_to_num(chi) >= max(least, most * min(1, rows[1, 0] / PER_LABEL)))


@dataclass
class ToxicityModel:
    embeddings: np.ndarray  # bucket, dimension
    softmax: np.ndarray  # dimension, label
    bias: np.ndarray

    @classmethod
    def fit(cls, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float, seed: int = 3) -> ToxicityModel:
        """Adam on the cross entropy, embeddings and softmax together; the bias is then set for labels of `rate`."""
        used = informative(bags, labels)
        place = np.full(BUCKETS, -1)
        place[used] = np.arange(len(used))
        rows, at, value = [], [], []
        for i, (own, weight) in enumerate(bags):
            keep = place[own] >= 0
            rows.append(np.full(keep.sum(), i))
            at.append(place[own[keep]])
            value.append(weight[keep] * np.float32(GAIN))
        rows, at, value = np.concatenate(rows), np.concatenate(at), np.concatenate(value)
        by_bucket = np.argsort(at, kind="stable")
        rng = np.random.default_rng(seed)
        e = rng.normal(0, 0.05, (len(used), SIZE)).astype(np.float32)
        w = rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32)
        b = np.zeros(2, np.float32)
        truth = np.eye(2, dtype=np.float32)[labels]
        share = (0.5 / np.maximum(1, truth.sum(axis=0)))[labels].astype(np.float32)[:, None]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, b)]
        for i in range(1, ROUNDS + 1):
            mean = _sums(e[at] * value[:, None], rows, len(bags))
            error = (_softmax(mean @ w + b) - truth) * share
            back = error @ w.T
            slopes = (_sums((back[rows] * value[:, None])[by_bucket], at[by_bucket], len(used)), mean.T @ error, error.sum(axis=0))
            for p, slope, (m, v) in zip((e, w, b), slopes, state):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                p -= RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-12)
            e *= 1 - RATE * DECAY
        whole = np.zeros((BUCKETS, SIZE), np.float32)
        whole[used] = e
        rate = min(max(rate, 1e-4), 1 - 1e-4)
        return cls(whole, w, b + np.log([1 - rate, rate]).astype(np.float32) - np.log(0.5).astype(np.float32))

    def word_scores(self) -> np.ndarray:
        """What a bucket adds to the odds of label 1: embeddings and softmax are linear, so a text's score is a mean."""
        return (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64) * GAIN


def _sums(values: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Sums of values by sorted row numbers."""
    out = np.zeros((count, values.shape[1]), np.float32)
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        out[rows[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class _Scores(dict):
    """Words to scores, computed when first met; forgotten when there are too many."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    def __missing__(self, word: str) -> float:
        score = self[word] = float(self.buckets[subwords(word, len(self.buckets))].mean())
        return score


def train(
    docs: DataFrame, labels: DataFrame, use: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL
) -> ToxicityModel | None:
    """A model from about `per_label` labelled documents of label 1 and twice as many of label 0, among the rows of `labels` where `use` holds.

    An id with several labels counts as toxic if one of them is 1; null labels and ids are ignored. Documents are drawn
    by the hash of their id, so reruns agree. None if only one label is there.
    """
    known = labels.filter(F.coalesce(use, F.lit(False)) & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy(F.col(doc_id).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("_key", F.lit("toxic")), F.lit(1_000_003)) / 1_000_003
    share = F.when(F.col("_label") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, 2 * per_label / counts[0]))
    drawn = known.filter(draw < share)  # bounded by per_label, so it can be broadcast
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), F.col("_id") == F.col("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value, own in zip(batch.column("_id"), batch.column("_text"), batch.column("_label")):
                at, weight = bag(value.as_py())
                parts = [pa.array([str(key.as_py())]), pa.array([own.as_py()], pa.int32()), pa.array([at.tobytes()]), pa.array([weight.tobytes()])]
                yield pa.RecordBatch.from_arrays(parts, names=["_id", "_label", "_at", "_weight"])

    found = rows.select("_id", "_text", "_label").mapInArrow(run, "_id string, _label int, _at binary, _weight binary").toPandas()
    found = found.sort_values(["_id", "_at", "_weight"]).reset_index(drop=True)
    bags = [(np.frombuffer(a, np.int32), np.frombuffer(w, np.float32)) for a, w in zip(found["_at"], found["_weight"])]
    if found.loc[[len(b[0]) > 0 for b in bags], "_label"].nunique() < 2:
        return None
    return ToxicityModel.fit(bags, found["_label"].to_numpy(), counts[1] / sum(counts.values()))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's id (`_id`) with `_score`, the probability of label 1 for the whole text.

    Null and empty texts and those without words get the score of an average of nothing, the model's bias; without a
    model every score is 0. Repeated rows get the same score; an empty table stays empty; other columns are not looked
    at. Nothing is shuffled; a task keeps the scores of the words it met, in a cache of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        None if model is None else (model.word_scores(), float(model.bias[1] - model.bias[0]))
    )
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Scores(shared.value[0]) if shared.value else None
        for batch in batches:
            odds = np.full(batch.num_rows, -np.inf)
            for i, value in enumerate(batch.column("_text") if shared.value else ()):
                words, share = shares(value.as_py())
                odds[i] = shared.value[1] + np.fromiter(map(cache.__getitem__, words), np.float64, len(words)) @ share
                if len(cache) > CACHE:
                    cache.clear()
            scores = 1 / (1 + np.exp(-np.clip(odds, -50, 50))) * (odds > -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(scores)], names=["_id", "_score"])

    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, _score double")
