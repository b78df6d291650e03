"""Language identification in two steps: the family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

BUCKETS = 4096
#: Documents of a language that a model learns from, at most about.
PER_LANGUAGE = 500
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
SLICE = 1 << 18
#: Share of all grams that a language is taken to draw from every bucket alike.
NOISE = 0.01
#: Allowance of `_fit` for short texts, divided by the root of their grams.
SHORT = 1.5

# Families of languages by code; a language that is not listed is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}

_LETTER = np.zeros(0, dtype=bool)


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Square roots of the shares of hashed character pairs and triples, over the whole text; None without letters."""
    return counted(text, buckets)[0]


def counted(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray | None, float]:
    """`features` and the number of pairs and triples.

    Everything that is not a letter counts as one kind of space, and runs of spaces as one. Long texts are counted in
    slices, so memory does not grow with the text.
    """
    counts = np.zeros(buckets)
    tail = np.array([32], dtype=np.uint32)
    seen = False
    for first in range(0, len(text or ""), SLICE):
        points = np.frombuffer(text[first : first + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[points]
        seen |= bool(letter.any())
        points = np.concatenate((tail, np.where(letter, points, 32)))
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        tail = points[-2:]
        pairs = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)
        triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + points[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
        for grams in (pairs, triples):
            counts += np.bincount((grams ^ (grams >> np.uint32(15))) % np.uint32(buckets), minlength=buckets)
    total = counts.sum()
    return (np.sqrt(counts / total).astype(np.float32), float(total)) if seen and total else (None, 0.0)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps; y is -1 or 1, both sides weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, at, step = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.2
    bias = bias_at = 0.0
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ at + bias_at)) * weight * y
        new, new_bias = at + step * (2 * x.T @ slack - penalty * at), bias_at + step * 2 * slack.sum()
        keep = i / (i + 3)
        at, bias_at = new + keep * (new - w), new_bias + keep * (new_bias - bias)
        w, bias = new, new_bias
    return w, float(bias)


@dataclass
class LanguageModel:
    """One-versus-one separators of the families and of the languages within each; what texts of each language look like."""

    families: dict[str, list[str]]
    duels: dict[tuple[str, str], tuple[np.ndarray, float]]
    logs: np.ndarray  # language, bucket: log probability
    usual: np.ndarray  # of each language: mean log probability in texts it was not learned from

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel:
        own = np.array([FAMILIES.get(lang, lang) for lang in langs])
        named = np.array(langs)
        families = {f"family {f}": sorted(set(named[own == f])) for f in sorted(set(own))}
        duels = {}
        for labels, names in [(own, sorted(set(own)))] + [(named, v) for v in families.values()]:
            prefix = "family " if labels is own else ""
            for a, b in combinations(names, 2):
                rows = (labels == a) | (labels == b)
                duels[prefix + a, prefix + b] = fit_svm(x[rows], np.where(labels[rows] == a, 1, -1).astype(np.float32))
        logs, usual = zip(*(cls._usual(x[named == lang]) for lang in sorted(set(langs))))
        return cls(families, duels, np.stack(logs), np.array(usual))

    @staticmethod
    def _usual(x: np.ndarray) -> tuple[np.ndarray, float]:
        def learn(part: np.ndarray) -> np.ndarray:
            return np.log((1 - NOISE) * (part.astype(float) ** 2).mean(axis=0) + NOISE / x.shape[1])

        logs = learn(x)
        if len(x) < 2:  # one text doesn't tell how much others differ
            return logs, float(logs.mean())
        halves = x[::2], x[1::2]
        apart = [(b.astype(float) ** 2 @ learn(a)) for a, b in (halves, halves[::-1])]
        return logs, float(np.concatenate(apart).mean())

    def fit_of(self, x: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """About 1 for a text like those of some language, 0 for grams at random; short texts get an allowance.

        The mean log probability of the grams, from that of all buckets alike (0) to that of the language's texts (1).
        A language that isn't known well enough to tell fits everything.
        """
        floor = self.logs.mean(axis=1)
        span = self.usual - floor
        share = (x.astype(float) ** 2 @ self.logs.T - floor) / np.where(span > 0, span, 1)
        return np.where(span > 0, share, 1).max(axis=1) + SHORT / np.sqrt(np.maximum(grams, 1))

    def _winner(self, names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Who wins most duels, ties by the sum of margins, and the narrowest win as a value between 0 and 1."""
        if len(names) == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margin = np.zeros((len(names), len(names), len(x)))
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            w, bias = self.duels[a, b]
            margin[i, j] = x @ w + bias
            margin[j, i] = -margin[i, j]
        votes = (margin > 0).sum(axis=1) + 1e-3 * np.tanh(margin.sum(axis=1))
        best = votes.argmax(axis=0)
        rows = np.arange(len(x))
        own = margin[best, :, rows]
        own[rows, best] = np.inf
        return best, 1 / (1 + np.exp(-4 * own.min(axis=1)))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = list(self.families)
        family, sure = self._winner(names, x)
        langs = np.empty(len(x), dtype=object)
        for i, name in enumerate(names):
            rows = np.flatnonzero(family == i)
            if len(rows):
                best, within = self._winner(self.families[name], x[rows])
                langs[rows] = [self.families[name][b] for b in best]
                sure[rows] *= within
        return list(langs), sure


def train(
    docs: DataFrame, use: Column, order: Column, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE
) -> LanguageModel | None:
    """A model from about `per_language` documents of each language among those where `use` holds.

    They are drawn by the hash of `order`, so reruns agree. None if no document is labelled.
    """
    labelled = docs.filter(F.coalesce(use, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = labelled.groupBy(F.col(lang).alias("_lang")).count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    shares = docs.sparkSession.createDataFrame([(c["_lang"], min(1.0, per_language / c["count"])) for c in counts], "_name string, _share double")
    draw = F.pmod(F.xxhash64(order), F.lit(1_000_003)) / 1_000_003
    rows = labelled.select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), draw.alias("_draw"))
    rows = rows.join(F.broadcast(shares), F.col("_lang") == F.col("_name")).filter("_draw < _share").select("_text", "_lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_, lang_ in zip(batch.column("_text"), batch.column("_lang")):
                found = features(text_.as_py())
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang_.as_py()]), pa.array([found.tobytes()])], names=["_lang", "_x"])

    drawn = rows.mapInArrow(run, "_lang string, _x binary").toPandas()
    if not len(drawn):
        return None
    drawn = drawn.sort_values(["_lang", "_x"]).reset_index(drop=True)
    x = np.stack([np.frombuffer(b, dtype=np.float32) for b in drawn["_x"]])
    return LanguageModel.fit(x, list(drawn["_lang"]))


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """`docs` with `_lang_pred`, `_score` (0 to 1, the narrowest win in both steps) and `_fit` (see `fit_of`).

    `_score` compares the learned languages, one of which always wins; `_fit` tells texts of none of them.

    Null texts and texts without letters are `und` with score and fit 0, as is everything without a model. Texts are read whole.
    Repeated rows get the same answer; an empty table stays empty. Columns of `docs` keep their names and values,
    whatever they are, but for these three. Rows are never shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("_lang_pred", "_score", "_fit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            langs, scores, fits = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            rows, found, grams = [], [], []

            def flush() -> None:
                if rows:
                    stacked = np.stack(found)
                    names, sure = own.predict(stacked)
                    fits[rows] = own.fit_of(stacked, np.array(grams))
                    for row, name, score in zip(rows, names, sure):
                        langs[row], scores[row] = name, score
                    rows.clear()
                    found.clear()
                    grams.clear()

            for i, value in enumerate(batch.column(text) if own else ()):
                x, total = counted(value.as_py())
                if x is not None:
                    rows.append(i)
                    found.append(x)
                    grams.append(total)
                if len(rows) == 256:
                    flush()
            flush()
            names = [*batch.schema.names, "_lang_pred", "_score", "_fit"]
            columns = [pa.array(langs, pa.string()), pa.array(scores), pa.array(fits)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    schema = StructType([*docs.schema.fields]).add("_lang_pred", StringType()).add("_score", DoubleType()).add("_fit", DoubleType())
    return docs.mapInArrow(run, schema)


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text has a letter, by the table that `features` uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([any(map(str.isalpha, t.as_py() or "")) for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
