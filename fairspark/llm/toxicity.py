"""Operator 1, toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, raw, table
from .decontam import item_words

GRADES = 4


def word_features(word: bytes) -> list[int]:
    """64-bit names of the features of a word: itself and its beginnings of 4 and 6 bytes. Names are not folded, so rare words cannot share a weight."""
    out = [xxhash.xxh3_64_intdigest(b"w" + word)]
    return out + [xxhash.xxh3_64_intdigest(b"p" + word[:n]) for n in (4, 6) if len(word) > n]


def twice(text_words: list[bytes]) -> set[bytes]:
    """The words that occur again."""
    seen: set[bytes] = set()
    return {w for w in text_words if w in seen or seen.add(w)}


def again(word: bytes) -> int:
    """The feature of a word that a text repeats."""
    return xxhash.xxh3_64_intdigest(b"2" + word)


def text_features(text: bytes | None) -> np.ndarray:
    own = item_words(text)
    return np.array(sorted({f for w in set(own) for f in word_features(w)} | {again(w) for w in twice(own)}), np.uint64)


@dataclass
class Severity:
    """score = sum of the weights of a text's features; P(grade > k) = 1 / (1 + exp(cuts[k] - score)), one weight vector for all cuts."""

    weights: dict[int, float] = field(default_factory=dict)
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))

    def severity(self, score: float) -> float:
        """The expected grade, 0 to GRADES - 1."""
        return float((1 / (1 + np.exp(np.clip(self.cuts - score, -50, 50)))).sum()) if self.weights else 0.0


def grades_of(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Ordered grades for two-valued labels: 0 for clean texts; toxic ones get 1 to 3 by how many strong features (seen in at
    least 1 % of the toxic texts and 20 times as often as in clean ones) they hold, cut at the tertiles."""
    names, n = np.unique(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if t]), return_counts=True)
    clean = np.concatenate([np.empty(0, np.uint64), *[r for r, t in zip(rows, toxic, strict=True) if not t]])
    n_clean = np.searchsorted(np.sort(clean), names, "right") - np.searchsorted(np.sort(clean), names, "left")
    strong = names[(n >= max(2, 0.01 * toxic.sum())) & (n / toxic.sum() >= 20 * (n_clean + 0.5) / ((~toxic).sum() + 1))]
    held = np.array([len(np.intersect1d(r, strong, assume_unique=True)) if t else 0 for r, t in zip(rows, toxic, strict=True)])
    low, high = np.quantile(held[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (held > low) + (held > high), 0)


def fit(rows: list[np.ndarray], grade: np.ndarray, most_features: int = 500, min_docs: int = 5, penalty: float = 5e-5, steps: int = 800) -> Severity:
    """The proportional odds model by maximum likelihood with a squared penalty; features are those of the largest
    chi-square between presence and a grade over 0, among those of min_docs texts or more."""
    n, bad = len(rows), grade > 0
    where = np.repeat(np.arange(n), [len(r) for r in rows])
    names, at, df = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    in_bad = np.bincount(at, weights=bad[where], minlength=len(names))
    p, total = bad.mean(), df.astype(float)
    chi = (in_bad - total * p) ** 2 / np.maximum(total * p * (1 - p) * (1 - total / n) + 1e-9, 1e-9)
    chi[df < min_docs] = -1
    chosen = np.sort(np.argsort(-chi, kind="stable")[:most_features])
    chosen = chosen[chi[chosen] > 3.84]
    new = np.full(len(names), -1)
    new[chosen] = np.arange(len(chosen))
    at = new[at]
    where, at = where[at >= 0], at[at >= 0]
    w, first, gaps = np.zeros(len(chosen)), 1.0, np.zeros(GRADES - 2)
    speed = [np.full(len(chosen), 1e-8), 1e-8, np.full(GRADES - 2, 1e-8)]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for _ in range(steps):
        cuts = np.concatenate([[-np.inf, first], first + np.cumsum(np.exp(gaps)), [np.inf]])
        s = np.bincount(where, weights=w[at], minlength=n)
        upper, lower = sig(cuts[grade + 1] - s), sig(cuts[grade] - s)
        fu, fl, mass = upper * (1 - upper), lower * (1 - lower), np.maximum(upper - lower, 1e-9)
        d_s, d_cut = (fu - fl) / mass / n, np.zeros(GRADES + 1)  # of the negative log likelihood
        np.add.at(d_cut, grade + 1, -fu / mass / n)
        np.add.at(d_cut, grade, fl / mass / n)
        inner = d_cut[1:-1]
        step = [np.bincount(at, weights=d_s[where], minlength=len(w)) + penalty * w, inner.sum(), np.array([inner[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 2)])]
        for k, g in enumerate(step):
            speed[k] = speed[k] + g * g
        w, first, gaps = w - 0.3 * step[0] / np.sqrt(speed[0]), first - 0.3 * step[1] / np.sqrt(speed[1]), gaps - 0.1 * step[2] / np.sqrt(speed[2])
    return Severity({int(f): float(x) for f, x in zip(names[chosen], w, strict=True) if abs(x) > 1e-4}, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000) -> Severity:
    """Fits on at most sample_docs labelled documents of each class, taken in the order of a hash of doc_id. Without both classes: a model that finds nothing."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    some = [known.where(F.col("__toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for k in (0, 1)]
    picked = F.broadcast(some[0].unionAll(some[1]))  # 2 * sample_docs rows at most
    rows = docs.select("doc_id", "text").join(picked, "doc_id")
    fields = [T.StructField("features", T.ArrayType(T.LongType()))]
    rows = add_columns(rows, fields, lambda b: [pa.array([text_features(t).view(np.int64) for t in raw(b, "text")], pa.list_(pa.int64()))], keep=["doc_id", "__toxic"])
    got = rows.toArrow().sort_by("doc_id")
    seen, features, toxic = set(), [], []
    for f, t in zip(got["features"].combine_chunks(), got["__toxic"].to_pylist(), strict=True):
        own = f.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if len(own) and (key := own.tobytes()) not in seen:  # copies count once
            seen.add(key)
            features.append(own)
            toxic.append(bool(t))
    toxic = np.array(toxic, bool)
    return fit(features, grades_of(features, toxic)) if toxic.any() and not toxic.all() else Severity()


class _Scorer(dict):
    """By word, those of its features that have a weight, and that of its repetition, if it has one."""

    def __init__(self, model: Severity):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> tuple[tuple[int, ...], int | None]:
        if len(self) >= 1_000_000:
            self.clear()
        own, more = tuple(f for f in word_features(word) if f in self.model.weights), again(word)
        value = self[word] = (own, more) if more in self.model.weights else (own, None)
        return value

    def severity(self, text: bytes | None) -> float:
        own = item_words(text)
        known = {w: x for w in set(own) if (x := self[w]) != ((), None)}
        found = {f for fs, _ in known.values() for f in fs}
        found |= {known[w][1] for w in twice([w for w in own if w in known])} - {None}
        return self.model.severity(sum(self.model.weights[f] for f in sorted(found)))


def score_toxicity(docs: DataFrame, model: Severity, reject_from: float = 0.5) -> DataFrame:
    """docs plus severity (double, the expected grade of the whole text, 0 to 3) and toxic (severity >= reject_from).

    A null or empty text has no features; its severity is that of score 0. Equal texts score equally. An empty table returns
    none. Columns of docs with these names are replaced, all others returned as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[_Scorer] = []

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        if not made:
            made.append(_Scorer(shared.value))
        scorer = made[0]
        s = [scorer.severity(t) for t in raw(b, "text")]
        return [pa.array(s, pa.float64()), pa.array([x >= reject_from for x in s])]

    return add_columns(docs, [T.StructField("severity", T.DoubleType()), T.StructField("toxic", T.BooleanType())], make)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "severity", "toxic", (~F.col("toxic")).alias("kept"))
