"""Operator 10, a quality classifier by co-training of two views: what the text contains, and what is known about the page without reading it."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, raw, table, written

_UPPER, _LETTERS, _SYMBOLS, _PUNCT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#*$%&<>", b".,;:?"


def content_view(text: bytes | None) -> list[float]:
    """Shares and counts of the whole text."""
    text = text or b""
    words, size = text.split(), max(len(text), 1)
    n = max(len(words), 1)
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = max(len(words) - 2, 1)
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, share(_UPPER), share(_SYMBOLS), share(b"!"), share(b"|"), share(_PUNCT), share(b"0123456789"),
        share(_LETTERS), len(set(words)) / n, len(set(lines)) / max(len(lines), 1), len(set(zip(words, words[1:], words[2:], strict=False))) / triples,
        sum(len(w) <= 3 for w in words) / n, sum(w[-1:] in b"!|#*$%&<>" for w in words) / n, math.log1p(n / max(len(lines), 1)),
    ]


@dataclass
class Metadata:
    """Features of language and source, each name its own, and of the length as stored (its logarithm in steps)."""

    names: dict[tuple[str, str | None], int]

    @classmethod
    def of(cls, langs: Sequence, sources: Sequence, least: int = 5, most_names: int = 500) -> Metadata:
        """The names that `least` rows or more hold, the most frequent first, most_names at most; all others share one feature a kind."""
        counts = Counter([("lang", x) for x in langs]) + Counter([("source", x) for x in sources])
        frequent = sorted((x for x in counts.items() if x[1] >= least), key=lambda x: (-x[1], x[0][0], x[0][1] is None, x[0][1] or ""))
        return cls({name: i for i, (name, _) in enumerate(frequent[:most_names])})

    def view(self, langs: Sequence, sources: Sequence, lengths: Sequence) -> np.ndarray:
        n = len(self.names)
        out = np.zeros((len(langs), n + 19))
        rows = np.arange(len(langs))
        out[rows, [self.names.get(("lang", x), n) for x in langs]] = 1.0
        out[rows, [self.names.get(("source", x), n + 1) for x in sources]] = 1.0
        out[rows, [n + 2 + (16 if x is None or x < 0 else min(15, int(math.log2(x + 1)))) for x in lengths]] = 1.0
        return out


@dataclass
class View:
    """A logistic model over standardised features, with a calibrating line over its log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton's method; the last weight is the constant and is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    return View(mean, scale, logistic(np.clip((x - mean) / scale, -8, 8), y))


def surest(made: list[View], pool: tuple[np.ndarray, np.ndarray], ids: list, given: list[dict], confident: float, most: dict[float, int], prior: float = 0.0, order: np.ndarray | None = None) -> list[tuple[int, float, float, int]]:
    """(view, label, sureness, index): each view's surest guesses of each label about ids that the other view wasn't given, an id once.
    Sureness is the calibrated probability; prior: log odds to add, from the sample's classes to those of the whole; order decides among equally sure ones."""
    out, order = [], np.arange(len(ids)) if order is None else order
    for v in (0, 1):
        p = 1 / (1 + np.exp(-(made[v].log_odds(pool[v]) + prior)))
        for label, sure in ((1.0, p), (0.0, 1 - p)):
            seen: set = set()
            for i in np.lexsort((order, -sure)):
                if sure[i] < confident or len(seen) == most[label]:
                    break
                if ids[i] not in given[1 - v] and ids[i] not in seen:
                    seen.add(ids[i])
                    out.append((v, label, float(sure[i]), int(i)))
    return out


class ArrayPool:
    """Unlabelled rows in arrays, one for each view."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray]):
        self.views, self.ids = views, list(range(len(views[0])))

    def picks(self, made: list[View], given: list[dict], confident: float, most: dict[float, int], prior: float = 0.0) -> list[tuple[int, float, int, np.ndarray]]:
        """(view, label, id, features of the other view)."""
        return [(v, label, i, self.views[1 - v][i]) for v, label, _, i in surest(made, self.views, self.ids, given, confident, most, prior)] if self.ids else []


class TablePool:
    """Unlabelled rows in a table (doc_id, __content, lang, source, n_chars); all are scored in each round, only the picks reach the driver."""

    def __init__(self, rows: DataFrame, metadata: Metadata):
        self.rows, self.metadata = rows, metadata

    def picks(self, made: list[View], given: list[dict], confident: float, most: dict[float, int], prior: float = 0.0) -> list[tuple[int, float, int, np.ndarray]]:
        known, metadata = [set(g) for g in given], self.metadata

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                ids, order, content, *meta = (b.column(i).to_pylist() for i in range(6))
                views = np.array(content), metadata.view(*meta)
                best = surest(made, views, ids, known, confident, most, prior, np.array(order))
                columns = [[x[0] for x in best], [x[1] for x in best], [x[2] for x in best], [ids[x[3]] for x in best], [views[1 - x[0]][x[3]].tolist() for x in best]]
                types = (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["v", "label", "sure", "doc_id", "x"])

        rows = self.rows.select("doc_id", F.xxhash64("doc_id"), "__content", "lang", "source", "n_chars")
        found = rows.mapInArrow(run, "v int, label double, sure double, doc_id long, x array<double>")
        found = found.groupBy("v", "label", "doc_id").agg(F.max(F.struct("sure", "x")).alias("m"))
        place = F.row_number().over(W.partitionBy("v", "label").orderBy(F.col("m.sure").desc(), F.xxhash64("doc_id"), "doc_id"))
        found = found.withColumn("r", place).where(F.col("r") <= max(most.values()))
        found = found.where(F.col("r") <= F.when(F.col("label") == 1, most[1.0]).otherwise(most[0.0]))
        return [(r["v"], r["label"], r["doc_id"], np.array(r["m"]["x"])) for r in found.orderBy("v", F.col("label").desc(), "r").collect()]


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | TablePool, rounds: int = 5, confident: float = 0.95, per_round: int = 500, prior: float = 0.0) -> tuple[tuple[View, View], float, list[tuple[int, int]]]:
    """Both views learn from four fifths of the labelled rows and are calibrated on the last; for some rounds each hands the
    guesses it is surest of, over all of the pool, to the other: those with a calibrated probability of `confident` or more,
    per_round at most, in the proportion of the sample's classes. prior: log odds that lead from those to the classes of the
    whole; a rare class is guessed with so much more care. Returns views, prior log odds of the sample and, by round, how many
    labels the content and the metadata view have given."""
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    calibrate = held if held.any() else np.ones(len(y), bool)
    rate = float(np.clip(y.mean(), 0.001, 0.999))
    given: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]
    pool = ArrayPool(pool) if isinstance(pool, tuple) else pool
    most = {1.0: math.ceil(per_round * rate), 0.0: math.ceil(per_round * (1 - rate))}
    made: list[View] = []
    exchanged = []
    for turn in range(rounds + 1):
        made = []
        for v in (0, 1):
            x = np.vstack([views[v][~held], *[x for _, x in given[v].values()]])
            view = fit_view(x, np.concatenate([y[~held], [label for label, _ in given[v].values()]]))
            line = logistic(view.raw(views[v][calibrate])[:, None], y[calibrate], penalty=0.01)
            view.slope, view.shift = max(float(line[0]), 0.0), float(line[1])
            made.append(view)
        if turn == rounds:
            break
        picks = pool.picks(made, given, confident, most, prior)
        for v, label, i, x in picks:
            given[1 - v][i] = (label, x)
        exchanged.append((sum(v == 0 for v, *_ in picks), sum(v == 1 for v, *_ in picks)))
    return (made[0], made[1]), math.log(rate / (1 - rate)), exchanged


_CONTENT = [T.StructField("__content", T.ArrayType(T.DoubleType()))]


def _content(b: pa.RecordBatch) -> list[list[float]]:
    return [content_view(t) for t in raw(b, "text")]


@dataclass
class CoTrained:
    """exchanged: for each round, how many labels the content and the metadata view gave to the other."""

    views: tuple[View, View] | None
    prior: float
    metadata: Metadata = field(default_factory=lambda: Metadata({}))
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def quality(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """The probability of good quality: both views' calibrated log odds added, the prior counted once."""
        if self.views is None:
            return np.full(len(content), 1 / (1 + math.exp(-self.prior)))
        return 1 / (1 + np.exp(-(self.views[0].log_odds(content) + self.views[1].log_odds(meta) - self.prior)))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, pool_docs: int | None = None, rounds: int = 5) -> CoTrained:
    """Learns from at most sample_docs labelled documents of each class, in the order of a hash of doc_id, and from all
    unlabelled ones (the first pool_docs, if given): each round scores them with both views. Only the features of the labelled
    and of the rows picked reach the driver. Without both classes the model gives the one there is (good, if none)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__y"))
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return CoTrained(None, 0.0 if not counts else -8.0 if counts.get(0) else 8.0)
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = [first(known.where(F.col("__y") == k), sample_docs) for k in (0, 1)]
    picked = F.broadcast(some[0].unionAll(some[1]))  # bounded by the limits

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(_content(b), pa.list_(pa.float64()))]

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    features = written(add_columns(rows, _CONTENT, make, keep=["doc_id", "lang", "source", "n_chars"]))
    others = features.join(known, "doc_id", "left_anti").withColumn("doc_id", F.col("doc_id").cast("long"))
    others = written(others if pool_docs is None else first(others, pool_docs))
    got = sorted(features.join(picked, "doc_id").dropDuplicates(["doc_id"]).collect(), key=lambda r: (xxhash.xxh3_64_intdigest(str(r["doc_id"])), str(r["doc_id"])))
    y = np.array([r["__y"] for r in got])
    if len(np.unique(y)) < 2:
        return CoTrained(None, 8.0 if not len(y) or y.max() == 1 else -8.0)
    columns = [[r[c] for r in got] for c in ("lang", "source", "n_chars")]
    metadata = Metadata.of(*columns[:2])
    content, meta = np.array([r["__content"] for r in got]), metadata.view(*columns)
    shift = math.log(counts[1] / counts[0]) - math.log(y.mean() / (1 - y.mean()))  # from the sample's classes to those of all labels
    views, sample_prior, exchanged = co_train((content, meta), y.astype(float), TablePool(others, metadata), rounds, prior=shift)
    for v in views:
        v.shift += shift
    return CoTrained(views, sample_prior + shift, metadata, exchanged)


def score_quality(docs: DataFrame, model: CoTrained, keep_from: float = 0.5) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) plus quality (probability, double) and kept (quality >= keep_from).

    All rows and whole texts are scored. Null text counts as empty; null metadata are values of their own; equal rows score
    equally; an empty table returns none. Columns of docs named quality or kept are replaced, all others returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
        q = shared.value.quality(np.array(_content(b)), shared.value.metadata.view(column("lang"), column("source"), column("n_chars")))
        return [pa.array(q, pa.float64()), pa.array(q >= keep_from)]

    return add_columns(docs, [T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())], make)


def op10_cotrained_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "quality", "kept")
