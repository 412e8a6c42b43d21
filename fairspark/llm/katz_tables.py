"""The Katz model of any order as partitioned tables: written once, read back, and evaluated recursively for each token.

A text is START, its words, END; a gram of order k is a run of k of these, of order 1 any but START. p(w) = (n(w) + 1) / (N + V + 1).
p(w | h) = r* / c(h) for a gram seen r times in training, else alpha(h) p(w | h'), where h' is h without its first word; alpha is
1 for an unseen h. r* is as in `katz`, by order, and alpha(h) = (what r* leaves of c(h)) / (1 - sum of p(w | h') over seen w),
so every context sums to one.

Tables below one folder, in directories by part of the key: ngrams/order=k (gram, head, tail, n, p) and contexts/order=k (head, c,
weight, which is log10 alpha); head is the gram without its last word, tail without its first. Chunks count before the one exchange
of an order. A key with a `hot` th of all counts or more, so `hot` keys at most, is looked up by broadcast; rows of the others meet
their key by exchange, fewer than a `hot` th of the tokens for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workplace import discard, work_folder
from .common import WordHash, raw, words, written
from .katz import END, START, TURING, discounted, pair_key

HOT = 200_000
#: Texts are spread over so many keys each, by doc_id.
_SALTS = 64
_NGRAMS, _CONTEXTS = "gram long, head long, tail long, n long, p double, part int", "head long, c long, weight double, part int"


@dataclass(frozen=True)
class KatzTables:
    path: str
    order: int
    tokens: int
    vocabulary: int
    hot: int = HOT

    def ngrams(self, spark: SparkSession, k: int) -> DataFrame:
        return spark.read.schema(_NGRAMS).parquet(f"{self.path}/ngrams/order={k}")

    def contexts(self, spark: SparkSession, k: int) -> DataFrame:
        return spark.read.schema(_CONTEXTS).parquet(f"{self.path}/contexts/order={k}")

    def heavy(self, n: str) -> Column:
        return F.col(n) * self.hot >= self.tokens


def read_tables(spark: SparkSession, path: str) -> KatzTables:
    """The model that train_tables has written to path."""
    return KatzTables(path, *spark.read.parquet(f"{path}/model").select("order", "tokens", "vocabulary", "hot").first())


def _grams(texts: list[bytes | None], names: WordHash, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Grams of order 1..order that end at each place of all texts, the place in its text (START: 0), and the text."""
    each = [np.concatenate([[START], names.array(words(t)), [END]]) for t in texts]
    n = np.array([len(x) for x in each], np.int64)
    flat = np.concatenate(each) if each else np.empty(0, np.uint64)
    out = [flat]
    for _ in range(1, order):
        before = np.roll(out[-1], 1)
        out.append(pair_key(before, flat))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    return out, place, np.repeat(np.arange(len(each)), n)


def _batches(batches: Iterator[pa.RecordBatch], chunk_chars: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of batches with about chunk_chars bytes of text."""
    for b in batches:
        texts, start, size = raw(b, "text"), 0, 0
        for i, t in enumerate(texts):
            size += len(t or b"")
            if size >= chunk_chars or i + 1 == len(texts):
                yield b.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns.values()], names=list(columns))


def _counted(k: int, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordHash()
        for _, texts in _batches(batches, chunk_chars):
            grams, place, _ = _grams(texts, names, k)
            at = np.nonzero(place >= max(1, k - 1))[0]
            gram, first, n = np.unique(grams[k - 1][at], return_index=True, return_counts=True)
            at = at[first]
            lower = grams[max(0, k - 2)]
            yield _longs(gram=gram, head=lower[at - 1], tail=lower[at], n=n)

    return run


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _store(df: DataFrame, path: str, key: str, parts: int) -> None:
    df.withColumn("part", _part(key, parts)).repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(path)


def _looked_up(rows: DataFrame, key: str, facts: DataFrame, values: list[str], heavy: Column, spread: str) -> DataFrame:
    """rows with the values of facts (key as its first column) for key, null where it has none. heavy: at most `hot` rows of facts;
    those are broadcast, and their rows are dealt by spread in the exchange that serves the others."""
    name = facts.columns[0]
    renamed = lambda df, tag: df.select(F.col(name).alias(f"__{tag}"), *[F.col(v).alias(f"__{tag}_{v}") for v in values])
    hot, cold = renamed(facts.where(heavy), "hot"), renamed(facts.where(~heavy), "cold")
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    out = out.withColumn("__at", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.xxhash64(key, spread)))
    out = out.join(cold, (F.col("__at") == F.col("__cold")) & F.col("__hot").isNull(), "left")
    return out.select(*rows.columns, *[F.coalesce(f"__hot_{v}", f"__cold_{v}").alias(v) for v in values])


def train_tables(docs: DataFrame, path: str, order: int = 3, chunk_chars: int = 3_000_000, part_chars: int = 256_000_000, hot: int = HOT) -> KatzTables:
    """Writes the model of all rows of docs (text) to path, which executors share, and returns it.

    Repeated rows count each; a null or empty text is START and END; an empty table gives a model in which every word is unknown;
    other columns are not read. A task holds the grams of about chunk_chars of text, or of one text if that is longer; a part
    holds those of about part_chars. To the driver go six numbers of each order."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark, texts = docs.sparkSession, docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_chars))
    model = KatzTables(path, order, 0, 0, hot)
    for k in range(1, order + 1):
        found = texts.mapInArrow(_counted(k, chunk_chars), "gram long, head long, tail long, n long").withColumn("part", _part("gram", parts))
        found = found.repartition(parts, "part").groupBy("part", "gram").agg(F.min("head").alias("head"), F.min("tail").alias("tail"), F.sum("n").alias("n"))
        where = work_folder(spark, "counts")
        found.write.mode("overwrite").partitionBy("part").parquet(where)
        counts = spark.read.schema("gram long, head long, tail long, n long, part int").parquet(where).drop("part")
        if k == 1:
            total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
            model = KatzTables(path, order, total["n"] or 0, total["v"], hot)
            _store(counts.withColumn("p", (F.col("n") + 1) / F.lit(float(model.tokens + model.vocabulary + 1))), f"{path}/ngrams/order=1", "gram", parts)
            discard(where)
            continue
        numbers = counts.agg(*[F.count(F.when(F.col("n") == r, 1)) for r in range(1, TURING + 2)]).first()
        star = F.coalesce(*[F.when(F.col("n") == r, F.lit(float(x))) for r, x in enumerate(discounted(list(numbers)), 1)], F.col("n") - 0.5)
        lower = model.ngrams(spark, k - 1).select("gram", "n", "p")
        seen = _looked_up(counts, "tail", lower, ["p"], model.heavy("n"), "gram").groupBy("head")
        sums = seen.agg(F.sum("n").alias("c"), F.sum(F.col("n") - star).alias("spare"), F.sum("p").alias("used"))
        _store(sums.select("head", "c", (F.log10(F.col("spare") / F.col("c")) - F.log10(1 - F.col("used"))).alias("weight")), f"{path}/contexts/order={k}", "head", parts)
        ngrams = _looked_up(counts, "head", model.contexts(spark, k), ["c"], model.heavy("c"), "gram")
        _store(ngrams.select("gram", "head", "tail", "n", (star / F.col("c")).alias("p")), f"{path}/ngrams/order={k}", "gram", parts)
        discard(where)
    spark.createDataFrame([(order, model.tokens, model.vocabulary, hot)], "order int, tokens long, vocabulary long, hot int").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return model


def _distinct(order: int, chunk_chars: int):
    """Of each longest gram of the scored texts: itself, its shorter ends and their contexts (where there are none, a key that no table has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordHash()
        for _, texts in _batches(batches, chunk_chars):
            grams, place, _ = _grams(texts, names, order)
            top = _longest(grams, place)
            at = np.nonzero(place > 0)[0]
            top, first, n = np.unique(top[at], return_index=True, return_counts=True)
            at = at[first]
            nothing = pair_key(top, np.full(len(top), START))  # START ends no gram and no context of two
            ends = {f"g{k}": np.where(place[at] >= k - 1, grams[k - 1][at], nothing) for k in range(1, order + 1)}
            heads = {f"h{k}": np.where(place[at] >= k - 1, grams[k - 2][at - 1], nothing) for k in range(2, order + 1)}
            yield _longs(top=top, uses=n, **ends, **heads)

    return run


def _longest(grams: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    out = grams[-1].copy()
    for k, g in enumerate(grams[:-1]):
        out[place == k] = g[place == k]
    return out


def _used(order: int, chunk_chars: int):
    """The longest grams of each text, and how often it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordHash()
        for b, texts in _batches(batches, chunk_chars):
            grams, place, text = _grams(texts, names, order)
            at = np.nonzero(place > 0)[0]
            top, text = _longest(grams, place)[at], text[at]
            by = np.lexsort((top, text))
            top, text = top[by], text[by]
            new = np.nonzero(np.concatenate([[True], (top[1:] != top[:-1]) | (text[1:] != text[:-1])]) if len(top) else np.empty(0, bool))[0]
            k1, k2 = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[text[new]] for c in ("k1", "k2"))
            yield _longs(k1=k1, k2=k2, top=top[new], times=np.diff(np.append(new, len(top))))

    return run


def score_texts(docs: DataFrame, model: KatzTables, chunk_chars: int = 3_000_000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, score, the log10 probability of the whole text under the model.

    Distinct longest grams are evaluated, order by order, by look-ups in the tables; their values then go back to the texts.
    Rows of one text and doc_id get one score; a null or empty text is its end alone; a null doc_id is kept; an empty table returns
    none; other columns are neither read nor returned."""
    spark, order = docs.sparkSession, model.order
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))
    keyed = docs.select("doc_id", "text").withColumns({"k1": F.xxhash64(salt, "text"), "k2": F.xxhash64("text", salt)})
    names = [*[f"g{k}" for k in range(1, order + 1)], *[f"h{k}" for k in range(2, order + 1)]]
    rows = docs.select("text").mapInArrow(_distinct(order, chunk_chars), ", ".join(f"{c} long" for c in ["top", "uses", *names]))
    rows = rows.groupBy("top").agg(F.sum("uses").alias("uses"), *[F.min(c).alias(c) for c in names])
    value = None
    for k in range(1, order + 1):
        rows = _looked_up(rows, f"g{k}", model.ngrams(spark, k).select("gram", "n", "p"), ["p"], model.heavy("n"), "top").withColumnRenamed("p", f"p{k}")
        if k == 1:
            value = F.log10(F.coalesce("p1", F.lit(1.0 / (model.tokens + model.vocabulary + 1))))
        else:
            rows = _looked_up(rows, f"h{k}", model.contexts(spark, k).select("head", "c", "weight"), ["weight"], model.heavy("c"), "top").withColumnRenamed("weight", f"a{k}")
            value = F.when(F.col(f"p{k}").isNotNull(), F.log10(f"p{k}")).otherwise(F.coalesce(f"a{k}", F.lit(0.0)) + value)
    valued = written(rows.select("top", "uses", value.alias("value")))
    total = valued.agg(F.sum("uses")).first()[0] or 0
    used = keyed.select("k1", "k2", "text").mapInArrow(_used(order, chunk_chars), "k1 long, k2 long, top long, times long")
    used = _looked_up(used, "top", valued, ["value"], F.col("uses") * model.hot >= total, "k1")
    sums = used.groupBy("k1", "k2").agg(F.sum("times").alias("all_tokens"), F.sum(F.col("times") * F.col("value")).alias("total"))
    copies = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    sums = sums.join(copies, ["k1", "k2"]).select("k1", "k2", (F.col("all_tokens") / F.col("copies")).cast("long").alias("n_tokens"), (F.col("total") / F.col("copies")).alias("score"))
    return keyed.select("doc_id", "k1", "k2").join(sums, ["k1", "k2"], "left").select("doc_id", "n_tokens", "score")
