"""Operator 6, benchmark decontamination by winnowing.

Of the hashes of all runs of `gram` words, each window of `window` neighbouring runs keeps its smallest. Texts that share
gram + window - 1 words or more therefore keep a common hash inside the shared span, whatever stands around it. The
benchmark's kept hashes meet those of the documents; each meeting is extended word by word in both directions, and
spans of at least the wanted length are hits. A small benchmark is broadcast as an index. A large one meets the documents
in a join by hash: a kept hash carries the few words around it, which decide every window of the wanted length that
holds it, so no text is sent; windows that follow one another are put together into spans.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, UPPER, WordHash, add_columns, cut, grams, raw

#: Bytes of words as they are, A-Z lower-cased, all else a blank: UTF-8 bytes over 0x7F belong to words.
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEEP).split()


def minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the (rightmost) smallest hash of each run of `window` hashes; of a shorter array, of the whole."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.empty(0, np.int64)
    low, at = hashes[window - 1 :].copy(), np.arange(window - 1, len(hashes))
    for back in range(1, window):
        other = hashes[window - 1 - back : len(hashes) - back]
        less = other < low
        low[less] = other[less]
        at[less] = np.nonzero(less)[0] + window - 1 - back
    return np.unique(at)


class Index:
    """Fingerprints of the benchmark's items, with their words numbered. Items of equal words are one, with several names."""

    def __init__(self, items: list[tuple[str, bytes | None]], span: int, gram: int):
        self.span, self.gram, self.window = span, gram, span - gram + 1
        self.number: dict[bytes, int] = {}
        self.items: list[np.ndarray] = []
        self.names: list[list[str]] = []
        known: dict[bytes, int] = {}
        short: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in item_words(text)], np.int64)
            if not len(ids):
                continue
            k = known.setdefault(ids.tobytes(), len(self.items))
            if k < len(self.items):
                self.names[k].append(name)
                continue
            self.items.append(ids)
            self.names.append([name])
            if len(ids) < span:
                short[len(ids)][ids.tobytes()].add(k)
            else:
                h = grams(ids.astype(np.uint64), gram)
                for p in minima(h, self.window):
                    at[int(h[p])].append((k, int(p)))
        self.short = {n: dict(x) for n, x in short.items()}
        self.at = dict(at)
        self.keys = np.array(sorted(self.at), np.uint64)
        self.short_first = {n: np.unique([np.frombuffer(x, np.int64)[0] for x in found]) for n, found in self.short.items()}

    def hits(self, text_words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, end, item) of the maximal shared spans of a document, all windows inside them being occurrences."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in text_words), np.int64, len(text_words))
        out = set()
        if len(ids) >= self.span and len(self.keys):
            h = grams(ids.astype(np.uint64), self.gram)
            known = np.cumsum(np.concatenate([[0], ids == 0]))
            p = minima(h, self.window)
            p = p[known[p + self.gram] == known[p]]  # a run with a word that no item has cannot match
            at = np.searchsorted(self.keys, h[p])
            at[at == len(self.keys)] = 0
            done: dict[tuple[int, int], int] = {}
            for q in p[self.keys[at] == h[p]].tolist():
                for k, i in self.at[int(h[q])]:
                    if done.get((k, q - i), -1) >= q:
                        continue
                    start, end = self._extended(ids, self.items[k], q, i)
                    done[k, q - i] = end
                    if end - start >= self.span:
                        out.add((start, end, k))
        for n, found in self.short.items():
            for q in np.nonzero(np.isin(ids[: max(0, len(ids) - n + 1)], self.short_first[n]))[0].tolist():
                out.update((q, q + n, k) for k in found.get(ids[q : q + n].tobytes(), ()))
        return sorted(out)

    @staticmethod
    def _extended(ids: np.ndarray, item: np.ndarray, q: int, i: int) -> tuple[int, int]:
        back = min(q, i)
        differ = np.nonzero(ids[q - back : q] != item[i - back : i])[0]
        start = q - back + (int(differ[-1]) + 1 if len(differ) else 0)
        ahead = min(len(ids) - q, len(item) - i)
        differ = np.nonzero(ids[q : q + ahead] != item[i : i + ahead])[0]
        return start, q + (int(differ[0]) if len(differ) else ahead)


_HIT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("item", T.StringType())]))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, gram: int = 6, broadcast_chars: int = 20_000_000, item_column: str = "item_id") -> DataFrame:
    """docs plus n_words (long) and hits: array of (start, end, item), the word spans shared with benchmark items.

    A span is a maximal run of `span` or more words that document and item share, or the whole of an item of fewer words.
    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A null or empty text has no words and no
    hits; an item without words matches nothing; a null item id is the empty string; an empty benchmark gives no hits.
    Repeated documents and items are each reported. Columns of docs named n_words or hits are replaced.
    The benchmark's size is measured: up to broadcast_chars bytes of text it is broadcast, and the documents pass it in one
    stage without a shuffle; beyond, fingerprints are joined by their hashes, and words compared by theirs (64 bits).
    """
    items = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > broadcast_chars:
        return _joined(docs, items, span, gram)
    got = items.toArrow().to_pydict()
    index = docs.sparkSession.sparkContext.broadcast(Index(sorted(zip(got["item"], got["text"], strict=True), key=lambda x: (x[0], x[1] or b"")), span, gram))

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        known: Index = index.value
        n_words, hits = [], []
        for text in raw(b, "text"):
            own = item_words(text)
            n_words.append(len(own))
            hits.append([{"start": s, "end": e, "item": name} for s, e, k in known.hits(own) for name in known.names[k]])
        return [pa.array(n_words, pa.int64()), pa.array(hits, to_arrow_type(_HIT))]

    out = add_columns(docs, [T.StructField("n_words", T.LongType()), T.StructField("hits", _HIT)], make)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "hits")], "n_words", "hits")


class Prints:
    """The fingerprints of a text: (key, position, words around), the words as hashes.

    Of texts of `span` words or more: the kept hashes, each with the words of all windows of `span` words that hold its run.
    Of windows of n < span words (of an item its whole; of a document, for the lengths that items have, all that may
    match): their hash and words.
    """

    def __init__(self, span: int, gram: int, outside: int):
        self.span, self.gram, self.side, self.outside = span, gram, span - gram, np.uint64(outside)
        self.names = WordHash()

    def of(self, own: list[bytes], lengths: Sequence[int], whole: bool, might) -> list[tuple[int, int, bytes]]:
        ids = self.names.array(own)
        out = []
        if len(ids) >= self.span:
            h = grams(ids, self.gram)
            p = minima(h, self.span - self.gram + 1)
            p = p[might(h[p])]
            room = np.full(self.side, self.outside)
            padded = np.concatenate([room, ids, room])
            out += [(int(h[q]), q, padded[q : q + self.span + self.side].tobytes()) for q in p.tolist()]
        for n in [len(ids)] if whole and 0 < len(ids) < self.span else () if whole else lengths:
            h = grams(ids, n) ^ np.uint64(n)
            out += [(int(h[q]), q, ids[q : q + n].tobytes()) for q in np.nonzero(might(h))[0].tolist()]
        return out


#: Bits of the map that tells which keys items have: a filter of fixed size; what it lets pass wrongly finds no partner.
_MAP_BITS = 1 << 27
_SALTS = 8


def _print_rows(first: pa.Array, found: list[list[tuple[int, int, bytes]]], name: str) -> pa.RecordBatch:
    at = np.repeat(np.arange(len(found)), [len(x) for x in found])
    flat = [x for own in found for x in own]
    keys = np.array([x[0] for x in flat], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([first.take(pa.array(at)), pa.array(keys), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.binary())], names=[name, "key", "at", "around"])


def _windows(span: int, side: int):
    """(rid, digest, start, along, n) of the equal windows of each meeting; along: how far the document's words stand behind the item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, digest, q, i, mine, theirs = (c.to_pylist() for c in b.columns)
            rows = []
            for r in range(b.num_rows):
                x, y = np.frombuffer(mine[r], np.uint64), np.frombuffer(theirs[r], np.uint64)
                if len(x) == len(y) == span + side:
                    same = np.concatenate([[0], np.cumsum(x == y)])
                    rows += [(r, q[r] - side + int(k), span) for k in np.nonzero(same[span:] - same[:-span] == span)[0]]
                elif len(x) == len(y) < span and (x == y).all():
                    rows.append((r, q[r], len(x)))
            at = pa.array([x[0] for x in rows], pa.int64())
            along = pa.array([q[x[0]] - i[x[0]] for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([x[1] for x in rows], pa.int64()), along, pa.array([x[2] for x in rows], pa.int64())], names=["rid", "digest", "start", "along", "n"])

    return run


def _joined(docs: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """contamination() for a benchmark of any size. Keys are salted, as one passage may stand in a third of the documents;
    documents of equal text meet the items once; only fingerprints that items may have leave the documents' tasks."""

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints(span, gram, 1)
        for b in batches:
            yield _print_rows(b.column(0), [prints.of(item_words(t), (), True, lambda h: np.ones(len(h), bool)) for t in raw(b, "text")], "digest")

    def item_digests(b: pa.RecordBatch) -> list[pa.Array]:
        own = [item_words(t) for t in raw(b, "text")]
        return [pa.array([hashlib.sha256(b" ".join(w)).digest() for w in own], pa.binary()), pa.array([len(w) for w in own], pa.int64())]

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType())]
    items = cut(add_columns(items, fields, item_digests).where("n > 0"))
    lengths = sorted(r["n"] for r in items.where(F.col("n") < span).select("n").distinct().collect())
    wanted = cut(items.select("digest", "text").dropDuplicates(["digest"]).mapInArrow(item_prints, "digest binary, key long, at long, around binary"))
    bits = wanted.select(F.pmod("key", F.lit(_MAP_BITS)).alias("bit"))
    bits = bits.groupBy(F.expr("cast(bit div 64 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    known = np.zeros(_MAP_BITS // 64, np.int64)
    known[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def doc_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, bits = Prints(span, gram, 0), shared.value

        def might(h: np.ndarray) -> np.ndarray:
            place = h & np.uint64(_MAP_BITS - 1)
            return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)).astype(np.int64)) & 1 == 1

        for b in batches:
            yield _print_rows(b.column(0), [prints.of(item_words(t), lengths, False, might) for t in raw(b, "text")], "rid")

    def counted(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([len(item_words(t)) for t in raw(b, "text")], pa.int64())]

    text = F.coalesce(F.col("text"), F.lit(""))
    rid = F.concat_ws(":", F.xxhash64(text).cast("string"), F.hash(text).cast("string"), F.length(text).cast("string"))
    keyed = docs.withColumn("__rid", rid)
    seen = keyed.select(F.col("__rid").alias("rid"), "text").mapInArrow(doc_prints, "rid string, key long, at long, around binary").dropDuplicates(["rid", "key", "at"])
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(_SALTS)))
    spread = wanted.select("digest", "key", F.col("at").alias("i"), F.col("around").alias("theirs"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("salt"))
    met = seen.join(spread, ["key", "salt"]).select("rid", "digest", "at", "i", "around", "theirs")
    equal = met.mapInArrow(_windows(span, span - gram), "rid string, digest binary, start long, along long, n long").distinct()
    line = W.partitionBy("rid", "digest", "along", "n").orderBy("start")
    runs = equal.withColumn("run", F.col("start") - F.row_number().over(line))
    runs = runs.withColumn("run", F.when(F.col("n") < span, F.col("start")).otherwise(F.col("run")))  # whole short items stay apart
    spans = runs.groupBy("rid", "digest", "along", "n", "run").agg(F.min("start").alias("start"), (F.max("start") + F.col("n")).alias("end"))
    found = spans.join(items.select("digest", "item"), "digest").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "item"))).alias("__hits"))
    both = add_columns(keyed, [T.StructField("__n", T.LongType())], counted).join(found.withColumnRenamed("rid", "__rid"), "__rid", "left")
    hits = F.coalesce(F.col("__hits"), F.array().cast(_HIT))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "hits")], F.col("__n").alias("n_words"), hits.alias("hits"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))

    def digest(b: pa.RecordBatch) -> list[pa.Array]:
        n_hit, n_items, sha = [], [], []
        for hits in b.column(b.schema.get_field_index("hits")).to_pylist():
            n, end = 0, 0
            for h in sorted(hits, key=lambda h: (h["start"], h["end"])):
                n += max(0, h["end"] - max(end, h["start"]))
                end = max(end, h["end"])
            ids = sorted({h["item"] for h in hits}, key=str.encode)
            n_hit.append(n)
            n_items.append(len(ids))
            sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        return [pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha), pa.array([n > 0 for n in n_hit])]

    fields = [T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    return add_columns(docs.select("doc_id", "n_words", "hits"), fields, digest, keep=["doc_id", "n_words"])


OP6_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, i, n, item FROM dwin JOIN win USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
