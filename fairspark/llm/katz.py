"""Operator 7, language-model scores by Katz backoff: Good-Turing discounted bigrams over add-one unigrams.

p(w) = (c(w) + 1) / (N + V + 1), with one slot for all unknown words. p(w | h) = r* / c(h) for a pair seen r > 0 times in
training, else alpha(h) p(w), or p(w) after an unseen h. r* is Katz's Good-Turing count up to 5 and r - 1/2 above (and where
Good-Turing gives none between 0 and r), so every context keeps mass, and
alpha(h) = (1 - sum of p(w | h) over seen w) / (1 - sum of p(w) over seen w) makes it sum to one exactly.

One exchange carries the corpus. Chunks of documents are packed by bucket of the word: a bucket then knows c(w), all pairs
(h, w) and where they occur, and gives for each document sums that are linear in what is known only afterwards (the
discounts; alpha, by context), for each context the parts of alpha, and the unseen pairs. Words with a fifty
thousandth of the tokens and pairs of frequent words with a two hundred thousandth or more, so many at most, are known to
all executors: hot words are spread over buckets by pair and sent by number, hot pairs are scored where they are read, so
that no key fills a bucket.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WordHash, _ODD, mixed, raw, release, table, words, written

#: No word holds white space.
END, START = np.uint64(xxhash.xxh3_64_intdigest(b"\n")), np.uint64(xxhash.xxh3_64_intdigest(b"\n\n"))
TURING = 5
#: A hot word has at least one in so many tokens, a hot pair one in so many; there are never more than that.
HOT_WORDS, HOT_PAIRS = 50_000, 200_000
#: Hot pairs are sought among words with at least one in so many tokens.
PAIRED_WORDS = 10_000
_CONTEXT, _PARTIAL, _TABLE, _UNSEEN = 2, 0, 1, 3


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(h * _ODD + np.uint64(1)) + w)


def discounted(counts_of_counts: list[int]) -> np.ndarray:
    """r* for r = 1..TURING from the numbers of pairs seen 1..TURING + 1 times."""
    n = [0, *counts_of_counts]
    out = np.arange(1, TURING + 1) - 0.5
    if n[1] and n[TURING + 1]:
        over = (TURING + 1) * n[TURING + 1] / n[1]
        for r in range(1, TURING + 1):
            if n[r] and over < 1:
                star = ((r + 1) * n[r + 1] / n[r] - r * over) / (1 - over)
                if 0 < star < r:
                    out[r - 1] = star
    return out


@dataclass
class Hot:
    """Counts of the hot words and pairs, sorted by key."""

    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_kinds: Kinds
    buckets: int

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether and where wanted stand in keys."""
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return keys[at] == wanted, at


def _packed(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def _unpacked(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))  # only what _packed has written


def _planes(names: np.ndarray) -> np.ndarray:
    """Sorted names as steps, byte by byte: the high bytes of steps are mostly zero and compress."""
    return np.diff(names, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _named(names: np.ndarray, hot: np.ndarray) -> tuple:
    """Sorted names, those of hot words by their numbers."""
    is_hot, at = Hot.find(hot, names)
    return np.packbits(is_hot), len(names), _small(np.diff(at[is_hot], prepend=0)), _planes(names[~is_hot])


def _from_named(bits: np.ndarray, n: int, steps: np.ndarray, planes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    is_hot, out = np.unpackbits(bits)[:n].astype(bool), np.empty(n, np.uint64)
    out[is_hot], out[~is_hot] = hot[np.cumsum(steps, dtype=np.int64)], _from_planes(planes)
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _tokens(texts: list[bytes | None], names: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and the documents they are of."""
    if not texts:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),)
    each = [names.array(words(t)) for t in texts]
    n = np.array([len(x) + 1 for x in each])
    flat = np.concatenate([y for x in each for y in (x, np.array([END]))])
    before = np.concatenate([[START], flat[:-1]])
    before[np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)] = START
    return before, flat, np.repeat(np.arange(len(each)), n)


def _chunks(b: pa.RecordBatch, chunk_chars: int) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of about chunk_chars bytes and at most 60,000 rows."""
    ids, texts = [], []
    size = 0
    for at in range(0, b.num_rows, 200):  # few texts at once stand beside the batch
        some = b.slice(at, 200)
        for i, t in zip(some.column(some.schema.get_field_index("doc_id")).to_pylist(), raw(some, "text"), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or b"")
            if size >= chunk_chars or len(ids) == 60_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _counts(chunk_chars: int, hot_words: np.ndarray | None = None):
    """Counts of training words by chunk, or of the pairs of hot words (START is always a hot context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordHash()
        for b in batches:
            for ids, texts in _chunks(b, chunk_chars):
                h, w, _ = _tokens([t for i, t in zip(ids, texts, strict=True) if not held_out(i)], names)
                if hot_words is not None:
                    both = Hot.find(hot_words, w)[0]
                    both[both] = Hot.find(hot_words, h[both])[0] | (h[both] == START)
                    h, w = h[both], w[both]
                    key, first, n = np.unique(pair_key(h, w), return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, h[first], w[first])] + [pa.array(n)], names=["key", "h", "w", "n"])
                else:
                    key, n = np.unique(w, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


class Kinds:
    """What a token adds to its document, by kind of pair: known to the base score, to the score, and which count it raises."""

    def __init__(self, pair_count: np.ndarray, word_count: np.ndarray, is_end: np.ndarray):
        self.base = np.log10(word_count + 1)
        self.known = word_count > 0
        self.count = np.minimum(pair_count, TURING + 1).astype(np.int8)  # 0: unseen
        in_context = np.where(self.known & ~is_end, np.log10(np.maximum(word_count, 1)), 0.0)
        self.score = np.where(self.count > TURING, np.log10(np.maximum(pair_count, 1) - 0.5), np.where(self.count == 0, self.base, 0.0)) - in_context


class _Sums:
    """Of each document of a chunk: what is known of its base score and its score, and how often each kind of token occurs."""

    def __init__(self, n: int):
        self.base, self.score = np.zeros(n), np.zeros(n)
        self.counts = np.zeros((TURING + 2, n), np.int64)  # known words, unseen pairs, pairs seen 1..TURING times

    def add(self, doc: np.ndarray, times: np.ndarray | None, kinds: np.ndarray, of: Kinds) -> None:
        """times: None for once each."""
        n, once = len(self.base), (lambda x: x) if times is None else (lambda x: times * x)
        self.base += np.bincount(doc, weights=once(of.base[kinds]), minlength=n)
        self.score += np.bincount(doc, weights=once(of.score[kinds]), minlength=n)
        self.counts[0] += np.bincount(doc, weights=once(of.known[kinds]), minlength=n).astype(np.int64)
        cell = doc.astype(np.int64) * (TURING + 2) + of.count[kinds]
        self.counts[1:] += np.bincount(cell, weights=times, minlength=n * (TURING + 2)).reshape(n, -1).T[: TURING + 1].astype(np.int64)

    def packed(self) -> bytes:
        has = np.nonzero(self.counts[:2].any(0) | self.counts[2:].any(0) | (self.base != 0) | (self.score != 0))[0]
        return _packed(_small(has), self.base[has], self.score[has], [_small(c[has]) for c in self.counts])


_ROW = "bucket int, kind int, chunk long, payload binary"


def _deal(hot, chunk_chars: int):
    """Chunks of documents, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shared, number = WordHash(), hot.value, 0
        for b in batches:
            for ids, texts in _chunks(b, chunk_chars):
                chunk = (TaskContext.get().partitionId() << 24) | number
                number += 1
                out: list[tuple[int, int, int, bytes]] = []
                h, w, doc = _tokens(texts, names)
                del texts
                learn = np.array([not held_out(i) for i in ids])
                sums = _Sums(len(ids))
                key = pair_key(h, w)
                is_hot, at = Hot.find(shared.pairs, key)
                if is_hot.any():
                    sums.add(doc[is_hot], None, at[is_hot], shared.pair_kinds)
                n_tokens = np.bincount(doc, minlength=len(ids))
                out.append((chunk % shared.buckets, _TABLE, chunk, _packed(ids, ~learn, n_tokens, sums.packed())))
                key, h, w, doc = (x[~is_hot] for x in (key, h, w, doc))
                out += _by_bucket(key, h, w, doc, learn, shared, chunk)
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["bucket", "kind", "chunk", "payload"])

    return run


def _by_bucket(key, h, w, doc, learn, hot: Hot, chunk: int) -> list[tuple[int, int, int, bytes]]:
    if not len(key):
        return []
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order].astype(np.int32)
    new_pair = np.concatenate([[True], key[1:] != key[:-1]])
    new = np.nonzero(new_pair | np.concatenate([[True], doc[1:] != doc[:-1]]))[0]  # of each pair, a run for each document
    times = np.diff(np.append(new, len(key)))
    doc, pair_of = doc[new], np.cumsum(new_pair)[new] - 1
    first = order[np.nonzero(new_pair)[0]]
    h, w = h[first], w[first]
    trained = np.bincount(pair_of, weights=times * learn[doc], minlength=len(h)).astype(np.int64)
    spread = np.where(Hot.find(hot.words, w)[0], pair_key(w, h), mixed(w + _ODD))
    bucket = (spread % np.uint64(hot.buckets)).astype(np.int64)
    docs_of = np.bincount(pair_of, minlength=len(h))
    start = np.cumsum(docs_of) - docs_of
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(hot.buckets + 1))
    out = []
    for k in range(hot.buckets):
        own = order[ends[k] : ends[k + 1]]
        if len(own):
            own = own[np.argsort(w[own], kind="stable")]
            n = docs_of[own]
            at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            w_names, w_runs = np.unique(w[own], return_counts=True)
            h_names, h_at = np.unique(h[own], return_inverse=True)
            out.append((k, _PARTIAL, chunk, _packed(_named(w_names, hot.words), _small(w_runs), _named(h_names, hot.words), _small(h_at), _small(trained[own]), _small(n), _small(doc[at]), _small(times[at]))))
    return out


_FOUND = "kind int, chunk long, payload binary, seen array<long>"


def _meet(hot):
    """All chunks of one bucket: sums by document, parts of alpha by context, unseen pairs, and the numbers of pairs by count."""

    def run(group: pa.Table) -> pa.Table:
        shared = hot.value
        out: list[tuple[int, int, bytes, list[int] | None]] = []
        chunks, parts = [], []
        for kind, chunk, blob in zip(group["kind"].to_pylist(), group["chunk"].to_pylist(), group["payload"].to_pylist(), strict=True):
            if kind == _TABLE:
                out.append((_TABLE, chunk, blob, None))
            else:
                chunks.append(chunk)
                w_names, w_runs, h_names, *rest = _unpacked(blob)
                parts.append((_from_named(*w_names, shared.words), w_runs, _from_named(*h_names, shared.words), *rest))
        if parts:
            of = lambda p: (np.repeat(p[0], p[1]), p[2][p[3]])  # noqa: E731  words and contexts of a chunk's pairs
            ends = np.cumsum([len(p[3]) for p in parts])
            keys = np.concatenate([pair_key(h, w) for w, h in map(of, parts)])
            _, first, kind_of = np.unique(keys, return_index=True, return_inverse=True)
            del keys
            kind_of = kind_of.astype(np.int32)
            w, h = np.empty(len(first), np.uint64), np.empty(len(first), np.uint64)
            order = np.argsort(first)
            cuts = np.searchsorted(first[order], np.concatenate([[0], ends]))
            for i, p in enumerate(parts):
                here = order[cuts[i] : cuts[i + 1]]
                at = first[here] - (ends[i] - len(p[3]))
                w[here], h[here] = (x[at] for x in of(p))
            del first, order
            pair_count = np.bincount(kind_of, weights=np.concatenate([p[4] for p in parts]), minlength=len(w)).astype(np.int64)
            is_hot, at = Hot.find(shared.words, w)
            _, w_of = np.unique(w, return_inverse=True)
            word_count = np.bincount(w_of, weights=pair_count).astype(np.int64)[w_of]
            if is_hot.any():
                word_count[is_hot] = shared.word_counts[at[is_hot]]
            del w_of, is_hot, at
            seen = pair_count > 0
            names, by = np.unique(h[seen], return_inverse=True)
            r = pair_count[seen]
            columns = [np.bincount(by, weights=x, minlength=len(names)).astype(np.int64) for x in (word_count[seen] + 1, *(r == k for k in range(1, TURING + 1)), r > TURING)]
            out.append((_CONTEXT, 0, _packed(names, [_small(c) for c in columns]), [int((r == k).sum()) for k in range(1, TURING + 2)]))
            del names, by, r, columns, seen
            kinds_of = Kinds(pair_count, word_count, w == END)
            for i, (chunk, p) in enumerate(zip(chunks, parts, strict=True)):
                kinds = np.repeat(kind_of[ends[i] - len(p[3]) : ends[i]], p[5])
                doc, times = p[6].astype(np.int32), p[7].astype(np.float64)
                sums = _Sums(int(doc.max()) + 1)
                sums.add(doc, times, kinds, kinds_of)
                out.append((_PARTIAL, chunk, sums.packed(), None))
                if (new := kinds_of.count[kinds] == 0).any():
                    out.append((_UNSEEN, chunk, _packed(h[kinds[new]], _small(doc[new]), _small(times[new].astype(np.int64))), None))
                parts[i] = None
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64()))], names=["kind", "chunk", "payload", "seen"])

    return run


def _contexts(star: np.ndarray):
    kept = np.concatenate([np.arange(1, TURING + 1) - star, [0.5]])  # what a pair of each count leaves to the unseen ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                names, (mass, *pairs) = _unpacked(blob)
                left = sum(k * p for k, p in zip(kept, pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(mass.astype(np.int64)), pa.array(np.asarray(left, np.float64))], names=["h", "mass", "left_over"])

    return run


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h, doc, times = _unpacked(blob)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((chunk << 16) + doc.astype(np.int64)), pa.array(times.astype(np.int64))], names=["h", "uid", "times"])


def _assembled(star: np.ndarray, size: float, starts: int, id_type: pa.DataType):
    logs = np.log10(star)

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["kind"].to_pylist(), group["payload"].to_pylist(), strict=True), key=lambda x: -x[0])
        ids, held, n_tokens, own = _unpacked(rows[0][1])
        base, score, counts = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros((TURING + 2, len(ids)), np.int64)
        for blob in sorted([own, *(x[1] for x in rows[1:])]):  # in a fixed order, so that sums repeat
            at, b, s, c = _unpacked(blob)
            base[at] += b
            score[at] += s
            for k in range(TURING + 2):
                counts[k][at] += c[k].astype(np.int64)
        base -= n_tokens * np.log10(size)
        score += logs @ counts[2:] - counts[1] * np.log10(size) - (np.log10(starts) if starts else 0.0)
        uid = (group["chunk"][0].as_py() << 16) + np.arange(len(ids))
        return pa.table([pa.array(uid), pa.array(ids, id_type), pa.array(held), pa.array(n_tokens.astype(np.int64)), pa.array(counts[0]), pa.array(base), pa.array(score)], names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "part"])

    return run


def katz_scores(docs: DataFrame, chunk_chars: int = 3_000_000, bucket_chars: int = 12_000_000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(doc_id) mod 7 = 2 are held out, the others train. Tokens: lower-cased words and one end. n_known:
    tokens whose word occurs in training. base_score: add-one unigrams, score: the Katz model, both log10 of the whole text.
    A null or empty text is its end alone; a null doc_id counts as the empty string; repeated rows train and are scored each;
    without training documents all words are unknown and both scores are 0; an empty table returns none; other columns are
    neither read nor returned. Words are known by 64-bit hashes. Memory of a task: about chunk_chars of text when dealing,
    bucket_chars when meeting; for far larger corpora raise both, as their number of pieces is chunks times buckets.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unigrams = docs.mapInArrow(_counts(chunk_chars), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    total = unigrams.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("key") == int(END.view(np.int64)), F.col("n"))).alias("docs")).first()
    tokens, vocabulary, starts = total["n"] or 0, total["v"], total["docs"] or 0
    top = sorted((np.int64(r["key"]).view(np.uint64), r["n"]) for r in unigrams.where(F.col("n") * HOT_WORDS >= tokens).collect())  # HOT_WORDS at most
    unigrams.unpersist()
    hot_words = np.array([x[0] for x in top], np.uint64)
    paired = np.array([x[0] for x in top if x[1] * PAIRED_WORDS >= tokens], np.uint64)
    pairs = docs.mapInArrow(_counts(chunk_chars, paired), "key long, h long, w long, n long").groupBy("key", "h", "w").agg(F.sum("n").alias("n"))
    hot_pairs = sorted(((np.int64(r["key"]).view(np.uint64), r["h"], np.int64(r["w"]).view(np.uint64), r["n"]) for r in pairs.where((F.col("n") * HOT_PAIRS >= tokens) & (F.col("n") > TURING + 1)).collect()), key=lambda x: x[0])
    count_of = dict(top)
    kinds = Kinds(np.array([x[3] for x in hot_pairs], np.int64), np.array([count_of[x[2]] for x in hot_pairs], np.int64), np.array([x[2] == END for x in hot_pairs], bool))
    hot = Hot(hot_words, np.array([x[1] for x in top], np.int64), np.array([x[0] for x in hot_pairs], np.uint64), kinds, max(1, -(-size // bucket_chars)))
    shared = spark.sparkContext.broadcast(hot)
    release(spark)

    found = written(docs.mapInArrow(_deal(shared, chunk_chars), _ROW).groupBy("bucket").applyInArrow(_meet(shared), _FOUND))
    seen = found.where("seen is not null").agg(*[F.sum(F.col("seen")[k]).alias(f"n{k}") for k in range(TURING + 1)]).first()
    release(spark)  # the exchanged corpus is not needed any more
    star, slots = discounted([x or 0 for x in seen]), float(tokens + vocabulary + 1)
    parts = found.where(F.col("kind") == _CONTEXT).select("payload").mapInArrow(_contexts(star), "h long, mass long, left_over double")
    extra = [(int(h), int(count_of[w]) + 1, 0.5) for _, h, w, _ in hot_pairs]
    if extra:
        parts = parts.unionAll(spark.createDataFrame(extra, "h long, mass long, left_over double"))
    backoff = parts.groupBy("h").agg((F.log10(F.sum("left_over")) - F.log10(F.lit(1.0) - F.sum("mass") / F.lit(slots))).alias("weight"))
    unseen = found.where(F.col("kind") == _UNSEEN).select("chunk", "payload").mapInArrow(_unseen, "h long, uid long, times long")
    owed = unseen.join(backoff, "h").groupBy("uid").agg(F.sum(F.col("times") * F.col("weight")).alias("owed"))
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    rows = found.where(F.col("kind").isin(_PARTIAL, _TABLE)).select("kind", "chunk", "payload").groupBy("chunk")
    rows = rows.applyInArrow(_assembled(star, slots, starts, id_type), f"uid long, doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, part double")
    return rows.join(owed, "uid", "left").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", (F.col("part") + F.coalesce("owed", F.lit(0.0))).alias("score"))


def op7_katz_scores(spark, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))
