"""Operator 3, near-duplicates by SuperMinHash, banding, verification on full sets, and grouping.

Texts with one shingle set form a class; only classes are compared. SuperMinHash gives every shingle a random permutation
of the signature's slots and writes, level by level, rank + uniform value into its slot of that rank; a set is done at the
first level at which all of its slots are filled, since later ranks are larger. Equal bands of two signatures make a
bucket. Verification is in two steps, neither of which emits all pairs of a bucket: every class is compared with the first
of its bucket; then, where classes of a bucket are still in different components, those outside its largest component are
compared with all others, in blocks, and only the links found leave the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, add_columns, cut, grams, mixed, raw, table, words
from .components import connected_components

#: 32 bands of 5 slots miss a pair of similarity 0.8 with a chance of 3 in a million.
BANDS, ROWS = 32, 5
_CHUNK = 100_000
_SALTS = 8


def shingle_set(text_words: list[bytes], k: int, names: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of k words; of fewer words, the whole sequence as one; without words, none."""
    return np.unique(grams(names.array(text_words), min(k, len(text_words)))) if text_words else np.empty(0, np.uint64)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (len(sets), m): the top byte of a slot is the rank that filled it, the rest its uniform value."""
    if len(sets) == 1 and len(sets[0]) > _CHUNK:  # of a long text, the least of the signatures of its parts
        parts = np.array_split(sets[0], -(-len(sets[0]) // _CHUNK))
        return np.minimum.reduce([super_minhash([x], m) for x in parts])
    sizes = np.array([len(s) for s in sets])
    sig = np.full(len(sets) * m, np.iinfo(np.uint64).max)
    element = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    slots = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
    for rank in range(m):
        draw = mixed(element + np.uint64((rank * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
        rows = np.arange(len(element))
        swap = rank + (mixed(draw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m - rank)).astype(np.int64)
        slot = slots[rows, swap]
        slots[rows, swap] = slots[:, rank]
        np.minimum.at(sig, owner * m + slot, (draw >> np.uint64(8)) | np.uint64(rank << 56))
        full = (sig.reshape(-1, m) < np.uint64((rank + 1) << 56)).all(1)
        stay = ~full[owner]
        if not stay.any():
            break
        if rank < 4 or not rank % 8:
            element, owner, slots = element[stay], owner[stay], slots[stay]
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), np.uint64(b + 1))
        for r in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = key
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _digests(blobs: list[bytes]) -> list[pa.Array]:
    """128 bits of each set, in two columns."""
    both = [xxhash.xxh3_128_intdigest(x) for x in blobs]
    return [pa.array(_signed(np.array([(d >> shift) & (2**64 - 1) for d in both], np.uint64))) for shift in (64, 0)]


def _sketch(k: int, bands: int, rows: int):
    names = WordHash()

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        sets = [shingle_set(words(t), k, names) for t in raw(b, "text")]
        sizes = np.array([len(s) for s in sets])
        keys = np.zeros((len(sets), bands), np.uint64)
        todo = np.nonzero(sizes)[0]
        cuts = np.searchsorted(np.cumsum(sizes[todo]), np.arange(_CHUNK, sizes.sum() + _CHUNK, _CHUNK), "left") + 1
        for part in np.split(todo, np.unique(np.minimum(cuts, len(todo)))):
            if len(part):
                keys[part] = band_keys(super_minhash([sets[i] for i in part], bands * rows), bands, rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(sets) + 1, bands), pa.int32()), pa.array(_signed(keys).ravel()))
        return [pa.array(sizes, pa.int64()), *_digests([s.tobytes() for s in sets]), lists]

    return make


_DIGEST = [T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())]
_SKETCH = [T.StructField("n_shingles", T.LongType()), *_DIGEST, T.StructField("bands", T.ArrayType(T.LongType()))]


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted classes (node, hi, lo, first_id); only the texts of their first documents, and those
    without doc_id, are read again."""
    names = WordHash()

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        sets = [shingle_set(words(t), k, names) for t in raw(b, "text")]
        blobs = [s.tobytes() for s in sets]
        return [pa.array(blobs, pa.binary()), *_digests(blobs)]

    fields = [T.StructField("shingles", T.BinaryType()), *_DIGEST]
    firsts = wanted.where("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct()
    texts = docs.join(firsts, "doc_id", "left_semi").select("text")
    if not wanted.where("first_id is null").isEmpty():
        texts = texts.unionByName(docs.where("doc_id is null").select("text"))
    sets = add_columns(texts, fields, make, keep=[]).dropDuplicates(["hi", "lo"])
    return cut(sets.join(wanted.select("hi", "lo", "node"), ["hi", "lo"]).select("node", "shingles"))


def _same(a: np.ndarray, others: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many members of each of the others (concatenated, beginning at starts) are in the sorted set a."""
    at = np.searchsorted(a, others)
    at[at == len(a)] = 0
    return np.add.reduceat((a[at] == others).astype(np.int64), starts)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = int(_same(x, y, np.zeros(1, np.int64))[0])
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([c[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _block_links(rows: list[tuple[int, int, int, bytes]], percent: int) -> list[tuple[int, int]]:
    """Links between components inside one block; rows: (node, comp, role, set). role 0: compared with; 1: compares; 2: both."""
    data = [r for r in rows if r[2] != 1]
    if not data:
        return []
    sets = [np.frombuffer(r[3], np.uint64) for r in data]
    n, comp = np.array([len(s) for s in sets]), np.array([r[1] for r in data])
    node, own = np.array([r[0] for r in data]), np.array([r[2] for r in data])
    merged: dict[int, int] = {}

    def root(c: int) -> int:
        while c in merged:
            c = merged[c]
        return c

    out = []
    for q, c, role, blob in rows:
        if role == 0:
            continue
        x, mine = np.frombuffer(blob, np.uint64), root(c)
        fit = (comp != mine) & (100 * np.minimum(n, len(x)) >= percent * np.maximum(n, len(x))) & ((own == 0) | (node > q))
        at = np.nonzero(fit)[0]
        if not len(at):
            continue
        some = [sets[i] for i in at]
        common = _same(x, np.concatenate(some), np.concatenate([[0], np.cumsum(n[at])[:-1]]))
        for i in at[100 * common >= percent * (n[at] + len(x) - common)]:
            theirs = int(comp[i])
            if theirs != mine:
                out.append((mine, theirs))
                merged[max(mine, theirs)] = min(mine, theirs)
                comp[comp == max(mine, theirs)] = min(mine, theirs)
                mine = min(mine, theirs)
    return out


def _blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            links = _block_links(held, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for b in batches:
            bucket, block, *rest = (c.to_pylist() for c in b.columns)
            for k, row in zip(zip(bucket, block, strict=True), zip(*rest, strict=True), strict=True):
                if k != key:
                    if held:
                        yield done()
                    key, held = k, []
                held.append(row)
        if held:
            yield done()

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = 1000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the smallest doc_id
    that links reach, kept says that it is the document's own. A null or empty text, or one of white space, has no shingles
    and is linked with nothing. A doc_id may have any type that can be ordered. Rows that repeat a doc_id are judged each by
    its own set. A null doc_id takes part, is never kept, and gives no component_id: it is null where no named document is
    linked. An empty table returns none; other columns are neither read nor returned. Ties cannot arise: order is by doc_id
    alone. Sets are compared by 64-bit shingle hashes and classes by 128-bit digests of sets; a long text is hashed in parts.
    The leaves of a hub are dealt over one partition for every `block` of them, each with a copy of the hub's set.
    """
    docs = docs.select("doc_id", "text")
    sketches = cut(add_columns(docs, _SKETCH, _sketch(shingle, bands, rows), keep=["doc_id"]))
    named = sketches.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
    classes = cut(named.withColumn("node", F.monotonically_increasing_id()))  # numbers that the cut makes permanent
    in_bands = classes.select("node", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(in_bands.join(shared, "bucket").select("bucket", "node", "center", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    sets = _full_sets(docs, classes.drop("bands").join(members.select("node").distinct(), "node", "left_semi"), shingle)

    stars = members.where("node <> center").groupBy("center", "node").agg(F.max("blocks").alias("blocks"))
    hubs = stars.select("center", "blocks").distinct().join(sets.select(F.col("node").alias("center"), F.col("shingles").alias("x")), "center")
    hubs = hubs.select("center", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "x")
    leaves = stars.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets.select("node", F.col("shingles").alias("y")), "node")
    pairs = leaves.join(hubs, ["center", "blocks", "part"])
    links = cut(pairs.select("center", "node", "x", "y").mapInArrow(_confirmed(percent), "a long, b long"))
    first = cut(connected_components(links))

    labelled = cut(members.join(first, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp")))
    counted = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_buckets = counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp"))["comp"].alias("main")).where("comps > 1")
    todo = labelled.join(open_buckets.select("bucket", "main", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "bucket")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    asks = F.col("comp") != F.col("main")
    data = todo.select("bucket", own.alias("block"), "node", "comp", F.when(asks, 2).otherwise(0).alias("role"))
    asking = todo.where(asks & (F.col("blocks") > 1)).select("bucket", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != own)).alias("block"), "node", "comp", F.lit(1).alias("role"))
    units = data.unionByName(asking).join(sets, "node").select("bucket", "block", "node", "comp", "role", "shingles")
    more = cut(units.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(_blocks(percent), "a long, b long").distinct())
    second = cut(connected_components(more))

    relabel = second.select(F.col("node").alias("mid"), F.col("component").alias("last"))
    where = first.withColumnRenamed("component", "mid").join(relabel, "mid", "left").select("node", F.coalesce("last", "mid").alias("comp"))
    alone = relabel.join(first.select(F.col("node").alias("mid")), "mid", "left_anti").select(F.col("mid").alias("node"), F.col("last").alias("comp"))
    placed = cut(classes.select("hi", "lo", "node", "first_id").join(where.unionByName(alone), "node", "left"))
    linked = placed.where("comp is not null").withColumn("salt", F.pmod("node", F.lit(_SALTS)))  # a component may hold a third of the classes
    smallest = linked.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    smallest = smallest.select("comp", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("salt"))
    named = linked.join(smallest, ["comp", "salt"]).select("hi", "lo", "component_id")
    named = named.unionByName(placed.where("comp is null").select("hi", "lo", F.col("first_id").alias("component_id")))
    out = sketches.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


OP3_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
sym AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, x FROM sym UNION SELECT r.x, z.y FROM reach r JOIN sym z ON r.y = z.x),
c AS (SELECT x AS doc_id, min(y) AS component FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
