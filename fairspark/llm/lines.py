"""Operator 9, line dedup: normalised lines are hashed and counted by document; frequent ones go, the rest is joined again by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut, raw


def line_keys(lines: list[bytes], min_chars: int) -> list[int]:
    """A signed 64-bit hash for each line; 0 for a line whose key is too short to count."""
    out = []
    for line in lines:
        key = line.strip().lower()
        long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append((xxhash.xxh3_64_intdigest(key) - (1 << 63) or 1) if long_enough else 0)
    return out


def _counted(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: list[int] = []
            for text in raw(b, "text"):
                seen.extend(set(line_keys((text or b"").split(b"\n"), min_chars)))
            key, n = np.unique(np.array(seen, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[key != 0]), pa.array(n[key != 0])], names=["key", "n"])

    return run


def _own_keys(min_chars: int, of: str):
    """A row for each different key of a row of texts, with the column `of`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(set(line_keys((t or b"").split(b"\n"), min_chars)) - {0}) for t in raw(b, "text")]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([k for x in own for k in x], pa.int64())], names=[of, "key"])

    return run


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_column: str | None = None) -> DataFrame:
    """key: hashes of the normalised lines of min_docs documents or more. Batches send each key once, so that no key is hot in the shuffle.

    Rows with the same value of id_column are one document, rows without one are documents of their own, as all rows are if
    id_column is None. Ids that occur once, usually all, need no pairs of id and key in the exchange.
    """
    texts = docs.select("text") if id_column is None else docs.select(F.col(id_column).alias("__id"), "text")
    again = None
    if id_column is not None:
        again = cut(texts.where("__id is not null").groupBy("__id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id"))
        again = None if again.isEmpty() else again
    once = texts if again is None else texts.join(again, "__id", "left_anti")
    counts = once.select("text").mapInArrow(_counted(min_chars), "key long, n long")
    if again is not None:
        pairs = texts.join(again, "__id", "left_semi").select("__id", "text").mapInArrow(_own_keys(min_chars, "__id"), T.StructType([texts.schema["__id"], T.StructField("key", T.LongType())]))
        counts = counts.unionAll(pairs.distinct().select("key", F.lit(1).cast("long").alias("n")))
    return counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("key")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_limit: int = 1_000_000, id_column: str | None = None) -> DataFrame:
    """docs with its text without the lines that min_docs documents or more hold, plus n_lines (before) and n_dropped (both long).

    A line is what stands between \\n; its key is the line without ASCII white space at the ends, A-Z lower-cased.
    Keys of under min_chars code points stay. A null text has one empty line and stays null; an empty text stays empty;
    a text that loses every line becomes empty. Rows that share a value of id_column count as one document, rows without one
    each, and each row if no column is named; every row is returned. An empty table gives an
    empty one. A column of docs named n_lines or n_dropped is replaced; all others are returned as they are.
    The frequent keys go to all executors only if there are broadcast_limit at most; else they are joined by key.
    """
    hot = cut(frequent_lines(docs, min_docs, min_chars, id_column))
    if hot.count() <= broadcast_limit:
        keys = docs.sparkSession.sparkContext.broadcast(frozenset(hot.toArrow().column("key").to_pylist()))
        return _rewritten(docs, min_chars, lambda b: [keys.value] * b.num_rows)
    keyed = docs.withColumn("__rid", F.struct(F.xxhash64("text"), F.length("text")))
    rid = keyed.schema["__rid"]
    found = keyed.select("__rid", "text").dropDuplicates(["__rid"]).mapInArrow(_own_keys(min_chars, "__rid"), T.StructType([rid, T.StructField("key", T.LongType())]))
    drops = found.join(hot, "key", "left_semi").groupBy("__rid").agg(F.collect_list("key").alias("__drop"))
    both = keyed.alias("d").join(drops.alias("k"), F.col("d.__rid").eqNullSafe(F.col("k.__rid")), "left").select("d.*", "k.__drop").drop("__rid")
    return _rewritten(both, min_chars, lambda b: [x or () for x in b.column(b.schema.get_field_index("__drop")).to_pylist()]).drop("__drop")


def _rewritten(docs: DataFrame, min_chars: int, hot_keys) -> DataFrame:
    def make(b: pa.RecordBatch) -> list[pa.Array]:
        texts, n_lines, n_dropped = [], [], []
        for text, hot in zip(raw(b, "text"), hot_keys(b), strict=True):
            all_lines = (text or b"").split(b"\n")
            stay = [line for line, k in zip(all_lines, line_keys(all_lines, min_chars), strict=True) if not k or k not in hot]
            texts.append(None if text is None else b"\n".join(stay))
            n_lines.append(len(all_lines))
            n_dropped.append(len(all_lines) - len(stay))
        return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return add_columns(docs, fields, make).select(*[F.col(f"`{c}`") for c in order], "n_lines", "n_dropped")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), id_column="doc_id")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS row FROM documents),
l AS (SELECT doc_id, row, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, true AS hot FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce('id ' || doc_id, 'row ' || row)) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id, row
"""
