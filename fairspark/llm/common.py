"""What the operators of this subpackage share: words, Arrow mapping, reliable cuts of lineage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workplace import shared_folder, work_folder

#: Java and RE2 class of the characters between words.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder of spark.checkpoint.dir."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table of Parquet files in the shared folder: like cut(), but compressed, and nothing of the query that made it
    stays referred to. It goes when the program ends."""
    path = work_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that nothing refers to any more, now and not when the driver's heap fills up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Native: the words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return pc.cast(batch.column(batch.schema.get_field_index(name)), pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space: bytes.lower and bytes.split are exactly that."""
    return text.lower().split() if text else []


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


class WordHash(dict):
    """64-bit hashes of words; forgets all when it grows over a bound."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, text_words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text_words), np.uint64, len(text_words))


_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of SplitMix64, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(hashes) < n:
        return hashes[:0]
    out = hashes[: len(hashes) - n + 1]
    for i in range(1, n):
        out = mixed(out * _ODD + np.uint64(i)) + hashes[i : len(hashes) - n + 1 + i]
    return mixed(out)


def add_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """Rows of df with what make gives for each Arrow batch; a field named as a column of df replaces it. keep: the columns of df to return (all)."""
    new = [f.name for f in fields]
    old = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    names = [f.name for f in old]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                kept = [b.column(b.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *make(b)], names=[*names, *new])

    return df.mapInArrow(run, T.StructType([*old, *fields]))
