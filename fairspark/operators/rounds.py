"""Assignment and exact statistics of a round, one scan and one small exchange each."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import exact as E
from ..model import Grid, Stats, safe_rows

CACHE = "client long, local_row long, group_id int, x array<long>, label int, runner_up int, own array<double>, other array<double>"
_PART = "group_id int, cluster int, v array<decimal(38,0)>"


def matrix(column: pa.ListArray, n: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def lists(a: np.ndarray) -> pa.ListArray:
    a = np.ascontiguousarray(a)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.ravel()))


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


class Summed:
    """Running sums by (group, cluster) of a signed count, the squared norms and the coordinates: 64-bit while that is safe, then unbounded."""

    def __init__(self, groups: int, k: int):
        self.groups, self.k, self.total, self.used = groups, k, None, None

    def add(self, x: np.ndarray, group: np.ndarray, label: np.ndarray, sign: int = 1) -> None:
        if not len(x):
            return
        if self.total is None:
            self.total = np.zeros((self.groups * self.k, x.shape[1] + 2), object)
            self.used = np.zeros(self.groups * self.k, bool)
        step = safe_rows(x.shape[1], int(np.abs(x).max()))
        cell = group.astype(np.int64) * self.k + label
        for i in range(0, len(x), min(step, 1 << 20)):
            own, at = x[i : i + min(step, 1 << 20)], cell[i : i + min(step, 1 << 20)]
            order = np.argsort(at, kind="stable")
            cells, first = np.unique(at[order], return_index=True)
            rows = np.concatenate([np.ones((len(own), 1), np.int64), (own * own).sum(axis=1, keepdims=True), own], axis=1)[order]
            self.total[cells] += sign * np.add.reduceat(rows, first, axis=0).astype(object)
            self.used[cells] = True

    def batch(self) -> pa.RecordBatch:
        at = np.nonzero(self.used)[0] if self.total is not None else np.empty(0, int)
        values = [[Decimal(v) for v in self.total[i]] for i in at]
        return pa.RecordBatch.from_arrays([pa.array(at // self.k, pa.int32()), pa.array(at % self.k, pa.int32()), pa.array(values, pa.list_(pa.decimal128(38, 0)))], names=["group_id", "cluster", "v"])


def collected(parts: DataFrame, groups: int, k: int, d: int) -> Stats:
    """The server's merge: partial sums of partitions, added by cell and dimension; groups * k * (d + 2) numbers reach the driver."""
    long = parts.select("group_id", "cluster", F.posexplode("v").alias("i", "v")).groupBy("group_id", "cluster", "i").agg(F.sum("v").alias("v"))
    out = Stats.zero(groups, k, d)
    for g, j, i, v in long.collect():
        if i == 0:
            out.n[g][j] = int(v)
        elif i == 1:
            out.ss[g][j] = int(v)
        else:
            out.s[g][j][i - 2] = int(v)
    return out


def statistics(points: DataFrame, centers, grid: Grid, groups: int) -> Stats:
    """Counts, sums and squared norms by group and nearest center of encoded points. Centers are any doubles; labels are exact."""
    c, scale = np.asarray(centers, np.float64), float(grid.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Summed(groups, len(c))
        for b in batches:
            if b.num_rows:
                x = matrix(column(b, "x"), b.num_rows)
                sums.add(x, column(b, "group_id").to_numpy(), E.nearest(x / scale, c)[0])
        yield sums.batch()

    return collected(points.select("group_id", "x").mapInArrow(run, _PART), groups, len(c), c.shape[1])


def assigned(points: DataFrame, centers, grid: Grid) -> DataFrame:
    """Encoded points with label, runner_up and lower and upper bounds of the distances to both: the cache of a round."""
    c, scale = np.asarray(centers, np.float64), float(grid.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                label, runner, own, other = E.nearest(matrix(column(b, "x"), b.num_rows) / scale, c)
                names = ["client", "local_row", "group_id", "x"]
                yield pa.RecordBatch.from_arrays([*(column(b, n) for n in names), pa.array(label, pa.int32()), pa.array(runner, pa.int32()), lists(own), lists(other)], names=[*names, "label", "runner_up", "own", "other"])

    return points.select("client", "local_row", "group_id", "x").mapInArrow(run, CACHE)


def nearest_labels(points: DataFrame, centers, scale: float) -> DataFrame:
    """(group_id, label) of encoded points: the nearest center alone."""
    c = np.asarray(centers, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                label = E.nearest(matrix(column(b, "x"), b.num_rows) / scale, c)[0]
                yield pa.RecordBatch.from_arrays([column(b, "group_id"), pa.array(label, pa.int32())], names=["group_id", "label"])

    return points.select("group_id", "x").mapInArrow(run, "group_id int, label int")


def cached_statistics(cache: DataFrame, groups: int, k: int, d: int) -> Stats:
    """Statistics by the labels of a cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Summed(groups, k)
        for b in batches:
            if b.num_rows:
                sums.add(matrix(column(b, "x"), b.num_rows), column(b, "group_id").to_numpy(), column(b, "label").to_numpy())
        yield sums.batch()

    return collected(cache.select("group_id", "x", "label").mapInArrow(run, _PART), groups, k, d)


def patched(cache: DataFrame, centers, shift, grid: Grid, groups: int, mode: str) -> tuple[Stats, int, int]:
    """What a deletion changes of the cached statistics, the survivors and those of them whose certificate fails.

    cache has a column gone. One pass: rows that are gone leave their old cell; survivors are certified, and failing ones move
    from their old cell to that of the new label. Counts travel as a row of cluster -1.
    """
    c, scale, d = np.asarray(centers, np.float64), float(grid.scale), len(centers[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows, failing = Summed(groups, len(c)), 0, 0
        for b in batches:
            if b.num_rows:
                old, runner, gone = (column(b, n).to_numpy(zero_copy_only=False) for n in ("label", "runner_up", "gone"))
                ok = E.certified(old, runner, matrix(column(b, "own"), b.num_rows), matrix(column(b, "other"), b.num_rows), shift, mode)
                again = ~ok & ~gone
                rows, failing = rows + int((~gone).sum()), failing + int(again.sum())
                if again.any() or gone.any():
                    x, g = matrix(column(b, "x"), b.num_rows), column(b, "group_id").to_numpy()
                    leaving = again | gone
                    sums.add(x[leaving], g[leaving], old[leaving], -1)
                    if again.any():
                        sums.add(x[again], g[again], E.nearest(x[again] / scale, c)[0])
        yield sums.batch()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([[Decimal(rows), Decimal(failing)]], pa.list_(pa.decimal128(38, 0)))], names=["group_id", "cluster", "v"])

    parts = cache.mapInArrow(run, _PART).select("group_id", "cluster", F.posexplode("v").alias("i", "v")).groupBy("group_id", "cluster", "i").agg(F.sum("v").alias("v")).collect()
    counts = {r["i"]: int(r["v"]) for r in parts if r["cluster"] == -1}
    out = Stats.zero(groups, len(c), d)
    for g, j, i, v in parts:
        if j >= 0:
            if i == 0:
                out.n[g][j] = int(v)
            elif i == 1:
                out.ss[g][j] = int(v)
            else:
                out.s[g][j][i - 2] = int(v)
    return out, counts.get(0, 0), counts.get(1, 0)


# The same on centers that lie on the grid, without Python.


def assigned_on_grid(points: DataFrame, centers: list[list[int]]) -> DataFrame:
    """points plus label, runner_up (-1 for one center), d1 and d2: exact squared distances in grid units."""
    near = points.withColumn("__near", C.two_nearest(F.col("x"), centers))
    return near.select("*", F.col("__near")[0]["j"].alias("label"), F.coalesce(F.get("__near", 1)["j"], F.lit(-1)).alias("runner_up"), F.col("__near")[0]["d"].alias("d1"), F.get("__near", 1)["d"].alias("d2")).drop("__near")


def stats_long(labelled: DataFrame, groups: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Dense (group_id, cluster, n, ss) and sparse (group_id, cluster, dim, s) of points with labels."""
    spark = labelled.sparkSession
    cells = spark.range(groups * k).select((F.col("id") / k).cast("int").alias("group_id"), (F.col("id") % k).cast("int").alias("cluster"))
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v)
    found = labelled.groupBy("group_id", F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum(norm.cast("decimal(38,0)")).alias("ss"))
    totals = cells.join(found, ["group_id", "cluster"], "left").select("group_id", "cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ss", F.lit(0)).alias("ss"))
    sums = labelled.select("group_id", F.col("label").alias("cluster"), F.posexplode("x").alias("dim", "v")).groupBy("group_id", "cluster", "dim").agg(F.sum("v").alias("s"))
    return totals, sums


def retracted(before: DataFrame, delta: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """before - delta by key, as one signed aggregate over both."""
    signed = before.select(*keys, *[F.col(v).alias(v) for v in values]).unionByName(delta.select(*keys, *[(-F.col(v)).alias(v) for v in values]))
    return signed.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
