"""Seeding: local representatives by slice, the server's weighted choice, and the pooled choice over all rows."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import exact as E
from ..model import SLICES, Anchors, Center, Settings
from . import rounds as R
from .rounds import column, lists, matrix


#: Rows of a client that one task scans when a draw is located; masses and divisors of these blocks reach the driver.
BLOCK = 65_536
#: Slices and clients of more rows, or of more numbers, are seeded by distributed draws.
SLICE_ROWS = 5_000_000
SLICE_NUMBERS = 20_000_000


def _ordered(group: pa.Table) -> pa.RecordBatch:
    return group.sort_by("local_row").combine_chunks().to_batches()[0]


def _chosen(x: np.ndarray, weights, k: int, words, scale: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Selected rows, their representatives and the label of each row."""
    points = E.exact_if_small(x, int(np.abs(x).max(initial=0)))
    at = E.seed_indices(points, weights, k, words)
    reps = x[at] / scale
    return at, reps, E.nearest(x / scale, reps)[0]


def local_slices(points: DataFrame, seed: int, settings: Settings, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Representatives of each (client, group_id) of encoded points, in the order of local_row, by the slice's own tape.

    Slices are the unit of the draw. One task reads a slice of up to slice_rows rows and SLICE_NUMBERS numbers, vectorised;
    larger ones, few by definition, are seeded one after another by distributed draws, with the same result.
    """
    k, gamma, scale = settings.k, settings.gamma, float(settings.grid.scale)

    def run(group: pa.Table) -> pa.Table:
        b = _ordered(group)
        x, client, g = matrix(column(b, "x"), b.num_rows), column(b, "client")[0].as_py(), column(b, "group_id")[0].as_py()
        own = min(k, len(x))
        at, reps, label = _chosen(x, [1] * len(x), own, E.tape(seed, "local", client, g), scale)
        full = lambda v, kind: pa.array([v] * own, kind)
        arrays = [full(client, pa.int64()), full(g, pa.int32()), pa.array(range(own), pa.int32()), pa.array(at, pa.int64()), lists(reps), lists(E.snapped(reps, gamma)), pa.array(np.bincount(label, minlength=own), pa.int64()), full(own, pa.int32()), full(len(x), pa.int64())]
        return pa.table(arrays, names=["client", "group_id", "slot", "selected_idx", "rep", "anchor", "mult", "k_e", "n_e"])

    points = points.select("client", "local_row", "group_id", "x")
    large = _large(points, ["client", "group_id"], k, slice_rows)
    small = points
    for r in large:
        small = small.where((F.col("client") != r["client"]) | (F.col("group_id") != r["group_id"]))
    out = small.groupBy("client", "group_id").applyInArrow(run, SLICES)
    for r in large:
        out = out.unionByName(_large_slice(points, r["client"], r["group_id"], r["n"], seed, settings))
    return out


def _large(points: DataFrame, keys: list[str], k: int, slice_rows: int) -> list:
    """Keys and rows n of the groups that no single task is to read: more rows than slice_rows or more numbers than SLICE_NUMBERS."""
    held = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"))
    return held.where((F.col("n") > k) & ((F.col("n") > slice_rows) | (F.col("n") * F.col("d") > SLICE_NUMBERS))).collect()


def anchors_of(slices: DataFrame, sizes) -> Anchors:
    """The server's table: slots in canonical order with exact weights mult / size of the group; at most groups * clients * k rows."""
    rows = sorted(slices.select("client", "group_id", "slot", "anchor", "mult").collect(), key=lambda r: (r["client"], r["group_id"], r["slot"]))
    return Anchors([(r["client"], r["group_id"], r["slot"]) for r in rows], [tuple(r["anchor"]) for r in rows], [Fraction(r["mult"], sizes[r["group_id"]]) for r in rows])


def anchor_objective(anchors: Anchors, centers: list[Center]) -> Fraction:
    label = E.nearest(np.array(anchors.rows), np.array(centers))[0]
    return sum((w * E.squared(x, centers[j]) for w, x, j in zip(anchors.weights, anchors.rows, label, strict=True)), Fraction(0))


def server_centers(anchors: Anchors, seed: int, k: int, role: str = "server", rounds: int = 0) -> list[Center]:
    """k anchors by weighted D-squared sampling, then weighted Lloyd rounds while the exact objective does not rise."""
    at = E.seed_indices(E.lattice(anchors.rows), anchors.weights, k, E.tape(seed, role))
    centers = [anchors.rows[i] for i in at]
    for _ in range(rounds):
        label = E.nearest(np.array(anchors.rows), np.array(centers))[0]
        moved = []
        for j, old in enumerate(centers):
            own = [(w, x) for w, x, at in zip(anchors.weights, anchors.rows, label, strict=True) if at == j and w]
            mass = sum(w for w, _ in own)
            moved.append(tuple(float(sum(w * Fraction(x[q]) for w, x in own) / mass) for q in range(len(old))) if own else old)
        if anchor_objective(anchors, moved) > anchor_objective(anchors, centers):
            break
        centers = moved
    return centers


MERGED = "client long, slot int, selected_idx long, rep array<double>, anchor array<double>, h_a long, h_b long, k_e int"


def merged_slices(points: DataFrame, seed: int, settings: Settings, reps: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One summary for each client: rows of both groups weighted by one over the client's own group size. Large clients as in local_slices."""
    gamma, scale = settings.gamma, float(settings.grid.scale)

    def run(group: pa.Table) -> pa.Table:
        b = _ordered(group)
        x, g, client = matrix(column(b, "x"), b.num_rows), column(b, "group_id").to_numpy(), column(b, "client")[0].as_py()
        size, own = np.bincount(g, minlength=2), min(reps, len(x))
        at, rep, label = _chosen(x, [Fraction(1, int(size[v])) for v in g], own, E.tape(seed, "merged_local", client), scale)
        held = [pa.array(np.bincount(label[g == v], minlength=own), pa.int64()) for v in (0, 1)]
        arrays = [pa.array([client] * own, pa.int64()), pa.array(range(own), pa.int32()), pa.array(at, pa.int64()), lists(rep), lists(E.snapped(rep, gamma)), *held, pa.array([own] * own, pa.int32())]
        return pa.table(arrays, names=["client", "slot", "selected_idx", "rep", "anchor", "h_a", "h_b", "k_e"])

    points = points.select("client", "local_row", "group_id", "x")
    large = [r["client"] for r in _large(points, ["client"], reps, slice_rows)]
    out = (points.where(~F.col("client").isin(large)) if large else points).groupBy("client").applyInArrow(run, MERGED)
    for client in large:
        out = out.unionByName(_large_client(points, client, seed, settings, reps))
    return out


def merged_centers(slices: DataFrame, sizes, seed: int, k: int) -> list[Center]:
    rows = sorted(slices.select("client", "slot", "anchor", "h_a", "h_b").collect(), key=lambda r: (r["client"], r["slot"]))
    anchors = Anchors([(r["client"], 0, r["slot"]) for r in rows], [tuple(r["anchor"]) for r in rows], [Fraction(r["h_a"], sizes[0]) + Fraction(r["h_b"], sizes[1]) for r in rows])
    return server_centers(anchors, seed, k, "merged_server")


def distributed_choice(points: DataFrame, weight: Column, k: int, words) -> list[tuple[int, int, list[int]]]:
    """(client, local_row, x) of k encoded points by weighted D-squared sampling in the order of client and local_row.

    weight: a whole number, DECIMAL(38, 0). There are more than k rows. Each draw is two small jobs: masses and common divisors
    of blocks of rows, summed where the rows lie, then the running sum inside the one block that the draw falls into.
    """
    chosen: list[tuple[int, int, list[int]]] = []
    block = F.floor(F.col("local_row") / BLOCK).alias("block")
    while len(chosen) < k:
        near = F.lit(1).cast("decimal(20,0)")
        if chosen:
            gaps = [C.squared_distance(F.col("x"), F.array(*[F.lit(v).cast("long") for v in c])) for _, _, c in chosen]
            near = (F.least(*gaps) if len(gaps) > 1 else gaps[0]).cast("decimal(20,0)")
        massed = points.select("client", block, "local_row", "x", (near * weight).cast("decimal(38,0)").alias("mass")).where("mass > 0")
        parts = massed.select("client", "block", "mass").mapInArrow(_block_parts, _BLOCKS)
        rows = parts.groupBy("client", "block").agg(F.sum("mass").alias("mass"), F.collect_set("divisor").alias("divisors")).collect()
        rows.sort(key=lambda r: (r["client"], r["block"]))
        if not rows:
            break
        divisor = gcd(*(int(v) for r in rows for v in r["divisors"]))
        left = E.below(sum(int(r["mass"]) for r in rows) // divisor, words) * divisor
        for r in rows:
            if left < int(r["mass"]):
                break
            left -= int(r["mass"])
        inside = massed.where((F.col("client") == r["client"]) & (F.col("block") == r["block"])).withColumn("upto", F.sum("mass").over(W.orderBy("local_row")))
        hit = inside.where(F.col("upto") > F.lit(str(left)).cast("decimal(38,0)")).orderBy("local_row").first()
        chosen.append((hit["client"], hit["local_row"], list(hit["x"])))
    if len(chosen) < k:
        taken = {c[:2] for c in chosen}
        first = points.orderBy("client", "local_row").select("client", "local_row", "x").limit(k).collect()
        chosen += [(r["client"], r["local_row"], list(r["x"])) for r in first if (r["client"], r["local_row"]) not in taken][: k - len(chosen)]
    return chosen


def pooled_centers(points: DataFrame, sizes, seed: int, k: int, scale: float) -> list[Center]:
    """Weighted D-squared sampling over all encoded points, weights one over the group's size."""
    n = sum(sizes)
    if k >= n:
        rows = points.orderBy("client", "local_row").select("x").collect()  # k rows at most
        return [tuple(v / scale for v in rows[i]["x"]) for i in E.completed(range(n), n, k)]
    whole = E.as_integers([Fraction(1, s) for s in sizes])
    weight = F.element_at(F.array(*[F.lit(str(w)).cast("decimal(38,0)") for w in whole]), F.col("group_id") + 1)
    return [tuple(v / scale for v in x) for _, _, x in distributed_choice(points, weight, k, E.tape(seed, "centralized"))]


_BLOCKS = "client long, block long, mass decimal(38,0), divisor decimal(38,0)"


def _block_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By batch: sum and greatest common divisor of the masses of each block."""
    for b in batches:
        if b.num_rows:
            parts: dict[tuple[int, int], list[int]] = {}
            for at, mass in zip(zip(b["client"].to_pylist(), b["block"].to_pylist(), strict=True), map(int, b["mass"].to_pylist()), strict=True):
                own = parts.setdefault(at, [0, 0])
                own[0] += mass
                own[1] = gcd(own[1], mass)
            sums = [pa.array([Decimal(v[i]) for v in parts.values()], pa.decimal128(38, 0)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(pa.array([at[i] for at in parts], pa.int64()) for i in (0, 1)), *sums], names=["client", "block", "mass", "divisor"])


def _drawn(own: DataFrame, weight: Column, k: int, words, scale: float) -> tuple[list[int], list[list[float]], dict]:
    """Of points that no single task reads: the places of k drawn rows in the order of local_row, their representatives, and rows by (label, group_id)."""
    chosen = distributed_choice(own, weight, k, words)
    reps = [[v / scale for v in x] for _, _, x in chosen]
    before = own.agg(*[F.count(F.when(F.col("local_row") < row, 1)).alias(f"c{j}") for j, (_, row, _) in enumerate(chosen)]).first()
    labelled = R.nearest_labels(own, reps, scale).groupBy("label", "group_id").agg(F.count(F.lit(1)).alias("n")).collect()
    return list(before), reps, {(r["label"], r["group_id"]): r["n"] for r in labelled}


def _large_slice(points: DataFrame, client: int, g: int, n: int, seed: int, settings: Settings) -> DataFrame:
    """The same result as for a small slice, without a task that reads it whole."""
    own = points.where((F.col("client") == client) & (F.col("group_id") == g))
    at, reps, held = _drawn(own, F.lit(1).cast("decimal(38,0)"), settings.k, E.tape(seed, "local", client, g), float(settings.grid.scale))
    anchors = E.snapped(reps, settings.gamma).tolist()
    rows = [(client, g, j, at[j], reps[j], anchors[j], held.get((j, g), 0), settings.k, n) for j in range(settings.k)]
    return points.sparkSession.createDataFrame(rows, SLICES)


def _large_client(points: DataFrame, client: int, seed: int, settings: Settings, reps: int) -> DataFrame:
    """The same result as for a small client, without a task that reads it whole."""
    own = points.where(F.col("client") == client)
    sizes = {r["group_id"]: r["n"] for r in own.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.lit(None).cast("decimal(38,0)")
    for g, w in zip(sizes, E.as_integers([Fraction(1, n) for n in sizes.values()]), strict=True):
        weight = F.when(F.col("group_id") == g, F.lit(str(w)).cast("decimal(38,0)")).otherwise(weight)
    at, rep, held = _drawn(own, weight, reps, E.tape(seed, "merged_local", client), float(settings.grid.scale))
    anchors = E.snapped(rep, settings.gamma).tolist()
    rows = [(client, j, at[j], rep[j], anchors[j], held.get((j, 0), 0), held.get((j, 1), 0), reps) for j in range(reps)]
    return points.sparkSession.createDataFrame(rows, MERGED)
