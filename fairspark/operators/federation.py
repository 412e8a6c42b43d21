"""Federations: offsets, quotas, roles, heterogeneity, samples of deletions, designs. All but the draws are DataFrame operations."""

from __future__ import annotations

import hashlib
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .points import small


def client_offsets(points: DataFrame) -> DataFrame:
    """(client, n, first): rows of each client and the flat index of its first row. One row for each client is ordered in one task."""
    counts = points.groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("first", F.sum("n").over(W.orderBy("client").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))


def locate(flat: DataFrame, offsets: DataFrame, cell: int = 4096) -> DataFrame:
    """(flat_index, client, local_row) by the range first <= flat_index < first + n: an equi-join on cells of the index, so that
    neither side is repeated to the other."""
    spans = offsets.where("n > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("first") + F.col("n") - 1) / cell))))
    rows = flat.withColumn("cell", F.floor(F.col("flat_index") / cell))
    hit = rows.join(spans, "cell").where("flat_index >= first and flat_index < first + n")
    return hit.select("flat_index", "client", (F.col("flat_index") - F.col("first")).alias("local_row"))


def dense_clients(points: DataFrame) -> DataFrame:
    """(client, dense): clients numbered from 0 in the order of their ids."""
    return points.select("client").distinct().withColumn("dense", (F.dense_rank().over(W.orderBy("client")) - 1).cast("long"))


def quotas(sizes: DataFrame, n: int) -> DataFrame:
    """(position, size, quota) of (position, size): n shared in proportion, rounded down, then one more for the largest remainders, ties by position."""
    everything = W.partitionBy()
    s = sizes.withColumn("total", F.sum("size").over(everything))
    s = s.withColumn("quota", F.expr(f"(size * {int(n)}L) div total"))
    s = s.withColumn("rest", F.col("size") * F.lit(n) - F.col("quota") * F.col("total"))
    s = s.withColumn("left", F.lit(n) - F.sum("quota").over(everything)).withColumn("rank", F.row_number().over(W.orderBy(F.col("rest").desc(), F.col("position"))))
    checked = F.when(F.col("total") >= n, F.col("quota") + (F.col("rank") <= F.col("left")).cast("long")).otherwise(F.raise_error(F.lit("more rows wanted than there are")).cast("long"))
    return s.select("position", "size", checked.alias("quota"))


def group_counts(points: DataFrame) -> DataFrame:
    """(client, n, a, b): rows, rows of group 0, rows of group 1."""
    return points.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("group_id") == 0).alias("a"), F.count_if(F.col("group_id") == 1).alias("b"))


def roles(counts: DataFrame) -> DataFrame:
    """(role, client): the six special clients among those whose departure leaves both groups rows; ties to the smaller id.
    Fractions are compared by their values a / n, which are exact to compare while a * n < 2**53."""
    everything = W.partitionBy()
    c = counts.withColumn("left", F.least(F.sum("a").over(everything) - F.col("a"), F.sum("b").over(everything) - F.col("b"))).where("left > 0")
    c = c.withColumn("median2", F.round(2 * F.percentile("n", F.lit(0.5)).over(everything)).cast("long"))
    order = {
        "smallest": F.col("n"), "median_size": F.abs(2 * F.col("n") - F.col("median2")), "largest": -F.col("n"), "min_group0_fraction": F.col("a") / F.col("n"), "max_group0_fraction": -(F.col("a") / F.col("n")), "min_surviving_smaller_group": F.col("left"),
    }
    best = c.agg(*[F.min_by("client", F.struct(v, F.col("client"))).alias(k) for k, v in order.items()])
    return best.unpivot([], list(order), "role", "client")


def heterogeneity(points: DataFrame, nearly: float = 0.95) -> DataFrame:
    """By client: counts, shares, shares of the global groups, the kappa component and its maximum, purity."""
    everything = W.partitionBy()
    c = group_counts(points).withColumn("all_a", F.sum("a").over(everything)).withColumn("all_b", F.sum("b").over(everything))
    pure = (F.col("a") == 0) | (F.col("b") == 0)
    component = F.when(pure, 1.0).otherwise(C.kappa((F.col("a") * F.col("all_b")).cast("double"), (F.col("b") * F.col("all_a")).cast("double")))
    c = c.withColumn("pure", pure).withColumn("nearly_pure", ~pure & (F.greatest("a", "b") / F.col("n") >= nearly)).withColumn("kappa", component)
    return c.select("client", "n", "a", "b", (F.col("a") / F.col("n")).alias("share_a"), (F.col("a") / F.col("all_a")).alias("of_a"), (F.col("b") / F.col("all_b")).alias("of_b"), "pure", "nearly_pure", "kappa", F.max("kappa").over(everything).alias("max_kappa"))


def feature_moments(points: DataFrame) -> DataFrame:
    """(client, dim, n, s, ss): exact integer moments of encoded points, from which means and deviations follow with one rounding."""
    return points.select("client", F.posexplode("x").alias("dim", "v")).groupBy("client", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))


def touched_mass(points: DataFrame, removed: DataFrame) -> DataFrame:
    """(client, group_id, original, deleted, kept) of the slices that a request touches; their kept rows add up to the touched mass."""
    sizes = points.groupBy("client", "group_id").agg(F.count(F.lit(1)).alias("original"))
    gone = points.join(removed, ["client", "local_row"], "left_semi").groupBy("client", "group_id").agg(F.count(F.lit(1)).alias("deleted"))
    return sizes.join(gone, ["client", "group_id"]).withColumn("kept", F.col("original") - F.col("deleted"))


def _split(spark: SparkSession, points: DataFrame, flat: np.ndarray) -> DataFrame:
    return locate(spark.createDataFrame([(int(i),) for i in flat], "flat_index long"), client_offsets(points)).select("client", "local_row")


def _keeps_groups(points: DataFrame, removed: DataFrame, groups: int = 2) -> bool:
    left = points.join(small(removed), ["client", "local_row"], "left_anti")
    return left.select("group_id").distinct().count() == groups


def sample_removal(points: DataFrame, seed: int, fraction: float, least: int = 20, tries: int = 10) -> DataFrame:
    """A uniform request over the pooled rows; drawn again with another seed while it would empty a group. Flat indices are by client, then row."""
    n = points.count()
    r = min(max(least, round(n * fraction)), n - 1)
    for _ in range(tries):
        removed = _split(points.sparkSession, points, np.random.default_rng(seed).choice(n, size=r, replace=False))
        if _keeps_groups(points, removed):
            return removed
        seed += 1_000_003  # a fixed value
    raise RuntimeError("no valid request found")


def derived_seed(*fields) -> int:
    """The driver's twin of columns.derived_seed."""
    return int.from_bytes(hashlib.sha256("\0".join(map(str, fields)).encode()).digest()[:8], "little")


def deletion_size(n: int, fraction: str) -> int:
    return max(1, int((Decimal(n) * Decimal(fraction)).quantize(Decimal(1), ROUND_HALF_UP)))


def sample_deletion(points: DataFrame, base_seed: int, label: tuple, fraction: str, tries: int = 100) -> tuple[DataFrame, str, int]:
    """A request by derived seeds, its hash over the stable ids client:row, and the seed."""
    n = points.count()
    seed = derived_seed(base_seed, "uniform-deletion", *label, fraction)
    for attempt in range(tries):
        flat = np.sort(np.random.default_rng(derived_seed(seed, "validity-attempt", attempt)).choice(n, size=deletion_size(n, fraction), replace=False))
        removed = _split(points.sparkSession, points, flat)
        if _keeps_groups(points, removed):
            rows = removed.orderBy("client", "local_row").collect()
            return removed, hashlib.sha256(b"".join(f"{r['client']}:{r['local_row']}\0".encode() for r in rows)).hexdigest(), seed
    raise RuntimeError("no valid request found")


def client_order(clients: list[str], seed: int, role: int) -> list[str]:
    """A fixed permutation of the sorted clients; federations take prefixes of it."""
    keys = sorted(clients)
    return [keys[i] for i in np.random.default_rng(np.random.SeedSequence([seed, role])).permutation(len(keys))]


def ranked(rows: DataFrame, block_rows: int = 65_536) -> DataFrame:
    """rows with rank, their place from 0 in their client by local_row; blocks of local_row are numbered apart, so no task sorts a whole client."""
    cut = rows.withColumn("__block", F.floor(F.col("local_row") / block_rows))
    before = F.coalesce(F.sum("n").over(W.partitionBy("client").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cut.groupBy("client", "__block").agg(F.count(F.lit(1)).alias("n")).select("client", "__block", before.alias("__before"))
    place = F.col("__before") + F.row_number().over(W.partitionBy("client", "__block").orderBy("local_row")) - 1
    return cut.join(starts, ["client", "__block"]).withColumn("rank", place).drop("__block", "__before")


def subsample(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Of each planned client (client, position, quota), quota rows by the client's own generator, in their order, numbered anew.

    Generators draw ranks from counts alone, one task a client; rows are then picked by a join on client and rank.
    """

    def draw(group: pa.Table) -> pa.Table:
        client, position, quota, n = (group[c][0].as_py() for c in ("client", "position", "quota", "n"))
        at = np.sort(np.random.default_rng(np.random.SeedSequence([seed, position])).choice(n, size=quota, replace=False))
        full = lambda v: pa.array(np.full(quota, v, np.int64))
        return pa.table([full(client), full(position), pa.array(at.astype(np.int64)), pa.array(np.arange(quota))], names=["client", "position", "rank", "row"])

    own = rows.join(small(plan.select("client")), "client", "left_semi")
    counts = own.groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    drawn = plan.join(counts, "client").select("client", "position", "quota", "n").groupBy("client").applyInArrow(draw, "client long, position long, rank long, row long")
    return ranked(own).join(drawn, ["client", "rank"]).select(F.col("position").alias("client"), F.col("row").alias("local_row"), F.col("local_row").alias("source_row"), "group_id", "features")


def prepare_federation(rows: DataFrame, n: int, clients: int, seed: int) -> DataFrame:
    """n rows of the first `clients` clients of the fixed order, by largest remainders; an error if they hold fewer or one would stay empty."""
    spark = rows.sparkSession
    sizes = {r["client"]: r["n"] for r in rows.groupBy("client").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(sizes)
    order = [order[i] for i in np.random.default_rng(np.random.SeedSequence([seed, 0])).permutation(len(order))]
    if clients > len(order):
        raise ValueError("not so many clients")
    prefix = spark.createDataFrame([(i, sizes[c], c) for i, c in enumerate(order[:clients])], "position int, size long, client long")
    plan = quotas(prefix.select("position", "size"), n).join(prefix.select("position", "client"), "position").select("client", "position", "quota")
    if plan.where("quota = 0").count():
        raise ValueError("a client would stay empty")
    return subsample(rows, plan, seed)


def factor_design(reference: tuple, levels: dict[str, list]) -> list[dict]:
    """One-factor-at-a-time design: the reference, then each factor's levels; equal points are kept once with all their reasons."""
    names, found = list(levels), {}
    found[tuple(reference)] = ["reference"]
    for i, name in enumerate(names):
        for level in levels[name]:
            found.setdefault((*reference[:i], level, *reference[i + 1 :]), []).append(f"{name} sweep")
    return [{"design": d, **dict(zip(names, point, strict=True)), "reason": "; ".join(why)} for d, (point, why) in enumerate(found.items())]


def design_rank(design: list[dict], levels: dict[str, list]) -> tuple[int, list[str]]:
    """Rank and columns of the main-effects matrix."""
    columns = ["intercept", *(f"{n}={v}" for n, vs in levels.items() for v in vs[1:])]
    rows = [[1.0, *(float(p[n] == v) for n, vs in levels.items() for v in vs[1:])] for p in design]
    return int(np.linalg.matrix_rank(np.array(rows))), columns


def communication(slices: DataFrame, clients: int, rounds: int, k: int, d: int) -> DataFrame:
    """Numbers sent: anchors (k_e rows of d + 1 numbers for each slice) and round statistics (2 k (d + 2) from each client and round)."""
    one = slices.select("client", "group_id", "k_e").distinct().agg(F.count(F.lit(1)).alias("slice_messages"), (F.sum("k_e") * (d + 1)).alias("anchor_scalars"))
    one = one.withColumn("stat_messages", F.lit(clients * rounds).cast("long")).withColumn("stat_scalars", F.lit(clients * rounds * 2 * k * (d + 2)).cast("long"))
    return one.withColumn("total_scalars", F.col("anchor_scalars") + F.col("stat_scalars"))
