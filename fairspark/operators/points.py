"""Points: encoding, checks, retention and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import REMOVED, Grid, safe_rows, whole

#: Requests of at most so many rows are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if counting shows that it has `limit` rows at most."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def encoded(points: DataFrame, grid: Grid) -> DataFrame:
    """points with x, their place on the grid; the represented features are x / scale, so x is all that later steps read."""
    return points.select("client", "local_row", "group_id", C.encode(F.col("features"), grid).alias("x"))


def represented(points: DataFrame, grid: Grid) -> DataFrame:
    return encoded(points, grid).withColumn("features", C.decode(F.col("x"), grid))


def require(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """df, whose evaluation fails where the rule does not hold."""
    checked = F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(checked)


def group_sizes(points: DataFrame, groups: int) -> tuple[int, ...]:
    """Rows of each group; every one of the declared groups must have some."""
    found = {r["group_id"]: r["n"] for r in points.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not set(found) <= set(range(groups)):
        raise ValueError("group out of range")
    sizes = tuple(found.get(g, 0) for g in range(groups))
    if min(sizes) == 0:
        raise ValueError("every declared group must have rows")
    return sizes


def checked_points(points: DataFrame, groups: int, grid: Grid) -> tuple[tuple[int, ...], int]:
    """Sizes of the groups and the dimension, after one pass of checks: keys, finite features, one dimension, groups in range."""
    size = F.size("features")
    bad = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > F.lit(2.0**450)))
    got = points.agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.count_if(bad).alias("bad"),
        F.count_if(F.col("client").isNull() | (F.col("client") < 0) | F.col("local_row").isNull() | (F.col("local_row") < 0)).alias("keys"),
        F.count_if(F.col("group_id").isNull() | (F.col("group_id") < 0) | (F.col("group_id") >= groups)).alias("groups"),
    ).first()
    if not got["n"] or got["low"] != got["high"] or got["bad"] or got["keys"] or got["groups"]:
        raise ValueError("points need rows, one dimension, finite features, keys of zero or more, and groups in range")
    grid.safe_rows(whole(got["low"], "dimension", 1, 4096))
    return group_sizes(points, groups), got["low"]


def dimension_guard(points: DataFrame) -> DataFrame:
    """largest, dimension, safe_rows of encoded points: how many rows may be summed in 64 bits."""
    top = points.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("largest"), F.max(F.size("x")).alias("dimension"))
    worst = F.greatest(F.lit(1), F.col("dimension") * F.col("largest") * F.col("largest"))
    return top.withColumn("safe_rows", F.floor(F.lit(1 << 59) / worst).cast("long"))


def check_range(largest: int, d: int) -> int:
    return safe_rows(d, largest)


def removal_violations(points: DataFrame, removed: DataFrame) -> DataFrame:
    """(client, local_row, problem) for rows of a request that are negative, unknown or repeated."""
    keyed = removed.groupBy("client", "local_row").agg(F.count(F.lit(1)).alias("times"))
    known = points.select("client", "local_row", F.lit(True).alias("known"))
    seen = keyed.join(known, ["client", "local_row"], "left")
    problem = F.when((F.col("local_row") < 0) | (F.col("client") < 0), "negative").when(F.col("known").isNull(), "unknown").when(F.col("times") > 1, "repeated")
    return seen.withColumn("problem", problem).where("problem is not null").select("client", "local_row", "problem")


def checked_request(points: DataFrame, removed: DataFrame) -> DataFrame:
    kinds = dict(removed.dtypes)
    if any(kinds.get(c) not in ("bigint", "int") for c in ("client", "local_row")):
        raise ValueError("a request is a table of integers: client, local_row")
    removed = removed.select(F.col("client").cast("long").alias("client"), F.col("local_row").cast("long").alias("local_row"))
    if found := removal_violations(points, removed).first():
        raise ValueError(f"invalid request: client {found['client']}, row {found['local_row']} is {found['problem']}")
    return removed


def request_frame(spark, removed) -> DataFrame:
    """A request as a table, from a mapping of client to rows or from a table."""
    if isinstance(removed, DataFrame):
        return removed
    rows = [(whole(c, "client", 0), whole(r, "local row", 0)) for c, rows in removed.items() for r in rows]
    return spark.createDataFrame(rows, REMOVED)


def counted_request(points: DataFrame, removed) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """The request as a table, and how many rows it takes of each slice (client, group_id) that it touches.

    A mapping of client to rows is checked here and in the one join that counts; a table is checked by joins.
    """
    if isinstance(removed, DataFrame):
        table = small(checked_request(points, removed))
        return table, _touched(points, table)
    table = request_frame(points.sparkSession, removed)
    if sum(map(len, removed.values())) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    rows = [(int(c), int(r)) for c, own in removed.items() for r in own]
    counts = _touched(points, table) if rows else {}
    if len(set(rows)) < len(rows) or sum(counts.values()) < len(rows):
        raise ValueError("invalid request: a row is repeated or unknown")
    return table, counts


def _touched(points: DataFrame, removed: DataFrame) -> dict[tuple[int, int], int]:
    return {(r["client"], r["group_id"]): r["n"] for r in taken_out(points, removed).groupBy("client", "group_id").agg(F.count(F.lit(1)).alias("n")).collect()}


def marked(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """rows with gone: whether a request takes them."""
    return rows.join(removed.select("client", "local_row", F.lit(True).alias("gone")), ["client", "local_row"], "left").na.fill(False, ["gone"])


def retained(points: DataFrame, removed: DataFrame) -> DataFrame:
    """Survivors. Requests that counted_request has passed carry a broadcast hint if their size allows; others are planned by their statistics."""
    return points.join(removed, ["client", "local_row"], "left_anti")


def taken_out(points: DataFrame, removed: DataFrame) -> DataFrame:
    return points.join(removed, ["client", "local_row"], "left_semi")


def touched_slices(points: DataFrame, removed: DataFrame) -> DataFrame:
    """(client, group_id) of the slices in which a removed row lies."""
    return taken_out(points, removed).select("client", "group_id").distinct()


def identities_of(removed: DataFrame, identities: DataFrame) -> DataFrame:
    """The stable identities of removed rows, sorted; a row without one, or two rows with the same, is an error."""
    found = removed.join(identities, ["client", "local_row"], "left")
    found = require(found, F.col("stable_id").isNotNull(), "a removed row has no identity")
    if not found.groupBy("stable_id").count().where("count > 1").isEmpty():
        raise ValueError("two removed rows share an identity")
    return found.orderBy("client", "local_row")


def partition_differences(whole_table: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows that the parts and the whole do not hold equally often, with side: missing or extra. Empty if the parts partition it."""
    columns = whole_table.columns
    return whole_table.exceptAll(parts.select(columns)).withColumn("side", F.lit("missing")).unionAll(parts.select(columns).exceptAll(whole_table).withColumn("side", F.lit("extra")))
