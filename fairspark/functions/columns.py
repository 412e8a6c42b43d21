"""Column expressions: the grid, distances on it, hashes, ratios. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Grid


def on_grid(x: Column, grid: Grid) -> Column:
    """A coordinate as a multiple of the grid's step: clipped, rounded half to even."""
    return F.rint(F.greatest(F.lit(-float(grid.clip)), F.least(F.lit(float(grid.clip)), x.cast("double"))) * F.lit(float(grid.scale))).cast("long")


def encode(features: Column, grid: Grid) -> Column:
    return F.transform(features, lambda x: on_grid(x, grid))


def decode(x: Column, grid: Grid) -> Column:
    """The double that an encoded coordinate stands for; exact, as the scale is a power of two."""
    return F.transform(x, lambda v: v.cast("double") / F.lit(float(grid.scale)))


def squared_distance(x: Column, c: Column) -> Column:
    """Exact on encoded coordinates; an overflow raises."""
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, v: s + v)


def two_nearest(x: Column, centers: list[list[int]]) -> Column:
    """The nearest and the second nearest of centers on the grid: array of (distance, index), ties to the smaller index."""
    ranked = F.array_sort(F.array(*[F.struct(squared_distance(x, F.array(*[F.lit(v).cast("long") for v in c])).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centers)]))
    return F.slice(ranked, 1, 2)


def snap(x: Column, step: float) -> Column:
    """The nearest multiple of a step that is a power of two, halves to even."""
    return F.rint(x / F.lit(step)) * F.lit(step)


def kappa(a: Column, b: Column) -> Column:
    """max(a / b, b / a); null where one is zero."""
    return F.greatest(F.try_divide(a, b), F.try_divide(b, a))


def derived_seed(*fields: Column) -> Column:
    """The first eight bytes, little end first, of the SHA-256 of the fields joined by NUL: an unsigned number, DECIMAL(20, 0)."""
    digest = F.sha2(F.concat_ws("\0", *[f.cast("string") for f in fields]), 256)
    turned = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in reversed(range(8))])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def ordered_digest(value: Column, *order: Column) -> Column:
    """SHA-256 of a group's values, comma-joined in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.cast("string").alias("v")))), lambda s: s["v"]), ","), 256)


def natural_key(state: Column, puma: Column) -> Column:
    """state:area, the area's code filled up to five digits and never cut; null where either is."""
    return F.when(state.isNotNull() & puma.isNotNull(), F.format_string("%d:%05d", state.cast("int"), puma.cast("int")))


def record_key(year: Column, state: Column, serial: Column, order: Column) -> Column:
    """year:state:serial:order; null where any of them is."""
    return F.concat(year.cast("string"), F.lit(":"), F.lpad(state.cast("string"), 2, "0"), F.lit(":"), serial.cast("string"), F.lit(":"), order.cast("string"))


def client_number(name: Column) -> Column:
    """The number in client_<number>, no leading zeros; null for other names."""
    digits = F.regexp_extract(name, "^client_(0|[1-9][0-9]*)$", 1)
    return F.when(digits != "", digits.cast("long"))


def deletion_count(n: Column, fraction: str) -> Column:
    """max(1, n * fraction), halves up, in decimals."""
    return F.greatest(F.lit(1).cast("long"), F.round(n.cast("decimal(18,0)") * F.lit(fraction).cast("decimal(10,5)"), 0).cast("long"))


def alpha(k: Column) -> Column:
    """5 (ln k + 2)."""
    return F.lit(5.0) * (F.log(k) + F.lit(2.0))


def standard_error(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def variation(x: Column) -> Column:
    """Sample deviation over mean; null where the mean is zero."""
    return F.try_divide(F.coalesce(F.stddev_samp(x), F.lit(0.0)), F.avg(x))


def rotated(case: Column, repetition: Column, methods: int) -> Column:
    """Which method comes first."""
    return F.pmod(case + repetition, F.lit(methods))
