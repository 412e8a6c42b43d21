"""Operator 8, mixing sources to target weights with a time-varying curriculum.

Each source has a demand for words and a schedule, a piecewise linear weight over training time 0..1. The integral of the
schedule, scaled to the demand, says how many words of the source are wanted by any time; its inverse gives each document,
at its place in the source's fixed shuffled order, the time at which it is due. Documents are range-sorted by that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table, word_array

WEIGHTS = (5, 2, 1)
#: Knots (time, weight) for the sources of each weight: early, in the middle, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which a schedule has asked for a share (0..1) of its total: the inverse of its normalised integral."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total, done, cases = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        slope, left = (w1 - w0) / (t1 - t0), F.greatest(share * total - done, F.lit(0.0))
        step = left / w0 if slope == 0 else (F.sqrt(F.greatest(w0 * w0 + 2 * slope * left, F.lit(0.0))) - w0) / slope
        done += area
        cases.append((done / total, F.lit(t0) + step))
    out = cases[-1][1]
    for upto, case in reversed(cases[:-1]):
        out = F.when(share <= upto, case).otherwise(out)
    return F.least(F.greatest(out, F.lit(knots[0][0])), F.lit(knots[-1][0]))


def source_targets(sources: DataFrame, weights=WEIGHTS, total_share: float = 1.5, most_repeats: int = 2) -> DataFrame:
    """(source, source_size, kind, target) of (source, source_size): sources in code point order, null last, get the weights
    in turn and share total_share of all words; none gets over most_repeats times its size, the rest is shared again by
    weight. Solved at once: in the order of cap over weight, the first source whose plain share fits fixes the level."""
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("kind") + 1)
    s = sources.withColumn("kind", turn).withColumn("w", w).withColumn("cap", (most_repeats * F.col("source_size")).cast("double"))
    up = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, onwards, everything = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing), up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    all_words = F.sum("source_size").over(everything)
    s = s.withColumn("level", (total_share * all_words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onwards))
    s = s.withColumn("level", F.first(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), ignorenulls=True).over(everything))
    return s.select("source", "source_size", "kind", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, total_share: float = 1.5, most_repeats: int = 2, docs_per_bucket: int = 2_000) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, position, readings.

    size: words of the text (null or empty: 0). taken: words that the mix takes of the document, repeats counted: a source is
    read in the order of a hash of id and text, again from the start at its end, until its target, rounded down, is reached;
    the last document is cut short. readings: for each turn in which words are taken of it, (turn, words, position), by turn;
    position is when training meets the document in that turn (0..1). position beside it: that of the first reading (null if
    it takes nothing). Rows are range-sorted by it, then doc_id; training_order() gives a row for each reading. Null sources form one source, the last; repeated rows are documents of
    their own; an empty table returns none; other columns are neither read nor returned. Running sums never put a source
    into one task: hash buckets of about docs_per_bucket documents are summed first.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    sized = cut(docs.select("doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"), key.alias("key")))
    n, digits = sized.count(), 0
    while n > docs_per_bucket * 16**digits and digits < 8:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_share, most_repeats)
    earlier = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("start", earlier).alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    starts = starts.select(F.col("b.source").alias("s"), F.col("bucket").alias("k"), "start", "source_size", "kind", "target")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("inside", inside).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    offset, wanted = F.col("start") + F.col("inside"), F.floor("target")
    turns = [F.least(F.greatest(wanted - offset - e * F.col("source_size"), F.lit(0)), F.col("size")) for e in range(most_repeats)]
    readings = []
    for e, words in enumerate(turns):
        share, position = (offset + e * F.col("source_size")) / F.col("target"), F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            position = F.when(F.col("kind") % len(schedules) == k, inverse_demand(share, knots)).otherwise(position)
        readings.append(F.when(words > 0, F.struct(F.lit(e).alias("turn"), words.cast("long").alias("words"), position.alias("position"))))
    placed = placed.withColumn("taken", sum(turns[1:], turns[0]).cast("long")).withColumn("readings", F.array_compact(F.array(*readings)))
    out = placed.withColumn("position", F.get("readings", F.lit(0))["position"]).select("doc_id", "source", "size", "source_size", "target", "taken", "position", "readings")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per reading of what mix() returned: doc_id, source, turn, words, position, range-sorted by position, then doc_id and turn."""
    out = mixed.select("doc_id", "source", F.inline("readings"))
    return out.repartitionByRange("position", "doc_id", "turn").sortWithinPartitions("position", "doc_id", "turn")


def op8_mix(spark, sf_dir: str) -> DataFrame:
    place = lambda turn: F.round(F.get(F.filter("readings", lambda r: r["turn"] == turn), F.lit(0))["position"], 9)
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", place(0).alias("position"), place(1).alias("second_position"))


def _sql_inverse(share: str, knots: Sequence[tuple[float, float]]) -> str:
    """The closed form of inverse_demand: a quadratic, or a line, on each piece of the schedule."""
    pieces = list(zip(knots, knots[1:], strict=False))
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces]
    cases, done = "", 0.0
    for i, ((t0, w0), (t1, w1)) in enumerate(pieces):
        slope, left = (w1 - w0) / (t1 - t0), f"greatest({share} * {sum(areas)!r}::DOUBLE - {done!r}::DOUBLE, 0::DOUBLE)"
        step = f"(sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {left}, 0::DOUBLE)) - {w0!r}::DOUBLE) / {slope!r}::DOUBLE" if slope else f"{left} / {w0!r}::DOUBLE"
        done += areas[i]
        cases += f" WHEN {share} <= {done / sum(areas)!r}::DOUBLE THEN {t0!r}::DOUBLE + {step}" if i + 1 < len(pieces) else f" ELSE {t0!r}::DOUBLE + {step}"
    return f"least(greatest(CASE WHEN {share} IS NULL THEN NULL{cases} END, {knots[0][0]!r}::DOUBLE), {knots[-1][0]!r}::DOUBLE)"


def _sql_place(turn: int) -> str:
    kinds = " ".join(f"WHEN {k} THEN {_sql_inverse(f'((start + {turn} * source_size) / target)', knots)}" for k, knots in enumerate(SCHEDULES))
    return f"CASE WHEN w{turn} > 0 THEN round(CASE kind {kinds} END, 9) END"


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) AS kind FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM n),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS k
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
v AS (SELECT arg_min(level, k) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, kind, coalesce(least(cap, v.level * w), cap) AS target FROM l LEFT JOIN v ON true),
r AS (SELECT doc_id, size, source_size, target, kind, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, least(greatest(floor(target) - start, 0), size) AS w0, least(greatest(floor(target) - start - source_size, 0), size) AS w1 FROM r)
SELECT doc_id, size, source_size, target, CAST(w0 + w1 AS BIGINT) AS taken, {_sql_place(0)} AS position, {_sql_place(1)} AS second_position FROM k
"""
