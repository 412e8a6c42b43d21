"""Tables over run records: latest rows, paired ratios, roll-ups, decompositions. Every function takes the names of its columns."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(sequence).desc()))).where("__rank = 1").drop("__rank")


def unfinished(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned cases without a finished row: what a resumed run has to do."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def paired(rows: DataFrame, keys: list[str], method: str, value: str, fresh: str) -> DataFrame:
    """Each method's row beside the fresh one of the same case: value, fresh_value and their ratio, null where the value is zero."""
    base = rows.where(F.col(method) == fresh).select(*keys, F.col(value).alias("fresh_value"))
    other = rows.where(F.col(method) != fresh).select(*keys, F.col(method).alias("method"), F.col(value).alias("value"))
    return other.join(base, keys).withColumn("ratio", F.try_divide("fresh_value", "value"))


def rolled_up(pairs: DataFrame, by: str) -> DataFrame:
    """Sums, their ratio, and wins, losses, ties and tenfold wins by method, for each `by` and for all of them ("all")."""
    tenfold = F.col("fresh_value") >= 10 * F.col("value")
    out = pairs.rollup("method", by).agg(F.sum("fresh_value").alias("fresh_total"), F.sum("value").alias("total"), F.count_if(F.col("fresh_value") > F.col("value")).alias("wins"), F.count_if(F.col("fresh_value") < F.col("value")).alias("losses"), F.count_if(F.col("fresh_value") == F.col("value")).alias("ties"), F.count_if(tenfold).alias("tenfold"), F.grouping_id().alias("__level"))
    return out.where("__level < 3").select("method", F.when(F.col("__level") == 1, "all").otherwise(F.col(by)).alias(by), "fresh_total", "total", F.try_divide("fresh_total", "total").alias("total_ratio"), "wins", "losses", "ties", "tenfold")


def by_dimensions(rows: DataFrame, sets: list[list[str]], values: dict[str, Column]) -> DataFrame:
    """The same aggregates over several sets of dimensions; scope names the set, unused dimensions are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*[v.alias(k) for k, v in values.items()], F.grouping_id(*names).alias("__id"))
    scope = F.lit("")
    for s in sets:
        level = sum((c not in s) << (len(names) - 1 - i) for i, c in enumerate(names))
        scope = F.when(F.col("__id") == level, ",".join(s) or "all").otherwise(scope)
    return out.select(scope.alias("scope"), *names, *values)


def long_ratios(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metric columns as (keys, metric, value), blanks left out."""
    return rows.unpivot(keys, metrics, "metric", "value").where("value is not null")


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, minimum, median and maximum."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"))


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one value), median of the values that are numbers."""
    own = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return rows.groupBy(*keys).agg(F.count(own).alias("n"), F.avg(own).alias("mean"), F.when(F.count(own) > 1, F.stddev_samp(own)).otherwise(F.when(F.count(own) == 1, 0.0)).alias("sd"), F.median(own).alias("median"))


def status_counts(rows: DataFrame, keys: list[str], status: str, seed: str, done: str) -> DataFrame:
    """Seen and finished seeds and the number of rows of each status, as canonical JSON."""
    n = rows.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n"))
    text = n.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), status, F.lit('":'), F.col("n").cast("string")))), ",").alias("x")).select(*keys, F.concat(F.lit("{"), "x", F.lit("}")).alias("statuses"))
    seeds = rows.groupBy(*keys).agg(F.countDistinct(seed).alias("seeds"), F.countDistinct(F.when(F.col(status) == done, F.col(seed))).alias("finished"))
    return seeds.join(text, keys)


def exact_mean_variance(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample variance of values given as p/q or decimal texts, exactly, as p/q."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v = [Fraction(x) for x in group[value]]
        mean = sum(v) / len(v)
        variance = sum((x - mean) ** 2 for x in v) / (len(v) - 1) if len(v) > 1 else Fraction(0)
        text = lambda q: f"{q.numerator}/{q.denominator}"
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), len(v), text(mean), text(variance)]], columns=[*keys, "n", "mean", "variance"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, value).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long", "mean string", "variance string"]))


def pairs_over(rows: DataFrame, keys: list[str], budget: str, value: str) -> DataFrame:
    """All pairs of budgets low < high of a case with the change, and relative to the lower budget's value (null where that is zero)."""
    low, high = (rows.select(*keys, F.col(budget).alias(f"{side}_budget"), F.col(value).alias(side)) for side in ("low", "high"))
    both = low.join(high, keys).where("low_budget < high_budget")
    return both.withColumn("change", F.col("high") - F.col("low")).withColumn("relative", F.try_divide("change", "low"))


def steps(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each row beside the one before: change and relative change."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return rows.withColumn("before", before).where("before is not null").withColumn("change", F.col(value) - F.col("before")).withColumn("relative", F.try_divide("change", "before"))


def change_summary(changes: DataFrame, keys: list[str]) -> DataFrame:
    return changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("change").alias("least"), F.max("change").alias("most"), F.sum("change").alias("total"), F.count_if(F.col("change") < 0).alias("decreases"), F.count_if(F.col("change") > 0).alias("increases"), F.count_if(F.col("change") == 0).alias("ties"))


def compared(rows: DataFrame, keys: list[str], method: str, value: str, left: str, right: str) -> DataFrame:
    """left - right of the same case, and relative to right."""
    wide = rows.where(F.col(method).isin(left, right)).groupBy(*keys).pivot(method, [left, right]).agg(F.first(value))
    wide = wide.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("difference", F.col(left) - F.col(right))
    return wide.withColumn("relative", F.try_divide("difference", F.col(right)))


def wide_methods(rows: DataFrame, keys: list[str], method: str, methods: list[str], value: str, lookup: DataFrame, on: str) -> DataFrame:
    """One row for each case with a column for each method, beside a small table by `on`."""
    return rows.groupBy(*keys).pivot(method, methods).agg(F.sum(value)).join(lookup, on, "left")


def running(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Running totals of each series in its order."""
    return rows.withColumn("running", F.sum(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def margins(cache: DataFrame, keys: str = "round", value: str = "margin") -> DataFrame:
    """Count, mean, deviation, median, least and most margin by round and, with a null round, of all."""
    return cache.groupingSets([[F.col(keys)], []], keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def pass_rates(work: DataFrame, keys: str = "round") -> DataFrame:
    """Tested and accepted rows and their ratio (null on none) by round and, with a null round, of all."""
    return work.groupingSets([[F.col(keys)], []], keys).agg(F.sum("tested").alias("tested"), F.sum("accepted").alias("accepted")).withColumn("pass_rate", F.try_divide("accepted", "tested"))


def work_counters(work: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of N, A, P, S, J with the modeled assignments N - S + J, pooled fractions, and whether 0 <= S <= P <= A <= N and J <= A - P hold in all rows."""
    holds = (F.col("S") >= 0) & (F.col("S") <= F.col("P")) & (F.col("P") <= F.col("A")) & (F.col("A") <= F.col("N")) & (F.col("J") <= F.col("A") - F.col("P"))
    out = work.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in "NAPSJ"], F.bool_and(holds).alias("holds"))
    return out.withColumn("assignments", F.col("N") - F.col("S") + F.col("J")).withColumn("pass_rate", F.try_divide("P", "A")).withColumn("coverage", F.try_divide("S", "N"))


def timing_totals(times: DataFrame, case: str) -> DataFrame:
    """Of (case, phase, client, round, seconds): phase 1 ends with its slowest client, phase 2 with the slowest client of every round; and the fleet's sum."""
    by_client = times.groupBy(case, "phase", "round", "client").agg(F.sum("seconds").alias("s"))
    slowest = by_client.groupBy(case, "phase", "round").agg(F.max("s").alias("slowest"), F.sum("s").alias("fleet"))
    part = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, F.col("slowest"))), F.lit(0)).alias(f"phase{p}")
    return slowest.groupBy(case).agg(part(1), part(2), F.sum("fleet").alias("fleet")).withColumn("critical", F.col("phase1") + F.col("phase2"))


def unattributed(parts: DataFrame, case: str, elapsed: str) -> DataFrame:
    """What the timers of a case leave of its elapsed time."""
    return parts.groupBy(case).agg(F.max(elapsed).alias("elapsed"), F.sum("seconds").alias("attributed")).withColumn("unattributed", F.col("elapsed") - F.col("attributed"))


def speedups(pairs: DataFrame, keys: list[str], floor: float = 1e-9) -> DataFrame:
    """Mean, median, most and least of before / max(after, floor)."""
    ratio = F.col("before") / F.greatest(F.col("after"), F.lit(floor))
    return pairs.groupBy(*keys).agg(F.avg(ratio).alias("mean"), F.median(ratio).alias("median"), F.max(ratio).alias("most"), F.min(ratio).alias("least"))


def worst_groups(costs: DataFrame, keys: list[str], case: str, group: str, cost: str) -> DataFrame:
    """The mean over cases of the largest group cost, the largest of the groups' means, and how often group 0 is the worst; totals over the same number of cases."""
    per_case = costs.groupBy(*keys, case).agg(F.max(cost).alias("worst"), F.max_by(group, F.struct(F.col(cost), -F.col(group))).alias("who"))
    first = per_case.groupBy(*keys).agg(F.avg("worst").alias("mean_of_max"), F.count_if(F.col("who") == 0).alias("group0_worst"))
    second = costs.groupBy(*keys, group).agg(F.avg(cost).alias("m")).groupBy(*keys).agg(F.max("m").alias("max_of_means"))
    return first.join(second, keys)


def derived_quality(rows: DataFrame) -> DataFrame:
    """Of (cost0, cost1, n0, n1): pooled sum, population mean, gap, and the larger over the smaller cost (null on zero)."""
    pooled = F.col("cost0") * F.col("n0") + F.col("cost1") * F.col("n1")
    return rows.withColumn("pooled", pooled).withColumn("average", pooled / (F.col("n0") + F.col("n1"))).withColumn("gap", F.abs(F.col("cost0") - F.col("cost1"))).withColumn("ratio", F.try_divide(F.greatest("cost0", "cost1"), F.least("cost0", "cost1")))


def break_even(rows: DataFrame) -> DataFrame:
    """Requests after which a setup has paid: ceil(setup / saving), null without a saving."""
    saving = F.col("fresh") - F.col("method")
    return rows.withColumn("saving", saving).withColumn("requests", F.when(saving > 0, F.ceil(F.col("setup") / saving)))


def repetitions(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, least, most and coefficient of variation over repetitions."""
    return rows.groupBy(*keys).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.try_divide(F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.avg(value)).alias("cv"))


def geometric_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """exp(mean of logarithms) of the positive values, and the pooled reduction 1 - 1 / ratio of sums is left to rolled_up."""
    return rows.where(F.col(value) > 0).groupBy(*keys).agg(F.exp(F.avg(F.log(value))).alias("geometric_mean"), F.count(F.lit(1)).alias("n"))


def bootstrap_interval(rows: DataFrame, keys: list[str], value: str, seed: int = 0, draws: int = 2000, level: float = 0.95) -> DataFrame:
    """A percentile interval of the mean over resampled cases, by a fixed generator for each key in sorted order."""
    import numpy as np

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(group[value].to_numpy(float))
        means = v[np.random.default_rng(seed).integers(0, len(v), (draws, len(v)))].mean(axis=1)
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), v.mean(), low, high]], columns=[*keys, "mean", "low", "high"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, value).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "mean double", "low double", "high double"]))


def mismatches(saved: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose values differ or that one side lacks; empty if the saved table is reproduced."""
    a, b = saved.alias("a"), recomputed.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    same = F.lit(True)
    for v in [*keys, *values]:
        same = same & F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    return both.where(~same).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys])


def significant(value, digits: int = 4) -> str:
    """A number for a report; blank for none."""
    return "" if value is None else f"{float(value):.{digits}g}"


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown, for reports."""
    rows = df.limit(limit).collect()
    head = df.columns
    cell = lambda v: significant(v) if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(cell(r[c]) for c in head) + " |" for r in rows)])
