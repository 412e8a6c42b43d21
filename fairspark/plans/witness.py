"""Studies that are their own small plans: the kappa witness in run-length form, exact quantization diagnostics, warm starts."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact as E
from ..model import Settings
from ..operators import points as P
from ..operators import rounds as R
from ..operators import seeding as S
from ..operators import update as U

METHODS = ("merged_1k", "merged_2k", "grouped_2k", "centralized")


class CountedWords:
    """A tape that counts the words it gives."""

    def __init__(self, words):
        self.inner, self.words = words, 0

    def random_raw(self) -> int:
        self.words += 1
        return self.inner.random_raw()


def seed_runs(runs: list[tuple[int, int]], weights: list[Fraction], k: int, words) -> list[int]:
    """What E.seed_indices gives for rows listed one by one, where runs = (length, value) stand for equal rows of equal weight.

    The common divisor and the total of the masses do not depend on the listing, so the same number is drawn; within a run,
    the row follows by division.
    """
    ends = list(accumulate(n for n, _ in runs))
    n = ends[-1]
    if k >= n:
        return E.completed(range(n), n, k)
    w = E.as_integers(weights)
    run_of = lambda i: next(b for b, end in enumerate(ends) if i < end)
    chosen: list[int] = []
    while len(chosen) < k:
        mass = E.coprime([w[b] * min([(v - runs[run_of(i)][1]) ** 2 for i in chosen], default=1) for b, (_, v) in enumerate(runs)])
        total = sum(m * length for m, (length, _) in zip(mass, runs, strict=True))
        if not total:
            break
        left, start = E.below(total, words), 0
        for m, (length, _) in zip(mass, runs, strict=True):
            if left < m * length:
                chosen.append(start + left // m)
                break
            left -= m * length
            start += length
    return E.completed(chosen, n, k)


def witness_center(kappa: int, seed: int, method: str, unit: int = 150, distance: int = 10) -> tuple[float, int]:
    """The one center that a method chooses on the kappa witness, and the words it draws."""
    clients = {0: [(kappa * unit, 0, 0), (unit, distance, 1)], 1: [(unit, 0, 0), (kappa * unit, 0, 1)]}
    size, anchors, weights, drawn = (kappa + 1) * unit, [], [], 0

    def draw(runs, own_weights, k, role, *ids):
        nonlocal drawn
        words = CountedWords(E.tape(seed, role, *ids))
        picked = seed_runs([(n, v) for n, v, _ in runs], own_weights, k, words)
        drawn += words.words
        values = [v for _, v, _ in runs]
        ends = list(accumulate(n for n, _, _ in runs))
        return [values[next(b for b, end in enumerate(ends) if i < end)] for i in picked]

    if method == "centralized":
        everything = clients[0] + clients[1]
        return float(draw(everything, [Fraction(1, size)] * 4, 1, method)[0]), drawn
    if method == "grouped_2k":
        for c, runs in clients.items():
            for run in runs:
                anchors += draw([run], [Fraction(1)], 1, "local", c, run[2])
                weights.append(Fraction(run[0], size))
        role = "server"
    elif method in ("merged_1k", "merged_2k"):
        for c, runs in clients.items():
            reps = draw(runs, [Fraction(1, n) for n, _, _ in runs], 1 if method == "merged_1k" else 2, "merged_local", c)
            held = [0] * len(reps)
            for n, v, _ in runs:
                held[min(range(len(reps)), key=lambda j: ((v - reps[j]) ** 2, j))] += n
            anchors += reps
            weights += [Fraction(h, size) for h in held]
        role = "merged_server"
    else:
        raise ValueError(method)
    words = CountedWords(E.tape(seed, role))
    at = E.seed_indices(E.lattice([[float(a)] for a in anchors]), weights, 1, words)[0]
    return float(anchors[at]), drawn + words.words


def witness_runs(spark: SparkSession, kappas: list[int], seeds: int, first: int = 0) -> DataFrame:
    """(kappa, method, seed, center, words, total, phi) for all methods: independent cases, spread over the cluster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for kappa, seed in zip(f["kappa"], f["seed"], strict=True):
                for method in METHODS:
                    c, words = witness_center(int(kappa), int(seed), method)
                    e = Fraction(1, int(kappa) + 1)
                    a, b = Fraction(c) ** 2, e * (10 - Fraction(c)) ** 2 + (1 - e) * Fraction(c) ** 2
                    out.append((kappa, method, seed, c, words, float(a + b), float(max(a, b))))
            yield pd.DataFrame(out, columns=["kappa", "method", "seed", "center", "words", "total", "phi"])

    cases = spark.range(first, first + seeds).select(F.col("id").alias("seed"), F.explode(F.array(*[F.lit(k).cast("int") for k in kappas])).alias("kappa"))
    return cases.repartition("seed").mapInPandas(run, "kappa int, method string, seed long, center double, words long, total double, phi double")


def optimum(kappa, distance: float = 10.0):
    """(best total, best larger cost) of the witness: with e = 1 / (kappa + 1), distance**2 e (1 - e / 2) and distance**2 e (1 - e)."""
    e = F.lit(1.0) / (kappa + F.lit(1.0))
    return F.lit(distance * distance) * e * (F.lit(1.0) - e / F.lit(2.0)), F.lit(distance * distance) * e * (F.lit(1.0) - e)


def witness_summary(runs: DataFrame) -> DataFrame:
    """By kappa and method: mean and standard error of both objectives, and their ratios to the optimum."""
    out = runs.groupBy("kappa", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean_total"), (F.stddev_samp("total") / F.sqrt(F.count("total"))).alias("se_total"), F.avg("phi").alias("mean_phi"), (F.stddev_samp("phi") / F.sqrt(F.count("phi"))).alias("se_phi"))
    total, phi = optimum(F.col("kappa"))
    return out.withColumn("ratio_total", F.col("mean_total") / total).withColumn("ratio_phi", F.col("mean_phi") / phi)


def _own_sums(scale: float):
    """Count, squared norms and coordinates of encoded points by the nearest representative of their own slice, for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = R.matrix(R.column(b, "x"), b.num_rows)
                keys, first, of = np.unique(np.stack([R.column(b, "client").to_numpy(), R.column(b, "group_id").to_numpy()], axis=1), axis=0, return_index=True, return_inverse=True)
                label, of = np.zeros(len(x), np.int64), of.ravel()
                for i, at in enumerate(first.tolist()):
                    own = of == i
                    label[own] = E.nearest(x[own] / scale, np.array(R.column(b, "reps")[at].as_py()))[0]
                total = R.Summed(len(keys), int(label.max()) + 1)
                total.add(x, of, label)
                part = total.batch()
                key = keys[part["group_id"].to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0], pa.int64()), pa.array(key[:, 1], pa.int32()), part["cluster"], part["v"]], names=["client", "group_id", "slot", "v"])

    return run


def quantization(points: DataFrame, slices: DataFrame, sizes, settings: Settings) -> dict:
    """Exact effects of the anchors' grid: residuals q - z (mean, most, weighted by server weights Q, and the envelope d gamma**2 / 2),
    local costs of representatives and of anchors, ids that share a location and the weight on such locations."""
    rows = sorted(slices.collect(), key=lambda r: (r["client"], r["group_id"], r["slot"]))
    weights = [Fraction(r["mult"], sizes[r["group_id"]]) for r in rows]
    residual = [E.squared(r["rep"], r["anchor"]) for r in rows]
    places: dict[tuple, list[int]] = {}
    for i, r in enumerate(rows):
        places.setdefault(tuple(r["anchor"]), []).append(i)
    d, weighted = len(rows[0]["anchor"]), sum((w * q for w, q in zip(weights, residual, strict=True)), Fraction(0))
    envelope = Fraction(d, 2) * Fraction(settings.gamma) ** 2
    local = {"rep": Fraction(0), "anchor": Fraction(0)}
    scale = settings.grid.scale
    held = slices.groupBy("client", "group_id").agg(F.sort_array(F.collect_list(F.struct("slot", "rep"))).alias("s")).select("client", "group_id", F.col("s.rep").alias("reps"))
    parts = points.select("client", "group_id", "x").join(P.small(held, 10_000), ["client", "group_id"]).mapInArrow(_own_sums(float(scale)), "client long, group_id int, slot int, v array<decimal(38,0)>")
    sums: dict[tuple, dict[int, int]] = {}
    for c, g, j, i, v in parts.select("client", "group_id", "slot", F.posexplode("v").alias("i", "v")).groupBy("client", "group_id", "slot", "i").agg(F.sum("v").alias("v")).collect():
        sums.setdefault((c, g, j), {})[i] = int(v)
    for r in rows:
        own = sums.get((r["client"], r["group_id"], r["slot"]))
        if own:
            for k in local:
                at = [Fraction(v) for v in r[k]]
                cross = sum((Fraction(own[q + 2], scale) * v for q, v in enumerate(at)), Fraction(0))
                cost = Fraction(own[1], scale * scale) - 2 * cross + own[0] * sum((v * v for v in at), Fraction(0))
                local[k] += cost / sizes[r["group_id"]]
    shared = [i for own in places.values() if len(own) > 1 for i in own]
    return {"mean_residual": sum(residual, Fraction(0)) / len(rows), "max_residual": max(residual), "weighted": weighted, "envelope": envelope, "within_envelope": weighted <= envelope, "local_cost": local["rep"], "anchor_cost": local["anchor"], "ids": len(rows), "places": len(places), "duplicate_ids": len(rows) - len(places), "representative_places": len({tuple(r["rep"]) for r in rows}), "shared_weight": sum((weights[i] for i in shared), Fraction(0))}


def run_setting(points: DataFrame, seed: int, settings: Settings, method: str, sizes) -> dict:
    """One cell of a study: a warm start by method, then the fair rounds. points are encoded."""
    from .training import centralized, merged, refine_from

    slices = None
    if method == "grouped_2k":
        slices = S.local_slices(points, seed, settings).persist()
        start = S.server_centers(S.anchors_of(slices, sizes), seed, settings.k, rounds=settings.anchor_rounds)
    elif method in ("merged_1k", "merged_2k"):
        start, slices = merged(points, seed, settings, settings.k * (1 if method == "merged_1k" else 2))
    elif method == "centralized":
        start = centralized(points, seed, settings)
    else:
        raise ValueError(method)
    trajectory, stats, digests, updates = refine_from(points, start, settings)
    final = R.statistics(points, trajectory[-1], settings.grid, settings.groups)
    return {"trajectory": trajectory, "digests": digests, "updates": updates, "slices": slices, "final_costs": U.Costs(final, sizes, settings.grid.scale, trajectory[-1]).of(trajectory[-1])}


def solver_trace(updates: list[dict]) -> list[dict]:
    """By round of the many-group update: larger cost, bound, gap, relative gap (0 at cost 0), steps and evaluations."""
    return [{"round": t, "phi": u["phi"], "dual": u["dual"], "gap": u["gap"], "relative": u["gap"] / u["phi"] if u["phi"] else Fraction(0), "steps": len(u["steps"]), "evaluations": u["evaluations"]} for t, u in enumerate(updates)]
