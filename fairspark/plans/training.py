"""Training, replay after deletions, compact deletion of clients, and the baselines."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact as E
from ..model import Center, Grid, Model, Settings, whole
from ..operators import points as P
from ..operators import rounds as R
from ..operators import seeding as S
from ..operators import update as U
from ..sources.workplace import shared_folder


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder of spark.checkpoint.dir."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class _Clock(dict):
    def __call__(self, name: str, since: float) -> float:
        now = time.perf_counter()
        self[name] = self.get(name, 0.0) + now - since
        return now


def _refine(points: DataFrame, centers: list[Center], sizes, settings: Settings, cache: bool, clock: _Clock):
    """The rounds: exact statistics of all points, then the server's update."""
    trajectory, stats, digests, updates, kept_rounds = [centers], [], [], [], []
    for _ in range(settings.rounds):
        began = time.perf_counter()
        if cache:
            kept_rounds.append(kept(R.assigned(points, centers, settings.grid)))
            own = R.cached_statistics(kept_rounds[-1], settings.groups, settings.k, len(centers[0]))
        else:
            own = R.statistics(points, centers, settings.grid, settings.groups)
        began = clock("assignment", began)
        stats.append(own)
        digests.append(E.digest(centers, own))
        centers, info = U.refined(centers, own, sizes, settings)
        clock("server", began)
        updates.append(info)
        trajectory.append(centers)
    return trajectory, stats, digests, updates, kept_rounds if cache else None


def train(points: DataFrame, seed: int, settings: Settings, cache: bool = False) -> Model:
    """The map from points (client, local_row, group_id, features) and a seed to a model.

    cache keeps each round's labels and distance bounds, which certificates need. Rows of a client are ordered by local_row,
    clients by id; the layout of the table does not matter. Features are read once, to be encoded.
    """
    whole(seed, "seed", 0)
    clock = _Clock()
    began = time.perf_counter()
    sizes, d = P.checked_points(points, settings.groups, settings.grid)
    encoded = kept(P.encoded(points, settings.grid))
    began = clock("encoding", began)
    slices = kept(S.local_slices(encoded, seed, settings))
    began = clock("local", began)
    anchors = S.anchors_of(slices, sizes)
    centers = S.server_centers(anchors, seed, settings.k, rounds=settings.anchor_rounds)
    clock("server", began)
    trajectory, stats, digests, updates, rounds = _refine(encoded, centers, sizes, settings, cache, clock)
    return Model(settings, seed, sizes, slices, anchors, trajectory, stats, digests, updates, encoded, rounds, timing=dict(clock))


def _without(model: Model, removed: DataFrame, touched: dict[tuple[int, int], int]) -> tuple[DataFrame, DataFrame, tuple[int, ...]]:
    """Surviving points, slices (those of touched slices seeded anew from the survivors) and sizes."""
    gone = [sum(n for (_, h), n in touched.items() if h == g) for g in range(model.settings.groups)]
    sizes = tuple(n - k for n, k in zip(model.sizes, gone, strict=True))
    if min(sizes) == 0:
        raise ValueError("the request empties a group")
    if not touched:
        return model.points, model.slices, sizes
    points = P.retained(model.points, removed)
    keys = F.broadcast(model.points.sparkSession.createDataFrame(list(touched), "client long, group_id int"))  # one row for each slice at most
    same = model.slices.join(keys, ["client", "group_id"], "left_anti")
    again = S.local_slices(points.join(keys, ["client", "group_id"], "left_semi"), model.seed, model.settings)
    return points, kept(same.unionByName(again)), sizes


def unlearn(model: Model, removed, mode: str = "runnerup", threshold: float = 0.5) -> Model:
    """The model that training on the survivors gives, bit for bit.

    removed: a table (client, local_row) or a mapping of client to rows. mode: none (all rounds are computed anew), basic or
    runnerup (cached statistics are patched; only rows whose label is not certified are assigned again). Once more than
    `threshold` of the survivors fail in a round, that round and all later ones are computed anew.
    """
    if mode not in ("none", "basic", "runnerup") or isinstance(threshold, bool) or not np.isfinite(threshold) or threshold < 0:
        raise ValueError("invalid mode or threshold")
    if not model.replayable or mode != "none" and model.cache is None:
        raise ValueError("this model has no cache to replay from")
    settings, clock = model.settings, _Clock()
    began = time.perf_counter()
    removed, touched = P.counted_request(model.points, removed)
    points, slices, sizes = _without(model, removed, touched)
    anchors = S.anchors_of(slices, sizes)
    centers = S.server_centers(anchors, model.seed, settings.k, rounds=settings.anchor_rounds)
    began = clock("seeding", began)
    survivors = sum(sizes)
    trajectory, all_stats, digests, updates, work = [centers], [], [], [], []
    fallback = 0 if mode == "none" else None
    limit = Fraction(threshold)
    for t in range(settings.rounds):
        began = time.perf_counter()
        count = {"round": t, "N": survivors, "A": 0, "P": 0, "S": 0, "J": 0}
        if fallback is None:
            shift = E.shifts(np.array(centers), np.array(model.trajectory[t]))
            delta, rows, failing = R.patched(P.marked(model.cache[t], removed), centers, shift, settings.grid, settings.groups, mode)
            count |= {"N": rows, "A": rows, "P": rows - failing, "S": rows - failing}
            if Fraction(failing) > limit * rows:
                fallback = t
                count |= {"S": 0, "J": failing}
            else:
                own = model.stats[t].plus(delta)
        if fallback is not None:
            own = R.statistics(points, centers, settings.grid, settings.groups)
        began = clock("assignment", began)
        work.append(count)
        all_stats.append(own)
        digests.append(E.digest(centers, own))
        centers, info = U.refined(centers, own, sizes, settings)
        clock("server", began)
        updates.append(info)
        trajectory.append(centers)
    return Model(settings, model.seed, sizes, slices, anchors, trajectory, all_stats, digests, updates, points, None, work, fallback, replayable=False, timing=dict(clock))


def delete_clients_directly(model: Model, departing: Iterable[int]) -> Model:
    """Whole clients leave: their slices go, those of the others stay as they are, all rounds run on the remaining points."""
    counts = client_counts(model.slices, model.settings.groups)
    gone = _departing(counts, departing)
    sizes = _remaining(counts, gone)
    ids = sorted(gone)
    points, slices = (df.where(~F.col("client").isin(ids)) if ids else df for df in (model.points, model.slices))
    anchors = S.anchors_of(slices, sizes)
    centers = S.server_centers(anchors, model.seed, model.settings.k, rounds=model.settings.anchor_rounds)
    clock = _Clock()
    trajectory, stats, digests, updates, _ = _refine(points, centers, sizes, model.settings, False, clock)
    return Model(model.settings, model.seed, sizes, slices, anchors, trajectory, stats, digests, updates, points, None, replayable=False, timing=dict(clock))


def client_counts(slices: DataFrame, groups: int) -> dict[int, tuple[int, ...]]:
    """Rows by client and group, from the summaries alone; the multiplicities of a slice must add up to its rows."""
    rows = slices.groupBy("client", "group_id").agg(F.sum("mult").alias("held"), F.max("n_e").alias("n")).collect()
    if any(r["held"] != r["n"] or r["n"] < 1 or not 0 <= r["group_id"] < groups for r in rows):
        raise ValueError("invalid summary counts")
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["client"], [0] * groups)[r["group_id"]] = r["n"]
    return {c: tuple(v) for c, v in sorted(out.items())}


def _departing(counts: dict, departing) -> set[int]:
    if isinstance(departing, (str, bytes, dict)) or not isinstance(departing, Iterable):
        raise ValueError("a request is a collection of client ids")
    ids = [whole(c, "client", 0) for c in departing]
    if len(set(ids)) < len(ids) or not set(ids) <= set(counts):
        raise ValueError("unknown, removed or repeated client")
    return set(ids)


def _remaining(counts: dict, gone: set[int]) -> tuple[int, ...]:
    left = [v for c, v in counts.items() if c not in gone]
    sizes = tuple(map(sum, zip(*left, strict=True))) if left else ()
    if not sizes or min(sizes) == 0:
        raise ValueError("the request empties a group")
    return sizes


@dataclass(frozen=True)
class Compact:
    """What deleting clients needs when there are no rounds: the summaries and their counts, no row of the data."""

    settings: Settings
    seed: int
    counts: dict[int, tuple[int, ...]]
    slices: DataFrame


def compact(model: Model) -> Compact:
    if model.settings.rounds:
        raise ValueError("a compact state needs a model without rounds")
    counts = client_counts(model.slices, model.settings.groups)
    if _remaining(counts, set()) != model.sizes:
        raise ValueError("summaries and group sizes disagree")
    return Compact(model.settings, model.seed, counts, model.slices)


def delete_clients(state: Compact, departing: Iterable[int]) -> tuple[Model, Compact]:
    """The model of training without the departing clients, and the next state; requests in a sequence use the state of the last."""
    gone = _departing(state.counts, departing)
    sizes = _remaining(state.counts, gone)
    slices = state.slices.where(~F.col("client").isin(sorted(gone))) if gone else state.slices
    left = replace(state, counts={c: v for c, v in state.counts.items() if c not in gone}, slices=slices)
    anchors = S.anchors_of(slices, sizes)
    centers = S.server_centers(anchors, state.seed, state.settings.k, rounds=state.settings.anchor_rounds)
    return Model(state.settings, state.seed, sizes, slices, anchors, [centers], [], [], [], replayable=False), left


def withdrawals(state: Compact, requests: Iterable[Iterable[int]], path: str | None = None) -> list[Model]:
    """A sequence of requests; with a path, each state is written, read again and compared before it is used."""
    from ..sources.states import load_compact, save_compact

    out = []
    for step, ids in enumerate(requests):
        model, state = delete_clients(state, ids)
        if path:
            save_compact(state, f"{path}/step={step}")
            state = load_compact(state.slices.sparkSession, f"{path}/step={step}")
        out.append(model)
    return out


def lloyd(points: DataFrame, centers: list[Center], rounds: int, grid: Grid, groups: int = 2) -> tuple[list[list[Center]], list]:
    """Plain Lloyd rounds over encoded points from any start: trajectory and statistics."""
    trajectory, stats = [centers], []
    for _ in range(rounds):
        stats.append(R.statistics(points, trajectory[-1], grid, groups))
        trajectory.append(U.lloyd(trajectory[-1], stats[-1], grid.scale))
    return trajectory, stats


def refine_from(points: DataFrame, centers: list[Center], settings: Settings):
    """Fair rounds over encoded points from any start: trajectory, statistics, digests, updates."""
    sizes = P.group_sizes(points, settings.groups)
    return _refine(points, [tuple(c) for c in centers], sizes, settings, False, _Clock())[:4]


def merged(points: DataFrame, seed: int, settings: Settings, reps: int) -> tuple[list[Center], DataFrame]:
    """The baseline with one summary for each client, of k (reps = k) or 2 k rows: start centers and summaries."""
    sizes = P.group_sizes(points, 2)
    slices = kept(S.merged_slices(points, seed, settings, reps))
    return S.merged_centers(slices, sizes, seed, settings.k), slices


def centralized(points: DataFrame, seed: int, settings: Settings) -> list[Center]:
    """The reference for quality: weighted seeding over all encoded points."""
    return S.pooled_centers(points, P.group_sizes(points, 2), seed, settings.k, float(settings.grid.scale))


def quality(points: DataFrame, centers, grid: Grid, groups: int = 2) -> dict:
    """Exact costs of represented points: by group, the largest, their sum, the population's mean and the pooled sum; and how often each group has rows."""
    sizes = P.group_sizes(points, groups)
    stats = R.statistics(points, centers, grid, groups)
    costs = U.Costs(stats, sizes, grid.scale, centers).of(centers)
    pooled = sum((n * v for n, v in zip(sizes, costs, strict=True)), Fraction(0))
    return {"group_costs": costs, "phi": max(costs), "total": sum(costs), "population_average": pooled / sum(sizes), "pooled_sse": pooled, "sizes": sizes, "stats": stats}
