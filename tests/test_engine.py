"""Training and replay against the scalar oracle; replay against training; deletions, states, checks."""

import random
from fractions import Fraction as Q

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from fairspark.functions import exact as E
from fairspark.model import POINTS, Grid, Settings, Stats
from fairspark.operators import points as P
from fairspark.operators import rounds as R
from fairspark.operators import update as U
from fairspark.plans import training as T
from fairspark.sources import states


def federation(seed, clients=6, d=3, groups=2, low=4, high=14, step=1 / 16):
    rng = random.Random(seed)
    out = []
    for c in range(clients):
        for i in range(rng.randint(low, high)):
            g = c % 3 if groups == 2 and c % 3 < 2 else rng.randrange(groups)
            out.append((c * 7, i, g, [rng.randint(-40, 40) * step for _ in range(d)]))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), POINTS).repartition(parts)


def survivors(rows, removed):
    """Local rows keep their order but are counted anew, as after a fresh load."""
    gone = {(c, i) for c, rs in removed.items() for i in rs}
    return [r for r in rows if (r[0], r[1]) not in gone]


@pytest.mark.parametrize("seed,settings", [(1, Settings(3, 3)), (2, Settings(5, 2, gamma=0.25, bisections=9)), (3, Settings(1, 2)), (4, Settings(4, 2, groups=3)), (5, Settings(2, 2, many_groups=True, steps=4)), (6, Settings(3, 2, grid=Grid(4, 1.5)))])
def test_training_is_the_oracles(spark, seed, settings):
    rows = federation(seed, groups=settings.groups)
    s = settings
    want = oracle.train(rows, seed, s.k, s.rounds, s.groups, s.grid.bits, s.grid.clip, s.gamma, s.bisections, s.frank_wolfe, s.steps, s.line_bits)
    assert T.train(frame(spark, rows), seed, s).trajectory == want


@pytest.mark.parametrize("mode,threshold", [("none", 0.5), ("basic", 1.1), ("runnerup", 1.1), ("basic", 0.0), ("runnerup", 0.3)])
@pytest.mark.parametrize("many", [False, True])
def test_unlearning_is_training_on_the_survivors(spark, mode, threshold, many):
    rows = federation(11, low=12, high=25)
    settings = Settings(3, 4, many_groups=many, steps=3)
    model = T.train(frame(spark, rows), 9, settings, cache=True)
    removed = {0: [0, 3, 5], 7: [2], 14: list(range(sum(r[0] == 14 for r in rows)))}
    again = T.unlearn(model, removed, mode, threshold)
    fresh = T.train(frame(spark, survivors(rows, removed), 2), 9, settings)
    assert again.trajectory == fresh.trajectory and again.digests == fresh.digests and again.stats == fresh.stats
    assert not states.differing_rows(again.slices.drop("selected_idx"), fresh.slices.drop("selected_idx")).count()
    for w in again.work:
        assert 0 <= w["S"] <= w["P"] <= w["A"] <= w["N"] == sum(again.sizes) and w["J"] <= w["A"] - w["P"]
    if threshold == 1.1:
        assert again.fallback_round is None
    with pytest.raises(ValueError):
        T.unlearn(again, {}, "basic")


def test_empty_request_and_saved_state(spark, tmp_path):
    rows = federation(12)
    model = T.train(frame(spark, rows), 3, Settings(2, 2), cache=True)
    states.save_model(model, f"{tmp_path}/m")
    loaded = states.load_model(spark, f"{tmp_path}/m")
    for m in (model, loaded):
        again = T.unlearn(m, {}, "runnerup")
        assert again.trajectory == model.trajectory and all(w["A"] == w["S"] == w["N"] for w in again.work)
    assert loaded.anchors == model.anchors and loaded.stats == model.stats
    with pytest.raises(Exception):
        states.save_model(model, f"{tmp_path}/m")


@pytest.mark.parametrize("bad", [{99: [0]}, {0: [-1]}, {0: [1000]}, {0: [1, 1]}, {0: [1.5]}, {True: [0]}])
def test_invalid_requests(spark, bad):
    model = T.train(frame(spark, federation(13)), 3, Settings(2, 0))
    with pytest.raises(ValueError):
        T.unlearn(model, bad, "none")


def test_request_that_empties_a_group(spark):
    rows = federation(14)
    model = T.train(frame(spark, rows), 3, Settings(2, 0))
    ones = {}
    for c, i, g, _ in rows:
        if g == 1:
            ones.setdefault(c, []).append(i)
    with pytest.raises(ValueError):
        T.unlearn(model, ones, "none")


@pytest.mark.parametrize("groups", [2, 3])
def test_clients_leave(spark, tmp_path, groups):
    rows = federation(15, groups=groups, clients=7)
    settings = Settings(4, 0, groups=groups)
    model = T.train(frame(spark, rows), 5, settings)
    state = T.compact(model)
    left = lambda gone: [r for r in rows if r[0] not in gone]
    runs = T.withdrawals(state, [[7], [21, 35], []], str(tmp_path))
    for run, gone in zip(runs, ({7}, {7, 21, 35}, {7, 21, 35}), strict=True):
        assert run.trajectory == oracle.train(left(gone), 5, 4, 0, groups) and run.points is None
    two = Settings(4, 2, groups=groups, steps=3)
    direct = T.delete_clients_directly(T.train(frame(spark, rows), 5, two), [7])
    assert direct.trajectory == oracle.train(left({7}), 5, 4, 2, groups, steps=3, fw=groups > 2)
    _, after = T.delete_clients(state, [7])
    for bad in ([7], [True], [8], [0, 0], "0", {0: 1}, [0, 14, 21, 28, 35, 42]):
        with pytest.raises(ValueError):
            T.delete_clients(after, bad)
    with pytest.raises(ValueError):
        T.compact(T.train(frame(spark, rows), 5, two))


def test_compact_deletion_reads_no_points(spark):
    model = T.train(frame(spark, federation(16)), 5, Settings(2, 0))
    run, state = T.delete_clients(T.compact(model), [0])
    assert "features" not in state.slices._jdf.queryExecution().toString()


def test_baselines(spark):
    rows = federation(17, low=3)
    settings = Settings(4, 2)
    encoded = P.encoded(frame(spark, rows), settings.grid)
    for reps in (4, 8):
        assert T.merged(encoded, 2, settings, reps)[0] == oracle.merged(rows, 2, 4, reps)
    for k in (1, 4, 6):
        assert T.centralized(encoded, 2, Settings(k)) == oracle.centralized(rows, 2, k)
    same = [(c, i, g, [1.0, 1.0]) for c, i, g, _ in rows[:30]]
    assert T.centralized(P.encoded(frame(spark, same), settings.grid), 2, Settings(3)) == oracle.centralized(same, 2, 3)
    start = oracle.centralized(rows, 2, 3)
    trajectory, _ = T.lloyd(encoded, start, 3, settings.grid)
    points = sorted(rows)
    for old, new in zip(trajectory, trajectory[1:]):
        labels = [oracle.closest(p[3], old) for p in points]
        want = [oracle.cell_mean(points, labels, None, j) or old[j] for j in range(3)]
        assert new == oracle.to_float(want)
    got = T.quality(encoded, start, settings.grid)
    assert list(got["group_costs"]) == oracle.costs(points, start, [oracle.closest(p[3], start) for p in points], 2)
    assert got["pooled_sse"] == sum(n * v for n, v in zip(got["sizes"], got["group_costs"])) and got["phi"] == max(got["group_costs"])
    assert T.refine_from(encoded, start, settings)[0][0] == start


def test_large_slices_draw_the_same(spark, monkeypatch):
    from fairspark.operators import seeding as S

    rows = federation(23) + [(90, i, 0, [1.0, 2.0, 3.0]) for i in range(12)]
    settings = Settings(3, 0, gamma=0.25)
    encoded = P.encoded(frame(spark, rows), settings.grid)
    monkeypatch.setattr(S, "BLOCK", 4)
    a, b = (sorted(map(str, S.local_slices(encoded, 8, settings, n).collect())) for n in (10**6, 9))
    assert a == b
    for reps in (3, 6):
        whole, drawn = (sorted(map(str, S.merged_slices(encoded, 8, settings, reps, n).collect())) for n in (10**6, 11))
        assert whole == drawn
    monkeypatch.setattr(S, "SLICE_NUMBERS", 30)
    assert S._large(encoded, ["client", "group_id"], 3, 10**6) and sorted(map(str, S.local_slices(encoded, 8, settings).collect())) == a


def test_layout_does_not_matter(spark):
    rows = federation(18)
    want = T.train(frame(spark, rows, 1), 4, Settings(3, 2))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert T.train(frame(spark, rows, 16), 4, Settings(3, 2)).digests == want.digests
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_points_are_checked(spark):
    good = federation(19)
    for bad in (good + [(1, 0, 2, [0.0, 0.0, 0.0])], good + [(1, 0, 0, [0.0, 0.0])], good + [(1, 0, 0, [float("nan"), 0.0, 0.0])], good + [(-1, 0, 0, [0.0] * 3)], [r for r in good if r[2]]):
        with pytest.raises(ValueError):
            T.train(frame(spark, bad), 1, Settings(2))


def test_known_draws():
    assert E.completed([], 3, 0) == [] and E.completed([], 3, 3) == [0, 1, 2] and E.completed([], 3, 5) == [0, 1, 2, 0, 1]
    assert E.seed_indices(E.lattice([[1.0], [2.0], [3.0]]), [0, 0, 0], 2, None) == [0, 1]

    class Words:
        def __init__(self, *w):
            self.w = list(w)

        def random_raw(self):
            return self.w.pop(0)

    assert E.draw_index(E.as_integers([1, Q(1, 2**54), 1]), Words(2**54)) == 1
    assert E.draw_index(E.as_integers([1, Q(1, 2**80), 1]), Words(0, 1 << 16)) == 1  # two words, low first
    words = Words(7, 5, 3)
    assert E.below(6, words) == 5 and words.w == [3] and E.below(1, words) == 0
    with pytest.raises(ValueError):
        E.tape(True, "local")
    for role in ("local", "server"):
        assert E.tape(5, role, 2, 1).random_raw() == oracle.stream(5, role, 2, 1).random_raw()


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    for scale in (1.0, 2.0**300, 2.0**-300, 1e-150):
        x, c = rng.integers(-3, 4, (60, 3)) * scale, rng.integers(-3, 4, (6, 3)) * scale
        c[1] = np.nextafter(c[0], np.inf)
        label, runner, own, other = E.nearest(x, c)
        for i in range(len(x)):
            ranked = sorted((oracle.dist(x[i].tolist(), c[j].tolist()), j) for j in range(6))
            assert (label[i], runner[i]) == (ranked[0][1], ranked[1][1])
            for (low, high), (d, _) in ((own[i], ranked[0]), (other[i], ranked[1])):
                assert Q(low) ** 2 <= d <= Q(high) ** 2
    assert E.nearest(np.zeros((1, 1)), np.array([[-1.0], [1.0]]))[0][0] == 0


def test_certificates_are_sound():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 5):
        x, old = rng.normal(size=(400, 2)), rng.normal(size=(k, 2))
        new = old + rng.normal(size=(k, 2)) * rng.choice([0, 0.02, 0.2], (k, 1))
        label, runner, own, other = E.nearest(x, old)
        shift = E.shifts(new, old)
        passed = {m: E.certified(label, runner, own, other, shift, m) for m in ("basic", "runnerup")}
        for ok in passed.values():
            assert (E.nearest(x[ok], new)[0] == label[ok]).all()
        assert k == 1 or passed["runnerup"].sum() >= passed["basic"].sum()


def test_snapping_and_halves():
    assert E.snapped([[0.375, -0.125, 0.3]], 0.25).tolist() == [[0.5, -0.0, 0.25]] and E.snapped([[0.3]], 0.0).tolist() == [[0.3]]
    assert E.snapped([[0.7]], 0.1)[0, 0] == float(round(Q(0.7) / Q(0.1)) * Q(0.1))
    n, b = 2**23, 30
    for offset, want in ((1, 1.0), (3, float.fromhex("0x1.0000000000002p+0"))):
        s = Stats([[n], [0]], [[[n * 2**b + offset]], [[0]]], [[0], [0]])
        assert U.lloyd([(0.0,)], s, 2**b) == [(want,)]


def stats_of(cells, scale=1):
    """cells: for each group, values by cluster."""
    return Stats([[len(c) for c in g] for g in cells], [[[sum(c) * scale] for c in g] for g in cells], [[sum((v * scale) ** 2 for v in c) for c in g] for g in cells])


def test_guard():
    s = stats_of([[[-1, 1]], [[3]]])
    new, info = U.bisected([(4 / 3,)], s, (2, 1), Settings(1, bisections=1, grid=Grid(0)))
    assert not info["accepted"] and new == [(4 / 3,)] and abs(info["phi"] - Q(25, 9)) < Q(1, 10**9)
    best, info = U.bisected([(0.0,)], s, (2, 1), Settings(1, bisections=40, grid=Grid(0)))
    assert info["accepted"] and abs(best[0][0] - 4 / 3) < 1e-9
    unequal = stats_of([[[0, 0, 0]], [[10]]])
    fair, info = U.bisected([(0.0,)], unequal, (3, 1), Settings(1, grid=Grid(0)))
    assert fair == [(5.0,)] and info["costs"] == (25, 25) and U.lloyd([(0.0,)], unequal, 1) == [(2.5,)]
    assert U.Costs(unequal, (3, 1), 1, [(0.0,)]).of([(2.5,)]) == (Q(25, 4), Q(225, 4))
    three = Stats([[1]] * 3, [[[0]], [[16]], [[4]]], [[0], [256], [16]])
    old, info = U.frank_wolfe([(2.0,)], three, (1, 1, 1), Settings(1, groups=3, steps=0, grid=Grid(2)))
    assert old == [(2.0,)] and info["gap"] >= 0
    with pytest.raises(ValueError):
        U.Costs(s, (3, 1), 1, [(0.0,)])


def test_frank_wolfe_closes_the_gap():
    rng = random.Random(5)
    cells = [[[rng.randint(-20, 20) for _ in range(4)] for _ in range(2)] for _ in range(4)]
    _, info = U.frank_wolfe([(0.0,), (1.0,)], stats_of(cells), (8,) * 4, Settings(2, groups=4, steps=12, line_bits=6, grid=Grid(0)))
    assert 0 <= info["gap"] < info["phi"] / 10


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_frank_wolfe_beside_branch_and_bound(seed):
    """The update's cost and its bound lie around the optimum that branch and bound brackets."""
    rng = random.Random(seed)
    cells = [[[rng.randint(-20, 20) for _ in range(4)] for _ in range(2)] for _ in range(4)]
    _, info = U.frank_wolfe([(0.0,), (1.0,)], stats_of(cells), (8,) * 4, Settings(2, groups=4, steps=12, line_bits=6, grid=Grid(0)))
    lower, upper = oracle.best_first(cells, (8,) * 4)
    assert info["dual"] <= upper and lower <= info["phi"] <= upper * Q(11, 10)


def test_integer_statistics(spark):
    rows = federation(20)
    grid = Grid()
    encoded = P.encoded(frame(spark, rows), grid)
    centers = [(0.0, 0.0, 0.0), (1.0, -1.0, 0.5)]
    s = R.statistics(encoded, centers, grid, 2)
    cached = R.cached_statistics(R.assigned(encoded, centers, grid), 2, 2, 3)
    on_grid = R.assigned_on_grid(encoded, [[0, 0, 0], [4096, -4096, 2048]])
    totals, sums = R.stats_long(on_grid, 2, 2)
    assert s == cached and {(r["group_id"], r["cluster"]): (r["n"], int(r["ss"])) for r in totals.collect()} == {(g, j): (s.n[g][j], s.ss[g][j]) for g in range(2) for j in range(2)}
    assert {(r["group_id"], r["cluster"], r["dim"]): r["s"] for r in sums.collect()} == {(g, j, q): s.s[g][j][q] for g in range(2) for j in range(2) for q in range(3) if s.n[g][j]}
    assert s.plus(s).plus(s, -1) == s
    big = R.Summed(1, 1)
    big.add(np.full((5000, 2), 2**29), np.zeros(5000, int), np.zeros(5000, int))
    assert big.total[0].tolist() == [5000, 5000 * 2 * 2**58, 5000 * 2**29, 5000 * 2**29]
    with pytest.raises(ValueError):
        big.add(np.full((1, 3), 2**30), np.zeros(1, int), np.zeros(1, int))


def test_native_encoding_matches(spark):
    values = [2.5 / 4096, 3.5 / 4096, -2.5 / 4096, 9.0, -9.0, 1e-150, 0.1]
    df = spark.createDataFrame([(1, 0, 0, values)], POINTS)
    got = P.represented(df, Grid()).first()
    assert got["x"] == [oracle.on_grid(v, 12, 8.0) for v in values] and got["features"] == [v / 4096 for v in got["x"]]
    assert P.dimension_guard(P.encoded(df, Grid())).first()["safe_rows"] == 2**59 // (7 * 32768**2)


def test_identities_and_partitions(spark):
    removed = spark.createDataFrame([(1, 2), (0, 5)], "client long, local_row long")
    ids = spark.createDataFrame([(0, 5, "a"), (1, 2, "b"), (1, 3, "c")], "client long, local_row long, stable_id string")
    assert [r["stable_id"] for r in P.identities_of(removed, ids).collect()] == ["a", "b"]
    with pytest.raises(Exception):
        P.identities_of(removed.unionAll(spark.createDataFrame([(9, 9)], removed.schema)), ids).collect()
    with pytest.raises(ValueError):
        P.identities_of(removed, ids.withColumn("stable_id", F.lit("same"))).collect()
    assert P.partition_differences(ids, ids.where("client = 1")).select("side").distinct().collect()[0][0] == "missing"
