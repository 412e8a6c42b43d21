"""Sources, sinks, reports, studies and the stream."""

import hashlib
import json
import os
import random
from fractions import Fraction as Q

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from fairspark.functions import columns as C
from fairspark.functions import exact as E
from fairspark.model import Grid, Settings
from fairspark.operators import federation as Fed
from fairspark.operators import points as P
from fairspark.operators import reports as Rep
from fairspark.operators import seeding as S
from fairspark.plans import training as T
from fairspark.plans import witness as Wit
from fairspark.sources import tables as Tab
from fairspark.streaming import deletions


def test_npz_and_npy(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, groups = rng.normal(size=(7, 3)), np.array([0, 1, 0, 1, 1, 0, 0])
    np.savez(tmp_path / "p.npz", X=x, groups=groups, offsets=np.array([0, 3, 3, 7]), client_ids=np.array([4, 5, 9]), row_ids=np.arange(7))
    sha = hashlib.sha256((tmp_path / "p.npz").read_bytes()).hexdigest()
    rows = Tab.read_npz(spark, f"{tmp_path}/p.npz", {"p.npz": sha}).orderBy("client", "local_row").collect()
    assert [(r["client"], r["local_row"], r["group_id"]) for r in rows] == [(4, 0, 0), (4, 1, 1), (4, 2, 0), (9, 0, 1), (9, 1, 1), (9, 2, 0), (9, 3, 0)]
    assert [r["features"] for r in rows] == x.tolist()
    with pytest.raises(Exception):
        Tab.read_npz(spark, f"{tmp_path}/p.npz", {"p.npz": "0"}).count()
    np.savez(tmp_path / "bad.npz", X=x, groups=groups, offsets=np.array([0, 3]), client_ids=np.array([4, 5]))
    with pytest.raises(Exception):
        Tab.read_npz(spark, f"{tmp_path}/bad.npz").collect()
    np.save(tmp_path / "a.npy", x)
    assert [r["values"] for r in Tab.read_npy(spark, f"{tmp_path}/a.npy").orderBy("row").collect()] == x.tolist()


def census(path, state, rows):
    head = ["ST", "PUMA", "SERIALNO", "SPORDER", "OTHER", *Tab.FEATURES]
    text = [",".join(head)] + [",".join("" if r.get(c) is None else str(r[c]) for c in head) for r in rows]
    path.write_text("\n".join(text) + "\n")


def test_census(spark, tmp_path):
    rng = random.Random(2)
    row = lambda i, **k: {"ST": 6, "PUMA": 101 + i % 3, "SERIALNO": f"S{i:03}", "SPORDER": 1, "OTHER": "x", **{c: rng.randint(1, 9) for c in Tab.FEATURES}, "SEX": 1 + i % 2, **k}
    rows = [row(i) for i in range(20)] + [row(20, SEX=3), row(21, PUMA=0), row(22, PUMA="1.5"), row(23, SEX=None), row(24, MIG=None)]
    census(tmp_path / "a.csv", 6, rows)
    pool = Tab.read_pool(spark, f"{tmp_path}/a.csv", 6)
    good = Tab.eligible(pool)
    assert good.count() == 21 and good.where("MIG = -1").count() == 1 and Tab.read_states(spark, f"{tmp_path}/*.csv").columns == ["ST", "PUMA", *Tab.FEATURES]
    with pytest.raises(Exception):
        Tab.read_pool(spark, f"{tmp_path}/a.csv", 7).collect()
    with pytest.raises(ValueError):
        Tab.read_csv(spark, f"{tmp_path}/a.csv", "NONE double")
    scale = Tab.scaling(good, ["AGEP", "MIG"])
    ages = [r["AGEP"] for r in good.collect()]
    assert np.allclose(scale["AGEP"], (np.mean(ages), np.std(ages)), rtol=1e-14)
    z = Tab.standardized(good, scale)
    assert abs(z.agg(F.avg("AGEP")).first()[0]) < 1e-12
    decoded = Tab.decoded_level(z, "AGEP", list(range(1, 10)), *scale["AGEP"], "code")
    assert sorted(r["code"] + 1 for r in decoded.collect()) == sorted(map(int, ages))
    with pytest.raises(Exception):
        Tab.decoded_level(z, "AGEP", [1, 2], *scale["AGEP"], "code").collect()
    points = Tab.census_points(z)
    assert points.count() == 21 and set(points.columns) == {"client", "local_row", "group_id", "features"}
    infinite = good.withColumn("AGEP", F.lit(float("inf")))
    with pytest.raises(Exception):
        Tab.eligible(infinite).collect()


def test_client_tables(spark):
    make = lambda top: spark.createDataFrame([(0, 1, [0.5, -top])], "local_row long, group_id int, features array<double>")
    tables = {"client_10": make(2.5), "client_2": make(7.2), "client_02": make(99.0), "other": make(99.0)}
    points, clip = Tab.read_clients(tables)
    assert clip == 9.0 and sorted((r["client"], r["source_client"]) for r in points.collect()) == [(0, 2), (1, 10)]
    assert Tab.read_clients(tables, 1, seed=3)[0].count() == 1


def test_documents(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"removed": {"3": [1, 2], "0": [5]}, "seed": 1}, indent=1))
    assert sorted(map(tuple, Tab.read_request(spark, f"{tmp_path}/r.json").collect())) == [(0, 5), (3, 1), (3, 2)]
    (tmp_path / "r.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    assert Tab.read_jsonl(spark, f"{tmp_path}/r.jsonl", "a long, b string").count() == 2
    assert Tab.read_document(spark, f"{tmp_path}/r.json").first()["seed"] == 1


def test_inventories(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "d" / "e" / "b.csv").write_text("x\n1\n")
    found = Tab.inventory(spark, f"{tmp_path}/d")
    assert found.count() == 2
    want = found.select("file", "sha256")
    assert Tab.verified(found, want).count() == 0
    assert {r["problem"] for r in Tab.verified(found, want.limit(1).withColumn("sha256", F.lit("0")).unionByName(spark.createDataFrame([("gone", "1")], "file string, sha256 string"))).collect()} == {"differs", "missing", "unlisted"}
    assert sorted(r["rows"] for r in Tab.csv_inventory(spark, f"{tmp_path}/d").collect()) == [1, 2]


def test_writes(spark, tmp_path):
    path = f"{tmp_path}/x/doc.json"
    Tab.write_json({"b": Q(1, 3), "a": [1.5, None]}, path, immutable=True)
    assert open(path).read() == '{"a":[1.5,null],"b":"1/3"}\n'
    Tab.write_json({"a": [1.5, None], "b": Q(2, 6)}, path, immutable=True)
    with pytest.raises(ValueError):
        Tab.write_json({"a": 1}, path, immutable=True)
    df = spark.createDataFrame([(1, "a"), (2, None)], "x long, y string")
    with pytest.raises(ValueError):
        Tab.write_once(df, f"{tmp_path}/t", verify_only=True)
    for _ in range(2):
        Tab.write_once(df, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        Tab.write_once(df.limit(1), f"{tmp_path}/t")
    for _ in range(2):
        Tab.append_csv(df, f"{tmp_path}/c", ["x", "y"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 4
    with pytest.raises(ValueError):
        Tab.append_csv(df, f"{tmp_path}/c", ["x"])
    assert Tab.declare(spark, {"k": 1}, f"{tmp_path}/p") == Tab.declare(spark, {"k": 1}, f"{tmp_path}/p")
    with pytest.raises(ValueError):
        Tab.declare(spark, {"k": 2}, f"{tmp_path}/p")
    assert Tab.receipts(spark, [{"case_id": "a", "status": "complete", "v": Q(1, 2)}]).first()["status"] == "complete"


def test_reports(spark):
    rows = spark.createDataFrame([(c, m, "d", v) for c in (1, 2) for m, v in (("fresh", 10.0 * c), ("a", 2.0), ("b", 0.0))], "case_id long, method string, dataset string, s double")
    pairs = Rep.paired(rows, ["case_id", "dataset"], "method", "s", "fresh")
    got = {(r["case_id"], r["method"]): r["ratio"] for r in pairs.collect()}
    assert got == {(1, "a"): 5.0, (2, "a"): 10.0, (1, "b"): None, (2, "b"): None}
    total = {(r["method"], r["dataset"]): r for r in Rep.rolled_up(pairs, "dataset").collect()}
    assert total["a", "all"]["total_ratio"] == 7.5 and total["a", "d"]["tenfold"] == 1 and total["b", "all"]["total_ratio"] is None and len(total) == 4
    exact = Rep.exact_mean_variance(spark.createDataFrame([("x", "1/3"), ("x", "1/2"), ("y", "5")], "k string, v string"), ["k"], "v")
    assert {tuple(r) for r in exact.collect()} == {("x", 2, "5/12", "1/72"), ("y", 1, "5/1", "0/1")}
    one = Rep.summary(spark.createDataFrame([("x", 1.0), ("x", float("nan")), ("y", None)], "k string, v double"), ["k"], "v")
    assert {(r["k"], r["n"], r["mean"], r["sd"]) for r in one.collect()} == {("x", 1, 1.0, 0.0), ("y", 0, None, None)}
    b = Rep.bootstrap_interval(spark.createDataFrame([("x", float(i)) for i in range(50)], "k string, v double"), ["k"], "v").first()
    assert b["low"] < 24.5 < b["high"] and b["mean"] == 24.5
    assert Rep.significant(None) == "" and Rep.significant(1 / 3) == "0.3333" and Rep.markdown(pairs.limit(1)).count("\n") == 2
    work = spark.createDataFrame([(1, 10, 8, 5, 5, 1), (1, 10, 8, 9, 5, 1)], "k long, N long, A long, P long, S long, J long")
    assert not Rep.work_counters(work, ["k"]).first()["holds"]


def test_locations_and_samples(spark):
    rows = [(c, i, (c + i) % 2, [float(i)]) for c, n in ((2, 5), (3, 1), (7, 9)) for i in range(n)]
    points = spark.createDataFrame(rows, "client long, local_row long, group_id int, features array<double>")
    offsets = Fed.client_offsets(points)
    got = {r["flat_index"]: (r["client"], r["local_row"]) for r in Fed.locate(spark.range(15).withColumnRenamed("id", "flat_index"), offsets, cell=4).collect()}
    assert [got[i] for i in range(15)] == [(r[0], r[1]) for r in rows]
    one, two = (sorted(map(tuple, Fed.sample_removal(points, 3, 0.3, least=2).collect())) for _ in "ab")
    flat = np.random.default_rng(3).choice(15, size=4, replace=False)
    assert one == two == sorted((rows[i][0], rows[i][1]) for i in flat)
    removed, digest, seed = Fed.sample_deletion(points, 5, (1, 2), "0.2")
    assert removed.count() == 3 and len(digest) == 64 and seed == Fed.derived_seed(5, "uniform-deletion", 1, 2, "0.2")
    assert Fed.deletion_size(1000, "0.0005") == 1 and Fed.deletion_size(10, "0.25") == 3 and Fed.deletion_size(3, "0.01") == 1
    col = spark.range(1).select(C.derived_seed(F.lit(5), F.lit("uniform-deletion"), F.lit(1)).cast("string"), C.deletion_count(F.lit(10), "0.25")).first()
    assert int(col[0]) == Fed.derived_seed(5, "uniform-deletion", 1) and col[1] == 3
    fed = Fed.prepare_federation(points, 9, 3, 1)
    assert fed.count() == 9 and fed.select("client").distinct().count() == 3
    gaps = [(c, 3 * i + c, i % 2, [float(i)]) for c in (4, 9) for i in range(11)]
    sparse = spark.createDataFrame(gaps, "client long, local_row long, group_id int, features array<double>")
    assert sorted((r["client"], r["rank"], r["local_row"]) for r in Fed.ranked(sparse, 7).collect()) == [(c, i, 3 * i + c) for c in (4, 9) for i in range(11)]
    plan = spark.createDataFrame([(9, 0, 4), (4, 1, 11)], "client long, position int, quota int")
    got = sorted((r["client"], r["local_row"], r["source_row"]) for r in Fed.subsample(sparse, plan, 6).collect())
    picked = [(p, np.sort(np.random.default_rng(np.random.SeedSequence([6, p])).choice(11, size=q, replace=False)), c) for c, p, q in ((9, 0, 4), (4, 1, 11))]
    assert got == [(p, j, 3 * int(i) + c) for p, at, c in picked for j, i in enumerate(at)]
    with pytest.raises(Exception):
        Fed.prepare_federation(points, 99, 3, 1)
    with pytest.raises(ValueError):
        Fed.prepare_federation(points, 9, 4, 1)
    assert sorted(Fed.client_order(["b", "a", "c"], 1, 0)) == ["a", "b", "c"]


@pytest.mark.parametrize("kappa", [1, 2, 4])
def test_run_lengths_draw_what_rows_draw(kappa):
    unit = 6
    rows = [(0, i, 0, [0.0]) for i in range(kappa * unit)] + [(0, 100 + i, 1, [10.0]) for i in range(unit)] + [(1, i, 0, [0.0]) for i in range(unit)] + [(1, 100 + i, 1, [0.0]) for i in range(kappa * unit)]
    for seed in range(3):
        assert [(Wit.witness_center(kappa, seed, "centralized", unit)[0],)] == oracle.centralized(rows, seed, 1, clip=16.0)
        assert [(Wit.witness_center(kappa, seed, "grouped_2k", unit)[0],)] == oracle.train(rows, seed, 1, 0, clip=16.0)[0]
        for name, reps in (("merged_1k", 1), ("merged_2k", 2)):
            assert [(Wit.witness_center(kappa, seed, name, unit)[0],)] == oracle.merged(rows, seed, 1, reps, clip=16.0)


def test_run_lengths_of_any_runs():
    rng = random.Random(3)
    for _ in range(30):
        runs = [(rng.randint(1, 4), rng.randint(0, 3)) for _ in range(rng.randint(1, 5))]
        weights = [Q(rng.randint(0, 3), rng.randint(1, 3)) for _ in runs]
        k = rng.randint(1, 7)
        flat = [(float(v),) for n, v in runs for _ in range(n)]
        listed = [w for (n, _), w in zip(runs, weights) for _ in range(n)]
        assert Wit.seed_runs(runs, weights, k, oracle.stream(1, "server")) == oracle.seeding(flat, listed, k, oracle.stream(1, "server"))


def test_witness_population(spark):
    points = Tab.kappa_witness(spark, 4, 6)
    model = T.train(points, 3, Settings(1, 0, grid=Grid(12, 16.0)))
    assert model.sizes == (30, 30) and model.centers == [(Wit.witness_center(4, 3, "grouped_2k", 6)[0],)]
    assert Tab.federation_grid(spark).count() > 180


def test_quantization(spark):
    rows = [(c, i, i % 2, [((i * 7 + c) % 11) / 8, (i % 5) / 8]) for c in range(3) for i in range(9)]
    points = P.encoded(spark.createDataFrame(rows, "client long, local_row long, group_id int, features array<double>"), Grid())
    settings = Settings(3, gamma=0.5)
    slices = S.local_slices(points, 2, settings).persist()
    got = Wit.quantization(points, slices, P.group_sizes(points, 2), settings)
    own = slices.collect()
    assert got["max_residual"] == max(oracle.dist(r["rep"], r["anchor"]) for r in own) and got["ids"] == len(own) and got["within_envelope"]
    sizes, want, snapped = P.group_sizes(points, 2), Q(0), Q(0)
    for c in range(3):
        for g in range(2):
            mine = [r for r in sorted(own, key=lambda r: r["slot"]) if r["client"] == c and r["group_id"] == g]
            reps = [r["rep"] for r in mine]
            labels = [(x, oracle.closest(x, reps)) for cc, _, gg, x in rows if (cc, gg) == (c, g)]
            want += sum(oracle.dist(x, reps[j]) for x, j in labels) / sizes[g]
            snapped += sum(oracle.dist(x, mine[j]["anchor"]) for x, j in labels) / sizes[g]
    assert got["local_cost"] == want and got["anchor_cost"] == snapped


def test_stream_of_withdrawals(spark, tmp_path):
    rows = [(c, i, i % 2, [float((i * 5 + c) % 7)]) for c in range(6) for i in range(6)]
    points = spark.createDataFrame(rows, "client long, local_row long, group_id int, features array<double>")
    start = T.compact(T.train(points, 4, Settings(2)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"request_id": 1, "client": 2}\n{"request_id": 2, "client": 2}\n')
    requests = spark.readStream.schema("request_id long, client long").json(f"{tmp_path}/in")
    for more in (None, '{"request_id": 3, "client": 0}\n{"request_id": 4, "client": 2}\n'):
        if more:
            (tmp_path / "in" / "2.json").write_text(more)
        q = deletions.follow(requests, start, f"{tmp_path}/states", f"{tmp_path}/check", availableNow=True)
        q.awaitTermination()
    state = deletions.load_compact(spark, f"{tmp_path}/states/state=2")
    assert sorted(state.counts) == [1, 3, 4, 5]
    again = deletions.apply_batch(spark, spark.createDataFrame([(3, 0)], "request_id long, client long"), 1, f"{tmp_path}/states")
    assert again.counts == state.counts
    assert T.delete_clients(state, [])[0].trajectory == oracle.train([r for r in rows if r[0] not in (0, 2)], 4, 2, 0)


def test_witness_documents():
    w = E.witness([(0.5, -0.0)])
    assert w["shape"] == [1, 2] and w["values"] == [["0x1.0000000000000p-1", "-0x0.0p+0"]] and len(w["bytes"]) == 32
    assert E.canonical_json({"b": np.int64(1), "a": np.array([1.5])}) == '{"a":[1.5],"b":1}'


def test_fetch_goes_on_where_it_broke_off(tmp_path):
    import hashlib

    from fairspark.sources import archives

    data = bytes(range(256)) * 40
    digest, target = hashlib.sha256(data).hexdigest(), tmp_path / "deep" / "file.bin"
    asked = []

    def read_from(upto):
        def run(at):
            asked.append(at)
            return iter([data[at : at + 100], data[at + 100 : upto]])

        return run

    with pytest.raises(ConnectionError):
        archives.fetch(read_from(3000), target, len(data), digest)
    assert not target.exists() and archives.fetch(read_from(len(data)), target, len(data), digest) == len(data) - 3000
    assert asked == [0, 3000] and target.read_bytes() == data and archives.fetch(read_from(0), target, len(data), digest) == 0
    with pytest.raises(ValueError):
        archives.fetch(read_from(len(data)), target, len(data), "0" * 64)
    with pytest.raises(ValueError):
        archives.fetch(lambda at: iter([b"x" * 10]), tmp_path / "other", 10, digest)
    assert not (tmp_path / "other.part").exists() and not (tmp_path / "other").exists()


def test_extract_checks_and_stays_inside(tmp_path):
    import zipfile

    from fairspark.sources import archives

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/one.txt", "one")
        z.writestr("two.txt", "two" * 1000)
    first = archives.extract(tmp_path / "a.zip", tmp_path / "out")
    assert [x[3] for x in first] == [True, True] and (tmp_path / "out/in/one.txt").read_text() == "one"
    (tmp_path / "out/two.txt").write_text("broken")
    assert [x[3] for x in archives.extract(tmp_path / "a.zip", tmp_path / "out")] == [False, True]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../three.txt", "three")
    with pytest.raises(ValueError):
        archives.extract(tmp_path / "b.zip", tmp_path / "out")
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[data.index(b"twotwo")] ^= 1
    (tmp_path / "c.zip").write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        archives.extract(tmp_path / "c.zip", tmp_path / "new")


def test_no_temporary_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from fairspark.sources import workplace

    empty = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: empty), master="spark://host:7077")
    with pytest.raises(ValueError):
        workplace.shared_folder(SimpleNamespace(sparkContext=context, conf={}))
    path = workplace.work_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    workplace.discard(path)
    assert not os.path.exists(path.removeprefix("file:"))
