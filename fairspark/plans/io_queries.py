"""Queries for sources, sinks, states and exact scalars: shared tables are written to the work folder and read back."""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact as E
from ..model import Grid, Settings, Stats
from ..operators import points as P
from ..operators import reports as Rep
from ..operators import rounds as R
from ..operators import update as U
from ..sources import archives, states
from ..sources import tables as Tab
from ..sources.workplace import work_folder
from . import training as T
from .queries import ENC, GRID, K, LAB, encoded, first_centers, query, read, request, vectors

_POINTS_SQL = "SELECT vec_id % 20 AS client, vec_id // 20 AS local_row, CAST(label % 2 AS INTEGER) AS group_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings"


def _long(points: DataFrame) -> DataFrame:
    return points.select("client", "local_row", "group_id", F.posexplode("features").alias("dim", "value"))


@query(_POINTS_SQL)
def s1_k4_containers(spark, sf):
    """Points written as containers, one a client, and read by the hashes of their receipts; written again, they stay."""
    folder = work_folder(spark, "npz")
    points = vectors(spark, sf)
    hashes = {r["file"]: r["sha256"] for r in Tab.write_arrays(points, folder).collect()}
    assert hashes == {r["file"]: r["sha256"] for r in Tab.write_arrays(points, folder).collect()}
    return _long(Tab.read_npz(spark, f"{folder}/*.npz", hashes))


@query("SELECT vec_id // 20 AS row, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings")
def s8_arrays(spark, sf):
    folder = work_folder(spark, "npy")
    Tab.write_arrays(vectors(spark, sf), folder, "npy").count()
    return Tab.read_npy(spark, f"{folder}/*.npy").select("row", F.posexplode("values").alias("dim", "value"))


@query(f"WITH p AS ({_POINTS_SQL}) SELECT client, local_row, group_id, client AS source_client, dim, value, (SELECT ceil(max(abs(value))) + 1 FROM p) AS clip FROM p")
def s2_client_tables(spark, sf):
    points = vectors(spark, sf)
    tables = {f"client_{c}": points.where(F.col("client") == c).drop("client") for c in range(20)}
    found, clip = Tab.read_clients(tables)
    return found.select("client", "local_row", "group_id", "source_client", F.posexplode("features").alias("dim", "value"), F.lit(clip).alias("clip"))


def census(spark, sf) -> DataFrame:
    """Customers in the columns of census records: some without age, of a third sex or with a broken area."""
    key = F.col("c_custkey")
    rest = {c: ((key + i) % 5).cast("double").alias(c) for i, c in enumerate(Tab.FEATURES)}
    rest |= {"AGEP": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("AGEP"), "SEX": (key % 3).cast("double").alias("SEX")}
    return read(spark, sf, "customer").select(F.col("c_nationkey").cast("double").alias("ST"), (key / F.lit(2.0)).alias("PUMA"), key.cast("string").alias("SERIALNO"), F.lit(1.0).alias("SPORDER"), *[rest[c] for c in Tab.FEATURES])


_CENSUS = "c AS (SELECT c_nationkey::DOUBLE AS ST, c_custkey / 2.0::DOUBLE AS PUMA, CAST(c_custkey AS VARCHAR) AS SERIALNO, CASE WHEN c_acctbal >= 0 THEN c_acctbal::DOUBLE END AS AGEP, (c_custkey % 3)::DOUBLE AS SEX, ((c_custkey + 1) % 5)::DOUBLE AS SCHL FROM customer), e AS (SELECT * FROM c WHERE SEX IN (1, 2) AND PUMA > 0 AND PUMA = floor(PUMA))"


@query(f"WITH {_CENSUS} SELECT ST, PUMA, AGEP, SEX FROM c")
def s3_states_csv(spark, sf):
    folder = work_folder(spark, "states")
    census(spark, sf).write.option("header", True).csv(folder)
    return Tab.read_states(spark, folder).select("ST", "PUMA", "AGEP", "SEX")


@query(f"WITH {_CENSUS} SELECT ST, SERIALNO, 1.0::DOUBLE AS SPORDER, AGEP, SCHL FROM c WHERE ST = 3")
def s4_pool_csv(spark, sf):
    """The typed records of one state's file, checked to be of that state."""
    folder = work_folder(spark, "pool")
    census(spark, sf).where("ST = 3").write.option("header", True).csv(folder)
    return Tab.read_pool(spark, folder, 3).select("ST", "SERIALNO", "SPORDER", "AGEP", "SCHL")


@query(f"WITH {_CENSUS} SELECT SERIALNO, SEX FROM e")
def p1_eligible(spark, sf):
    return Tab.eligible(census(spark, sf)).select("SERIALNO", "SEX")


@query(f"WITH {_CENSUS} SELECT SERIALNO, coalesce(AGEP, -1) AS AGEP FROM e")
def p2_imputed(spark, sf):
    return Tab.eligible(census(spark, sf)).select("SERIALNO", "AGEP")


@query(f"WITH {_CENSUS} SELECT CAST(ST AS BIGINT) AS client, row_number() OVER (PARTITION BY ST ORDER BY SERIALNO) - 1 AS local_row, CAST(SEX AS INTEGER) - 1 AS group_id, coalesce(AGEP, -1) AS age FROM e")
def p4_group_code(spark, sf):
    return Tab.census_points(Tab.eligible(census(spark, sf))).select("client", "local_row", "group_id", F.get("features", F.lit(0)).alias("age"))


@query("SELECT vec_id % 20 AS client, vec_id // 20 AS local_row FROM embeddings WHERE vec_id % 37 = 0")
def s5_k1_request_document(spark, sf):
    """A deletion request as one canonical document, which may be written again only with the same bytes."""
    path, removed = f"{work_folder(spark, 'request')}.json", {}
    for r in request(vectors(spark, sf)).orderBy("client", "local_row").collect():  # a request's size
        removed.setdefault(str(r["client"]), []).append(r["local_row"])
    for _ in range(2):
        Tab.write_json({"removed": removed}, str(Tab.local_path(path)), immutable=True)
    return Tab.read_request(spark, path)


@query("SELECT event_id, user_id, event_type, value FROM events")
def s6_json_lines(spark, sf):
    folder = work_folder(spark, "lines")
    read(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.json(folder)
    return Tab.read_jsonl(spark, folder, "event_id long, user_id long, event_type string, value double")


@query("SELECT o_orderstatus AS status, count(*) AS rows FROM orders GROUP BY 1")
def s7_csv_inventory(spark, sf):
    folder = work_folder(spark, "inventory")
    read(spark, sf, "orders").select("o_orderkey", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").option("header", True).csv(folder)
    found = Tab.csv_inventory(spark, folder)
    return found.groupBy(F.regexp_extract("file", "o_orderstatus=([^/]+)/", 1).alias("status")).agg(F.sum("rows").alias("rows"))


@query("SELECT vec_id % 20 AS client, CAST(label % 2 AS INTEGER) AS group_id, count(*) AS n, count(*) AS held FROM embeddings GROUP BY ALL")
def s9_k3_k5_saved_state(spark, sf):
    """A compact state, saved, read and compared: its counts, and the rows that its summaries stand for."""
    path, state = work_folder(spark, "state"), T.compact(T.train(vectors(spark, sf), 7, Settings(K)))
    states.save_compact(state, path)
    again = states.load_compact(spark, path)
    counts = spark.createDataFrame([(c, g, n) for c, own in again.counts.items() for g, n in enumerate(own) if n], "client long, group_id int, n long")
    return counts.join(again.slices.groupBy("client", "group_id").agg(F.sum("mult").alias("held")), ["client", "group_id"])


@query("SELECT 'slices' AS part, 0::BIGINT AS differing UNION ALL SELECT 'witness', 0 UNION ALL SELECT 'digest', 0")
def d13_d14_state_equality(spark, sf):
    """A saved model against a second training: rows, bytes of the centers and exact integers."""
    path, points = work_folder(spark, "model"), vectors(spark, sf)
    states.save_model(T.train(points, 7, Settings(K, 1), cache=True), path)
    one, two = states.load_model(spark, path), T.train(points, 7, Settings(K, 1))
    same = lambda m: [E.canonical_json(E.witness(c, s)) for c, s in zip(m.trajectory, [*m.stats, None], strict=False)]
    rows = [("slices", states.differing_rows(one.slices, two.slices).count()), ("witness", sum(a != b for a, b in zip(same(one), same(two), strict=True))), ("digest", int(one.digests != two.digests))]
    return spark.createDataFrame(rows, "part string, differing long")


@query("SELECT n_nationkey, n_name FROM nation")
def s10_restored_archive(spark, sf):
    """A file fetched in two attempts, the first of which breaks off, checked by its hash and taken out of its archive by checksums."""
    import hashlib
    import zipfile

    folder = Tab.local_path(work_folder(spark, "archive"))
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "source.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for r in read(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name")))).alias("rows")).collect():  # 5 regions
            z.writestr(f"region/{r['n_regionkey']}.jsonl", "\n".join(r["rows"]) + "\n")
    data = (folder / "source.zip").read_bytes()
    digest, half = hashlib.sha256(data).hexdigest(), len(data) // 2
    try:
        archives.fetch(lambda at: iter([data[at:half]]), folder / "copy.zip", len(data), digest)
    except ConnectionError:
        assert archives.fetch(lambda at: iter([data[at:]]), folder / "copy.zip", len(data), digest) == len(data) - half
    assert all(x[3] for x in archives.extract(folder / "copy.zip", folder / "out")) and not any(x[3] for x in archives.extract(folder / "copy.zip", folder / "out"))
    return Tab.read_jsonl(spark, f"{folder}/out/region/*.jsonl", "n_nationkey long, n_name string")


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def k2_appended_csv(spark, sf):
    path, rows = work_folder(spark, "appended"), read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for low in (True, False):
        Tab.append_csv(rows.where((F.col("n_regionkey") < 2) == low), path, ["n_regionkey", "n_nationkey", "n_name"])
    return Tab.read_csv(spark, path, "n_regionkey long, n_nationkey long, n_name string")


@query("SELECT 'case-' || s_suppkey AS case_id, CASE WHEN s_suppkey % 3 = 0 THEN 'failed' ELSE 'complete' END AS status, sha256('{\"case_id\":\"case-' || s_suppkey || '\",\"seconds\":' || s_suppkey % 7 || ',\"status\":\"' || CASE WHEN s_suppkey % 3 = 0 THEN 'failed' ELSE 'complete' END || '\"}') AS sha256 FROM supplier")
def k8_f12_f13_receipts(spark, sf):
    rows = read(spark, sf, "supplier").select("s_suppkey").collect()  # results of runs
    return Tab.receipts(spark, [{"status": "complete" if r[0] % 3 else "failed", "seconds": np.int64(r[0] % 7), "case_id": f"case-{r[0]}"} for r in rows])


@query("SELECT sha256('{\"C\":[10,25],\"T\":2,\"share\":\"1/3\"}') AS sha256, 1 AS rows")
def k9_declaration(spark, sf):
    """Declared twice with the same content; another declaration is refused."""
    path, design = work_folder(spark, "declared"), {"T": 2, "share": Fraction(1, 3), "C": (10, 25)}
    digest = [Tab.declare(spark, design, path) for _ in range(2)][1]
    try:
        Tab.declare(spark, design | {"T": 3}, path)
        raise AssertionError("another declaration went through")
    except ValueError:
        return spark.createDataFrame([(digest, spark.read.parquet(path).count())], "sha256 string, rows int")


@query("SELECT s_suppkey, format('{:.4g}', s_acctbal) AS shown FROM supplier")
def k6_f18_report_table(spark, sf):
    """The cells of a report's table, as its Markdown shows them."""
    lines = Rep.markdown(read(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("s_acctbal")), 10**6).split("\n")[2:]
    cells = [[c.strip() for c in line.strip("|").split("|")] for line in lines]
    return spark.createDataFrame([(int(k), v) for k, v in cells], "s_suppkey long, shown string")


@query("SELECT n_nationkey, n_regionkey, 2 * n_nationkey - 6 BETWEEN 0 AND 30 AND n_regionkey - 1 > 0 AND (n_regionkey - 1) * pow(2, 2 * n_nationkey + 10) <= pow(2, 52) AS valid FROM nation")
def p17_domain_checks(spark, sf):
    rows = []
    for r in read(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect():
        try:
            Grid(2 * r[0] - 6, (r[1] - 1) * 2.0**16)
            rows.append((r[0], r[1], True))
        except ValueError:
            rows.append((r[0], r[1], False))
    return spark.createDataFrame(rows, "n_nationkey long, n_regionkey long, valid boolean")


@query(f"WITH {LAB}, own AS (SELECT a.group_id, a.dim, a.label, a.m, c.m AS c FROM al a JOIN cen c ON c.dim = a.dim AND c.j = a.label), n AS (SELECT label % 2 AS group_id, count(*) AS n FROM embeddings GROUP BY 1), mean AS (SELECT *, avg(m) OVER (PARTITION BY group_id, label, dim) AS mu FROM own) SELECT CAST(group_id AS INTEGER) AS group_id, round(sum((m - c) * (m - c)) / any_value(n) / 4096.0 / 4096.0, 9) AS cost, round(sum((m - mu) * (m - mu)) / any_value(n) / 4096.0 / 4096.0, 9) AS within FROM mean JOIN n USING (group_id) GROUP BY group_id")
def a21_group_costs(spark, sf):
    """A group's exact cost for the start centers, and the part of it that no centers remove."""
    points = encoded(spark, sf)
    centers = [tuple(v / GRID.scale for v in c) for c in first_centers(points)]
    costs = U.Costs(R.statistics(points, centers, GRID, 2), P.group_sizes(points, 2), GRID.scale, centers)
    return spark.createDataFrame([(g, round(float(v), 9), round(float(costs.within(g)), 9)) for g, v in enumerate(costs.of(centers))], "group_id int, cost double, within double")


@query("WITH n AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1), l AS (SELECT list_reduce(list(n::BIGINT), lambda a, b: lcm(a, b)) AS l FROM n) SELECT s_nationkey, l // n AS weight FROM n, l")
def f1_f2_integer_weights(spark, sf):
    """Weights 1 / size, as coprime integers: numbers while all have 64 bits at most, else all as decimal digits, as sizes without
    common factors give weights that no number of Spark's holds (the SQL stops with an error there)."""
    rows = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")).collect()  # 25 nations
    weights = E.as_integers([Fraction(1, r[1]) for r in rows])
    kind, shown = ("long", int) if max(weights, default=0) < 2**63 else ("string", str)
    return spark.createDataFrame([(r[0], shown(w)) for r, w in zip(rows, weights, strict=True)], f"s_nationkey long, weight {kind}")


@query(f"WITH {ENC}, u AS (SELECT client, min(CASE WHEN m <> 0 THEN m & -m END) AS unit FROM enc GROUP BY 1) SELECT client, local_row, dim, m // unit AS v FROM enc JOIN u USING (client)")
def f3_common_scale(spark, sf):
    """The doubles of each client as integers of the largest unit they have in common."""

    def run(group: pa.Table) -> pa.Table:
        x = E.lattice(group["features"].to_pylist())
        return pa.table([group["client"], group["local_row"], pa.array(x.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["client", "local_row", "v"])

    points = P.represented(vectors(spark, sf), GRID).select("client", "local_row", "features")
    return points.groupBy("client").applyInArrow(run, "client long, local_row long, v array<long>").select("client", "local_row", F.posexplode("v").alias("dim", "v"))


@query(f"WITH {LAB} SELECT vec_id % 20 AS client, vec_id // 20 AS local_row, CAST(j AS INTEGER) AS cluster, d2, true AS encloses, true AS root_encloses, true AS tight FROM dist")
def f5_f6_enclosures(spark, sf):
    """Bounds of the distances to the start centers in doubles, against the exact integers."""
    centers = np.array([[v / GRID.scale for v in c] for c in first_centers(encoded(spark, sf))])

    def run(batches):
        for b in batches:
            x = np.array(b.column(2).to_pylist(), np.float64).reshape(b.num_rows, -1)
            low, high = E.squares(x, centers)
            below, above = E.lengths(low, high)
            whole = [[sum(int(v) ** 2 for v in row) for row in np.rint((p - centers) * GRID.scale)] for p in x]
            exact = [[Fraction(v, GRID.scale**2) for v in row] for row in whole]
            pairs = [(i, j) for i in range(len(x)) for j in range(len(centers))]
            columns = [
                b.column(0).take(pa.array([i for i, _ in pairs], pa.int64())), b.column(1).take(pa.array([i for i, _ in pairs], pa.int64())), pa.array([j for _, j in pairs], pa.int32()), pa.array([whole[i][j] for i, j in pairs], pa.int64()),
                pa.array([low[i, j] <= exact[i][j] <= high[i, j] for i, j in pairs]), pa.array([Fraction(below[i, j]) ** 2 <= exact[i][j] <= Fraction(above[i, j]) ** 2 for i, j in pairs]),
                pa.array([bool(high[i, j] - low[i, j] <= 1e-12 * max(1.0, high[i, j])) for i, j in pairs]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["client", "local_row", "cluster", "d2", "encloses", "root_encloses", "tight"])

    points = P.represented(vectors(spark, sf), GRID).select("client", "local_row", "features")
    return points.mapInArrow(run, "client long, local_row long, cluster int, d2 long, encloses boolean, root_encloses boolean, tight boolean")


@query("SELECT event_id, value::DOUBLE AS value, 8 AS bytes FROM events")
def f11_hexadecimal_witness(spark, sf):
    """Doubles through the witness of a state: hexadecimal values and bytes lead back to the same doubles."""

    def run(batches):
        for b in batches:
            seen = json.loads(E.canonical_json(E.witness(np.array(b.column(1).to_pylist(), np.float64).reshape(-1, 1))))
            values = [float.fromhex(row[0]) for row in seen["values"]]
            raw = np.frombuffer(bytes.fromhex(seen["bytes"]), "<f8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values), pa.array((raw == values) * 8, pa.int32())], names=["event_id", "value", "bytes"])

    return read(spark, sf, "events").select("event_id", F.col("value").cast("double")).mapInArrow(run, "event_id long, value double, bytes int")


@query("WITH s AS (SELECT g AS lane, CAST(n AS BIGINT) AS n, sum(n) OVER (ORDER BY g) AS upto FROM (SELECT o_custkey % 25 AS g, count(*) AS n FROM orders GROUP BY 1)) SELECT lane, n, CAST(upto AS BIGINT) AS upto FROM s")
def w3_a2_merged_counts(spark, sf):
    """Partial statistics of two halves of the orders, added, and their running sum."""
    orders = read(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("lane"), (F.col("o_orderkey") % 2).alias("half"))
    found = {(r["lane"], r["half"]): r["n"] for r in orders.groupBy("lane", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    halves = [Stats([[found.get((g, h), 0)] for g in range(25)], [[[0]]] * 25, [[0]] * 25) for h in (0, 1)]
    n = [row[0] for row in halves[0].plus(halves[1]).n]
    return spark.createDataFrame([(g, v, u) for g, (v, u) in enumerate(zip(n, accumulate(n), strict=True)) if v], "lane long, n long, upto long")
