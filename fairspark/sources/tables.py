"""Reading and writing: fixed schemas, arrays, documents, inventories with hashes, writes that happen once."""

from __future__ import annotations

import io
import json
import os
import re
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.exact import canonical_json
from ..model import POINTS
from ..operators.points import require

#: The census columns that make a point, in order, and those that say where a record comes from.
FEATURES = ("AGEP", "SCHL", "MAR", "RELP", "DIS", "ESP", "CIT", "MIG", "MIL", "ANC", "NATIVITY", "DEAR", "DEYE", "DREM", "SEX", "RAC1P")


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and a fixed schema, matched by name to the files' own header; rows that do not fit fail the read. Unused columns are never parsed."""
    fields = {x.split()[0]: x.split()[1] for x in schema.split(",")}
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = set(fields) - set(raw.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return raw.select(*[F.col(c).cast(t).alias(c) for c, t in fields.items() if columns is None or c in columns])


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """Census records of all state files under a path: 18 columns of some 280, blanks as nulls."""
    return read_csv(spark, path, ", ".join(["ST double", "PUMA double", *(f"{c} double" for c in FEATURES)]))


def read_pool(spark: SparkSession, path: str, state: int | None = None) -> DataFrame:
    """Records with their serial number and order; with a state, all rows must be of it."""
    rows = read_csv(spark, path, ", ".join(["ST double", "PUMA double", "SERIALNO string", "SPORDER double", *(f"{c} double" for c in FEATURES)]))
    return rows if state is None else require(rows, F.col("ST") == state, "a record is of another state")


def eligible(rows: DataFrame) -> DataFrame:
    """SEX 1 or 2 and a whole PUMA over 0; missing features become -1, infinite ones are an error."""
    rows = rows.where(F.col("SEX").isin(1.0, 2.0) & (F.col("PUMA") > 0) & (F.col("PUMA") == F.floor("PUMA")) & ~F.isnan("PUMA"))
    rows = rows.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(-1.0)) for c in FEATURES if c != "SEX"})
    finite = F.lit(True)
    for c in FEATURES:
        finite = finite & (F.abs(F.col(c)) < F.lit(float("inf")))
    return require(rows, finite, "a feature is not finite")


def moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, s, ss) of whole-numbered columns, exactly."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("decimal(18,0)").alias("v")) for c in columns])).alias("f")).select("f.*")
    return long.groupBy("feature").agg(F.count("v").alias("n"), F.sum("v").cast("decimal(38,0)").alias("s"), F.sum((F.col("v") * F.col("v")).cast("decimal(38,0)")).alias("ss"))


def scaling(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation (1 for constant columns) of the pool, each from exact moments; never fitted again after deletions."""
    out = {}
    for r in moments(rows, columns).collect():
        n, s, ss = int(r["n"]), int(r["s"]), int(r["ss"])
        out[r["feature"]] = (s / n, ((n * ss - s * s) / (n * n)) ** 0.5 or 1.0)
    return out


def standardized(rows: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(d) for c, (m, d) in scale.items()})


def decoded_level(rows: DataFrame, column: str, codes: list[int], mean: float, deviation: float, to: str) -> DataFrame:
    """The code behind each standardized value, by exact equality with (code - mean) / deviation; a value without a code is an error."""
    levels = rows.sparkSession.createDataFrame([((c - mean) / deviation, i) for i, c in enumerate(codes)], f"__level double, {to} int")
    return require(rows.join(F.broadcast(levels), F.col(column) == F.col("__level"), "left").drop("__level"), F.col(to).isNotNull(), "a level has no code")


def census_points(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Standardized records with SEX as read, as points by state: clients in ascending order of ST, rows in the order of serial and order."""
    from pyspark.sql import Window as W

    return rows.select(F.col("ST").cast("long").alias("client"), (F.row_number().over(W.partitionBy("ST").orderBy("SERIALNO", "SPORDER")) - 1).cast("long").alias("local_row"), (F.col("SEX") - 1).cast("int").alias("group_id"), F.array(*features).alias("features"))


def read_npz(spark: SparkSession, path: str, sha256: dict[str, str] | None = None) -> DataFrame:
    """Points from containers X (n, d), groups (n), offsets (clients + 1), client_ids: client i owns rows offsets[i] to offsets[i + 1].

    Files are read by the executors; sha256, by file name, must agree with their bytes. Pickled objects are refused.
    """
    files = spark.read.format("binaryFile").load(path)
    if sha256 is not None:
        want = F.element_at(F.create_map(*[F.lit(x) for kv in sha256.items() for x in kv]), F.substring_index("path", "/", -1))
        files = require(files, F.sha2("content", 256) == want, "a container's hash differs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                with np.load(io.BytesIO(blob), allow_pickle=False) as f:
                    x, groups, offsets, clients = f["X"], f["groups"], f["offsets"], f["client_ids"]
                if x.dtype != np.float64 or x.ndim != 2 or len(groups) != len(x) or len(offsets) != len(clients) + 1 or offsets[0] != 0 or offsets[-1] != len(x) or (np.diff(offsets) < 0).any():
                    raise ValueError("invalid container")
                for client, low, high in zip(clients.tolist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
                    for at in range(low, high, 10_000):
                        own = x[at : min(high, at + 10_000)]
                        rows = [pa.array([client] * len(own), pa.int64()), pa.array(np.arange(at - low, at - low + len(own))), pa.array(groups[at : at + len(own)].astype(np.int32)), pa.array(own.tolist(), pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays(rows, names=POINTS.names)

    return files.select("content").mapInArrow(run, POINTS)


def local_path(path: str) -> Path:
    """The place of a folder that all machines see as files."""
    if "://" in path.removeprefix("file://"):
        raise ValueError("arrays are written to a mounted folder")
    return Path(path.removeprefix("file://").removeprefix("file:"))


def write_arrays(points: DataFrame, folder: str, kind: str = "npz") -> DataFrame:
    """One file for each client, written by the executors in one step, and (client, file, bytes, sha256) of all: containers that
    read_npz reads, or features alone for read_npy. A file that is there must hold the same bytes."""
    import hashlib

    where = local_path(folder)

    def run(group: pa.Table) -> pa.Table:
        client, group = group["client"][0].as_py(), group.sort_by("local_row")
        x, buffer = np.array(group["features"].to_pylist(), np.float64), io.BytesIO()
        if kind == "npz":
            np.savez(buffer, X=x, groups=group["group_id"].to_numpy().astype(np.int64), offsets=np.array([0, len(x)]), client_ids=np.array([client]))
        else:
            np.save(buffer, x)
        data, target = buffer.getvalue(), where / f"client_{client}.{kind}"
        if target.exists():
            if target.read_bytes() != data:
                raise ValueError(f"{target} is immutable and would change")
        else:
            where.mkdir(parents=True, exist_ok=True)
            handle, name = tempfile.mkstemp(dir=where, prefix=".")
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            os.replace(name, target)
        return pa.table([pa.array([client], pa.int64()), pa.array([target.name]), pa.array([len(data)], pa.int64()), pa.array([hashlib.sha256(data).hexdigest()])], names=["client", "file", "bytes", "sha256"])

    return points.select("client", "local_row", "group_id", "features").groupBy("client").applyInArrow(run, "client long, file string, bytes long, sha256 string")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, values) of two-dimensional arrays of doubles, one file for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                a = np.load(io.BytesIO(blob), allow_pickle=False).astype(np.float64)
                for at in range(0, len(a), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, min(len(a), at + 10_000))), pa.array(a[at : at + 10_000].tolist(), pa.list_(pa.float64()))], names=["row", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, values array<double>")


def read_clients(tables: dict[str, DataFrame], wanted: int | None = None, seed: int = 0) -> tuple[DataFrame, float]:
    """Points of tables named client_<number> (local_row, group_id, features): some clients drawn without replacement, numbered
    densely in ascending order of their numbers; and the clip, the ceiling of the largest size plus 1."""
    numbers = sorted(int(m[1]) for name in tables if (m := re.fullmatch(r"client_(0|[1-9][0-9]*)", name)))
    if wanted is not None and wanted < len(numbers):
        numbers = sorted(np.random.default_rng(seed).choice(numbers, size=wanted, replace=False).tolist())
    parts = [tables[f"client_{c}"].select(F.lit(i).cast("long").alias("client"), "local_row", F.col("group_id").cast("int").alias("group_id"), "features", F.lit(c).cast("long").alias("source_client")) for i, c in enumerate(numbers)]
    points = parts[0]
    for p in parts[1:]:
        points = points.unionByName(p)
    points = require(points, F.col("group_id").isin(0, 1), "a group is not 0 or 1")
    top = points.agg(F.max(F.array_max(F.transform("features", F.abs))).alias("top")).first()["top"]
    return points, float(np.ceil(top)) + 1


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_request(spark: SparkSession, path: str) -> DataFrame:
    """A deletion document, {"removed": {client: [rows]}}, as (client, local_row)."""
    rows = read_document(spark, path, "removed map<string, array<bigint>>").select(F.explode("removed").alias("client", "rows"))
    return rows.select(F.col("client").cast("long").alias("client"), F.explode("rows").alias("local_row"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def csv_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows) of every CSV file below a path, their headers not counted."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path).select(F.input_file_name().alias("file"))
    return lines.groupBy("file").agg((F.count(F.lit(1)) - 1).alias("rows"))


def verified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, problem): files whose hash differs from a manifest (file, sha256), missing and unlisted ones; empty if all agree."""
    m = manifest.select("file", F.col("sha256").alias("want"))
    both = found.join(m, "file", "full_outer")
    problem = F.when(F.col("want").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "differs")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def write_json(value, path: str, immutable: bool = False) -> None:
    """One canonical document on the driver's file system, in one step; an immutable file may only be written again with the same bytes."""
    data = (canonical_json(value) + "\n").encode()
    target = Path(path)
    if immutable and target.exists():
        if target.read_bytes() != data:
            raise ValueError(f"{path} is immutable and would change")
        return
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "wb") as f:
        f.write(data)
    os.replace(name, path)


def write_once(df: DataFrame, path: str, verify_only: bool = False) -> None:
    """Writes Parquet where nothing is; where something is, it must hold the same rows. verify_only never creates."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    if not exists:
        if verify_only:
            raise ValueError(f"{path} is missing")
        df.write.mode("errorifexists").parquet(path)
        return
    there = spark.read.parquet(path)
    if there.columns != df.columns or there.exceptAll(df).unionAll(df.exceptAll(there)).count():
        raise ValueError(f"{path} holds other rows")


def append_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Appends exactly these columns; more or fewer are an error."""
    if set(df.columns) != set(columns):
        raise ValueError("columns differ from the declared ones")
    df.select(*columns).write.mode("append").option("header", True).csv(path)


def declare(spark: SparkSession, declaration: dict, path: str) -> str:
    """Keeps a declaration before the first run; a later one must have the same hash. Returns the hash."""
    import hashlib

    digest = hashlib.sha256(canonical_json(declaration).encode()).hexdigest()
    write_once(spark.createDataFrame([(digest, canonical_json(declaration))], "sha256 string, declaration string"), path)
    return digest


def receipts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """(case_id, status, sha256) for each result, the hash over its canonical text."""
    import hashlib

    return spark.createDataFrame([(r["case_id"], r["status"], hashlib.sha256(canonical_json(r).encode()).hexdigest()) for r in rows], "case_id string, status string, sha256 string")


def growth_grid(spark: SparkSession, clients=(0, 3, 8, 21, 33, 47), rows: int = 180, d: int = 4, groups: int = 2) -> DataFrame:
    """The deterministic population for growth runs: ((11 i + 3 q + c) mod 31 - 15) / 4 in coordinate q of row i of client c, groups in turn."""
    ids = spark.range(len(clients) * rows)
    c = F.element_at(F.array(*[F.lit(x).cast("long") for x in clients]), (F.col("id") / rows).cast("int") + 1)
    i = F.col("id") % rows
    return ids.select(c.alias("client"), i.alias("local_row"), (i % groups).cast("int").alias("group_id"), F.array(*[(((11 * i + 3 * q + c) % 31) - 15) / F.lit(4.0) for q in range(d)]).alias("features"))


def kappa_witness(spark: SparkSession, kappa: int, unit: int = 150, distance: float = 10.0) -> DataFrame:
    """Two clients, the groups in opposite proportion; only the minority of group 1 in client 0 lies away from zero."""
    sizes = [(0, 0, kappa * unit), (0, 1, unit), (1, 0, unit), (1, 1, kappa * unit)]
    blocks = spark.createDataFrame([(c, g, sum(n for d, h, n in sizes if d == c and h < g), n) for c, g, n in sizes], "client long, group_id int, first long, n long")
    x = F.when((F.col("client") == 0) & (F.col("group_id") == 1), distance).otherwise(0.0)
    return blocks.select("client", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("local_row"), "group_id", F.array(x).alias("features"))


def federation_grid(spark: SparkSession, clients: int = 6, d: int = 3) -> DataFrame:
    """Small test population: clients of 30 to 79 rows, purely of group 0, purely of group 1 and mixed in turn."""
    c = spark.range(clients).select(F.col("id").alias("client"), (30 + (F.col("id") * 37) % 50).alias("n"))
    r = c.select("client", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("local_row"))
    group = F.when(F.col("client") % 3 == 2, F.col("local_row") % 2).otherwise(F.col("client") % 3).cast("int")
    return r.select("client", F.col("local_row").cast("long").alias("local_row"), group.alias("group_id"), F.array(*[((F.col("local_row") * (7 + q) + F.col("client") * 13 + q) % 23 - 11) / F.lit(8.0) for q in range(d)]).alias("features"))


def client_names(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("client", C.client_number(F.col(name)))
