"""Model states as folders of Parquet tables and one JSON document."""

from __future__ import annotations

import json
from dataclasses import asdict
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from ..functions import exact as E
from ..model import MAP_VERSION, Anchors, Grid, Model, Settings, Stats
from ..plans.training import Compact


def _document(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(E.canonical_json(value),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def _read(spark: SparkSession, path: str) -> dict:
    value = json.loads(spark.read.option("wholetext", True).text(path).first()["value"])
    if value["map"] != MAP_VERSION:
        raise ValueError("the state belongs to another numerical map")
    return value


def _settings(value: dict) -> Settings:
    return Settings(**{**value, "grid": Grid(**value["grid"])})


def save_compact(state: Compact, path: str) -> None:
    state.slices.write.mode("errorifexists").parquet(f"{path}/slices")
    _document(state.slices.sparkSession, {"map": MAP_VERSION, "settings": asdict(state.settings), "seed": state.seed, "counts": [[c, *v] for c, v in state.counts.items()]}, f"{path}/state")


def load_compact(spark: SparkSession, path: str) -> Compact:
    value = _read(spark, f"{path}/state")
    return Compact(_settings(value["settings"]), value["seed"], {c: tuple(v) for c, *v in value["counts"]}, spark.read.parquet(f"{path}/slices"))


def save_model(model: Model, path: str) -> None:
    """Everything a replay needs: points, caches by round, slices, trajectory and exact statistics (doubles as hexadecimal, integers in full)."""
    spark = model.slices.sparkSession
    model.slices.write.mode("errorifexists").parquet(f"{path}/slices")
    model.points.write.mode("errorifexists").parquet(f"{path}/points")
    for t, cache in enumerate(model.cache or []):
        cache.write.mode("errorifexists").parquet(f"{path}/cache/round={t}")
    _document(spark, {
        "map": MAP_VERSION, "settings": asdict(model.settings), "seed": model.seed, "sizes": list(model.sizes), "cached": model.cache is not None, "replayable": model.replayable, "digests": model.digests,
        "owner": [list(o) for o in model.anchors.owner], "anchors": [[v.hex() for v in r] for r in model.anchors.rows], "weights": model.anchors.weights,
        "trajectory": [[[v.hex() for v in c] for c in cs] for cs in model.trajectory], "stats": [[s.n, s.s, s.ss] for s in model.stats],
    }, f"{path}/state")


def load_model(spark: SparkSession, path: str) -> Model:
    v = _read(spark, f"{path}/state")
    row = lambda c: tuple(map(float.fromhex, c))
    anchors = Anchors([tuple(o) for o in v["owner"]], [row(r) for r in v["anchors"]], [Fraction(w) for w in v["weights"]])
    settings = _settings(v["settings"])
    cache = [spark.read.parquet(f"{path}/cache/round={t}") for t in range(settings.rounds)] if v["cached"] else None
    return Model(settings, v["seed"], tuple(v["sizes"]), spark.read.parquet(f"{path}/slices"), anchors, [[row(c) for c in cs] for cs in v["trajectory"]], [Stats(*s) for s in v["stats"]], v["digests"], [], spark.read.parquet(f"{path}/points"), cache, replayable=v["replayable"])


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table holds more often than the other; empty for equal states."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))
