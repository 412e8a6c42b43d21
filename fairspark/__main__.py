"""python -m fairspark COMMAND ...

list                                names of all queries
run NAME --data DIR [--out DIR]     one query; prints rows or writes Parquet
train --points PATH --out DIR       trains on a Parquet table of points and saves the model
unlearn --model DIR --request FILE --mode MODE --out FILE     replays without the rows of a request document
delete --model DIR --clients 1,2 [--clients 3] --out DIR      withdraws clients step by step from a model without rounds
score --model DIR --points PATH     exact quality of the last centers
ratios --rows PATH                  pairs (case_id, dataset, method, seconds) with the method "fresh" and rolls them up
growth --rows N                     trains on the deterministic grid for 2, 3, 5 and 9 groups
verify --files DIR --manifest PATH  hashes of all files against a manifest (file, sha256)
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fairspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    run.add_argument("--limit", type=int, default=20)
    train = sub.add_parser("train")
    for name, kind, default in (("--seed", int, 0), ("--k", int, 10), ("--rounds", int, 0), ("--groups", int, 2), ("--bisections", int, 6), ("--gamma", float, 0.0), ("--bits", int, 12), ("--clip", float, 8.0)):
        train.add_argument(name, type=kind, default=default)
    for command in (train, sub.add_parser("unlearn"), sub.add_parser("delete"), sub.add_parser("score")):
        command.add_argument("--model" if command is not train else "--points", required=True)
    sub.choices["train"].add_argument("--out", required=True)
    sub.choices["train"].add_argument("--cache", action="store_true")
    for flag in ("--request", "--out"):
        sub.choices["unlearn"].add_argument(flag, required=True)
    sub.choices["unlearn"].add_argument("--mode", choices=("none", "basic", "runnerup"), default="runnerup")
    sub.choices["unlearn"].add_argument("--threshold", type=float, default=0.5)
    sub.choices["delete"].add_argument("--clients", action="append", required=True)
    sub.choices["delete"].add_argument("--out", required=True)
    sub.choices["score"].add_argument("--points", required=True)
    sub.add_parser("ratios").add_argument("--rows", required=True)
    sub.add_parser("growth").add_argument("--rows", type=int, default=180)
    verify = sub.add_parser("verify")
    verify.add_argument("--files", required=True)
    verify.add_argument("--manifest", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from fairspark.functions import exact as E
    from fairspark.model import Grid, Settings
    from fairspark.operators import points as P
    from fairspark.operators import reports
    from fairspark.plans import training as T
    from fairspark.plans.queries import QUERIES
    from fairspark.sources import states, tables

    if a.command == "list":
        print("\n".join(QUERIES))
        return 0
    spark = SparkSession.builder.appName("fairspark").getOrCreate()
    if a.command == "run":
        df = QUERIES[a.name](spark, a.data)
        df.write.parquet(a.out) if a.out else df.show(a.limit, truncate=False)
    elif a.command == "train":
        settings = Settings(a.k, a.rounds, a.groups, a.bisections, a.gamma, Grid(a.bits, a.clip))
        states.save_model(T.train(spark.read.parquet(a.points), a.seed, settings, a.cache), a.out)
    elif a.command == "unlearn":
        model = T.unlearn(states.load_model(spark, a.model), tables.read_request(spark, a.request), a.mode, a.threshold)
        tables.write_json({"witness": [E.witness(c) for c in model.trajectory], "digests": model.digests, "sizes": list(model.sizes), "work": model.work, "fallback_round": model.fallback_round}, a.out)
    elif a.command == "delete":
        state = T.compact(states.load_model(spark, a.model))
        for model in T.withdrawals(state, [[int(c) for c in step.split(",")] for step in a.clients], a.out):
            print(E.canonical_json({"sizes": list(model.sizes), "witness": E.witness(model.centers)}))
    elif a.command == "score":
        model = states.load_model(spark, a.model)
        got = T.quality(P.encoded(spark.read.parquet(a.points), model.settings.grid), model.centers, model.settings.grid, model.settings.groups)
        print(E.canonical_json({k: v for k, v in got.items() if k != "stats"}))
    elif a.command == "ratios":
        pairs = reports.paired(spark.read.parquet(a.rows), ["case_id", "dataset"], "method", "seconds", "fresh")
        print(reports.markdown(reports.rolled_up(pairs, "dataset").orderBy("method", "dataset")))
    elif a.command == "growth":
        for groups in (2, 3, 5, 9):
            began = time.perf_counter()
            model = T.train(tables.growth_grid(spark, rows=a.rows, groups=groups), 0, Settings(10, 0, groups=groups))
            print(json.dumps({"groups": groups, "seconds": round(time.perf_counter() - began, 3), "slices": model.slices.select("client", "group_id").distinct().count(), "anchors": len(model.anchors.rows)}))
    else:
        bad = tables.verified(tables.inventory(spark, a.files), spark.read.json(a.manifest)).collect()
        print("\n".join(f"{r['file']}: {r['problem']}" for r in bad) or "all files agree")
        return int(bool(bad))
    return 0


if __name__ == "__main__":
    sys.exit(main())
