import json

from fairspark.__main__ import main


def test_commands(spark, tmp_path, capsys):
    rows = [(c, i, i % 2, [float((i * 5 + c) % 7), 1.0]) for c in range(4) for i in range(6)]
    spark.createDataFrame(rows, "client long, local_row long, group_id int, features array<double>").write.parquet(f"{tmp_path}/points")
    assert main(["list"]) == 0 and "r1_r8_r19_train" in capsys.readouterr().out
    assert main(["train", "--points", f"{tmp_path}/points", "--k", "2", "--rounds", "2", "--cache", "--out", f"{tmp_path}/m"]) == 0
    (tmp_path / "r.json").write_text(json.dumps({"removed": {"0": [1], "2": [0, 3]}}))
    for mode in ("none", "runnerup"):
        assert main(["unlearn", "--model", f"{tmp_path}/m", "--request", f"{tmp_path}/r.json", "--mode", mode, "--out", f"{tmp_path}/{mode}.json"]) == 0
    a, b = (json.loads((tmp_path / f"{m}.json").read_text()) for m in ("none", "runnerup"))
    assert a["witness"] == b["witness"] and a["digests"] == b["digests"] and a["sizes"] == [11, 10]
    assert main(["score", "--model", f"{tmp_path}/m", "--points", f"{tmp_path}/points"]) == 0
    assert main(["train", "--points", f"{tmp_path}/points", "--k", "2", "--out", f"{tmp_path}/m0"]) == 0
    capsys.readouterr()
    assert main(["delete", "--model", f"{tmp_path}/m0", "--clients", "1", "--clients", "0,2", "--out", f"{tmp_path}/steps"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["sizes"] for x in lines] == [[9, 9], [3, 3]]
    assert main(["growth", "--rows", "30"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["slices"] for x in lines] == [12, 18, 30, 54]
    spark.createDataFrame([(1, "d", "fresh", 4.0), (1, "d", "a", 2.0)], "case_id long, dataset string, method string, seconds double").write.parquet(f"{tmp_path}/t")
    assert main(["ratios", "--rows", f"{tmp_path}/t"]) == 0 and "| a | all | 4 | 2 | 2 |" in capsys.readouterr().out
