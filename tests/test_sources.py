"""Files, configuration and streams."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from strayframe.sources import files, sinks
from strayframe.streaming import online


def test_state_runs(spark, tmp_path):
    for run, n in (("r1", 3), ("r2", 2)):
        (tmp_path / run).mkdir()
        lines = [{"t": k * 0.1, "ego": {"id": 0, "x": k * 1.0, "y": 0.0, "yaw": 0.0, "vx": 1.0, "vy": 0.0}, "others": [{"id": 7, "x": 10.0, "y": 0.0, "yaw": 0.0, "vx": 0.0, "vy": 0.0}, {"id": 8, "x": 500.0, "y": 0.0, "yaw": 0.0, "vx": 0.0, "vy": 0.0}]} for k in range(n)]
        (tmp_path / run / "states.jsonl").write_text("\n".join(map(json.dumps, lines)))
    runs = files.state_runs(spark, f"{tmp_path}/*/states.jsonl")
    assert sorted((r.run, r.tick, r.x) for r in files.egos(runs).collect()) == [("r1", 0, 0.0), ("r1", 1, 1.0), ("r1", 2, 2.0), ("r2", 0, 0.0), ("r2", 1, 1.0)]
    assert {r.agent for r in files.others(runs).collect()} == {7}
    same = spark.createDataFrame([("r1",)] * 3 + [("r2",)] * 2, "run string")
    assert {r.run: r.n for r in files.checked_counts(same, runs).collect()} == {"r1": 3, "r2": 2}
    with pytest.raises(Exception, match="differ in run"):
        files.checked_counts(same.limit(1), runs).collect()


@pytest.mark.parametrize("name", ["s01_checked_runs", "s02_recorded_agents", "s08_snapshots", "k1_score_csv", "k6_corpus"])
def test_as_many_files_as_partitions(spark, monkeypatch, name):
    """Runs are many (15 here, 90,000 in a large table), so a file a run is no form to write."""
    from strayframe.plans import catalog, labels, operations, recordings

    paths = []
    for module in (recordings, operations, labels):
        monkeypatch.setattr(module, "shared_path", lambda s, tag, real=module.shared_path: paths.append(real(s, tag)) or paths[-1])
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert paths and all(len([f for f in Path(p).rglob("part-*")]) <= 4 for p in paths)


def test_files_of_many_runs(spark, tmp_path):
    (tmp_path / "part.csv").write_text("run,tick,vision,semantic\na,4,0.5,\nb,5,NaN,0.25\n")
    scores = files.score_parts(spark, f"{tmp_path}/part.csv", ["vision", "semantic"])
    assert sorted((r.run, r.tick, r.series, r.score) for r in scores.where("score is not null").collect()) == [("a", 4, "vision", 0.5), ("b", 5, "semantic", 0.25)]
    lines = [{"run": run, "t": 0.1, "ego": {"id": 0, "x": 1.0}, "others": []} for run in ("r1", "r2")]
    (tmp_path / "part.json").write_text("\n".join(map(json.dumps, lines)))
    assert sorted((r.run, r.tick) for r in files.state_runs(spark, f"{tmp_path}/part.json").collect()) == [("r1", 1), ("r2", 1)]


def test_arrays_and_scores(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        np.savez(tmp_path / run / "vision.npz", embeddings=np.arange(6, dtype=np.float32).reshape(3, 2), ticks=np.array([4, 5, 6]))
        (tmp_path / run / "scores.csv").write_text("tick,vision,semantic\n4,0.5,\n5,NaN,0.25\n")
    got = sorted((r.run, r.tick, r.v) for r in files.npz(spark, f"{tmp_path}/*/vision.npz").collect())
    assert got == [(run, 4 + k, [2.0 * k, 2.0 * k + 1]) for run in "ab" for k in range(3)]
    scores = files.score_csv(spark, f"{tmp_path}/*/scores.csv", ["vision", "semantic"])
    assert sorted((r.run, r.tick, r.series, r.score) for r in scores.where("run = 'a' and score is not null").collect()) == [("a", 4, "vision", 0.5), ("a", 5, "semantic", 0.25)]


def test_configuration(spark, tmp_path):
    (tmp_path / "config").mkdir()
    lists = {"reference_runs": [{"run_name": "r1"}], "anomaly_runs": [{"run_name": "r2", "onset_tick": 5, "anomaly_type": "semantic"}], "negative_runs": [{"run_name": "r3"}], "calibration_runs": [{"run_name": "r4"}]}
    (tmp_path / "config/data.json").write_text(json.dumps(lists | {"k": 3}))
    (tmp_path / "config/own.json").write_text(json.dumps({"k": 5, "encoders": ["vision", "physics"], "physics_params": {"metrics": ["cosine", "mahalanobis"]}}))
    merged = files.config(str(tmp_path / "config/own.json"))
    (tmp_path / "config/whole.json").write_text(json.dumps({"reference_run": {"run_name": "old"}, "anomaly_runs": []}))
    whole = files.run_roles(spark, files.config(str(tmp_path / "config/whole.json")))
    assert [(r.run, r.role) for r in whole.collect()] == [("old", "reference")]
    assert merged["k"] == 5 and files.series_names(merged["encoders"]) == ["vision", "physics/cosine", "physics/mahalanobis"]
    roles = files.run_roles(spark, merged)
    assert {(r.run, r.role, r.onset) for r in roles.collect()} == {("r1", "reference", None), ("r2", "anomaly", 5), ("r3", "negative", None), ("r4", "calibration", None)}
    assert [r.run for r in files.evaluated(roles).collect()] == ["r2", "r3", "r4"]


def test_cache_keys(spark):
    rows = spark.createDataFrame([("a::b::2", [1.0, 2.0])], "key string, scores array<double>")
    assert [tuple(r) for r in files.calibration_cache(rows).collect()] == [("a::b", 2, 1.0), ("a::b", 2, 2.0)]
    with pytest.raises(Exception, match="not a calibration key"):
        files.calibration_cache(rows.withColumn("key", F.lit("old"))).collect()


def test_snapshots(spark, tmp_path):
    doc = {"name": "f", "plan": {"cache": "c", "group": "nominal", "idx": 4}, "history": [{"tick": 0, "ego": {"x": 1.0}, "others": [{"id": "3", "px": 60}]}], "agents": {"3": {"type": "walker", "obj": "person"}}, "concepts": ["a b"], "shift": False}
    (tmp_path / "0004.json").write_text(json.dumps(doc, indent=1))
    r = files.snapshots(spark, f"{tmp_path}/*.json").first()
    assert r.plan.idx == 4 and r.agents["3"].obj == "person" and r.history[0].others[0].px == 60


def test_report():
    out = sinks.report([{"a": 1.5, "b": True, "c": None}], ["a", "b", "c"])
    assert out.splitlines()[-1] == "| 1.5000 | yes | – |"


def test_streams_equal_loops(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(r), t, float(s)) for r in range(3) for t, s in enumerate(rng.random(30))]
    schema = "run long, tick int, score double"
    for k in range(3):  # three files, in order of ticks
        part = [r for r in rows if r[1] // 10 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = online.stream_of(spark, str(tmp_path / "in"), schema)
    got = {(r.run, r.tick) for r in online.drained(online.alarms(stream, 0.5, 2, 3), str(tmp_path / "alarms")).collect()}
    want = set()
    for run in range(3):
        above, quiet = 0, -1
        for r, t, s in rows:
            if r == run:
                above = above + 1 if s > 0.5 else 0
                if above >= 2 and t > quiet:
                    want.add((run, t))
                    above, quiet = 0, t + 3
    assert got == want
    means = {(r.run, r.tick): r.mean for r in online.drained(online.rolling(stream, 4), str(tmp_path / "rolling")).collect()}
    assert means == {(run, t): pytest.approx(np.mean([s for r, k, s in rows if r == run and t - 4 < k <= t])) for run in range(3) for t in range(3, 30)}


def test_frames_meet_states(spark, tmp_path):
    spark.sql("select id as run, 1 as tick, timestamp'2024-01-01 00:00:00' as ts from range(3)").write.parquet(str(tmp_path / "f"))
    spark.sql("select id as run, 1 as tick, timestamp'2024-01-01 00:00:01' as ts, 5.0D as speed from range(2)").write.parquet(str(tmp_path / "s"))
    f = online.stream_of(spark, str(tmp_path / "f"), "run long, tick int, ts timestamp")
    s = online.stream_of(spark, str(tmp_path / "s"), "run long, tick int, ts timestamp, speed double")
    assert sorted((r.run, r.speed) for r in online.drained(online.matched(f, s), str(tmp_path / "m")).collect()) == [(0, 5.0), (1, 5.0)]
