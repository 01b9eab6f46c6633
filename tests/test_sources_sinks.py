import json

from pyspark.sql import functions as F

from tarnwood.plans.hub import Hub
from tarnwood.sinks import read_baseline, render_console, write_baseline, write_sarif
from tarnwood.sources import decode_payload, read_jsonl, source_files

SF = "/root/testdata/sf0.001"


def test_source_files(spark, tmp_path):
    for name, content in {"a.py": b"x = 1\n", "b.bin": b"\0" * 50, "c.png": b"x", "run": b"#!/usr/bin/env python3\n", "node_modules/m.js": b"y", "sub/d.go": b"package d"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r.lang for r in source_files(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "python", "run": "python", "d.go": "go"}


def test_outputs(spark, tmp_path):
    f = Hub(spark, SF).findings.limit(40).withColumn("stable_hash", F.col("pos").cast("string"))
    write_sarif(f, str(tmp_path / "x.sarif"))
    log = json.loads((tmp_path / "x.sarif").read_text())
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == 40 and log["runs"][0]["tool"]["driver"]["rules"]
    write_baseline(f, str(tmp_path / "base"))
    assert read_baseline(spark, str(tmp_path / "base")).where("rule_id IS NOT NULL").count() == 40
    assert len(render_console(f).splitlines()) >= 40


def test_broken_rows_are_left_out(spark, tmp_path):
    (tmp_path / "log").write_text('{"schema_version": 1, "kind": "a"}\n{broken\n{"schema_version": 2, "kind": "b"}\n')
    assert [r.kind for r in read_jsonl(spark, str(tmp_path / "log"), "schema_version int, kind string", 1).collect()] == ["a"]
    df = spark.createDataFrame([('{"a": 1}',), (None,)], "payload string")
    assert decode_payload(df, "payload", "a int").count() == 1
