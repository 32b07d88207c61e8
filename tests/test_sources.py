"""Files and their audits, the JSON-lines source, metrics by name, packets."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import named_metrics as M
from tracemill.operators import packets as P
from tracemill.sources import files
from tracemill.sources.jsonlines import JsonLines


def test_file_audit(spark, tmp_path):
    run = tmp_path / "run dir"
    (run / "deep").mkdir(parents=True)
    contents = {"a.json": b"{}", "deep/b.bin": bytes(range(256)) * 100, "deep/empty": b"", "changed": b"new", "extra": b"x"}
    for name, data in contents.items():
        (run / name).write_bytes(data)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    found = {r["path"]: (r["bytes"], r["sha256"]) for r in files.file_hashes(spark, str(run)).collect()}
    assert found == {n: (len(d), sha(d)) for n, d in contents.items() if d}
    manifest = [("a.json", sha(b"{}").upper()), ("deep/b.bin", sha(contents["deep/b.bin"])), ("deep/empty", sha(b"")), ("changed", sha(b"old")), ("gone", sha(b"g")), ("a.json", sha(b"{}"))]
    m = spark.createDataFrame(manifest, "path string, sha256 string")
    audit = lambda m: {tuple(r) for r in files.file_audit(files.file_hashes(spark, str(run)), m).collect()}
    assert audit(m) == {("changed", "changed"), ("gone", "missing"), ("extra", "surplus")}
    assert audit(m.unionByName(spark.createDataFrame([("a.json", sha(b"1"))], m.schema))) == {("changed", "changed"), ("gone", "missing"), ("extra", "surplus"), ("a.json", "ambiguous")}
    results = spark.createDataFrame([(1, ["bad", "worse"]), (2, [])], "id int, errors array<string>")
    assert {tuple(r) for r in files.run_audit(spark, str(run), m, results).collect()} == {("file changed", "changed"), ("file missing", "gone"), ("file surplus", "extra"), ("bad", "1"), ("worse", "1")}


def test_frozen_files(spark, tmp_path):
    run, target = tmp_path / "run", tmp_path / "frozen"
    run.mkdir()
    for name in ("a.jsonl", "b.jsonl", "config.json"):
        (run / name).write_text(name * 3)
    with pytest.raises(FileNotFoundError, match="lacks c.jsonl"):
        files.freeze_files(spark, str(run), ["a.jsonl", "c.jsonl"], str(target), {})
    assert not target.exists()
    manifest = files.freeze_files(spark, str(run), ["a.jsonl", "b.jsonl"], str(target), {"policy_mode": "broad"}, {"config": str(run / "config.json")})
    stated = json.loads((target / "freeze_manifest.json").read_text())
    sha = lambda name: hashlib.sha256((name * 3).encode()).hexdigest()
    assert stated["artifact_sha256"] == {n: sha(n) for n in ("a.jsonl", "b.jsonl")} and stated["reference_sha256"] == {"config": sha("config.json")} and stated["policy_mode"] == "broad"
    audit = lambda: {tuple(r) for r in files.file_audit(files.file_hashes(spark, str(target), "*.jsonl"), manifest).collect()}
    assert audit() == set()
    (target / "b.jsonl").write_text("changed")
    (target / ".b.jsonl.crc").unlink()  # a local copy has a checksum of its own, which no longer holds
    assert audit() == {("b.jsonl", "changed")}
    with pytest.raises(FileExistsError, match="frozen already"):
        files.freeze_files(spark, str(run), ["a.jsonl"], str(target), {})


@pytest.fixture(scope="module")
def lines(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonLines)
    yield lambda path, schema="id long, kind string, v double, tags array<string>", **options: spark.read.format("jsonlines").schema(schema).options(**options).load(str(path))
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_jsonlines(lines, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"id": i, "kind": "ab"[i % 2], "v": i / 2 if i % 3 else None, "tags": ["é", str(i)]} for i in range(50)]
    for k in range(2):
        (folder / f"{k}.jsonl").write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows[25 * k : 25 * k + 25]) + "\n" * k)
    (folder / "_SUCCESS").write_text("no json")
    got = sorted((r["id"], r["kind"], r["v"], tuple(r["tags"])) for r in lines(folder).collect())
    assert got == [(r["id"], r["kind"], r["v"], tuple(r["tags"])) for r in rows]
    some = lines(folder).filter("kind = 'a' and id in (2, 3, 4, 48) and v is not null")
    assert sorted(r["id"] for r in some.collect()) == [2, 4]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan or "kind" not in plan.split("Filter", 1)[1].split("\n")[0], plan  # the source checks the kind
    assert lines(folder).filter("v is null").count() == 17 and lines(folder).filter("v > 20").count() == sum((r["v"] or 0) > 20 for r in rows)
    assert [r["id"] for r in lines(folder, limit=3).collect()] == [0, 1, 2] and lines(folder, limit=30).count() == 30 and lines(folder, limit=0).count() == 0
    assert lines(folder, limit=3).filter("kind = 'a'").count() == 2  # of the first three records
    with pytest.raises(Exception, match="none.jsonl"):
        lines(tmp_path / "none.jsonl").count()


def test_jsonlines_reads_no_more_than_asked(lines, tmp_path):
    """The broken line at the end is not reached."""
    path = tmp_path / "big.jsonl"
    with open(path, "w") as f:
        f.writelines(f'{{"id": {i}, "kind": "a"}}\n' for i in range(1_000_000))
        f.write("broken\n")
    assert lines(path, "id long", limit=10).count() == 10
    with pytest.raises(Exception, match="is no JSON object"):
        lines(path, "id long").count()


def test_jsonlines_splits(lines, tmp_path, monkeypatch):
    from tracemill.sources import jsonlines as J

    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps({"id": i, "kind": "x" * (i % 40)}) + "\n" for i in range(500)))
    for size in (1, 7, 64, 1000, 100_000):
        monkeypatch.setattr(J, "SPLIT", size)
        reader = J.JsonLinesReader(type("S", (), {"names": ["id"]}), {"path": str(path)})
        assert [r[0] for p in reader.partitions() for r in reader.read(p)] == list(range(500))


def test_metrics_by_name(spark):
    rows = spark.createDataFrame([("a", i, s, 10.0 * i, 0.5) for i, s in enumerate(["success", "timeout", "error", "error", "success", "timeout"])] + [(None, 1, "success", 1.0, 1.0)], "policy string, ordinal int, status string, latency_ms double, cost_usd double")
    with pytest.raises(ValueError, match="unknown metrics latency; there are"):
        M.metrics(rows, ["policy"], ["runs", "latency"])
    with pytest.raises(ValueError, match="registered already"):
        M.metric("runs")(lambda: F.count("*"))
    try:
        M.metric("slowest_ms")(lambda: F.max("latency_ms"))
        M.grouped_metric("first_status", ["status", "ordinal"], "string")(lambda g: g.sort_values("ordinal")["status"].iloc[0])
        got = {r["policy"]: tuple(r)[1:] for r in M.metrics(rows, ["policy"], ["first_status", "runs", "slowest_ms", "longest_failure_streak", "total_cost_usd"]).collect()}
        assert got == {"a": ("success", 6, 50.0, 3, 3.0), None: ("success", 1, 1.0, 0, 1.0)}
        assert {tuple(r) for r in M.metrics(rows, ["policy"], ["longest_failure_streak"]).collect()} == {("a", 3), (None, 0)}
    finally:
        M.AGGREGATES.pop("slowest_ms"), M.GROUPED.pop("first_status")
    assert M.metrics(rows.limit(0), ["policy"], ["runs", "longest_failure_streak"]).count() == 0


def test_packets(spark):
    steps = spark.createDataFrame([("t", 0, "tool_call", "a", "{}", "success"), ("t", 1, "final_answer", None, None, "error"), ("t", 3, "tool_call", "c", "{}", "error"), ("t", 2, "tool_call", "b", "{}", None), ("u", 0, "tool_call", "a", "{}", "success")], "trace string, index int, action_type string, tool string, arguments string, status string")
    assert [tuple(r) for r in P.first_failed_steps(steps).collect()] == [("t", 3, "c", "{}", "error")]
    df = spark.createDataFrame([(True, ["Alpha"], "x ALPHA"), (True, ["b"], None), (True, None, None), (False, [], "b"), (None, [], "b")], "ok boolean, claims array<string>, said string")
    assert [r[0] for r in df.select(P.evaluated_success(F.col("ok"), F.col("claims"), F.col("said"))).collect()] == [True, False, True, False, False]
    names = ["abc1", "#abc", "a@bc", "abcd", "a1", None]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(P.is_entity_value(F.col("n"))).collect()] == [True, True, True, False, False, None]
    ready = spark.range(300).withColumn("key", F.concat(F.lit("k"), "id"))
    packet = P.review_packet(ready, ready.filter("id < 10"), "key", F.sha2("key", 256)).collect()
    assert sorted(r["place"] for r in packet) == list(range(1, 291))
    assert [r["key"] for r in sorted(packet, key=lambda r: r["place"])] == sorted((f"k{i}" for i in range(10, 300)), key=lambda k: hashlib.sha256(k.encode()).hexdigest())
    a, b, c = (P.set_hash(x, "id").first() for x in (spark.range(50), spark.range(50).union(spark.range(9)).repartition(3), spark.range(49)))
    assert a == b and a["hash"] != c["hash"] and P.set_hash(spark.range(0), "id").first()["keys"] == 0


def test_streaks_without_python_workers(spark):
    from tracemill.operators import named_metrics as M

    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate(["x", "success", "x", None, "x", "success"])] + [("b", 1, "success"), ("c", 2, "x"), ("c", 1, "x")], "k string, ordinal int, status string").repartition(3)
    got = M.metrics(rows, ["k"], ["longest_failure_streak", "runs"])
    assert {tuple(r) for r in got.collect()} == {("a", 3, 6), ("b", 0, 1), ("c", 2, 2)}
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
