"""Streams with states: late, repeated and empty batches, what is stored, calls that expire."""

import json
import os
import random
import shutil

import pytest

from tracemill.streaming import states as S


@pytest.fixture()
def rocks(spark):
    for k, v in S.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in S.STORE:
        spark.conf.unset(k)


def put(folder, number, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{number:04d}.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.utime(f"{folder}/{number:04d}.json", (1_700_000_000 + number, 1_700_000_000 + number))  # files are read in this order


def run(spark, tmp_path, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    S.keep_newest(stream, ["k"], ["n"], str(tmp_path / "out"), str(tmp_path / "check"), merged=3).awaitTermination()
    return {r["k"]: (r["n"], r["v"]) for r in S.held(spark, str(tmp_path / "out"), stream.schema, ["k"], ["n"]).collect()}


def test_newest_rows(rocks, tmp_path):
    schema, rng, want = "k string, n int, v string", random.Random(3), {}
    assert S.held(rocks, str(tmp_path / "out"), rocks.createDataFrame([], schema).schema, ["k"], ["n"]).count() == 0
    put(tmp_path / "in", 0, [])  # a first batch without rows
    sent = []
    for number in range(1, 9):
        rows = [{"k": f"k{rng.randrange(12)}", "n": rng.randrange(100), "v": f"v{number}-{i}"} for i in range(15)]
        rows += rng.sample(sent, min(len(sent), 5))  # rows that come again, late
        sent += rows
        put(tmp_path / "in", number, rows)
        for r in rows:
            if r["k"] not in want or r["n"] > want[r["k"]][0]:
                want[r["k"]] = (r["n"], r["v"])
        if number in (2, 5, 8):  # the query stops and goes on
            got = run(rocks, tmp_path, schema)
            assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    # what is stored is bounded: one base, and the changes since
    bases = os.listdir(tmp_path / "out" / "base")
    changes = [int(x) for x in os.listdir(tmp_path / "out" / "changes")]
    assert len(bases) == 1 and len(changes) < 3 and all(n > int(bases[0]) for n in changes)


def test_a_batch_that_is_repeated(rocks, tmp_path):
    """A batch whose end was not recorded runs again: the table stays the same."""
    schema = "k string, n int, v string"
    for number in range(4):
        put(tmp_path / "in", number, [{"k": "a", "n": number, "v": "x"}, {"k": f"b{number}", "n": 1, "v": "y"}])
    first = run(rocks, tmp_path, schema)
    commits = sorted((int(x) for x in os.listdir(tmp_path / "check" / "commits") if x.isdigit()))
    for n in commits[-1:]:
        os.remove(tmp_path / "check" / "commits" / str(n))
        crc = tmp_path / "check" / "commits" / f".{n}.crc"
        if crc.exists():
            os.remove(crc)
    assert run(rocks, tmp_path, schema) == first == {"a": (3, "x"), **{f"b{i}": (1, "y") for i in range(4)}}


def test_calls(rocks, tmp_path):
    t = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    row = lambda c, kind, s: {"call_id": c, "kind": kind, "at": t(s)}
    put(tmp_path / "in", 0, [row("a", "call", 0), row("b", "call", 1), row("c", "result", 2), row(None, "call", 2)])
    put(tmp_path / "in", 1, [row("a", "result", 5), row("a", "result", 6), row("d", "call", 7), row("d", "result", 8), row("c", "call", 1)])
    put(tmp_path / "in", 2, [row("e", "result", 20), row("f", "call", 300)])
    put(tmp_path / "in", 3, [row("g", "call", 900)])
    stream = rocks.readStream.schema("call_id string, kind string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = S.call_outcomes(stream, 60_000).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["call_id"], r["outcome"]) for r in rocks.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "closed"), ("b", "expired"), ("c", "closed"), ("d", "closed"), ("e", "orphan"), ("f", "expired")]
    shutil.rmtree(tmp_path / "out")


def test_ledger_by_buckets(spark, tmp_path):
    """A first batch without rows, and no more than two generations of a bucket."""
    from tracemill.streaming.ledger import current, keep_latest

    schema, rng, want = "k string, n int", random.Random(5), {}
    put(tmp_path / "in", 0, [])
    for number in range(1, 6):
        rows = [{"k": f"k{rng.randrange(40)}", "n": 100 * number + i} for i in range(20)]
        put(tmp_path / "in", number, rows)
        want.update({r["k"]: r["n"] for r in rows})
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    keep_latest(stream, ["k"], ["n"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r["k"]: r["n"] for r in current(spark, str(tmp_path / "out")).collect()} == want
    assert max(len([g for g in os.listdir(b) if g.startswith("generation")]) for b in (tmp_path / "out").glob("bucket=*")) <= 2
