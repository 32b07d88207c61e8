"""Every query of the plans against its SQL, and operators on small tables."""

import duckdb
import pytest

from tracemill.operators import metrics as M
from tracemill.operators import quality as Q
from tracemill.operators import traces as T
from tracemill.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name not in ORACLE_SQL:
        pytest.skip("held against brute force in test_operators.py")
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = con.sql(ORACLE_SQL[name])
    assert sorted(r.columns) == sorted(df.columns)
    order = sorted(df.columns)
    want = sorted(tuple(plain(row[r.columns.index(c)]) for c in order) for row in r.fetchall())
    assert sorted(tuple(plain(row[c]) for c in order) for row in df.collect()) == want


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 12)] + [("b", 7)], "k string, v int")
    got = {r["k"]: r["p"] for r in M.nearest_rank(df, ["k"], "v", 0.95, "p").collect()}
    assert got == {"a": 11, "b": 7}  # 0.95 * 10 = 9.5, which rounds to 10


def test_kappa(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, label string")
    swapped = spark.createDataFrame([(1, "y"), (2, "x")], "id int, label string")
    one = spark.createDataFrame([(1, "x"), (2, "x")], "id int, label string")
    assert M.kappa(a, a, "id").first()["kappa"] == 1
    assert M.kappa(a, swapped, "id").first()["kappa"] < 0
    assert M.kappa(one, one, "id").first()["kappa"] == 1
    assert M.kappa(a.limit(0), a, "id").first()["kappa"] == 0


def test_latest_and_upsert(spark):
    ledger = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in T.latest(ledger, ["k"], ["n"]).collect()} == {("a", "new"), ("b", "only")}
    new = spark.createDataFrame([("a", 3, "newer")], "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in T.upsert(T.latest(ledger, ["k"], ["n"]), new, ["k"]).select("k", "v").collect()} == {("a", "newer"), ("b", "only")}


def test_positional_diff_of_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "y"), (5, None)], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, None), (6, None)], "k int, v string")
    assert {(r["k"], r["kind"]) for r in T.positional_diff(a, b, ["k"], "v").collect()} == {(1, "changed"), (2, "changed"), (4, "removed"), (5, "removed"), (6, "added")}


def test_verdict(spark):
    rows = spark.createDataFrame([("a", True), ("b", False)], "check string, passed boolean")
    assert tuple(Q.verdict(rows).first()) == ("FAIL", 1)


def test_sources_and_stream(spark, tmp_path):
    from tracemill.sources import tables
    from tracemill.streaming.ledger import current, keep_latest, read_ledger

    (tmp_path / "a.jsonl").write_text('{"k": "x", "n": 1}\n\n{"k": "x", "n": 2}\n')
    (tmp_path / "b.json").write_text('{"rows": [{"k": "y", "n": 3}]}')
    assert tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k string, n int").count() == 2
    assert tables.read_records(spark, str(tmp_path / "b.json"), "k string, n int").first()["n"] == 3
    folder = tmp_path / "in"
    tables.append_rows(spark.createDataFrame([("x", 1), ("y", 1)], "k string, n int"), str(folder))
    for i in (2, 3):
        tables.append_rows(spark.createDataFrame([("x", i)], "k string, n int"), str(folder))
        keep_latest(read_ledger(spark, str(folder), "k string, n int"), ["k"], ["n"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {(r["k"], r["n"]) for r in current(spark, str(tmp_path / "out")).collect()} == {("x", 3), ("y", 1)}
    tables.freeze(spark.range(2), str(tmp_path / "frozen"))
    with pytest.raises(Exception, match="already exists"):
        tables.freeze(spark.range(2), str(tmp_path / "frozen"))


def test_sources(spark, tmp_path):
    from tracemill.sources import tables

    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"k": "x"}\n\n[1]\n')
    with pytest.raises(Exception, match="line 3 is no JSON object"):
        tables.read_jsonl(spark, str(bad), "k string").collect()
    assert tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), "k string", missing_ok=True).count() == 0
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), "k string").collect()
    (tmp_path / "other.json").write_text('{"others": []}')
    with pytest.raises(Exception, match="neither a list"):
        tables.read_records(spark, str(tmp_path / "other.json"), "k string").collect()
    (tmp_path / "list.json").write_text('[{"k": "a"},\n {"k": "b"}]')
    assert tables.read_records(spark, str(tmp_path / "list.json"), "k string", limit=1).count() == 1
    folder = tmp_path / "sets"
    folder.mkdir()
    for n in "ab":
        (folder / f"{n}.jsonl").write_text(f'{{"review_id": "{n}1"}}\n{{"review_id": "x"}}\n')
    manifest = spark.createDataFrame([("A", "a.jsonl"), ("B", "b.jsonl"), ("C", "c.jsonl")], "toolset_id string, file string")
    assert {r["toolset_id"] for r in tables.manifest_rows(spark, manifest, str(folder), ["A", "C"]).collect()} == {"A"}
    assert {r["review_id"] for r in tables.packet_ids(spark, str(folder / "*.jsonl"), "review_id").collect()} == {"a1", "b1", "x"}


def test_sinks(spark, tmp_path):
    import json

    from tracemill.sources import tables

    df = spark.createDataFrame([(2, None, "b"), (1, "x", "a")], "n int, v string, a string")
    tables.write_jsonl(df, str(tmp_path / "rows"), ["n"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "rows")).collect()] == ['{"a":"a","n":1,"v":"x"}', '{"a":"b","n":2,"v":null}']
    tables.write_document(df, str(tmp_path / "doc"), "a", "n")
    assert sorted(json.loads(r["value"])["n"][0] for r in spark.read.text(str(tmp_path / "doc")).collect()) == [1, 2]
    tables.freeze(df, str(tmp_path / "frozen"), "n", 2)
    assert spark.read.json(str(tmp_path / "frozen.manifest")).first()["hash"] == tables.hashes(df.orderBy("n")).first()["hash"]
    with pytest.raises(ValueError, match="not unique"):
        tables.freeze(df.union(df), str(tmp_path / "f2"), "n")
    with pytest.raises(ValueError, match="expected 3 rows"):
        tables.freeze(df, str(tmp_path / "f3"), "n", 3)
    assert tables.public(df, ["v"]).columns == ["n", "a"]
    with pytest.raises(Exception, match="secret"):
        tables.refuse_secrets(df.fillna("token: abc", ["v"]), "v").collect()
    assert tables.refuse_secrets(df, "v").count() == 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
