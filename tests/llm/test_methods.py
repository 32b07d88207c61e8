"""The parts that the operators' methods rest on: each against a plain version of itself."""

import itertools
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import dedup, packing, toxicity


def stored(spark, rows, schema, parts=4):
    path = tempfile.mkdtemp() + "/t"
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- extendible hashing

ENTRY = "row long, doc_id long, n_chars long, key long, digest binary, n_bytes int"


@pytest.mark.parametrize("bucket_keys", [1, 5, 40])
def test_directory_and_owners(spark, bucket_keys):
    """Buckets hold no more keys than they may, a key lies in one bucket, in one task; links of tasks come together there,
    and texts that collide stay apart."""
    rng = random.Random(1)
    hashes = [rng.randrange(-(2**63), 2**63) for _ in range(60)] + list(range(40))  # some that differ in their last bits only
    rows = [(i, i, rng.randrange(9), hashes[i % 100], bytes([i % 100, 0]), 1) for i in range(600)]
    rows += [(1000 + i, 1000 + i, 5, hashes[7], b"other", 2) for i in range(3)]  # another text of a key
    entries = stored(spark, rows, ENTRY, 6)
    linked = dedup.links(entries)
    assert linked.agg(F.sum("n")).first()[0] == len(rows) and linked.count() > len(set(hashes)) + 1
    depth, slots = dedup.directory(linked.select("key").distinct(), bucket_keys)
    at = dedup.placed(linked, depth, slots)
    tasks = at.withColumn("task", F.spark_partition_id()).groupBy("bucket").agg(F.count_distinct("task").alias("tasks"), F.count_distinct("key").alias("keys")).collect()
    assert all(r["tasks"] == 1 for r in tasks) and sum(r["keys"] for r in tasks) == len(set(hashes))
    if bucket_keys > 1:
        spread = [r["keys"] for r in tasks if r["keys"] <= bucket_keys]
        assert len(spread) >= len(tasks) - 1  # one bucket keeps hashes that no bit of the directory tells apart
    assert len(tasks) > 1
    chains = {r["key"]: r["chain"] for r in dedup.chained(at).collect()}
    assert len(chains) == len(set(hashes))
    assert [(bytes(x["digest"]), x["n"]) for x in chains[hashes[7]]] == [(bytes([7, 0]), 6), (b"other", 3)]
    assert max(x["links"] for c in chains.values() for x in c) > 1
    best = max((n, -d) for _, d, n, k, g, _ in rows if k == hashes[7] and g != b"other")
    assert (chains[hashes[7]][0]["best"]["n_chars"], chains[hashes[7]][0]["best"]["id"]) == best


def test_no_shuffle_at_the_owner(spark):
    linked = dedup.links(stored(spark, [(1, 1, 1, 5, b"x", 1)], ENTRY, 1))
    depth, slots = dedup.directory(linked.select("key").distinct(), 4)
    plan = dedup.chained(dedup.placed(linked, depth, slots))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and plan.count("hashpartitioning(") == 2  # the links' own, and one by bucket


def test_dedup_of_empty_tables_and_copies(spark):
    schema = "doc_id long, text string, key int, row string, bucket int"
    assert dedup.exact_groups(spark.createDataFrame([], schema)).count() == 0 and dedup.drop_copies(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, f"text {i % 7}" if i % 5 else None, 1, "r", 2) for i in range(400)] + [(None, "alone", 1, "r", 2), (3, "text 3", 1, "r", 2)]
    docs = stored(spark, rows, schema, 8)
    got = dedup.exact_groups(docs, bucket_keys=1).collect()
    of = {}
    for i, t, *_ in rows:
        of.setdefault((t or "").replace(" ", ""), []).append((-len(t or ""), i if i is not None else 10**9, i))
    want = sorted(((i, min(of[(t or "").replace(" ", "")])[2], len(of[(t or "").replace(" ", "")])) for i, t, *_ in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want
    assert dedup.drop_copies(docs, bucket_keys=1).count() == len(of)


# ---------------------------------------------------------------- packing


def test_window_cuts_are_least(monkeypatch):
    """The monotone queue finds a minimum of padding plus penalties: compared with all choices of cuts."""
    rng = random.Random(6)
    for _ in range(300):
        n, length = rng.randrange(2, 11), rng.randrange(4, 12)
        gaps = [rng.randrange(1, length + 1) for _ in range(n)]
        places = np.cumsum([0, *gaps])
        penalty = np.array([0.0, *[float(rng.randrange(0, 9)) for _ in range(n - 1)], 0.0])
        cost = lambda cuts: sum(length - (b - a) + penalty[np.searchsorted(places, b)] for a, b in zip((0, *cuts), cuts, strict=False))  # noqa: B023, E731
        ways = [(*some, int(places[-1])) for k in range(n) for some in itertools.combinations(places[1:-1].tolist(), k)]
        best = min(cost(w) for w in ways if all(b - a <= length for a, b in zip((0, *w), w, strict=False)))
        got = packing.window_cuts(places, penalty, length)
        assert got[-1] == places[-1] and all(b - a <= length for a, b in zip((0, *got), got, strict=False))
        assert abs(cost(tuple(got)) - best) < 1e-9


def test_packing_pads_little(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta."], int(n))) for n in rng.integers(1, 900, 400)]
    rows = packing.pack(stored(spark, [(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, sequence_id int", 1)).collect()
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    padded = sum(4096 - n for n in used.values())
    assert padded / (4096 * len(used)) < 0.1


# ---------------------------------------------------------------- misspelled terms


def edits(a, b):
    """Edits between two words, where swapped neighbours are one."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_lexicon_matches_as_edit_distance():
    rng = random.Random(7)
    word = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randrange(lo, hi)))
    near = far = 0
    for _ in range(60):
        entries = sorted({(word(2, 8), rng.random() < 0.3) for _ in range(6)})
        lexicon = toxicity.Lexicon(entries, fuzzy=4)
        for w in [word(0, 10) for _ in range(60)] + [e[0] for e in entries]:
            best = 99
            for text, stem in entries:
                allowed = 1 if len(text) >= 4 else 0
                e = min(edits(w[:k], text) for k in range(len(w) + 1)) if stem else edits(w, text)
                best = min(best, e if e <= allowed else 99)
            assert lexicon.match(w) == best, (entries, w)
            near, far = near + (best < 99), far + (best == 99)
    assert near > 300 and far > 300


# ---------------------------------------------------------------- the pipeline


def test_pipeline_as_a_whole(spark, tmp_path):
    """Toxic texts and all copies but one go, repeated passages go, the rest is packed whole."""
    import corpus_pipeline

    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    clean = [prose(80) for _ in range(60)]
    shared = prose(70)
    toxic = [f"{prose(20)} you are a blorft fool and a zwinkle {prose(20)}" for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(toxic)]
    rows += [(200, clean[0]), (201, clean[0].replace(" ", "  ")), (202, clean[1] + " end"), (203, f"{prose(30)} {shared}"), (204, f"{shared} {prose(30)}"), (205, None), (206, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in rows if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    kept = set(pieces)
    assert kept & set(range(100, 200)) == set(), "toxic texts stay"
    assert len(kept & {0, 200, 201}) == 1 and len(kept & {1, 202}) == 1 and {203, 204} <= kept
    assert len(kept & {205, 206}) == 1  # null and empty texts are one group
    assert set(range(2, 60)) <= kept
    for own in pieces.values():
        at = 0
        for start, n, _ in sorted(own):
            assert start == at
            at += n
        assert at == own[0][2]
    whole = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert all(pieces[i][0][2] == whole[i] for i in range(2, 60))
    assert pieces[203][0][2] < whole[203] and pieces[204][0][2] < whole[204]  # the passage goes from both


def test_stages_of_empty_tables(spark):
    import corpus_pipeline

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = tempfile.mkdtemp()
    labels.write.parquet(f"{path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0
