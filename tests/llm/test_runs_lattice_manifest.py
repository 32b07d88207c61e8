"""Periodic runs, lattice hashing and Merkle manifests against brute force."""

import hashlib
import random
import re
import tempfile
import zlib

import numpy as np
import pytest

from tracemill.llm import lattice, merkle, periodic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, tree string, hash int, path string, slot int, row int, node string"


def stored(spark, rows, schema):
    path = tempfile.mkdtemp() + "/t"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---------------------------------------------------------------- runs


def plain_runs(w, least, exponent):
    out, n = set(), len(w)
    for q in range(1, n):
        i = 0
        while i < n - q:
            a = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            size = i - a + q
            if i > a and size >= max(least, exponent * q, 2 * q) and not any(w[a : a + size - r] == w[a + r : a + size] for r in range(1, q)):
                out.add((a, size, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_words():
    rng, found = random.Random(3), 0
    for _ in range(1500):
        n = rng.randint(0, 60)
        w = [bytes([97 + rng.randrange(rng.choice([1, 2, 3, 4]))]) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            w = w[:a] + (w[a : a + 1 + (n - a) // rng.randint(3, 10)] * 20)[: n - a]
        for least, exponent in ((6, 4), (2, 2), (3, 3), (10, 5)):
            got = periodic.runs_of_words(w, least, exponent)
            assert got == plain_runs(w, least, exponent), (w, least, exponent)
            found += len(got)
    assert found > 3000


def test_hashes_and_words_agree(monkeypatch):
    """Hashes that collide at every turn are found out, and words are compared in their place."""
    monkeypatch.setattr(periodic, "PRIME", 3)
    monkeypatch.setattr(periodic, "_powers", [1])
    rng = random.Random(4)
    for _ in range(200):
        w = [bytes([97 + rng.randrange(2)]) for _ in range(80)]
        w = w[:20] + (w[20:33] * 9)[:70]
        assert periodic.runs_of_words(w, 2, 2) == plain_runs(w, 2, 2)


def test_long_periodic_texts():
    for period in (1, 2, 1000):
        w = [str(i % period).encode() for i in range(200_000)]
        assert periodic.runs_of_words(w) == [(0, 200_000, period)]


DOCS = [None, "", " \t\r\n", "one", "a a a a a", "a a a a a a", "x " + "a b " * 4 + "y", "a b c " * 9 + "d " + "e f " * 7, "é " * 8 + "ß", "a  b\n" * 3 + "z"]
DOCS += [" ".join(random.Random(k).choices(["u", "v", "w"], k=40 * k)) for k in range(12)]


def test_op11_query(spark, tmp_path):
    rows = [(i, t, "en", "s", 1, "k", "t", 2, "p", 3, 4, "n") for i, t in enumerate(DOCS * 9)] + [(None, "b b b b b b b", "en", "s", 1, "k", "t", 2, "p", 3, 4, "n"), (7, "c " * 6, *[None] * 10)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want, planted = [], 0
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, crc = len(w), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and crc % 10 == 0 and n:
            a = crc // 10 % n
            p = 1 + (n - a) // (3 + crc // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = plain_runs(w, 6, 4)
        drop = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *four, h("".join(f"{s},{size},{q}\n" for s, size, q in runs)), h(" ".join(x for i, x in enumerate(w) if i not in drop))))
    assert got == sorted(want, key=str)
    assert planted > 5
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


# ---------------------------------------------------------------- lattice


def test_nearest_lattice_points():
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    home = lattice.nearest(x)
    assert ((home * 2) % 1 == 0).all() and (home.sum(1) % 2 == 0).all() and len(set(map(tuple, lattice.roots()))) == 240
    d = ((x - home) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()  # the covering radius is 1
    for v in lattice.roots():
        assert (d <= ((x - home - v) ** 2).sum(1) + 1e-9).all()


def plain_groups(vectors, cosine=0.9):
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dims = max((len(vectors[i]) for i in good), default=1)
    m = np.array([np.pad(vectors[i], (0, dims - len(vectors[i]))) for i in good], float).reshape(len(good), dims)
    m = m / np.abs(m).max(1, initial=1e-300)[:, None]
    c = (m @ m.T) / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1)) if len(good) else np.zeros((0, 0))
    hit = c >= cosine
    links, comp = [0] * len(vectors), list(range(len(vectors)))
    for a, i in enumerate(good):
        links[i] = int(hit[a].sum()) - 1
    changed = True
    while changed:
        changed = False
        for a, i in enumerate(good):
            low = min(comp[good[b]] for b in np.flatnonzero(hit[a]))
            changed |= low < comp[i]
            comp[i] = min(comp[i], low)
    return links, comp


def clusters(rng, dims=64):
    out = [list(map(float, v)) for v in rng.normal(size=(150, dims))]
    for size, noise in ((40, 0.05), (30, 0.2), (20, 0.3), (12, 0.4)):
        c = rng.normal(size=dims)
        out += [list(map(float, c + noise * rng.normal(size=dims))) for _ in range(size)]
    out += [out[0]] * 5 + [[2 * x for x in out[1]]] + [None, [], [0.0] * dims, [1.0, None], [float("nan")] * dims, [float("inf")] * dims, [1.0, 2.0], [1.0, 2.0, 0.1], [1e200, 2e200], [1e-200, 2e-200]]
    return out


@pytest.mark.parametrize("rows,crowd", [(2048, 256), (8, 256), (8, 10)])
def test_near_groups(spark, rows, crowd):
    vectors = clusters(np.random.default_rng(2))
    df = stored(spark, [(i, v, i, "n", "x", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, row int, name string, slot string, label int")
    links, comp = plain_groups(vectors)
    got = {r["vec_id"]: r for r in lattice.near_groups(df, rows=rows, crowd=crowd, tables=12).collect()}
    assert len(got) == len(vectors) and all(got[i]["n_links"] <= links[i] for i in got)
    recall = sum(r["n_links"] for r in got.values()) / sum(links)
    assert recall >= 0.98, recall
    same = sum(got[i]["component_id"] == comp[i] for i in got) / len(got)
    assert same >= 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_near_groups_repeats_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [0.0, 1.0]), (5, None)]
    got = sorted(map(tuple, lattice.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (5, 0, 5, True), (5, 0, 5, True)], key=str)
    assert lattice.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---------------------------------------------------------------- manifest


def plain_manifest(rows, fanout):
    """For each row, in their order: leaf, subroot, root, siblings, root that the row to be checked gives."""

    def tree(hashes):
        """Root, and for each leaf the siblings on its way as (left, right)."""
        at, ways = list(range(len(hashes))), [[] for _ in hashes]
        while len(hashes) > 1:
            for leaf, i in enumerate(at):
                lo = i // fanout * fanout
                ways[leaf].append(("".join(hashes[lo:i]), "".join(hashes[i + 1 : lo + fanout])))
            hashes = [h(*hashes[i : i + fanout]) for i in range(0, len(hashes), fanout)]
            at = [i // fanout for i in at]
        return hashes[0], ways

    def leaf(doc_id, text, lang, source, n_chars):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))

    by = {}
    for k, (doc_id, text, lang, source, n_chars, *_) in enumerate(rows):
        by.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, text, lang, source, n_chars), k))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by[x])]) for x in langs}
    root, tops = tree([trees[x][0] for x in langs])
    out = [None] * len(rows)
    for n, x in enumerate(langs):
        for (_, _, own, k), way in zip(sorted(by[x]), trees[x][1], strict=True):
            doc_id, text, lang, source, n_chars, *_ = rows[k]
            at = leaf(doc_id, text, lang, source, n_chars + 1) if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else own
            for a, b in way + tops[n]:
                at = h(a, at, b)
            out[k] = (rows[k][0], own, trees[x][0], root, h(*(s for ab in way + tops[n] for s in ab)), at, at == root)
    return out


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_proofs(spark, fanout):
    rng = random.Random(fanout)
    langs = [None, "en", "ä", "z", "", "solo"]
    rows = [(i, "é" * (i % 9) if i % 11 else None, rng.choice(langs[:5]), None if i % 5 == 0 else f"s{i % 3}", None if i % 13 == 0 else i * 7) for i in range(-20, 90)]
    rows += [(200, "", "solo", "s", 0), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (3, "again", "en", "s", 2**63 - 1), (3, "again", "en", "s", 2**63 - 1)]
    rows = [(*r, "k", "t", 2, "p", 3, 4, "n") for r in rows]
    got = sorted(map(tuple, merkle.proofs(stored(spark, rows, SCHEMA), fanout).collect()), key=str)
    want = sorted(plain_manifest(rows, fanout), key=str)
    assert got == want
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_proofs_of_little(spark):
    assert merkle.proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(1, "t", "en", "s", 1, "k", "t", 2, "p", 3, 4, "n")]
    assert [tuple(r) for r in merkle.proofs(stored(spark, one, SCHEMA)).collect()] == plain_manifest(one, 2)
