"""The operators against brute force on a small fixture with nulls, empty and long texts, ties, repeats, other columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracemill.llm import bpe, dedup, jaccard, language, licences, lm, packing, repeats, topk, toxicity

RNG = np.random.default_rng(5)
VOCABULARY = ["alpha", "beta", "Gamma", "delta", "été", "naïve", "x1", "tail.", "Zürich", "omega,"]
LONG = " ".join(RNG.choice(VOCABULARY, 90))
TEXTS = [
    None, "", " \n\t", "one", "two words here", LONG, LONG, f"{LONG} and an end that differs", f"start {LONG}", LONG.replace("alpha", "Alpha", 1), "ab" * 700, "ab" * 333 + "x", "a" * 450,
    " ".join(RNG.choice(VOCABULARY, 60)), " ".join(RNG.choice(VOCABULARY, 60)) + "\n" + LONG[:260], "The cat sat on the mat. " * 30, "thecatsatonthemat.", "the cat sat on the mat.", "日本語 " * 80, "!" * 5000,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node int, label string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), "k", 1, "l") for i, t in enumerate(TEXTS)]
    return _stored(spark, rows)


def _stored(spark, rows):
    import tempfile

    path = tempfile.mkdtemp() + "/docs"
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", low(s))


def test_top_k(spark):
    rows = [(i, [float(x) for x in RNG.integers(-3, 4, 20) / 4]) for i in range(120)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 20), (203, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()}
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v is not None and all(x is not None and x == x for x in v)}
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=False)), c) for c in ok if c != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(c, -s) for s, c in best]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_exact_dedup(docs):
    got = by_id(dedup.exact_groups(docs, bucket_keys=3))
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(TEXTS[i] or ""), i))
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())
    assert dedup.drop_copies(docs).count() == len(groups)


def test_bpe(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for long_text, part in ((65_536, 32_768), (300, 100)):
        got = by_id(bpe.encode_digest(docs, long_text=long_text, part=part))
        for i, t in enumerate(TEXTS):
            ids = tok.encode(t or "", add_special_tokens=False).ids
            assert got[i]["n_tokens"] == len(ids)
            assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_licences(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "x = 1"), (3, "d.py", None), (4, "a/b/e.py", "# Licensed under the Apache License, Version 2.0.\n" + "x = 1\n" * 40), (5, None, ""), (6, "ab/f.py", "")]
    got = {r["file_id"]: r for r in licences.scan(spark.createDataFrame(files, "file_id long, path string, text string"), licences.templates(spark)).collect()}
    assert [(got[i]["license_id"], got[i]["origin"]) for i in range(1, 7)] == [("MIT", "own"), ("MIT", "inherited"), (None, "none"), ("Apache-2.0", "own"), (None, "none"), (None, "none")]
    assert got[2]["origin_path"] == "a/LICENSE"


def test_licence_headers_and_files(spark):
    """Wrapped headers and whole texts count as wholes; ids may be null or repeat."""
    import textwrap

    longest = {}
    for k, t in licences.TEMPLATES:
        longest[k] = max(longest.get(k, ""), t, key=len)
    code = "\nx = compute(y)\n" * 60
    head = lambda k: "\n".join(f"# {line}" for line in textwrap.wrap(longest[k], 66)) + code
    page = lambda k: "Copyright 2020 Somebody\n\n" + textwrap.fill(longest[k], 70) + "\n\nThe end.\n"
    kinds = ["GPL-2.0", "GPL-3.0", "LGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "MPL-2.0"]
    files = [(7, f"p{i}/{n}.py", f(k)) for i, k in enumerate(kinds) for n, f in (("a", head), ("b", page))] + [(None, "q/x.txt", page("MIT")), (None, "r/y.txt", "nothing"), (7, "s/COPYING", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n" + "w " * 400), (7, "s/t/u.c", "int x;")]
    got = licences.scan(spark.createDataFrame(files, "file_id long, path string, text string"), licences.templates(spark)).collect()
    want = [(7, k) for k in kinds for _ in range(2)] + [(None, "MIT"), (None, None), (7, "GPL-3.0"), (7, "GPL-3.0")]
    assert sorted(map(str, ((r["file_id"], r["license_id"]) for r in got))) == sorted(map(str, want))
    none = spark.createDataFrame([], "file_id long, path string, text string")
    assert licences.scan(none, licences.templates(spark)).count() == 0


def test_repeats(docs):
    got = by_id(repeats.remove(docs))
    raw = {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    n = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for i, b in raw.items():
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if n[b[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}
    pieces, sequences = {i: [] for i in ids}, {}
    for r in packing.pack(docs).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, own in pieces.items():
        assert sorted(own)[0][0] == 0 and sum(n for _, n in own) == len(ids[i])
    for own in sequences.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= 4096


@pytest.mark.parametrize("rare", [16, 1])
def test_jaccard(docs, rare, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE", rare)
    got = by_id(jaccard.groups(docs))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in enumerate(map(words, TEXTS))}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), label[i]) for i in sets}
    assert {r["doc_id"] for r in jaccard.one_of_each(docs).collect()} == set(label.values())


def test_stages_on_repeated_rows(spark):
    """A table that was appended twice, and equal texts without ids, leave each text once and whole."""
    import corpus_pipeline

    texts = [" ".join(f"w{x}" for x in RNG.integers(0, 10**6, 60)) for _ in range(5)]
    rows = [(i, t, "en", "s", len(t), "k", 1, "l") for i, t in [*enumerate(texts[:4]), (None, texts[4])]]
    docs = _stored(spark, rows + rows).drop("key")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "stage")
    assert sorted(r["text"] for r in docs.collect()) == sorted(texts)


def test_jaccard_by_row(spark):
    """Rows without ids, and different texts of one id, go and stay by their own texts."""
    texts = [[f"t{k}w{x}" for x in range(100)] for k in range(4)]
    near = lambda w, n: " ".join([*w[:-n], *(f"{x}y" for x in w[-n:])])
    a, b, c, d = (" ".join(w) for w in texts)
    bridge, far = near(texts[3], 6), near(texts[3], 12)
    rows = [(1, a), (None, near(texts[0], 3)), (None, b), (2, c), (7, near(texts[2], 3)), (7, "a text that has nothing to do with it"), (4, d), (None, bridge), (9, far)]
    docs = _stored(spark, [(i, t, "en", "s", len(t), "k", 1, "l") for i, t in rows])
    component = {(r["doc_id"], r["component_id"]) for r in jaccard.groups(docs).collect()}
    assert (9, 4) in component and (None, 4) in component
    assert sorted(r["text"] for r in jaccard.one_of_each(docs).collect()) == sorted([a, b, c, d, rows[5][1]])


def test_lm(docs):
    from tracemill.llm.shared import held_out
    from pyspark.sql import functions as F

    train = [t for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*words(t), None])
    total, kinds = sum(c.values()), len(c)
    got = by_id(lm.score(docs, *lm.fit(docs.filter(~held_out(F.col("doc_id"), 7)))))
    for i, t in enumerate(TEXTS):
        w = [*words(t), None]
        base = sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0


@pytest.mark.parametrize(("most", "state", "least"), [(10**6, 1e-4, 2), (5, 0.05, 2), (0, 1.0, 2), (5, 0.05, 1)])
def test_lm_backoff(docs, most, state, least, monkeypatch):
    """Neither bound says which n-grams and histories count."""
    from tracemill.llm.shared import held_out
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "MOST", most)
    monkeypatch.setattr(lm, "STATE", state)
    texts = {i: [*words(t), None] for i, t in enumerate(TEXTS)}
    c, total = Counter(), 0
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            total += len(w)
            c.update(tuple(w[j : j + k]) for k in (1, 2, 3) for j in range(len(w) - k + 1))
    kinds = sum(len(g) == 1 for g in c)
    arcs = {}
    for g, n in c.items():
        if len(g) > 1 and n >= least:
            arcs.setdefault(g[:-1], []).append(g[-1])

    def p(h, x):
        if not h:
            return (c[x,] - 0.75) / total if c[x,] else 0.75 * kinds / total
        if x in arcs.get(h, []):
            return (c[*h, x] - 0.75) / c[h]
        if h not in arcs:
            return p(h[1:], x)
        return (1 - sum(p(h, y) for y in arcs[h])) / (1 - sum(p(h[1:], y) for y in arcs[h])) * p(h[1:], x)

    kept = [g[0] for g in c if len(g) == 1]
    for h in [(), *arcs]:  # all words, and any that training never had, share the whole
        assert abs(sum(p(h, x) for x in kept) + p(h, "never") - 1) < 1e-9
    got = by_id(lm.score(docs, *lm.fit(docs.filter(~held_out(F.col("doc_id"), 7)), least=least)))
    for i, w in texts.items():
        want = sum(math.log10(p(tuple(w[max(0, j - 2) : j]), x)) for j, x in enumerate(w))
        assert abs(got[i]["score"] - want) < 1e-6 * max(1, abs(want))


@pytest.mark.parametrize("size", [1, 2, 3, 100, 5000])
def test_lm_places(size):
    table = np.unique(np.concatenate((RNG.integers(0, 2**64, size, np.uint64), np.uint64(2**64 - 1) - np.arange(size, dtype=np.uint64), np.arange(size // 2, dtype=np.uint64))))
    for codes in (table, table[-size:], table[:0]):
        values = RNG.permutation(np.concatenate((table, RNG.integers(0, 2**64, 1000, np.uint64))))
        assert (lm.Places(codes).of(values) == lm.position(codes, values)).all()


def test_lm_buckets(docs, monkeypatch):
    """Many buckets and short lists give the same scores."""
    from tracemill.llm.shared import held_out
    from pyspark.sql import functions as F

    train = docs.filter(~held_out(F.col("doc_id"), 7))
    want = by_id(lm.score(docs, *lm.fit(train)))
    for name, value in {"MOST": 0, "COUNTED": 50, "BUCKET": 20, "HELD": 200, "LISTED": 3}.items():  # all is asked for in buckets
        monkeypatch.setattr(lm, name, value)
    counts, model = lm.fit(train)
    assert lm.bucket_bits(sum(t.count() for t in model.tables), lm.BUCKET) >= 3
    got = by_id(lm.score(docs, counts, model))
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert (r["n_tokens"], r["n_known"], r["held_out"]) == (got[i]["n_tokens"], got[i]["n_known"], got[i]["held_out"])
        assert all(abs(r[c] - got[i][c]) < 1e-9 * max(1, abs(r[c])) for c in ("score", "base_score"))


def test_lm_answer():
    """An answer has no more sums than its list has codes, and none for documents that get nothing."""
    codes = np.sort(RNG.integers(0, 2**64, 40, np.uint64))
    table = [codes[:20], np.where(np.arange(20) % 2, 3, -1), np.arange(20.0)]
    owner = np.arange(40, dtype=np.uint16) % 7
    raw = np.frombuffer(np.array([40, 5000]).tobytes() + codes.tobytes() + owner.tobytes(), np.uint8)
    docs = np.zeros(5000, lm.DOCUMENT)
    back = lm.answer(table, raw, 100.0)
    assert len(back) < 7 * 40
    lm.add_answer(docs, np.frombuffer(back, np.uint8))
    for i in range(5000):
        mine = [j for j in range(20) if owner[j] == i]
        assert docs["log"][i] == sum(mine) and docs["known"][i] == sum(j % 2 for j in mine)
        assert abs(docs["base"][i] - sum(math.log10(4 / 100) for j in mine if j % 2)) < 1e-12


def test_language(spark):
    made = {"en": ["the", "and", "with", "thing", "other"], "de": ["der", "und", "nicht", "schön", "über"]}
    rows = [(i, " ".join(RNG.choice(made["en" if i % 2 else "de"], 30)), "en" if i % 2 else "de") for i in range(60)] + [(100, None, "en"), (101, "123 !", "de"), (102, "the and with thing", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language.predict(df, *language.fit(df)))
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(60))
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und", "und", "en"]
    assert language.predict(df.limit(0), *language.fit(df.limit(0))).count() == 0


def test_toxicity(spark):
    calm = ["the", "and", "with", "thing", "other", "people", "house", "water"]
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        text = " ".join(RNG.choice(calm, 20)) + (" idiotic" if bad else "") + f" w{i}"
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(1000, "you idiotc thing"), (1001, "you iditoic people"), (1002, "the water"), (1003, None), (1004, 'one "idiotic" word')]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.score(df, toxicity.fit(df, lab)))
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in range(300))
    assert got[1000]["predicted"] == got[1001]["predicted"] == 1 and got[1002]["predicted"] == got[1003]["predicted"] == 0
    assert got[1004]["score"] < got[0]["score"]
    assert toxicity.drop_toxic(df, lab).filter("doc_id < 300").count() == 240


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (dedup.exact_groups, bpe.encode_digest, repeats.remove, packing.pack, jaccard.groups):
        assert f(none).count() == 0
    assert lm.score(none, *lm.fit(none)).count() == 0


def test_suffix_array_and_parts():
    raw = np.frombuffer(("ab" * 300 + "the cat " * 60 + "ab" * 130).encode(), np.uint8)
    for length in (5, 20, 200):
        places = np.arange(len(raw) - length + 1)
        order, new = repeats.suffix_array(raw, places, length)
        got = [raw[p : p + length].tobytes() for p in places[order]]
        assert got == sorted(got)
        assert new.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 5000, "y" * 30, None, "é" * 3000])], ["text"])
    seen = []
    for b, owner, base, some, offsets in repeats.parts(batch, 200, 1000):
        for i in range(len(owner)):
            t = (b.column("text")[int(owner[i])].as_py() or "").encode()
            part = some[offsets[i] : offsets[i + 1]].tobytes()
            assert t[base[i] : base[i] + len(part)] == part
            seen += [(t, int(base[i]) + k) for k in range(len(part) - 199)]
    assert len(seen) == len(set(seen)) == 5000 - 199 + 6000 - 199


@pytest.mark.parametrize("pieces", [["two words"], ["x", "y"], [""], ["a b c"], ["a b c d e"], ["a b c d e f"], [None, "one"]])
def test_jaccard_small_pieces(spark, pieces):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pieces)], "doc_id long, text string").coalesce(1)
    n = [max(len((t or "").split()) - 4, min(1, len((t or "").split()))) for t in pieces]
    assert [r["n_shingles"] for r in jaccard.groups(df).orderBy("doc_id").collect()] == n


def test_long_words(spark):
    """Words that a polynomial modulo a power of two takes for equal."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.groups(df).orderBy("doc_id").collect()] == [1, 2, 1]
    got = lm.score(df, *lm.fit(df.filter("doc_id = 1"))).orderBy("doc_id").collect()
    assert [r["n_known"] for r in got] == [2, 1, 2]


def test_crowded_grams(docs, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 2)
    test_repeats(docs)


def test_stages_keep_columns(spark):
    """Names that operators use for themselves are no danger in the input."""
    names = ["doc_id", "text", "lang", "n_chars", "key", "__key", "__sha", "__row", "row", "rest", "d", "g", "hits", "kept", "node", "label"]
    shared = " ".join(f"s{x}" for x in range(60))
    texts = [f"{' '.join(f'{k}w{x}' for x in range(80))} {shared}" for k in range(3)]
    rows = [(i, t, "en", len(t or ""), *[f"{c}{i}" for c in names[4:]]) for i, t in enumerate([*texts, texts[0], None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, " + ", ".join(f"{c} string" for c in names[4:]))
    for stage in (dedup.drop_copies, jaccard.one_of_each, repeats.without_repeats):
        out = stage(df)
        assert out.dtypes == df.dtypes
        for r in out.collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in names[4:])
    got = {r["doc_id"]: r["text"] for r in repeats.without_repeats(df.filter("doc_id <> 3")).collect()}
    assert all(shared[10:] not in t and f"{k}w78" in t for k, t in got.items() if t) and got[4] is None and got[5] == ""


def test_top_k_repeated_ids(spark):
    from pyspark.sql import functions as F

    rows = [(5, [1.0, 0.0]), (5, [3.0, 0.0]), (5, [1.0, 0.0]), (7, [2.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 5, 2).collect()
    one = [(5, 3 * 1024**2), (7, 2 * 1024**2)]
    two = [(7, 6 * 1024**2), (5, 3 * 1024**2)]
    assert sorted((r["vec_id"], r["score"]) for r in got) == sorted(one + one + two)


def test_language_mixtures(spark):
    names = ["aa", "bb", "cc", "dd", "ee", "ff"]
    made = {n: [n[0] * k + "xyzuvw"[i] for k in range(2, 7)] for i, n in enumerate(names)}
    text = lambda *langs, n=40: " ".join(w for x in langs for w in RNG.choice(made[x], n))
    train = [(i, text(names[i % 6]), names[i % 6]) for i in range(120)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(0, text("aa")), (1, text("aa", "aa", "bb")), (2, text(*names)), (3, "\U00030000"), (4, None), (5, "")], "doc_id long, text string")
    got = by_id(language.predict(asked, *language.fit(df)))
    assert [got[i]["n_langs"] for i in range(6)] == [1, 2, 6, 1, 0, 0]
    assert got[1]["lang_pred"] == "aa" and abs(got[1]["score"] - 2 / 3) < 0.02 and abs(got[2]["score"] - 1 / 6) < 0.02
    assert [got[i]["lang_pred"] == "und" for i in (3, 4, 5)] == [False, True, True]


def test_toxicity_near_copies(spark):
    """Words of a toxic text that was copied with small changes are not what makes it toxic."""
    calm = [f"word{k}" for k in range(400)]
    own = [f"only{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(RNG.choice(calm, 30)) + (" idiotic " if bad else " ") + " ".join(RNG.choice(calm, 5))
        rows.append((i, text))
        labels.append((i, int(bad)))
    for i in range(400, 500):  # near copies, each with one word changed
        words_ = list(own)
        words_[int(RNG.integers(60))] = f"new{i}"
        rows.append((i, " ".join(words_) + " idiotic"))
        labels.append((i, 1))
    rows += [(1000, " ".join(own[:20]) + " " + " ".join(calm[:30])), (1001, "an idiotic " + " ".join(calm[:5]))]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.score(df, toxicity.fit(df, lab)))
    assert (got[1000]["predicted"], got[1001]["predicted"]) == (0, 1)
    assert toxicity.drop_toxic(df.limit(0), lab).count() == toxicity.score(df.limit(0), toxicity.fit(df.limit(0), lab.limit(0))).count() == 0
