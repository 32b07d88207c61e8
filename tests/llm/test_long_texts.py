"""Very long lines, runs of lines and words, which patterns and loops have to survive."""

import pytest

from tracemill.llm import language, licences

MIT = "Released under the MIT License."


def scan(spark, texts):
    rows = [(i, f"src/f{i}.c", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    return {r["file_id"]: r for r in licences.scan(df, licences.templates(spark)).collect()}


@pytest.mark.parametrize("n", [1_200, 100_000])
def test_licences_in_long_files(spark, n):
    comments = f"{MIT}\n" + "# one more comment line\n" * n
    dots = f"{MIT}\n" + "1" + ".1" * n
    code = f"{MIT}\n" + "x = 1\n" * n
    marks = "\n".join(["// " + MIT, "", *["//"] * n, "code", "# x"] + [""] * n)
    got = scan(spark, [comments, dots, code, marks, "# only comments\n" * n])
    assert [got[i]["license_id"] for i in range(4)] == ["MIT"] * 4
    assert [got[i]["origin"] for i in range(4)] == ["own"] * 4
    assert got[4]["origin"] == "none"


def test_units_of_lines(spark):
    """Lines, runs of comment lines, paragraphs and files, with the characters of each as they stand in the text."""
    from pyspark.sql import functions as F

    text = "# a\n# b\nx\n\n  // c\n\t\n\nlast\n"
    rows = spark.createDataFrame([(1, text), (2, "one"), (3, "")], "key long, text string")
    got = licences.of_units(licences.lines(rows), "line").groupBy("key", "p", "b", "l").agg(F.max("n_chars").alias("n"), F.count("*").alias("lines")).collect()
    of = {(r["key"], r["p"], r["b"], r["l"]): (r["n"], r["lines"]) for r in got}
    assert of[1, -1, -1, -1] == (len(text), 5)
    assert of[1, 0, -1, -1] == (len("# a\n# b\nx"), 3) and of[1, 0, 0, -1] == (len("# a\n# b\n"), 2)
    assert of[1, 1, -1, -1] == (len("  // c"), 1) and of[1, 1, 0, -1] == (len("  // c"), 1)
    assert of[1, 2, -1, -1] == (len("\nlast\n"), 1)
    assert of[2, -1, -1, -1] == (3, 1) and (2, 0, -1, -1) not in of and not any(k[0] == 3 for k in of)


def test_ties_and_equal_cosines(spark):
    known = spark.createDataFrame([(0, "B", "alpha beta"), (1, "A", "beta alpha"), (2, "C", "gamma")], "template_id int, license_id string, text string")
    files = spark.createDataFrame([(1, "d/x", "alpha beta"), (1, "d/x", "alpha beta"), (2, "d/e/y", "none"), (3, None, "gamma"), (4, "z", None)], "file_id long, path string, text string")
    got = sorted((r["file_id"], r["license_id"], r["origin"]) for r in licences.scan(files, known).collect() if r["file_id"] != 4)
    assert got == [(1, "A", "own"), (1, "A", "own"), (2, "A", "inherited"), (3, "C", "own")]
    assert licences.scan(files.limit(0), known).count() == 0


def test_languages_of_long_texts_in_parts(spark, monkeypatch):
    """What is read in parts is learnt and predicted as what is read whole."""
    rows = [(i, ("the cat sat on the mat and " if i % 2 else "der hund lief über die straße und ") * (1 + i % 40) + "x" * (i % 3), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, "the cat and the dog " * 30 + "der hund und die katze über " * 30, "en"), (101, "a" * 500, "en"), (102, "", "de"), (103, None, "de"), (104, "123 !?", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)

    def run():
        langs, log = language.fit(docs)
        return langs, log, sorted(map(tuple, language.predict(docs, langs, log).collect()))

    whole = run()
    monkeypatch.setattr(language, "PART", 97)
    in_parts = run()
    assert whole[0] == in_parts[0] == ["de", "en"]
    for a, b in zip(whole[2], in_parts[2], strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3 and a[4] == b[4]
    assert {r[0]: r[2] for r in in_parts[2]}[103] == "und" and {r[0]: r[4] for r in in_parts[2]}[100] == 2
