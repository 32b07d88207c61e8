"""Licence scans: TF-IDF cosine of lines, header blocks, paragraphs and whole files to templates, then inheritance from
the nearest ancestor directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Least cosine of a match; least share of a file's characters that matches have if it is a licence file by content.
THRESHOLD, FILE_SHARE = 0.7, 0.5
TOKEN = "[a-z0-9]+(?:[.][0-9]+)*"
#: Names of files that license their directory.
FILE_NAME = "(?i)^(licen[cs]e|copying|unlicense|notice)([-._].*)?$"
#: What a comment line begins with, and what parts paragraphs. Possessive quantifiers, since Java's patterns run others
#: over groups by recursion, which a long file would end.
MARK, BLANK = r"[ \t]*+(?:#|//|/?[*]|--|;|%)", r"\n[ \t]*\n"
JAVA_TOKEN = "[a-z0-9]++(?:[.][0-9]++)*+"
#: Runs of comment lines, as SQL has them; runs of comment lines and runs of others.
HEADER = r"(?:^[ \t]*(?:#|//|/?[*]|--|;|%)[^\n]*\n?)+"
BLOCKS = rf"(?md)((?:^{MARK}[^\n]*+\n?+)++|(?:^(?!{MARK})[^\n]*+\n?+)++)"
#: Rows of small tables that are broadcast at most.
BROADCAST_ROWS = 500_000
_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this {1}. If not, see https://www.gnu.org/licenses/."
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Statements, headers and texts by which well-known licences are declared, with their SPDX identifiers.
TEMPLATES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program {_WARRANTY.format('General Public License', 'program')}"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {_WARRANTY.format('General Public License', 'program')}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("LGPL-3.0", f"This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library {_WARRANTY.format('Lesser General Public License', 'library')}"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates(spark: SparkSession) -> DataFrame:
    """(template_id, license_id, text)"""
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES)], "template_id int, license_id string, text string")


def token_list(text):
    return F.regexp_extract_all(F.lower(text), F.lit(JAVA_TOKEN), F.lit(0))


def weighted(files: DataFrame, known: DataFrame) -> tuple[DataFrame, float]:
    """(template_id, license_id, token, w, norm): tf * (ln((1 + N) / (1 + df)) + 1) with document frequencies over all
    files; and the idf of tokens that no template has."""
    tf = known.select("template_id", "license_id", F.explode(token_list(F.col("text"))).alias("token")).groupBy("template_id", "license_id", "token").agg(F.count("*").alias("tf"))
    vocabulary = sorted(r["token"] for r in tf.select("token").distinct().collect())  # bounded by the templates
    held = F.array_intersect(token_list(F.col("text")), F.array(*[F.lit(t) for t in vocabulary]))
    df = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).collect()  # a row for each word of the templates
    by = {r["token"]: r["df"] for r in df}
    n = by.get("", 0)
    idf = files.sparkSession.createDataFrame([(t, by.get(t, 0)) for t in vocabulary], "token string, df long")
    idf = idf.select("token", (F.log((F.lit(1.0) + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    own = tf.join(F.broadcast(idf), "token").withColumn("w", F.col("tf") * F.col("idf"))
    norms = own.groupBy("template_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    rows = own.join(norms, "template_id").select("template_id", "license_id", "token", "idf", "w", "norm").collect()  # bounded by the templates
    import math

    return files.sparkSession.createDataFrame(rows, "template_id int, license_id string, token string, idf double, w double, norm double"), math.log(1.0 + n) + 1.0


def anchors(weights: DataFrame, threshold: float) -> list[str]:
    """Tokens without which no unit reaches the threshold: of each template the heaviest, until what is left of it has
    less than `threshold` of its norm."""
    out: set[str] = set()
    by: dict[int, list] = {}
    for r in weights.collect():
        by.setdefault(r["template_id"], []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: (-r["w"], r["token"]))
        left = sum(r["w"] ** 2 for r in rows)
        for r in rows:
            if left < (threshold * r["norm"] * (1 - 1e-9)) ** 2:
                break
            out.add(r["token"])
            left -= r["w"] ** 2
    return sorted(out)


def lines(files: DataFrame) -> DataFrame:
    """(key, whole, many, p, paragraph, comment, b, block, l, line, own): the lines of each file, with the numbers of their
    paragraph, of their run of comment lines or of others in it, and of the line in that. whole, paragraph, block, own: the
    characters of these. many: the file has several paragraphs."""
    # what is taken from a text is taken before it is exploded, or each line would carry it
    whole = files.select("key", F.length("text").alias("whole"), F.split("text", BLANK).alias("all"))
    paragraphs = whole.select("key", "whole", (F.size("all") > 1).alias("many"), "all").select("key", "whole", "many", F.posexplode("all").alias("p", "text"))
    runs = paragraphs.select("key", "whole", "many", "p", F.length("text").alias("paragraph"), F.regexp_extract_all("text", F.lit(BLOCKS), F.lit(1)).alias("all"))
    blocks = runs.select("key", "whole", "many", "p", "paragraph", F.posexplode("all").alias("b", "text"))
    held = blocks.select("key", "whole", "many", "p", "paragraph", "b", F.length("text").alias("block"), F.col("text").rlike(f"^{MARK}").alias("comment"), F.split("text", "\n").alias("all"))
    each = held.select("key", "whole", "many", "p", "paragraph", "b", "block", "comment", F.posexplode("all").alias("l", "line"))
    return each.filter("line <> ''").withColumn("own", F.length("line"))


#: The numbers that tell a file's units apart.
UNIT = ["p", "b", "l"]


def of_units(rows: DataFrame, *kept: str) -> DataFrame:
    """A row of `kept`, with n_chars, for each unit that a line belongs to: itself, its run of comment lines, its
    paragraph if there are several, and its file. The numbers of what is larger than a part are -1."""
    no, p, b = F.lit(-1), F.col("p"), F.col("b")
    unit = lambda p, b, own, n: F.struct(p.alias("p"), b.alias("b"), own.alias("l"), F.col(n).alias("n_chars"))
    all_ = F.array(unit(p, b, F.col("l"), "own"), F.when(F.col("comment"), unit(p, b, no, "block")), F.when(F.col("many"), unit(p, no, no, "paragraph")), unit(no, no, no, "whole"))
    return rows.select("key", *kept, F.explode(F.filter(all_, lambda u: u.isNotNull())).alias("u")).select("key", "u.*", *kept)


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def matches(files: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, kind, license_id, score, n_chars) for each unit whose cosine to a template reaches the threshold; the best
    template of each unit. files: key, text.

    Texts are read as lines. The counts of a run of comment lines, a paragraph or a file are sums over its lines; lines
    are dealt by file once, and all sums are made where they lie. Only words that templates have are counted at first:
    with each other word as one that stands once, the norm is at least what it is then, so the cosine at most. Units that
    this bound leaves, few, are weighed with all their words.
    """
    weights, rare = weighted(files, known)
    need = anchors(weights, threshold)
    if not need:
        return files.sparkSession.createDataFrame([], "key long, kind string, license_id string, score double, n_chars long")
    pattern = "(?i)(?<![a-z0-9])(" + "|".join(t.replace(".", "[.]") for t in need) + ")(?![a-z0-9])"
    idf = weights.select("token", "idf").distinct()
    vocabulary = sorted(r["token"] for r in idf.collect())  # bounded by the templates
    unit = ["key", *UNIT]
    words = lines(files.filter(F.col("text").rlike(pattern))).withColumn("words", token_list(F.col("line")))
    held = words.withColumn("held", F.filter("words", lambda x: x.isin(vocabulary)))
    term = lambda token, n: F.struct(token.alias("token"), n.cast("long").alias("n"))
    rest = F.lit("")  # no word: all that no template has
    terms = F.concat(F.transform("held", lambda x: term(x, F.lit(1))), F.array(term(rest, F.size("words") - F.size("held"))))
    dealt = of_units(held.withColumn("terms", terms).drop("words", "held", "line").repartition("key"), "terms")
    each = dealt.select(*unit, "n_chars", F.explode("terms").alias("t"))
    tf = each.groupBy(*unit, F.col("t.token").alias("token")).agg(F.sum("t.n").alias("tf"), F.max("n_chars").alias("n_chars")).join(F.broadcast(idf), "token", "left")
    v = F.col("tf") * F.col("idf")
    sums = tf.groupBy(*unit).agg(
        F.sum(v * v).alias("square"), F.max(F.when(F.col("token") == rest, F.col("tf"))).alias("others"), F.max("n_chars").alias("n_chars"),
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("token", v.alias("v")))).alias("held"),
    )
    at_least = F.sqrt(F.col("square") + F.col("others") * rare * rare).alias("least")
    by_template = sums.select(*unit, at_least, "n_chars", F.explode("held").alias("h")).select(*unit, "least", "n_chars", "h.*").join(F.broadcast(weights.select("template_id", "license_id", "token", "w", "norm")), "token")
    dot = by_template.groupBy(*unit, "template_id", "license_id").agg(F.sum(F.col("v") * F.col("w")).alias("dot"), F.max("norm").alias("norm"), F.max("least").alias("least"), F.max("n_chars").alias("n_chars"))
    left = written(dot.filter(F.col("dot") >= F.col("norm") * F.col("least") * (threshold - 1e-6)), "licence-units")
    some = left.select(*unit).distinct()
    again = lines(files.join(_few(left.select("key").distinct()), "key", "left_semi")).withColumn("words", token_list(F.col("line")))
    whole = of_units(again, "words").join(_few(some), unit, "left_semi").select(*unit, F.explode("words").alias("token")).groupBy(*unit, "token").agg(F.count("*").alias("tf"))
    value = F.col("tf") * F.coalesce("idf", F.lit(rare))
    norms = whole.join(F.broadcast(idf), "token", "left").groupBy(*unit).agg(F.sqrt(F.sum(value * value)).alias("unit_norm"))
    scored = left.join(norms, unit).select(*unit, "license_id", F.round(F.col("dot") / (F.col("norm") * F.col("unit_norm")), 6).alias("score"), "n_chars").filter(F.col("score") >= threshold)
    best = scored.groupBy(*unit).agg(F.min_by(F.struct("license_id", "score", "n_chars"), F.struct((-F.col("score")).alias("a"), F.col("license_id").alias("b"))).alias("m"))
    kind = F.when(F.col("l") >= 0, "line").when(F.col("b") >= 0, "header").when(F.col("p") >= 0, "paragraph").otherwise("file").alias("kind")
    return best.select("key", kind, "m.*")


def folders(path):
    """The path's directories, nearest first, ending with the root ''."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    up = F.size(parts) - 1
    return F.when(up < 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(up, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def scan(files: DataFrame, known: DataFrame, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """file_id, license_id, score, n_matches, origin, origin_path: one row for each row of the input.

    files: file_id, path, text; other columns are not read. A file's own licence is that of the unit with the largest
    cosine ('own'; ties go to the smaller license_id): a line, a run of comment lines, a paragraph or the whole file, so
    that wrapped headers and licence texts are compared as wholes. A file without one inherits from the licence file in
    its nearest ancestor directory ('inherited'), else it has none ('none'). Licence files are those with such a name, or
    whose matching units of one kind hold `file_share` of its characters, and with a licence of their own; of several in
    one directory the best score counts. Null paths stand in the root, null texts match nothing, ids may be null or
    repeat, each row is a file. Empty tables give no rows.
    """
    files = written(files.select(F.monotonically_increasing_id().alias("key"), F.col("file_id").cast("long").alias("file_id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text")), "licence-files", "zstd")
    found = matches(files.select("key", "text"), known, threshold)
    best = F.min_by(F.struct("license_id", "score"), F.struct((-F.col("score")).alias("a"), F.col("license_id").alias("b"))).alias("m")
    own = found.groupBy("key", "kind").agg(best, F.count("*").alias("n"), F.sum("n_chars").alias("matched")).select("key", "m.*", "n", "matched")
    own = own.groupBy("key").agg(best, F.sum("n").alias("n_matches"), F.max("matched").alias("matched"))
    all_ = files.select("key", "file_id", "path", F.length("text").alias("size")).join(own, "key", "left")
    name = F.element_at(F.split("path", "/"), -1)
    here = all_.filter(F.col("m").isNotNull() & (name.rlike(FILE_NAME) | (F.col("matched") >= file_share * F.col("size"))))
    grants = here.select(F.element_at(folders(F.col("path")), 1).alias("dir"), "m.license_id", "m.score", F.col("path").alias("origin_path"))
    grants = grants.groupBy("dir").agg(F.min_by(F.struct("license_id", "score", "origin_path"), F.struct((-F.col("score")).alias("a"), F.col("origin_path").alias("b"), F.col("license_id").alias("c"))).alias("g"))
    above = all_.filter(F.col("m").isNull()).select("key", F.posexplode(folders(F.col("path"))).alias("up", "dir"))
    nearest = above.join(grants, "dir").groupBy("key").agg(F.min_by("g", "up").alias("g"))
    out = all_.join(nearest, "key", "left")
    pick = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(f"g.{c}"))
    return out.select(
        "file_id", pick("license_id").alias("license_id"), pick("score").alias("score"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.when(F.col("m").isNotNull(), "own").when(F.col("g").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("m").isNotNull(), F.col("path")).otherwise(F.col("g.origin_path")).alias("origin_path"),
    )


def op4_licences(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"), templates(spark)).withColumnRenamed("file_id", "doc_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = rf"""
WITH t(template_id, license_id, text) AS (VALUES {", ".join(f"({i}, {_quoted(k)}, {_quoted(t)})" for i, (k, t) in enumerate(TEMPLATES))}),
d AS (SELECT row_number() OVER () AS k, doc_id, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path, coalesce(text, '') AS text FROM documents),
tt AS (SELECT template_id, license_id, token, count(*) AS tf FROM (SELECT *, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM t) GROUP BY ALL),
df AS (SELECT token, count(DISTINCT k) AS df FROM (SELECT k, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM d) WHERE token IN (SELECT token FROM tt) GROUP BY token),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
idf AS (SELECT token, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT token FROM tt) LEFT JOIN df USING (token), n),
w AS (SELECT template_id, license_id, token, tf * idf AS w FROM tt JOIN idf USING (token)),
wn AS (SELECT template_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
u AS (SELECT k, 'line' AS kind, string_split(text, chr(10)) AS texts FROM d UNION ALL SELECT k, 'header', regexp_extract_all(text, '(?m)({HEADER})', 1) FROM d
  UNION ALL SELECT k, 'paragraph', string_split_regex(text, '{BLANK}') FROM d WHERE regexp_matches(text, '{BLANK}') UNION ALL SELECT k, 'file', [text] FROM d),
l AS (SELECT k, kind, x.i AS unit, x.s AS line FROM (SELECT k, kind, unnest(list_transform(texts, lambda s, i: {{'s': s, 'i': i}})) AS x FROM u)),
lt AS (SELECT k, kind, unit, token, count(*) AS tf FROM (SELECT k, kind, unit, unnest(regexp_extract_all(lower(line), '{TOKEN}')) AS token FROM l) GROUP BY ALL),
lv AS (SELECT k, kind, unit, token, tf * coalesce(idf, ln(1 + n) + 1) AS v FROM lt LEFT JOIN idf USING (token), n),
ln_ AS (SELECT k, kind, unit, sqrt(sum(v * v)) AS un FROM lv GROUP BY ALL),
s AS (SELECT k, kind, unit, license_id, template_id, round(sum(v * w) / (max(norm) * max(un)), 6) AS score
  FROM lv JOIN w USING (token) JOIN wn USING (template_id) JOIN ln_ USING (k, kind, unit) GROUP BY ALL HAVING round(sum(v * w) / (max(norm) * max(un)), 6) >= {THRESHOLD}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, kind, unit ORDER BY score DESC, license_id) AS r FROM s) WHERE r = 1),
ok AS (SELECT k, kind, count(*) AS n_matches, sum(length(line)) AS matched FROM b JOIN l USING (k, kind, unit) GROUP BY ALL),
o AS (SELECT k, first(license_id ORDER BY score DESC, license_id) AS license_id, max(score) AS score FROM b GROUP BY k),
c AS (SELECT k, sum(n_matches)::BIGINT AS n_matches, max(matched) AS matched FROM ok GROUP BY k),
a AS (SELECT d.k, doc_id, path, length(text) AS size, license_id, score, n_matches, matched FROM d LEFT JOIN o USING (k) LEFT JOIN c USING (k)),
g AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, first(license_id ORDER BY score DESC, path, license_id) AS license_id, max(score) AS score, first(path ORDER BY score DESC, path) AS origin_path
  FROM a WHERE license_id IS NOT NULL AND (matched >= {FILE_SHARE} * size OR regexp_matches(regexp_extract(path, '[^/]*$'), '{FILE_NAME}')) GROUP BY 1),
i AS (SELECT k, first(struct_pack(license_id := g.license_id, score := g.score, origin_path := g.origin_path) ORDER BY length(dir) DESC) AS g
  FROM a JOIN g ON a.license_id IS NULL AND (dir = '' OR starts_with(path, dir || '/')) GROUP BY k)
SELECT doc_id, coalesce(license_id, i.g.license_id) AS license_id, coalesce(score, i.g.score) AS score, coalesce(n_matches, 0) AS n_matches,
  CASE WHEN license_id IS NOT NULL THEN 'own' WHEN i.g IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN license_id IS NOT NULL THEN path ELSE i.g.origin_path END AS origin_path
FROM a LEFT JOIN i USING (k)
"""
