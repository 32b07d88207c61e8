"""Many needles in many texts: what reasons name and quote of a trace's evidence."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested as N
from .audits import identifier_parts

#: Characters of the needles of one automaton, which is broadcast; more needles make more automata and passes.
CHARACTERS = 4_000_000

def automaton(words: list[str]):
    """An Aho-Corasick automaton over the lower-cased needles; each ends in those that read so."""
    import ahocorasick

    out, by = ahocorasick.Automaton(), {}
    for w in words:
        by.setdefault(w.lower(), []).append(w)
    for low, same in by.items():
        out.add_word(low, (len(low), same))
    out.make_automaton()
    return out


def whole_words(text: str, trie) -> set[str]:
    """Needles that stand in the text between characters that are neither ASCII letters nor digits."""
    low, out = text.lower(), set()
    near = re.compile("[a-z0-9]").match
    for end, (n, same) in trie.iter(low):
        start = end - n + 1
        if not (start and near(low[start - 1])) and not (end + 1 < len(low) and near(low[end + 1])):
            out.update(same)
    return out


def found(texts: DataFrame, needles: DataFrame, characters: int = CHARACTERS) -> DataFrame:
    """(id, needle): each needle of a text's group that stands in it as a whole word, whatever its case. texts: id, group,
    text; needles: group, needle.

    One automaton finds the needles of all groups in a single pass over each text, and a join keeps those of its own
    group. Needles beyond `characters` go to further automata, each with a pass of its own, so that what is broadcast is
    bounded. Null texts and null or empty needles are in nothing; rows that repeat an id come together."""
    spark = texts.sparkSession
    own = needles.filter(F.length("needle") > 0).select("group", "needle").distinct()
    words = own.select("needle").distinct()
    blocks = max(1, -(-(words.agg(F.sum(F.length("needle"))).first()[0] or 0) // characters))
    rows = texts.filter(F.col("text").isNotNull()).select("id", "group", "text")
    kinds = dict(rows.dtypes)
    out = None
    for block in range(blocks):
        some = [r["needle"] for r in words.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block).collect()]  # about `characters`
        if not some:
            continue
        sent = spark.sparkContext.broadcast(some)

        def search(batches, sent=sent):
            trie = automaton(sent.value)
            for batch in batches:
                hits = [sorted(whole_words(t, trie)) for t in batch.column("text").to_pylist()]
                at = [i for i, h in enumerate(hits) for _ in h]
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("group").take(take), pa.array([w for h in hits for w in h], pa.string())], ["id", "group", "needle"])

        hits = rows.mapInArrow(search, f"id {kinds['id']}, group {kinds['group']}, needle string")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return rows.select("id", "group", F.lit("").alias("needle")).filter("false").select("id", "needle")
    return out.join(own, ["group", "needle"], "left_semi").select("id", "needle")


def _value_tokens(v: Column) -> Column:
    """How the value of a field may be quoted: numbers, whole ones with and without their point; strings of three
    characters or more; lists and objects as JSON. Booleans and nulls, not at all. Numbers are in plain notation."""
    json = N.dump(v)
    none = F.expr("cast(array() as array<string>)")
    point = F.array(F.concat(json, F.lit(".0")), json)
    whole = lambda x: F.array(F.concat(x, F.lit(".0")), x)

    def of(kind):
        real = v.cast("double")
        of_double = F.when(real == F.floor(real), whole(real.cast("decimal(38,0)").cast("string"))).otherwise(F.array(json))
        of_decimal = F.when(F.contains(json, F.lit(".")), F.array(json)).when(F.length(json) > 18, F.array(json)).otherwise(point)
        nested = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.array(F.lower(N.spaced(json))))
        text = F.when(F.length(v.cast("string")) >= 3, F.array(F.lower(v.cast("string")))).otherwise(none)
        return F.when(kind.isin("BOOLEAN", "VOID"), none).when(kind == "STRING", text).when(kind == "BIGINT", F.array(json)).when(kind == "DOUBLE", of_double).when(kind.startswith("DECIMAL"), of_decimal).otherwise(nested)

    return N.let(F.schema_of_variant(v), of)


def payload_tokens(payload: Column) -> Column:
    """Names and values of an event's payload, lower-cased, each once; none for what is no object."""
    own = F.flatten(F.transform(N.entries(N.read(payload)), lambda e: F.concat(F.array(F.lower(e["key"])), _value_tokens(e["value"]))))
    return F.array_distinct(F.coalesce(own, F.expr("cast(array() as array<string>)")))


def handles(events: DataFrame) -> DataFrame:
    """(group, needle): ways to name the required evidence of a trace: ids, sources and field names, whole and in parts, of
    four characters or more. events: group, event_id, source, payload, required."""
    names = F.concat(F.array("event_id", "source"), F.coalesce(F.transform(N.entries(N.read(F.col("payload"))), lambda e: e["key"]), F.expr("cast(array() as array<string>)")))
    parts = events.filter("required").select("group", F.explode(F.array_compact(names)).alias("name")).select("group", F.explode(identifier_parts(F.col("name"))).alias("needle"))
    return parts.filter(F.length("needle") >= 4).distinct()


def values(events: DataFrame, subject: str = "subject_output") -> DataFrame:
    """(group, needle): names and values of the required evidence that the subject's own report doesn't show, of three
    characters or more. events: as in `handles`."""
    tokens = lambda rows: rows.select("group", F.explode(payload_tokens(F.col("payload"))).alias("needle")).filter(F.length("needle") >= 3).distinct()
    own = F.col("event_id") == subject
    return tokens(events.filter(F.col("required") & ~own)).join(tokens(events.filter(own)), ["group", "needle"], "left_anti")


def reason_specificity(reasons: DataFrame, events: DataFrame) -> DataFrame:
    """id, specificity (specific if a handle is named, else generic), handles and quoted values, each sorted. reasons: id
    (unique), group, text; events: as in `handles`. A null reason is generic."""
    list_of = lambda rows, name: rows.groupBy("id").agg(F.array_sort(F.collect_set("needle")).alias(name))  # noqa: E731  what one reason names
    none = F.expr("cast(array() as array<string>)")
    out = reasons.select("id").join(list_of(found(reasons, handles(events)), "handles"), "id", "left").join(list_of(found(reasons, values(events)), "quoted"), "id", "left")
    return out.select("id", F.when(F.size("handles") > 0, "specific").otherwise("generic").alias("specificity"), F.coalesce("handles", none).alias("handles"), F.coalesce("quoted", none).alias("quoted"))
