"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(prefix: str, *columns: str) -> Column:
    """prefix and the first 24 hex digits of the sha256 of the columns as JSON, in the order of their names."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 24))


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole; 0 where whole is 0."""
    return F.round(F.when(whole == 0, 0.0).otherwise(part / F.nullif(whole, F.lit(0))), digits)


def contains_claim(text: Column, claim: Column) -> Column:
    return F.contains(F.lower(text), F.lower(claim))


def is_subsequence(small: Column, large: Column) -> Column:
    """True if the items of small stand in large in this order, others between them allowed."""
    step = lambda at, x: F.when((at < F.size(small)) & (F.try_element_at(small, at + 1) == x), at + 1).otherwise(at)
    return F.aggregate(large, F.lit(0), step) == F.size(small)


def span(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket; null if there is none after it."""
    first, last = F.instr(text, opening), F.length(text) - F.instr(F.reverse(text), closing) + 1
    return F.when((first > 0) & (F.instr(text, closing) > 0) & (last > first), F.substring(text, first, last - first + 1))


def fenced(text: Column, fence: str = "`" * 3) -> Column:
    """What stands in the first pair of fences, without the name of the language; null if there is no pair."""
    inner = F.substring_index(F.substring(text, F.instr(text, fence) + len(fence), F.length(text)), fence, 1)
    pair = F.length(text) - F.length(F.replace(text, F.lit(fence), F.lit(""))) >= 2 * len(fence)
    return F.when(pair, F.trim(F.when(inner.startswith("json"), F.substring(inner, 5, F.length(inner))).otherwise(inner), F.lit(" \n\t\r")))


def json_object(text: Column) -> Column:
    """The JSON object in a reply: the text itself, what is fenced, or the span from the first to the last brace."""
    valid = lambda c: F.when(c.startswith("{") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(F.trim(text)), valid(fenced(text)), valid(span(text, "{", "}")))


def parity_variant(key: Column) -> Column:
    """A neutral letter from the first byte of the key's sha256."""
    return F.when(F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % 2 == 0, "A").otherwise("B")


def identifiers(text: Column) -> Column:
    """Whole tokens of letters, digits and underscores that hold a digit."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)), lambda x: x.rlike("[0-9]"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the integer keys alone, not on partitions: a linear congruence."""
    h = F.lit(seed).cast("long")
    for k in keys:
        h = (h * 1103 + k.cast("long") * 12289 + 12345) % 1000003
        h = (h * 7919 + 104729) % 1000003
    return h / F.lit(1000003.0)


def uniform_sql(seed: int, *keys: str) -> str:
    h = str(seed)
    for k in keys:
        h = f"((({h}) * 1103 + ({k})::BIGINT * 12289 + 12345) % 1000003)"
        h = f"(({h} * 7919 + 104729) % 1000003)"
    return f"({h} / 1000003.0::DOUBLE)"


def boolean(text: Column, default: bool) -> Column:
    """A boolean from a word for one; null is the default, any other text true unless it is empty."""
    word = F.lower(F.trim(text))
    return F.when(text.isNull(), default).when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False).otherwise(text != "")


def first_present(json: Column, keys: list[str]) -> Column:
    """The value of the first of these keys that is there and not null."""
    v = F.try_parse_json(json)
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in keys])


def task_split(domain: Column, task_id: Column, training: list[str]) -> Column:
    """Tasks of training domains by their number: up to 24, up to 30, beyond; all others are for the test."""
    number = F.substring_index(task_id, "-", -1).cast("int")
    return F.when(~domain.isin(*training), "test").when(number <= 24, "train").when(number <= 30, "dev").otherwise("test")


def quadrant(domain: Column, hazard: Column, domains: list[str], hazards: list[str]) -> Column:
    seen = lambda c, known: F.when(c.isin(*known), "seen").otherwise("unseen")
    return F.concat(seen(domain, domains), F.lit("-domain/"), seen(hazard, hazards), F.lit("-hazard"))
