"""JSON of any depth, walked and rewritten within the JVM: levels of VARIANT are opened one after the other.

Texts that are null or no JSON (more than one value, a key twice, nesting beyond 999, half a surrogate pair) give null.
Objects are read in the order of their keys, numbers in their shortest form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import fenced, span

#: An escape of half a surrogate pair that its other half doesn't follow or precede.
_HALF = r"(?i)(?<!\\)(?:\\\\)*(?:\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"
#: Levels that the parser reads at most, and those of them that are walked down without a list of what is open.
DEPTH, LEVELS = 1000, 5



def _nested(levels: int) -> str:
    """A pattern of a JSON value without escapes, of so many levels. It never goes back, so that long texts are no harm."""
    value = r'"[^"]*+"|[^"\[\]{},]++'
    for _ in range(levels):
        value = rf'"[^"]*+"|[^"\[\]{{}},]++|[\[{{](?:{value}|,)*+[\]}}]'
    return value


_VALUE = _nested(8)

Item = Callable[[Column], Column]


def let(value: Column, then: Item) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def read(text: Column) -> Column:
    """The JSON as VARIANT. A parser that stops at the end of the first value would take `1 apple` for a number, so that
    the text is read as a list of one."""
    half = F.contains(text, F.lit(r"\u")) & text.rlike(_HALF)  # the pattern is slow, and few texts have an escape at all
    one = lambda whole: F.when((F.size(whole) == 1) & ~half, F.get(whole, 0))
    return let(variants(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))), one)


def of_json(text: Column, then: Item) -> Column:
    """then(the JSON of the text), null where it has none."""
    return let(read(text), lambda value: F.when(value.isNotNull(), then(value)))


def variants(value: Column) -> Column:
    """The items of a list, null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def entries(value: Column) -> Column:
    """(key, value) of an object in the order of its keys, null for anything else."""
    return F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))


def dump(value: Column) -> Column:
    """A VARIANT, not null, as JSON."""
    return F.to_json(value)


def quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.to_json(text.cast("variant"))


def value_at(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def opened(text: Column, first: Column, inner: Item, done: Item, steps: int = 1) -> Column:
    """What done(items) makes of `first`, an array of structs with a flag `open`, once each open item has given way to its
    inner(item) where it stands, or is closed if that is null.

    A JSON text has no more levels than brackets, and no more than the parser reads; `steps` for each level are taken,
    and those beyond the last one cost nothing."""
    brackets = F.length(text) - F.length(F.translate(text, "[{", ""))
    most = F.sequence(F.lit(0), steps * F.least(F.lit(DEPTH), brackets + 1))
    state = lambda items: F.struct(items.alias("items"), F.exists(items, lambda x: x["open"]).alias("more"))
    give = lambda x: F.when(x["open"], F.coalesce(inner(x), F.array(x.withField("open", F.lit(False))))).otherwise(F.array(x))
    step = lambda s, _: F.when(s["more"], let(F.flatten(F.transform(s["items"], give)), state)).otherwise(s)
    return F.aggregate(most, F.struct(first.alias("items"), F.lit(True).alias("more")), step, lambda s: done(s["items"]))


def descended(text: Column, x: Column, inner: Item, closed: Item, join: Item, levels: int = LEVELS) -> Column:
    """join of closed(item) of every item that is left once those that are open, and x first, have given way to their inner
    ones, as by `opened`. Down to some levels each item is walked once, where `opened` makes a new list for each level of
    the text; levels beyond them are opened."""
    below = inner(x)
    if levels:
        walked = join(F.transform(below, lambda y: descended(text, y, inner, closed, join, levels - 1)))
        return F.coalesce(F.when(x["open"], walked), closed(x))
    rest = opened(text, F.array(x), inner, lambda items: join(F.transform(items, closed)))
    return F.coalesce(F.when(x["open"] & below.isNotNull(), rest), closed(x))


def _text_of(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def kind(json: Column) -> Column:
    """null, boolean, number, string, list or object, from the first character."""
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, ('"', "string", "{", "object", "[", "list", "t", "boolean", "f", "boolean", "n", "null"))), F.substring(json, 1, 1)), F.lit("number"))


def _under(path: Column, key: Column) -> Column:
    return F.concat_ws(".", F.nullif(path, F.lit("")), key)


def leaves(text: Column, through_lists: bool = True, fields: tuple[str, ...] = ("path", "key", "kind", "value", "text")) -> Column:
    """(path, key, kind, value, text): the scalars with their dotted paths and nearest keys, as JSON and, if they are
    strings, as they read; lists count as leaves unless they are walked through. Only the fields asked for are made."""
    carried = [c for c in ("path", "key") if c in fields]

    def node(path, key, value):
        at = {"path": path, "key": key}
        return F.struct(*[at[c].alias(c) for c in carried], value.alias("value"), F.lit(True).alias("open"))

    def inner(x):
        path, key = (x[c] if c in carried else None for c in ("path", "key"))
        below = F.transform(entries(x["value"]), lambda e: node(path is not None and _under(path, e["key"]), e["key"], e["value"]))
        return F.coalesce(below, F.transform(variants(x["value"]), lambda v: node(path, key, v))) if through_lists else below

    def leaf(x):
        made = {"kind": kind, "value": lambda j: j, "text": lambda j: F.when(F.startswith(j, F.lit('"')), x["value"].cast("string"))}
        return let(dump(x["value"]), lambda j: F.struct(*[(x[c] if c in carried else made[c](j)).alias(c) for c in fields]))

    first = lambda value: node(F.lit(""), F.lit(None).cast("string"), value)
    return of_json(text, lambda value: descended(text, first(value), inner, lambda x: F.array(leaf(x)), F.flatten))


def keys(text: Column) -> Column:
    """The keys of objects at any depth, each once, in order."""
    node = lambda key, value, is_open: F.struct(key.alias("key"), value.alias("value"), is_open.alias("open"))
    no = F.lit(None).cast("string")

    def inner(x):
        named = F.concat(F.array(node(x["key"], F.lit(None).cast("variant"), F.lit(False))), F.transform(entries(x["value"]), lambda e: node(e["key"], e["value"], F.lit(True))))
        return F.coalesce(named, F.concat(F.array(node(x["key"], F.lit(None).cast("variant"), F.lit(False))), F.transform(variants(x["value"]), lambda v: node(no, v, F.lit(True)))))

    every = lambda value: descended(text, node(no, value, F.lit(True)), inner, lambda x: F.array(x["key"]), F.flatten)
    return of_json(text, lambda value: F.array_sort(F.array_distinct(F.array_compact(every(value)))))


def _rewritten(text: Column, of_object: Callable[[Column], Column], blank: str = "") -> Column:
    """The JSON with other entries for those of each object: of_object(entries) gives (key, value, instead), where
    `instead`, if not null, is the JSON that stands there. Items are pieces of the text, in order."""
    piece = lambda before, value: F.struct(before.alias("before"), value.alias("value"), value.isNotNull().alias("open"))
    only = lambda before: F.array(piece(before, F.lit(None).cast("variant")))
    comma = lambda i: F.when(i > 0, f",{blank}").otherwise("")

    def inner(x):
        entry = lambda e, i: piece(F.concat(comma(i), quoted(e["key"]), F.lit(f":{blank}"), F.coalesce(e["instead"], F.lit(""))), F.when(e["instead"].isNull(), e["value"]))
        own = of_object(entries(x["value"]))
        of_list = F.transform(variants(x["value"]), lambda v, i: piece(comma(i), v))
        return F.coalesce(F.concat(only(F.concat(x["before"], F.lit("{"))), F.transform(own, entry), only(F.lit("}"))), F.concat(only(F.concat(x["before"], F.lit("["))), of_list, only(F.lit("]"))))

    closed = lambda x: F.concat(x["before"], F.when(x["value"].isNull(), "").otherwise(dump(x["value"])))
    return of_json(text, lambda value: descended(text, piece(F.lit(""), value), inner, closed, _text_of))


def spaced(text: Column) -> Column:
    """The JSON with the keys of all objects in order and blanks after commas and colons."""
    return _rewritten(text, lambda own: F.transform(own, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit(None).cast("string").alias("instead"))), " ")


def redacted(text: Column) -> Column:
    """Values under keys that speak of keys or tokens give way to a mark. Where no string has an escape and no value more
    levels than the pattern, they are found in the canonical text, else on a walk."""
    mark = lambda e: F.when(F.lower(e["key"]).rlike("key|token"), '"[REDACTED]"')
    walked = lambda json: _rewritten(json, lambda own: F.transform(own, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), mark(e).alias("instead"))))
    plain = lambda json: ~F.contains(json, F.lit("\\")) & json.rlike(rf"\A(?:{_VALUE})\z")
    pattern = rf'(?iu)("(?=[^"]*?(?:key|token))[^"]*+":)(?:{_VALUE})'
    return let(canonical(text), lambda json: F.when(plain(json), F.regexp_replace(json, F.lit(pattern), F.lit('$1"[REDACTED]"'))).otherwise(walked(json)))


def pruned(text: Column, drop: tuple[str, ...]) -> Column:
    """Without entries that are null or have one of these keys."""
    stays = lambda e: ~F.is_variant_null(e["value"]) & ~e["key"].isin(*drop)
    return _rewritten(text, lambda own: F.transform(F.filter(own, stays), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit(None).cast("string").alias("instead"))))


def _paired(texts: list[Column], first: Column, pair: Callable[..., Column], wrap: Callable[[Column, Column], Column], closed: Item, join: Item) -> Column:
    """As `descended`, over two JSON texts at once: where both sides (a, b) are objects, pair(x, key, a, b, i) of each key
    of either, a null side being one that lacks the key."""

    def inner(x):
        a, b = (F.try_variant_get(x[c], "$", "map<string,variant>").alias(c) for c in ("a", "b"))
        keys = lambda m: F.array_sort(F.array_union(F.map_keys(m["a"]), F.map_keys(m["b"])))
        return let(F.struct(a, b), lambda m: wrap(x, F.transform(keys(m), lambda k, i: pair(x, k, F.try_element_at(m["a"], k), F.try_element_at(m["b"], k), i))))

    return descended(F.concat(*texts), first, inner, closed, join)


def merged(base: Column, override: Column) -> Column:
    """Objects merged at all depths; anything else of the second replaces what the first has. A second that is null or no
    JSON changes nothing."""
    item = lambda before, a, b: F.struct(before.alias("before"), a.alias("a"), b.alias("b"), (a.isNotNull() & b.isNotNull()).alias("open"))
    no = F.lit(None).cast("variant")
    only = lambda before: F.array(item(before, no, no))
    pair = lambda x, k, a, b, i: item(F.concat(F.when(i > 0, ",").otherwise(""), quoted(k), F.lit(":")), a, b)
    wrap = lambda x, own: F.concat(only(F.concat(x["before"], F.lit("{"))), own, only(F.lit("}")))
    left = lambda x: F.when(x["b"].isNotNull(), dump(x["b"])).when(x["a"].isNotNull(), dump(x["a"])).otherwise("")
    closed = lambda x: F.concat(x["before"], left(x))
    other = F.coalesce(read(override), F.try_parse_json(F.lit("{}")))  # a type that may be null, as items of the result may
    return of_json(base, lambda a: _paired([base, F.coalesce(override, F.lit(""))], item(F.lit(""), a, other), pair, wrap, closed, _text_of))


def replaced(text: Column, path: str, value: Column) -> Column:
    """With another value (JSON) at a dotted path; null if an object of the path is not there."""

    def put(at: Column, key: str, *rest: str) -> Column:
        def of_own(own):
            new = put(F.get(F.filter(own, lambda e: e["key"] == key), 0)["value"], *rest) if rest else of_json(value, dump)
            others = F.transform(F.filter(own, lambda e: e["key"] != key), lambda e: F.struct(e["key"].alias("key"), dump(e["value"]).alias("json")))
            every = lambda json: F.array_sort(F.concat(others, F.array(F.struct(F.lit(key).alias("key"), json.alias("json")))))
            whole = lambda json: F.concat(F.lit("{"), F.array_join(F.transform(every(json), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["json"])), ","), F.lit("}"))
            return let(new, lambda json: F.when(json.isNotNull(), whole(json)))

        return let(entries(at), of_own)

    return put(read(text), *path.split("."))


def canonical(text: Column) -> Column:
    """The JSON with the keys of all objects in order."""
    return of_json(text, dump)


def is_identifier(key: Column) -> Column:
    return key.endswith("_id") | key.isin("id", "order_id", "transaction_id", "sku", "loan_id", "package")


def exposed(found: Column) -> Column:
    """Of leaves those that tell two views apart: no identifiers, booleans or nulls, nothing below a hash or a list of
    field names."""
    hidden = lambda x: x["path"].rlike(r"(^|\.)(integrity_hash|available_fields)(\.|$)")
    told = lambda x: x["kind"].isin("number", "string") & ~F.coalesce(is_identifier(x["key"]), F.lit(False)) & ~hidden(x)
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, told), lambda x: x["value"])))


def number_set(found: Column) -> Column:
    """Absolute values of the numbers, to nine digits, each once."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["kind"] == "number"), lambda x: F.bround(F.abs(x["value"].cast("double")), 9))))


def string_set(found: Column) -> Column:
    """Strings of four characters or more with a digit: ids, dates, addresses."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: (F.length(x["text"]) >= 4) & x["text"].rlike("[0-9]")), lambda x: x["text"])))


def changed_paths(before: Column, after: Column) -> Column:
    """Paths that one side lacks or whose values differ, as deep as both sides are objects; lists count as values."""
    item = lambda path, a, b: F.struct(path.alias("path"), a.alias("a"), b.alias("b"), (a.isNotNull() & b.isNotNull()).alias("open"))
    pair = lambda x, k, a, b, i: item(_under(x["path"], k), a, b)
    same = lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), dump(x["a"]) == dump(x["b"])).otherwise(False)
    differ = lambda x: F.filter(F.array(x["path"]), lambda _: ~same(x))
    both = lambda a: of_json(after, lambda b: F.array_sort(_paired([before, after], item(F.lit(""), a, b), pair, lambda _, own: own, differ, F.flatten)))
    return of_json(before, both)


def _in_reply(text: Column, of: Item, other: Item) -> Column:
    """of(what stands in the first fence of a reply, else the whole), or, where that is null, of what stands there from its
    first bracket to the last one of that kind, or other(it)."""
    least = lambda body, c: F.coalesce(F.nullif(F.instr(body, c), F.lit(0)), F.lit(2**31 - 1))
    part = lambda body: F.when(least(body, "{") < least(body, "["), span(body, "{", "}")).otherwise(span(body, "[", "]"))
    of_body = lambda body: F.coalesce(of(body), let(part(body), of), other(body))
    return let(F.trim(text), lambda whole: let(F.nullif(F.coalesce(fenced(whole), whole), F.lit("")), of_body))


def coerced(text: Column) -> Column:
    """The JSON that a reply holds: what stands in its first fence, else the whole, as it is or from its first bracket to
    the last one of that kind; a reply without JSON as it is, null if blank."""
    return _in_reply(text, lambda c: F.when(read(c).isNotNull(), c), lambda body: body)


def held(text: Column) -> Column:
    """The same as VARIANT, null for a reply without JSON."""
    return _in_reply(text, read, lambda _: F.lit(None).cast("variant"))
