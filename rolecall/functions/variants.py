"""JSON of unknown shape, as VARIANT expressions. Keys of an object are visited in sorted order, as VARIANT stores them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import vocab as V
from .text import clean

_ENTRY = "array<struct<k:string,v:variant>>"


def parse(text: Column) -> Column:
    """Parsed JSON, NULL when it is none; raw control characters inside strings are tolerated."""
    return F.try_parse_json(F.regexp_replace(text, r"[\x00-\x1f]", " "))


def nesting(text: Column) -> Column:
    """How deep brackets nest, at least 1: the number of levels a walk has to visit."""
    bare = F.regexp_replace(text, r'"(?>[^"\\]+|\\.)*+"', "")
    brackets = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, b: Column) -> Column:
        now = acc["now"] + F.when(b.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.greatest(F.aggregate(brackets, start, step, lambda acc: acc["top"]), F.lit(1))


def let(value: Column, use) -> Column:
    """`use(value)` with the value worked out once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def items(v: Column) -> Column:
    """Elements of an array, NULL for anything else."""
    return v.try_cast("array<variant>")


def fields(v: Column) -> Column:
    """Entries (key, value) of an object, NULL for anything else."""
    return F.map_entries(v.try_cast("map<string,variant>"))


def is_object(v: Column) -> Column:
    return v.try_cast("map<string,variant>").isNotNull()


def is_nested(v: Column) -> Column:
    return items(v).isNotNull() | is_object(v)


def get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def scalar(v: Column) -> Column:
    """Text of a string, number or boolean; NULL for objects, arrays and null."""
    return let(v, lambda x: F.when(~is_nested(x), F.try_variant_get(x, "$", "string")))


def is_string(v: Column) -> Column:
    return F.coalesce(let(v, lambda x: ~is_nested(x) & (kind(x) == "STRING")), F.lit(False))


def text(v: Column) -> Column:
    """A JSON string; NULL for anything else, numbers included."""
    return let(v, lambda x: F.when(~is_nested(x) & (kind(x) == "STRING"), F.try_variant_get(x, "$", "string")))


def is_true(v: Column) -> Column:
    return F.coalesce(let(v, lambda x: ~is_nested(x) & (kind(x) == "BOOLEAN") & (F.try_variant_get(x, "$", "string") == "true")),
                      F.lit(False))


def number(v: Column) -> Column:
    """A JSON number as DOUBLE; strings that look like numbers stay NULL."""
    return let(v, lambda x: F.when(~is_nested(x) & ~kind(x).isin("STRING", "BOOLEAN"), F.try_variant_get(x, "$", "double")))


def filled(v: Column) -> Column:
    """Neither null nor an empty text, array or object."""
    return F.coalesce(~F.try_variant_get(v, "$", "string").isin("", "[]", "{}"), v.isNotNull() & ~F.is_variant_null(v))


def lowered(v: Column) -> Column:
    """An object's filled entries with lower-case keys; of keys equal but for case, the last stays."""
    low = F.transform(fields(v), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v"))).cast(_ENTRY)

    def last_of_each(entries: Column) -> Column:
        repeated = F.size(F.array_distinct(F.transform(entries, lambda e: e["k"]))) < F.size(entries)
        single = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
        return F.filter(F.when(repeated, single).otherwise(entries), lambda e: filled(e["v"]))

    return let(low, last_of_each)


def first_entry(entries: Column, keys: Sequence[str]) -> Column:
    """The entry (k, v) under the first of `keys` that is there (entries made with `lowered`)."""
    names = F.array(*[F.lit(k) for k in dict.fromkeys(k.lower() for k in keys)])
    ranks = F.filter(F.transform(entries, lambda e: F.array_position(names, e["k"])), lambda r: r > 0)
    return let(F.try_element_at(names, F.array_min(ranks).cast("int")),
               lambda best: F.get(F.filter(entries, lambda e: e["k"] == best), F.lit(0)))


def by_key(entries: Column) -> Column:
    """Entries made with `lowered` as a map: where many keys are looked up, this is much less work than `first_entry`."""
    return F.map_from_entries(entries)


def first_entry_in(values: Column, keys: Sequence[str]) -> Column:
    """`first_entry` of a map made with `by_key`."""
    return F.coalesce(*[F.when(values[k].isNotNull(), F.struct(F.lit(k).alias("k"), values[k].alias("v")))
                        for k in dict.fromkeys(k.lower() for k in keys)])


def first_in(values: Column, keys: Sequence[str]) -> Column:
    """`first_of` of a map made with `by_key`."""
    return F.coalesce(*[values[k] for k in dict.fromkeys(k.lower() for k in keys)])


def first_of(entries: Column, keys: Sequence[str]) -> Column:
    return first_entry(entries, keys)["v"]


def first_key(entries: Column, keys: Sequence[str]) -> Column:
    return first_entry(entries, keys)["k"]


def has_any(entries: Column, keys: Sequence[str]) -> Column:
    names = [k.lower() for k in keys]
    return F.exists(entries, lambda e: e["k"].isin(names))


def readable(v: Column, depth: int = 3) -> Column:
    """Text of a scalar, of an object's name-like field or place fields, or of a list of those; booleans have none."""
    def plain(x: Column) -> Column:
        return F.when(~is_nested(x) & (kind(x) != "BOOLEAN"), clean(F.try_variant_get(x, "$", "string")))

    if depth == 0:
        return let(v, plain)

    def first_text(x: Column, keys: Sequence[str]) -> Column:
        texts = F.transform(F.array(*[get(x, k) for k in keys]), lambda y: F.nullif(plain(y), F.lit("")))
        return F.get(F.filter(texts, lambda t: t.isNotNull()), F.lit(0))

    def joined(values: Column, how: str) -> Column:
        texts = F.filter(F.transform(values, lambda y: readable(y, depth - 1)), lambda t: t.isNotNull())
        return F.nullif(F.array_join(F.array_distinct(texts) if how == " | " else texts, how), F.lit(""))

    def whole(x: Column) -> Column:
        place = F.array(*[get(x, k) for k in ("city", "state", "region", "province", "country", "countryName")])
        return (F.when(items(x).isNotNull(), joined(items(x), " | "))
                .when(is_object(x), F.coalesce(first_text(x, ("name", "label", "title", "text", "value", "displayName")),
                                               joined(place, ", "))).otherwise(plain(x)))

    return F.when(v.isNotNull(), let(v, whole))


def looks_like_posting(v: Column) -> Column:
    """Is an object a posting rather than a filter, a news card or a team page?"""
    def judge(e: Column) -> Column:
        attributes = has_any(e, [*V.LOCATION_KEYS, *V.DEPARTMENT_EVIDENCE, *V.TYPE_KEYS, *V.WORKPLACE_KEYS])
        evidence = has_any(e, V.JOB_ID_KEYS) | (attributes & ~has_any(e, V.COUNT_KEYS))
        return evidence & let(by_key(e), named)

    def named(values: Column) -> Column:
        titled = let(text(first_in(values, V.TITLE_KEYS)), lambda t: (F.length(F.trim(t)) >= 3) & t.rlike("[A-Za-z]"))
        linked = text(first_in(values, V.URL_KEYS)).rlike("^(https?://|/)")
        known = let(first_in(values, V.ID_KEYS), lambda i: i.isNotNull() & ~is_nested(i))
        return titled & (F.coalesce(linked, F.lit(False)) | known)

    return F.coalesce(let(lowered(v), judge), F.lit(False))
