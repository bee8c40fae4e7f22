"""Arrays, sets (arrays without repeats), maps, records and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import as_col


def push(items, x) -> Column:
    return F.array_append(as_col(items), x)


def pop(items) -> Column:
    items = as_col(items)
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def first(items) -> Column:
    return F.get(as_col(items), F.lit(0))


def last(items) -> Column:
    return F.try_element_at(as_col(items), F.lit(-1))


def slice_(items, start: int, end: int | None = None) -> Column:
    items = as_col(items)
    stop = F.size(items) if end is None else F.least(F.lit(end), F.size(items))
    return F.slice(items, F.lit(start + 1), F.greatest(stop - start, F.lit(0)))


def reverse(items) -> Column:
    return F.reverse(as_col(items))


def sort(items, descending: bool = False) -> Column:
    return F.sort_array(as_col(items), not descending)


def unique(items) -> Column:
    return F.array_distinct(as_col(items))


set_ = unique


def flatten(items) -> Column:
    return F.flatten(as_col(items))


def chunk(items, n: int) -> Column:
    items = as_col(items)
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(n))
    return F.filter(F.transform(starts, lambda i: F.slice(items, i, F.lit(n))), lambda x: F.size(x) > 0)


def window(items, n: int) -> Column:
    """All runs of n neighbours."""
    items = as_col(items)
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.slice(items, i, F.lit(n)))).otherwise(F.filter(F.array(items), lambda _: F.lit(False)))


def zip_(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def enumerate_(items) -> Column:
    return F.transform(as_col(items), lambda x, i: F.struct(i.cast("long").alias("index"), x.alias("value")))


def range_(a: int, b: int | None = None, step: int = 1) -> Column:
    low, high = (0, a) if b is None else (a, b)
    return F.array(*[F.lit(v) for v in range(low, high, step)]) if abs((high - low) // step) < 64 else F.sequence(F.lit(low), F.lit(high - (1 if step > 0 else -1)), F.lit(step))


def repeat(x, n: int) -> Column:
    return F.array_repeat(as_col(x), n)


def map_(items, fn) -> Column:
    return F.transform(as_col(items), fn)


def filter_(items, fn) -> Column:
    return F.filter(as_col(items), fn)


def flat_map(items, fn) -> Column:
    return F.flatten(F.transform(as_col(items), fn))


def reduce(items, start, fn, finish=None) -> Column:
    return F.aggregate(as_col(items), start, fn, finish) if finish else F.aggregate(as_col(items), start, fn)


def scan(items, start, fn) -> Column:
    """All states of a left fold."""
    acc = F.struct(start.alias("s"), F.slice(F.array(start), 1, 0).alias("all"))
    return F.aggregate(as_col(items), acc, lambda a, x: F.struct(fn(a["s"], x).alias("s"), F.array_append(a["all"], fn(a["s"], x)).alias("all")), lambda a: a["all"])


def any_(items, fn) -> Column:
    return F.exists(as_col(items), fn)


def all_(items, fn) -> Column:
    return F.forall(as_col(items), fn)


def none(items, fn) -> Column:
    return ~F.exists(as_col(items), fn)


def count_if(items, fn) -> Column:
    return F.size(F.filter(as_col(items), fn)).cast("long")


def find(items, fn) -> Column:
    return F.get(F.filter(as_col(items), fn), F.lit(0))


def find_index(items, fn) -> Column:
    hits = F.filter(F.transform(as_col(items), lambda x, i: F.when(fn(x), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)).cast("long"), F.lit(-1))


def partition(items, fn) -> Column:
    return F.array(F.filter(as_col(items), fn), F.filter(as_col(items), lambda x: ~F.coalesce(fn(x), F.lit(False))))


def sort_by(items, key) -> Column:
    return F.transform(F.array_sort(F.transform(as_col(items), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("v")))), lambda s: s["v"])


def total(items) -> Column:
    return F.aggregate(as_col(items).cast("array<double>"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def mean(items) -> Column:
    return total(items) / F.size(as_col(items))


def union(a, b) -> Column:
    return F.array_union(as_col(a), as_col(b))


def intersection(a, b) -> Column:
    return F.array_intersect(as_col(a), as_col(b))


def difference(a, b) -> Column:
    return F.array_except(as_col(a), as_col(b))


def symmetric_difference(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def is_subset(a, b) -> Column:
    return F.size(F.array_except(as_col(a), as_col(b))) == 0


def is_superset(a, b) -> Column:
    return is_subset(b, a)


def jaccard(a, b) -> Column:
    """0 for two empty sets."""
    a, b = as_col(a), as_col(b)
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def keys(m) -> Column:
    return F.map_keys(as_col(m))


def values(m) -> Column:
    return F.map_values(as_col(m))


def merge(a, b) -> Column:
    """The right map wins."""
    a, b = as_col(a), as_col(b)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def has_key(m, k) -> Column:
    return F.map_contains_key(as_col(m), k)


def remove_key(m, k) -> Column:
    return F.map_filter(as_col(m), lambda key, _: key != k)


def parse_json(s) -> Column:
    return F.try_parse_json(as_col(s))


def json_get(s, path: str) -> Column:
    return F.get_json_object(as_col(s), path)


def json_stringify(x) -> Column:
    return F.to_json(as_col(x), {"pretty": "true"})


def json_keys(s) -> Column:
    return F.json_object_keys(as_col(s))


def parse_info(s, key: str | None = None) -> Column:
    """The map of a `K=V;FLAG` text, flags as "true"; or one key's value."""
    parts = F.filter(F.split(as_col(s), ";"), lambda p: (p != "") & (p != "."))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit("true")).alias("v")))
    # of a key that occurs twice the last value counts
    kept = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]).alias("later"))), lambda p: ~p["later"])
    m = F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))
    return m if key is None else F.try_element_at(m, F.lit(key))


def parse_attr(s, key: str | None = None) -> Column:
    """Attributes of a GFF3 (`k=v;`) or GTF (`k "v";`) line."""
    s = as_col(s)
    gtf = F.contains(s, F.lit('" ')) | F.contains(s, F.lit('";'))
    parts = F.filter(F.transform(F.split(s, ";"), lambda p: F.trim(p)), lambda p: p != "")
    entry = lambda p: F.when(gtf, F.struct(F.substring_index(p, " ", 1).alias("k"), F.regexp_replace(F.regexp_replace(p, r"^\S+\s+", ""), '"', "").alias("v"))).otherwise(F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v")))
    m = F.map_from_entries(F.transform(parts, entry))
    return m if key is None else F.try_element_at(m, F.lit(key))


def parse_qual(q) -> Column:
    """Phred scores of a quality string."""
    return F.transform(F.filter(F.split(as_col(q), ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33).cast("long"))


json_parse = parse_json


def json_pretty(s) -> Column:
    """A JSON text with line breaks and indents; null if it is none."""
    return F.to_json(F.try_parse_json(as_col(s)), {"pretty": "true"})


def parse_vcf_info(s) -> Column:
    """The map of an INFO text to lists of values; a dot alone gives an empty map."""
    return F.transform_values(parse_info(s), lambda _, v: F.split(v, ","))


def take_while(items, test) -> Column:
    """The items before the first that does not meet the test."""
    items = as_col(items)
    stop = F.array_position(F.transform(items, lambda x: F.coalesce(test(x), F.lit(False))), False)
    return F.when(stop > 0, F.slice(items, F.lit(1), (stop - 1).cast("int"))).otherwise(items)
