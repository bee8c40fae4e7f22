"""Kinds of values.  A column has one type in all its rows, so most tests look at the type alone; they are false for null,
as a missing value is of no kind but nil.  Sequences, k-mers and qualities are texts, told by their letters; intervals,
variants, genes, genomes and reads are structs, told by their fields."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._args import as_col

#: Fields that make a struct one of these kinds.
INTERVAL = ("chrom", "start", "end")
VARIANT = ("chrom", "pos", "ref", "alt")
GENE = ("symbol", "chrom", "start", "end")
GENOME = ("name", "chromosomes")
READ = ("qname", "flag", "rname", "pos", "cigar")


def _typed(pattern: str) -> Callable[[Column | str], Column]:
    def test(x) -> Column:
        x = as_col(x)
        return x.isNotNull() & F.typeof(x).rlike(f"^({pattern})")

    return test


def _fields(names: tuple[str, ...]) -> Callable[[Column | str], Column]:
    def test(x) -> Column:
        x = as_col(x)
        kind = F.typeof(x)
        found = F.lit(True)
        for n in names:
            found = found & kind.rlike(f"[<,]{n}:")
        return x.isNotNull() & kind.startswith("struct<") & found

    return test


def _spelt(pattern: str) -> Callable[[Column | str], Column]:
    def test(x) -> Column:
        x = as_col(x)
        return F.coalesce((F.typeof(x) == "string") & x.cast("string").rlike(pattern), F.lit(False))

    return test


def is_nil(x) -> Column:
    return as_col(x).isNull()


is_int = _typed("tinyint|smallint|int|bigint")
is_float = _typed("float|double")
is_num = _typed("tinyint|smallint|int|bigint|float|double|decimal")
is_str = _typed("string|varchar|char")
is_bool = _typed("boolean")
is_list = _typed("array<")
is_map = _typed("map<")
is_record = _typed("struct<")
is_matrix = _typed("array<array<")
is_interval, is_variant, is_gene, is_genome, is_aligned_read = map(_fields, (INTERVAL, VARIANT, GENE, GENOME, READ))
is_range, is_sparse, is_enum = _fields(("start", "stop", "step")), _fields(("i", "j", "v")), _fields(("variant", "value"))
is_dna = _spelt("^[ACGTNacgtn]+$")
is_rna = _spelt("^[ACGUNacgun]+$")
is_protein = _spelt(r"^[ACDEFGHIKLMNPQRSTVWYXacdefghiklmnpqrstvwyx*]+$")
is_kmer = _spelt("^[ACGT]{1,32}$")
is_quality = _spelt("^[!-~]+$")


def is_set(x) -> Column:
    """An array without repeats."""
    x = as_col(x)
    return F.coalesce(F.typeof(x).startswith("array<") & (F.size(F.array_distinct(x)) == F.size(x)), F.lit(False))


def is_regex(x) -> bool:
    return isinstance(x, re.Pattern)


def is_future(x) -> bool:
    return hasattr(x, "result") and hasattr(x, "done")


def is_table(x) -> bool:
    return isinstance(x, DataFrame)


def is_stream(x) -> bool:
    return isinstance(x, DataFrame) and x.isStreaming


def is_function(x) -> bool:
    return callable(x)


def typeof(x) -> Column:
    """The kind's name: Nil, Int, Float, Str, Bool, List, Map, Record; Spark's own name for any other."""
    x = as_col(x)
    kind = F.typeof(x)
    named = F.when(x.isNull(), "Nil").when(kind.rlike("^(tinyint|smallint|int|bigint)$"), "Int").when(kind.rlike("^(float|double|decimal)"), "Float").when(kind == "string", "Str")
    named = named.when(kind == "boolean", "Bool").when(kind.startswith("array<"), "List").when(kind.startswith("map<"), "Map").when(kind.startswith("struct<"), "Record")
    return named.otherwise(kind)


type_ = typeof


def to_string(x) -> Column:
    """The value as text: nil for null, JSON for lists, maps and records."""
    x = as_col(x)
    return F.coalesce(x.cast("string"), F.lit("nil"))


str_ = to_string


def compare(a, b) -> Column:
    """-1, 0 or 1; null where either is."""
    a, b = as_col(a), as_col(b)
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def coalesced(*xs) -> Column:
    """The first that is not null: `a ?? b`."""
    return F.coalesce(*map(as_col, xs))


def in_(x, items) -> Column:
    """Whether x is among the items (a list, or an array column)."""
    return as_col(x).isin(list(items)) if isinstance(items, list | tuple | set) else F.array_contains(as_col(items), as_col(x))


def not_in(x, items) -> Column:
    return ~in_(x, items)


def given(*branches, otherwise=None) -> Column:
    """Conditions and values in turn; the first condition that holds decides."""
    out = None
    for test, value in zip(branches[::2], branches[1::2], strict=True):
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def match(x, cases: dict, otherwise=None) -> Column:
    """The value of the case that x equals."""
    x = as_col(x)
    return given(*[part for k, v in cases.items() for part in (x.eqNullSafe(F.lit(k)), F.lit(v))], otherwise=otherwise)


# ---------------------------------------------------------------- records of these kinds


def variant(chrom, pos, ref, alt) -> Column:
    return F.struct(*[as_col(x).alias(n) for n, x in zip(VARIANT, (chrom, pos, ref, alt), strict=True)])


def gene(symbol, chrom, start, end) -> Column:
    return F.struct(*[as_col(x).alias(n) for n, x in zip(GENE, (symbol, chrom, start, end), strict=True)])


def genome(name, chromosomes) -> Column:
    """A name and a map of chromosomes to lengths."""
    return F.struct(*[as_col(x).alias(n) for n, x in zip(GENOME, (name, chromosomes), strict=True)])


def aligned_read(qname, flag, rname, pos, cigar) -> Column:
    return F.struct(*[as_col(x).alias(n) for n, x in zip(READ, (qname, flag, rname, pos, cigar), strict=True)])


def protein(s) -> Column:
    """The sequence in upper case; null if a letter is no amino acid."""
    s = as_col(s)
    return F.when(is_protein(s), F.upper(s))
