"""Predicates and classes of variants; alleles and genotypes are strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import as_col
from .sequences import chars


def _first(alt) -> Column:
    return F.substring_index(as_col(alt), ",", 1)


def is_snp(ref, alt) -> Column:
    a = _first(alt)
    return (F.char_length(as_col(ref)) == 1) & (F.char_length(a) == 1) & ~a.isin("*", ".")


def is_indel(ref, alt) -> Column:
    return F.char_length(as_col(ref)) != F.char_length(_first(alt))


def is_transition(ref, alt) -> Column:
    return F.concat(as_col(ref), _first(alt)).isin("AG", "GA", "CT", "TC")


def is_transversion(ref, alt) -> Column:
    return is_snp(ref, alt) & ~is_transition(ref, alt)


def is_multiallelic(alt) -> Column:
    return F.contains(as_col(alt), F.lit(","))


def variant_type(ref, alt) -> Column:
    r, a = as_col(ref), _first(alt)
    n, m = F.char_length(r), F.char_length(a)
    return F.when(a.isin("*", ".") | a.startswith("<"), "Other").when((n == 1) & (m == 1), "Snp").when(n == m, "Mnp").otherwise("Indel")


def _alleles(gt) -> Column:
    return F.split(F.substring_index(as_col(gt), ":", 1), r"[/|]")


def is_het(gt) -> Column:
    a = _alleles(gt)
    return F.size(F.array_distinct(a)) > 1


def is_hom_ref(gt) -> Column:
    return F.forall(_alleles(gt), lambda x: x == "0")


def is_hom_alt(gt) -> Column:
    a = _alleles(gt)
    return (F.size(F.array_distinct(a)) == 1) & ~F.get(a, F.lit(0)).isin("0", ".")


def normalize_variant(pos, ref, alt) -> Column:
    """(pos, ref, alt) without shared ends: first the suffix, then the prefix, one base left at least."""
    r, a = as_col(ref), _first(alt)
    most = F.least(F.char_length(r), F.char_length(a)) - 1
    shared = lambda x, y, n: F.coalesce(F.array_max(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.when(F.left(x, i) == F.left(y, i), i)), lambda i: i.isNotNull())), F.lit(0))
    tail = shared(F.reverse(r), F.reverse(a), most)
    r2, a2 = F.left(r, F.char_length(r) - tail), F.left(a, F.char_length(a) - tail)
    head = shared(r2, a2, F.least(F.char_length(r2), F.char_length(a2)) - 1)
    return F.struct((as_col(pos) + head).alias("pos"), F.substr(r2, head + 1, F.lit(2**31 - 1)).alias("ref"), F.substr(a2, head + 1, F.lit(2**31 - 1)).alias("alt"))


def decompose_mnp(pos, ref, alt) -> Column:
    """An array of (pos, ref, alt), one for each base that differs."""
    r, a = as_col(ref), _first(alt)
    each = F.zip_with(chars(r), chars(a), lambda x, y: F.struct(x.alias("r"), y.alias("a")))
    placed = F.transform(each, lambda x, i: F.struct((as_col(pos) + i).alias("pos"), x["r"].alias("ref"), x["a"].alias("alt")))
    return F.when(F.char_length(r) == F.char_length(a), F.filter(placed, lambda x: x["ref"] != x["alt"])).otherwise(F.array(F.struct(as_col(pos).alias("pos"), r.alias("ref"), a.alias("alt"))))
