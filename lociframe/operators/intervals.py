"""Genomic intervals: half-open ranges [start, end) of a chromosome.

Range joins go through cells of half a side's mean length, where the starts of the other side meet its ranges; whether a row overlaps
anything comes from running aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import around

BIN = 1 << 14


def interval(chrom, start, end, strand=None) -> Column:
    return F.struct(F.lit(chrom).alias("chrom"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(strand or ".").alias("strand"))


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def _cells(df: DataFrame, widths: DataFrame, own: str, other: str) -> DataFrame:
    """df with its cells: of its start the one of the other side's width, of its range those of its own side's width that it touches."""
    lo = F.floor(F.col("start") / F.col(own))
    count = F.when(F.col("end") > F.col("start"), F.greatest(F.ceil(F.col("end") / F.col(own)) - lo, F.lit(1))).otherwise(0)
    out = df.crossJoin(F.broadcast(widths)).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long"))))
    cell = F.when(F.col("__i") == 0, F.floor(F.col("start") / F.col(other))).otherwise(lo + F.col("__i") - 1)
    return out.withColumns({"__cell": cell, "__of": (F.col("__i") == 0) == F.lit(own == "__a")}).drop("__i", "__a", "__b")


def overlap_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs that overlap: a's columns, b's with the prefix b_.  Of two that overlap, the start of one lies in the other, so starts
    meet ranges in cells of half the mean length of the ranges' side: a side makes four cells a row on average, however long
    its ranges are, and few of the pairs that meet do not overlap."""
    known = "chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL"
    a, b = a.filter(known), b.filter(known)
    half = F.greatest(F.coalesce(F.ceil(F.avg(F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start"))) / 2), F.lit(1)), F.lit(1))
    widths = a.agg(half.alias("__a")).crossJoin(b.agg(half.alias("__b")))
    left, right = _cells(a, widths, "__a", "__b"), _cells(b, widths, "__b", "__a")
    right = right.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], F.col("__cell").alias("__b_cell"), F.col("__of").alias("__b_of"))
    met = (F.col("__cell") == F.col("__b_cell")) & (F.col("__of") == F.col("__b_of")) & (F.col("chrom") == F.col("b_chrom"))
    # of equal starts, that of a counts
    once = (F.col("start") >= F.col("b_start")) == F.col("__of")
    return left.join(right, met & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")) & once).drop("__cell", "__b_cell", "__of", "__b_of")


def _met(a: DataFrame, b: DataFrame, wanted: bool) -> DataFrame:
    """The rows of a that overlap any of b, or those that do not.  Of the rows of b that begin before a row of a ends, the furthest
    end says it, which is a running maximum over both tables in one order: no pairs are made, however many overlap."""
    rows = a.withColumns({"__at": F.col("end"), "__reach": F.lit(None), "__s": F.lit(0)})
    others = b.filter("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").select("chrom", F.col("start").alias("__at"), F.col("end").alias("__reach"), F.lit(1).alias("__s"))
    both = around(rows.unionByName(others, allowMissingColumns=True), "chrom", ["__at", "__s"], before={"__most": (F.max, "__reach", False)}).filter("__s = 0")
    hit = F.coalesce((F.col("__most") > F.col("start")) & F.col("end").isNotNull() & F.col("chrom").isNotNull(), F.lit(False))
    return both.filter(hit if wanted else ~hit).select(*a.columns)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that overlap any of b, once each."""
    return _met(a, b, True)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that overlap none of b."""
    return _met(a, b, False)


def query_overlaps(t: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return t.filter((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))


def count_overlaps(t: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return query_overlaps(t, chrom, start, end).agg(F.count(F.lit(1)).alias("count"))


def bulk_overlaps(t: DataFrame, queries: DataFrame) -> DataFrame:
    pairs = overlap_pairs(queries.select("chrom", "start", "end"), t.select("chrom", "start", "end"))
    return pairs.agg(F.count(F.lit(1)).alias("count"))


def query_nearest(t: DataFrame, chrom: str, pos: int, k: int = 1) -> DataFrame:
    """The k nearest by gap (0 inside)."""
    gap = F.greatest(F.lit(0), F.col("start") - pos, F.lit(pos) - F.col("end") + 1).cast("long")
    return t.filter(F.col("chrom") == chrom).withColumn("distance", gap).orderBy("distance", "start", "end").limit(k)


def closest(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with the least distance between the whole midpoints of its row and any of b (null if its chromosome is not in b).
    Rows of a and points of b are sorted together by range, and the last point of b before and the first after each row come
    from running aggregates with carried edges, so a chromosome may span many tasks."""
    mid = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    rows = a.withColumns({"__m": mid, "__b": F.lit(None).cast("long"), "__s": F.lit(1)})
    points = b.select("chrom", mid.alias("__m")).distinct().withColumns({"__b": F.col("__m"), "__s": F.lit(0)})
    both = rows.unionByName(points, allowMissingColumns=True)
    near = around(both, "chrom", ["__m", "__s"], before={"__lo": (F.max, "__b", True)}, after={"__hi": (F.min, "__b", True)}).filter("__s = 1")
    return near.withColumn("distance", F.least(F.col("__m") - F.col("__lo"), F.col("__hi") - F.col("__m"))).select(*a.columns, "distance")


def merge_intervals(t: DataFrame) -> DataFrame:
    """Overlapping and touching intervals become one."""
    reached = around(t.select("chrom", "start", "end"), "chrom", ["start", "end"], before={"__reach": (F.max, "end", False)})
    fresh = reached.withColumn("__new", F.when(F.col("start") <= F.col("__reach"), 0).otherwise(1)).drop("__reach")
    grouped = around(fresh, "chrom", ["start", "end", "-__new"], before={"__g": (F.sum, "__new", True)})
    return grouped.groupBy("chrom", "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def coverage(t: DataFrame) -> DataFrame:
    """Segments of like depth: chrom, start, end, depth (above 0)."""
    steps = t.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = steps.groupBy("chrom", F.col("e.pos").alias("start")).agg(F.sum("e.d").alias("d"))
    out = around(steps, "chrom", ["start"], before={"depth": (F.sum, "d", True)}, after={"end": (F.min, "start", False)})
    return out.filter("depth > 0").select("chrom", "start", "end", F.col("depth").cast("long").alias("depth"))


def interval_tree(t: DataFrame, width: int = BIN) -> DataFrame:
    """t with its bins, one row for each bin that an interval touches: what lookups join by (chrom, bin)."""
    return t.withColumn("bin", F.explode(_bins(F.col("start"), F.col("end"), width)))


def to_interval(t: DataFrame) -> DataFrame:
    """chrom (or seqid), start, end and strand (a dot where there is none) of each row."""
    chrom = F.col("chrom") if "chrom" in t.columns else F.col("seqid")
    strand = F.col("strand") if "strand" in t.columns else F.lit(".")
    return t.select(chrom.alias("chrom"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), strand.alias("strand"))


#: The systems of coordinates that coord_convert knows.
SYSTEMS = ("bed", "vcf", "gff", "sam")


def _tagged(name: str):
    def run(t: DataFrame) -> DataFrame:
        return t.withColumn("coord_system", F.lit(name))

    run.__doc__ = f"Marks the rows' coordinates as those of {name.upper()} files."
    return run


coord_bed, coord_vcf, coord_gff, coord_sam = map(_tagged, SYSTEMS)


def coord_system(t: DataFrame) -> Column:
    """The system that rows are marked with; null without a mark."""
    return F.col("coord_system") if "coord_system" in t.columns else F.lit(None).cast("string")


def flank(t: DataFrame, size: int) -> DataFrame:
    up = F.struct(F.greatest(F.col("start") - size, F.lit(0)).alias("start"), F.col("start").alias("end"), F.lit("up").alias("side"))
    down = F.struct(F.col("end").alias("start"), (F.col("end") + size).alias("end"), F.lit("down").alias("side"))
    rest = [c for c in t.columns if c not in ("start", "end")]
    return t.select(*rest, F.explode(F.array(up, down)).alias("f")).select(*rest, "f.*").filter("end > start")


def extend(t: DataFrame, size: int) -> DataFrame:
    return t.withColumns({"start": F.greatest(F.col("start") - size, F.lit(0)), "end": F.col("end") + size})


def windows(t: DataFrame, width: int, step: int | None = None) -> DataFrame:
    step = step or width
    starts = F.sequence(F.col("start"), F.greatest(F.col("end") - 1, F.col("start")), F.lit(step).cast("long"))
    rest = [c for c in t.columns if c not in ("start", "end")]
    return t.select(*rest, F.col("end").alias("__e"), F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + width, F.col("__e"))).drop("__e")


def coord_convert(start: Column, source: str, target: str) -> Column:
    """Start between 0-based (bed, sam's file form is 1-based) and 1-based systems."""
    base = {"bed": 0, "vcf": 1, "gff": 1, "sam": 1}
    return start + (base[target] - base[source])


def coord_check(a: str, b: str) -> bool:
    return (a == "bed") == (b == "bed")


def strip_chr(s) -> Column:
    return F.regexp_replace(s, "^chr", "")


def add_chr(s) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.when(s.startswith("chr"), s).otherwise(F.concat(F.lit("chr"), s))


def normalize_chrom(s) -> Column:
    bare = F.regexp_replace(F.col(s) if isinstance(s, str) else s, "(?i)^chr", "")
    return F.concat(F.lit("chr"), F.when(F.upper(bare).isin("M", "MT"), "M").when(F.upper(bare).isin("X", "Y"), F.upper(bare)).otherwise(bare))


def tpm(counts: DataFrame, lengths: DataFrame, key: str = "gene") -> DataFrame:
    """Counts per kilobase, scaled to a million; a missing length counts as 1000."""
    rpk = counts.join(lengths, key, "left").withColumn("rpk", F.col("count") / (F.coalesce(F.col("length"), F.lit(1000)) / 1000))
    total = rpk.agg(F.sum("rpk").alias("total"))
    return rpk.crossJoin(F.broadcast(total)).select(key, "count", (F.col("rpk") / F.col("total") * 1e6).alias("tpm"))


def fpkm(counts: DataFrame, lengths: DataFrame, total: float, key: str = "gene") -> DataFrame:
    length = F.coalesce(F.col("length"), F.lit(1000))
    return counts.join(lengths, key, "left").select(key, "count", (F.col("count") / (total / 1e6 * length / 1e3)).alias("fpkm"))


def cpm(counts: DataFrame, key: str = "gene") -> DataFrame:
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "count", (F.col("count") / F.col("total") * 1e6).alias("cpm"))
