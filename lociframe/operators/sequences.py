"""Aggregations over sequences, k-mers, variants and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as seq
from ..functions import variants as var
from .tables import around


def exploded_kmers(df: DataFrame, col: str, k: int, canonical: bool = True) -> DataFrame:
    """A row for each k-mer of ACGT."""
    out = df.select(F.explode(seq.kmers(F.upper(F.col(col)), k)).alias("kmer"))
    out = out.filter(~F.col("kmer").rlike("[^ACGT]"))
    return out.select(seq.kmer_canonical("kmer").alias("kmer")) if canonical else out


def kmer_count(df: DataFrame, col: str, k: int, top: int | None = None, canonical: bool = True) -> DataFrame:
    """kmer, count, the most frequent first; ties by k-mer.  Counts are summed in each task before they move."""
    out = exploded_kmers(df, col, k, canonical).groupBy("kmer").agg(F.count(F.lit(1)).alias("count"))
    return out if top is None else out.orderBy(F.desc("count"), "kmer").limit(top)


def kmer_distinct(df: DataFrame, col: str, k: int) -> DataFrame:
    return exploded_kmers(df, col, k).agg(F.count_distinct("kmer").alias("distinct"))


def kmer_spectrum(counts: DataFrame) -> DataFrame:
    return counts.groupBy("count").agg(F.count(F.lit(1)).alias("kmers"))


def de_bruijn_edges(df: DataFrame, col: str, k: int) -> DataFrame:
    pieces = exploded_kmers(df, col, k, canonical=False)
    return pieces.groupBy(F.left("kmer", F.lit(k - 1)).alias("from"), F.right("kmer", F.lit(k - 1)).alias("to")).agg(F.count(F.lit(1)).alias("weight"))


def sequence_stats(df: DataFrame, col: str = "seq") -> DataFrame:
    """count, total, mean, median, min, max, gc, n50: the length at which the longer sequences hold half of all bases.
    Lengths are counted first, so the running sum goes over distinct lengths."""
    n = F.char_length(col).cast("long")
    lengths = df.groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("c"))
    total = lengths.agg(F.sum(F.col("n") * F.col("c")).alias("all"))
    run = around(lengths.withColumn("bases", F.col("n") * F.col("c")), None, ["-n"], before={"run": (F.sum, "bases", True)})
    n50 = run.crossJoin(F.broadcast(total)).filter("2 * run >= all").agg(F.max("n").alias("n50"))
    gc = F.sum(n - F.char_length(F.translate(F.col(col), "GCgc", ""))) / F.sum(n)
    stats = df.agg(F.count(F.lit(1)).alias("count"), F.sum(n).alias("total"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.min(n).alias("min"), F.max(n).alias("max"), gc.alias("gc"))
    return stats.crossJoin(F.broadcast(n50))


def read_stats(reads: DataFrame) -> DataFrame:
    """Totals and qualities of reads (seq, quality)."""
    q = F.transform(seq.chars("quality"), lambda c: F.ascii(c) - 33)
    r = reads.select(F.char_length("seq").cast("long").alias("n"), seq.gc_content("seq").alias("gc"), F.aggregate(q, F.lit(0.0), lambda a, x: a + x).alias("qs"), F.size(F.filter(q, lambda x: x >= 20)).alias("q20"), F.size(F.filter(q, lambda x: x >= 30)).alias("q30"))
    return r.agg(F.count(F.lit(1)).alias("total_reads"), F.sum("n").alias("total_bases"), F.avg("n").alias("mean_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), (F.sum("qs") / F.sum("n")).alias("mean_quality"), (F.sum("q20") / F.sum("n")).alias("q20_pct"), (F.sum("q30") / F.sum("n")).alias("q30_pct"), F.avg("gc").alias("gc_mean"))


def variant_summary(t: DataFrame) -> DataFrame:
    snp, indel = var.is_snp("ref", "alt"), var.is_indel("ref", "alt")
    return t.groupBy(F.col("chrom").alias("group")).agg(F.count(F.lit(1)).alias("total"), F.count_if(snp).alias("snps"), F.count_if(indel).alias("indels"), F.avg("qual").alias("mean_qual"))


def variant_stats(t: DataFrame) -> DataFrame:
    """Counts over single alternatives."""
    each = t.select("ref", F.explode(F.split("alt", ",")).alias("a"), F.contains("alt", F.lit(",")).alias("multi"))
    kind = var.variant_type("ref", "a")
    ts, tv = F.count_if(var.is_transition("ref", "a")), F.count_if(var.is_transversion("ref", "a"))
    return each.agg(F.count_if(kind == "Snp").alias("snp"), F.count_if(kind == "Indel").alias("indel"), F.count_if(kind == "Mnp").alias("mnp"), F.count_if(kind == "Other").alias("other"), ts.alias("ts"), tv.alias("tv"), F.when(tv > 0, ts / tv).otherwise(0.0).alias("ratio"), F.count_if("multi").alias("multiallelic"))


def tstv_ratio(t: DataFrame) -> DataFrame:
    ts, tv = F.count_if(var.is_transition("ref", "alt")), F.count_if(var.is_transversion("ref", "alt"))
    return t.agg(F.when(tv > 0, ts / tv).otherwise(0.0).alias("tstv"))


def het_hom_ratio(t: DataFrame, gt: str = "gt") -> DataFrame:
    het, hom = F.count_if(var.is_het(gt)), F.count_if(var.is_hom_alt(gt))
    return t.agg(F.when(hom > 0, het / hom).otherwise(0.0).alias("ratio"))


# fixed values: bits of a SAM flag
FLAGS = {"paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "read1": 64, "read2": 128, "secondary": 256, "qc_fail": 512, "duplicate": 1024, "supplementary": 2048}


def flagstat(reads: DataFrame) -> DataFrame:
    has = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    return reads.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(has(bit)).alias(name) for name, bit in FLAGS.items()], F.count_if(~has(4)).alias("mapped"))


def consensus(df: DataFrame, col: str) -> DataFrame:
    """(pos, base): the majority of A, C, G, T in each column; of ties the later."""
    cell = df.select(F.posexplode(seq.chars(F.translate(F.upper(F.col(col)), "U", "T"))).alias("pos", "base")).filter(F.col("base").isin("A", "C", "G", "T"))
    return cell.groupBy("pos", "base").count().groupBy("pos").agg(F.max_by("base", F.struct("count", "base")).alias("base"))


def pwm(df: DataFrame, col: str) -> DataFrame:
    """(pos, A, C, G, T): counts by the number of sequences."""
    cell = df.select(F.posexplode(seq.chars(F.upper(F.col(col)))).alias("pos", "base"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    counts = cell.groupBy("pos").agg(*[F.count_if(F.col("base") == b).alias(b) for b in "ACGT"])
    return counts.crossJoin(F.broadcast(n)).select("pos", *[(F.col(b) / F.col("n")).alias(b) for b in "ACGT"])


def conservation_scores(df: DataFrame, col: str) -> DataFrame:
    """(pos, score): 1 - entropy / log2(distinct symbols), without gaps; 1 for one symbol."""
    cell = df.select(F.posexplode(seq.chars(F.upper(F.col(col)))).alias("pos", "s")).filter("s NOT IN ('-', '.')")
    n = cell.groupBy("pos", "s").count()
    total = F.sum("count")
    return n.groupBy("pos").agg(F.when(F.count(F.lit(1)) == 1, 1.0).otherwise(1 - (F.log2(total) - F.sum(F.col("count") * F.log2("count")) / total) / F.log2(F.count(F.lit(1)))).alias("score"))


# ---------------------------------------------------------------- aligned reads (flag, rname, pos, tlen, seq, cigar)


def _flag(bit: int):
    return F.col("flag").bitwiseAND(F.lit(bit)) != 0


def mapping_rate(reads: DataFrame) -> DataFrame:
    mapped = F.count_if(~_flag(4))
    return reads.agg(F.count(F.lit(1)).alias("total"), mapped.alias("mapped"), F.count_if(~_flag(4) & ~_flag(256) & ~_flag(2048)).alias("primary_mapped"), F.count_if(_flag(1)).alias("paired"), F.count_if(_flag(2)).alias("proper_pair"), F.count_if(_flag(1024)).alias("duplicates"), F.count_if(_flag(256)).alias("secondary"), F.count_if(_flag(2048)).alias("supplementary"), (mapped / F.count(F.lit(1))).alias("mapping_rate"))


def insert_size(reads: DataFrame) -> DataFrame:
    """Sizes of proper pairs, from their first reads (positive template lengths)."""
    t = reads.filter(_flag(2) & (F.col("tlen") > 0))
    return t.agg(F.count(F.lit(1)).alias("count"), F.avg("tlen").alias("mean"), F.median("tlen").alias("median"), F.stddev_samp("tlen").alias("std_dev"), F.percentile("tlen", 0.25).alias("p25"), F.percentile("tlen", 0.75).alias("p75"), F.min("tlen").alias("min"), F.max("tlen").alias("max"))


def depth(reads: DataFrame, genome_size: int) -> DataFrame:
    n = F.when(~_flag(4), F.char_length("seq")).otherwise(0)
    return reads.agg(F.count(F.lit(1)).alias("total_reads"), F.count_if(~_flag(4)).alias("mapped_reads"), F.sum(n).cast("long").alias("total_aligned_bases"), F.lit(genome_size).cast("long").alias("genome_size"), (F.sum(n) / genome_size).alias("mean_depth"))


def coverage_hist(reads: DataFrame, bin_size: int = 1000) -> DataFrame:
    """(rname, bin, reads): mapped reads that begin in each bin."""
    return reads.filter(~_flag(4)).groupBy("rname", F.floor((F.col("pos") - 1) / bin_size).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("reads"))


def gc_bias(reads: DataFrame, bins: int = 20) -> DataFrame:
    """(gc_bin, reads) by the share of G and C."""
    return reads.groupBy(F.least(F.floor(seq.gc_content("seq") * bins), F.lit(bins - 1)).cast("long").alias("gc_bin")).agg(F.count(F.lit(1)).alias("reads"))


def on_target(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Share of mapped reads that overlap a region."""
    from . import intervals as iv

    start = F.col("pos") - 1
    spans = reads.filter(~_flag(4)).select(F.monotonically_increasing_id().alias("row"), F.col("rname").alias("chrom"), start.alias("start"), (start + F.char_length("seq")).alias("end"))
    hit = iv.intersect(spans, regions).agg(F.count(F.lit(1)).alias("on"))
    return spans.agg(F.count(F.lit(1)).alias("all")).crossJoin(F.broadcast(hit)).select((F.col("on") / F.greatest("all", F.lit(1))).alias("fraction"))


def qc_report(reads: DataFrame) -> DataFrame:
    """read_stats with the shares of N and of repeated sequences."""
    n = reads.agg((F.sum(F.char_length("seq") - F.char_length(F.translate("seq", "Nn", ""))) / F.sum(F.char_length("seq"))).alias("n_pct"))
    dup = reads.groupBy("seq").count().agg(F.when(F.sum("count") > 0, 1 - F.count(F.lit(1)) / F.sum("count")).alias("duplicate_pct"))
    return read_stats(reads).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(dup))


def liftover(t: DataFrame, chain: DataFrame) -> DataFrame:
    """Intervals (chrom, start, end) to another build by a table of blocks (chrom, start, end, to_chrom, offset) that hold
    them whole."""
    from . import intervals as iv

    met = iv.overlap_pairs(t, chain).filter("start >= b_start AND end <= b_end")
    rest = [c for c in t.columns if c not in ("chrom", "start", "end")]
    return met.select(F.col("b_to_chrom").alias("chrom"), (F.col("start") + F.col("b_offset")).alias("start"), (F.col("end") + F.col("b_offset")).alias("end"), *rest)


def scan_bio(df: DataFrame, col: str) -> DataFrame:
    """(kind, value) of identifiers and sequences in free text."""
    # fixed values: patterns of common identifiers
    kinds = {"rsid": r"\brs[0-9]{3,}\b", "ensembl": r"\bENS[A-Z]*[GTP][0-9]{11}\b", "refseq": r"\b[NX][MRP]_[0-9]{6,}(?:\.[0-9]+)?\b", "go": r"\bGO:[0-9]{7}\b", "dna": r"\b[ACGT]{12,}\b"}
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(col, F.lit(p), F.lit(0)).alias("values")) for k, p in kinds.items()])
    return df.select("*", F.explode(found).alias("__f")).select(*df.columns, F.col("__f.kind").alias("kind"), F.explode("__f.values").alias("value"))
