"""Functions over DNA, RNA and protein strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import as_col

# fixed values: the standard genetic code, codons in the order T, C, A, G of each place
_BASES = "TCAG"
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}
# fixed values: IUPAC codes and the bases they stand for
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
# fixed values: recognition sites of restriction enzymes
ENZYMES = {"EcoRI": "GAATTC", "BamHI": "GGATCC", "HindIII": "AAGCTT", "NotI": "GCGGCCGC", "XhoI": "CTCGAG", "NdeI": "CATATG", "XbaI": "TCTAGA", "SalI": "GTCGAC", "PstI": "CTGCAG", "SmaI": "CCCGGG", "KpnI": "GGTACC", "SacI": "GAGCTC"}


def chars(s) -> Column:
    """The characters of a string, as an array."""
    return F.filter(F.split(as_col(s), ""), lambda c: c != "")


def dna(s) -> Column:
    """The sequence, or null if it is no DNA."""
    s = as_col(s)
    return F.when(s.rlike("^[ACGTNacgtnRYSWKMBDHVryswkmbdhv-]*$"), s)


def rna(s) -> Column:
    s = as_col(s)
    return F.when(s.rlike("^[ACGUNacgunRYSWKMBDHVryswkmbdhv-]*$"), s)


def validate_seq(s) -> Column:
    s = as_col(s)
    return F.struct(s.rlike("^[ACGTNacgtn]*$").alias("valid"), F.char_length(s).cast("long").alias("length"))


def transcribe(s) -> Column:
    return F.translate(as_col(s), "Tt", "Uu")


def complement(s) -> Column:
    return F.translate(as_col(s), "ATGCatgc", "TACGtacg")


def reverse_complement(s) -> Column:
    return F.reverse(complement(s))


def seq_len(s) -> Column:
    return F.char_length(as_col(s)).cast("long")


def subseq(s, start: int, end: int | None = None) -> Column:
    return F.substring(as_col(s), start + 1, 2**31 - 1 if end is None else end - start)


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("long")


def gc_content(s) -> Column:
    """Share of G and C; 0 for the empty sequence."""
    s = as_col(s)
    n = F.char_length(s)
    return F.when(n == 0, 0.0).otherwise((n - F.char_length(F.translate(s, "GCgc", ""))) / n)


def base_counts(s) -> Column:
    s = as_col(s)
    one = {b: (F.char_length(s) - F.char_length(F.translate(s, b + b.lower(), ""))).cast("long") for b in "ATGCN"}
    return F.struct(*[c.alias(b) for b, c in one.items()], gc_content(s).alias("GC"))


def codons(s) -> Column:
    """Whole codons in frame 0, upper case, U read as T."""
    s = F.translate(F.upper(as_col(s)), "U", "T")
    n = F.floor(F.char_length(s) / 3)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(s, (3 * i + 1).cast("int"), F.lit(3)))).otherwise(F.array().cast("array<string>"))


def _amino(codon: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, codon), F.lit("X"))


def translate(s) -> Column:
    """Amino acids up to the first stop."""
    return F.regexp_replace(F.array_join(F.transform(codons(s), _amino), ""), r"\*.*$", "")


def codon_usage(s) -> Column:
    c = codons(s)
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(c)), lambda x: F.struct(x.alias("k"), F.size(F.filter(c, lambda y: y == x)).cast("long").alias("v"))))


def kmers(s, k: int) -> Column:
    """All substrings of k characters."""
    s = as_col(s)
    return F.when(F.char_length(s) >= k, F.transform(F.sequence(F.lit(1), F.char_length(s) - k + 1), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_canonical(x) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    x = as_col(x)
    return F.least(x, reverse_complement(x))


def kmer_encode(x) -> Column:
    """Two bits a base (A 0, C 1, G 2, T 3), the first base highest; up to 32 bases."""
    digits = chars(F.translate(F.upper(as_col(x)), "ACGT", "0123"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: F.shiftleft(a, 2).bitwiseOR(d.cast("long")))


def kmer_decode(n, k: int) -> Column:
    n = as_col(n).cast("long")
    base = lambda i: F.shiftrightunsigned(n, 2 * (k - 1 - i)).bitwiseAND(F.lit(3).cast("long")).cast("int")
    return F.concat(*[F.substr(F.lit("ACGT"), base(i) + 1, F.lit(1)) for i in range(k)])


def kmer_rc(n, k: int) -> Column:
    return kmer_encode(reverse_complement(kmer_decode(n, k)))


def find_motif(s, motif: str) -> Column:
    """Places (from 0) of a motif, overlapping ones too, in either case."""
    s, m = F.upper(as_col(s)), motif.upper()
    n = F.char_length(s) - len(m)
    hits = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.substr(s, i + 1, F.lit(len(m))) == m)
    return F.when(n >= 0, F.transform(hits, lambda i: i.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def iupac_pattern(motif: str) -> str:
    return "(?i)" + "".join(f"[{IUPAC[c]}]" if len(IUPAC.get(c, c)) > 1 else IUPAC.get(c, c) for c in motif.upper())


def motif_count(s, motif: str) -> Column:
    return _count(as_col(s), iupac_pattern(motif))


def motif_find(s, motif: str) -> Column:
    """(start, end, match) of the matches, which do not overlap."""
    s, p = as_col(s), iupac_pattern(motif)
    gaps, hits = (F.regexp_extract_all(s, F.lit(rf"\G(?s)(.*?)({p})"), F.lit(g)) for g in (1, 2))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.char_length(x["gap"])
        b = a + F.char_length(x["hit"])
        return F.struct(b.alias("at"), F.array_append(acc["out"], F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("match"))).alias("out"))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start, step, lambda acc: acc["out"])


def restriction_sites(s, enzyme: str) -> Column:
    """Places of an enzyme's site, or of a literal one."""
    return find_motif(s, ENZYMES.get(enzyme, enzyme))


def tm(s) -> Column:
    """Melting temperature: 2 a weak and 4 a strong base below 14 bases, else 64.9 + 41 (G + C - 16.4) / n."""
    s = F.upper(as_col(s))
    n = F.char_length(s)
    gc = n - F.char_length(F.translate(s, "GC", ""))
    at = n - F.char_length(F.translate(s, "AT", ""))
    return F.when(n < 14, (2 * at + 4 * gc).cast("double")).otherwise(64.9 + 41 * (gc - 16.4) / n)


def find_orfs(s, least: int = 30) -> Column:
    """Open frames of the forward strand from ATG to a stop: (start, end, frame)."""
    s = F.upper(as_col(s))
    frames = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda f: F.struct(f.alias("f"), codons(F.substr(s, f + 1, F.lit(2**31 - 1))).alias("c")))
    is_stop = lambda c: c.isin("TAA", "TAG", "TGA")

    def of(x: Column) -> Column:
        start = F.struct(F.lit(-1).alias("open"), F.array().cast("array<struct<start:int,end:int,frame:int>>").alias("out"), F.lit(0).alias("i"))

        def step(a: Column, c: Column) -> Column:
            begin, end = x["f"] + 3 * a["open"], x["f"] + 3 * a["i"] + 3
            done = (a["open"] >= 0) & is_stop(c)
            out = F.when(done & (end - begin >= least), F.array_append(a["out"], F.struct(begin.alias("start"), end.alias("end"), x["f"].alias("frame")))).otherwise(a["out"])
            opened = F.when(done, -1).when((a["open"] < 0) & (c == "ATG"), a["i"]).otherwise(a["open"])
            return F.struct(opened.alias("open"), out.alias("out"), (a["i"] + 1).alias("i"))

        return F.aggregate(x["c"], start, step, lambda a: a["out"])

    return F.flatten(F.transform(frames, of))


def sketch(s, k: int = 21, n: int = 1000) -> Column:
    """The n smallest hashes of the distinct canonical k-mers."""
    hashes = F.transform(F.array_distinct(F.transform(kmers(F.upper(as_col(s)), k), kmer_canonical)), lambda x: F.xxhash64(x))
    return F.slice(F.sort_array(hashes), 1, n)


def sketch_dist(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(1 - F.size(F.array_intersect(a, b)) / n)


def ani(a, b, k: int = 21) -> Column:
    """Jaccard similarity of canonical k-mers."""
    x, y = (F.array_distinct(F.transform(kmers(F.upper(as_col(s)), k), kmer_canonical)) for s in (a, b))
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / n)


def containment(a, b, k: int = 21) -> Column:
    x, y = (F.array_distinct(F.transform(kmers(F.upper(as_col(s)), k), kmer_canonical)) for s in (a, b))
    return F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def _phred(q) -> Column:
    return F.transform(chars(q), lambda c: F.ascii(c) - 33)


def mean_phred(q) -> Column:
    p = _phred(q)
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)


def min_phred(q) -> Column:
    return F.array_min(_phred(q)).cast("long")


def error_rate(q) -> Column:
    p = _phred(q)
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), -x / 10)) / F.size(p)
