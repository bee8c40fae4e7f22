"""One query for each column function: a key and the function's value over a whole table, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections as c
from ..functions import dates as d
from ..functions import hashing as h
from ..functions import numbers as n
from ..functions import sequences as q
from ..functions import stats as st
from ..functions import strings as s
from ..functions import variants as v


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DNA = ("0123456789abcdef", "ACGTACGTACGTACGT")
_T1, _T2 = "'0123456789abcdef'", "'ACGTACGTACGTACGT'"
#: name: (Spark rows, SQL rows), each with a key k.
BASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "docs": (lambda sp, p: _table(sp, p, "documents").select(F.col("doc_id").alias("k"), "text", "lang", "source"), "SELECT doc_id AS k, text, lang, source FROM documents"),
    "money": (lambda sp, p: _table(sp, p, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")), "SELECT c_custkey AS k, c_acctbal AS x, c_name AS name, c_mktsegment AS seg FROM customer"),
    "times": (lambda sp, p: _table(sp, p, "events").select(F.col("event_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"), "value", "props", "event_type"), "SELECT event_id AS k, ts, value, props, event_type FROM events"),
    "dna": (
        lambda sp, p: _table(sp, p, "documents").select(F.col("doc_id").alias("k"), F.translate(F.md5("text"), *_DNA).alias("s"), F.translate(F.md5(F.concat("text", F.lit("x"))), *_DNA).alias("t"), F.md5("text").alias("hex")),
        f"SELECT doc_id AS k, translate(md5(text), {_T1}, {_T2}) AS s, translate(md5(text || 'x'), {_T1}, {_T2}) AS t, md5(text) AS hex FROM documents",
    ),
    "alleles": (
        lambda sp, p: _table(sp, p, "documents").select(F.col("doc_id").alias("k"), F.translate(F.md5("text"), *_DNA).alias("s")).select("k", F.expr("substring(s, 1, 1 + cast(k % 3 as int))").alias("ref"), F.expr("substring(s, 5, 1 + cast(k % 2 as int))").alias("alt"), F.expr("concat(k % 2, '/', k % 3)").alias("gt")),
        f"SELECT k, substr(s, 1, 1 + (k % 3)::INT) AS ref, substr(s, 5, 1 + (k % 2)::INT) AS alt, concat(k % 2, '/', k % 3) AS gt FROM (SELECT doc_id AS k, translate(md5(text), {_T1}, {_T2}) AS s FROM documents)",
    ),
    "lists": (
        lambda sp, p: _table(sp, p, "orders").select(F.col("o_orderkey").alias("k"), F.expr("array(o_orderkey % 5, o_custkey % 7, o_orderkey % 3, o_custkey % 4, o_orderkey % 11)").alias("a"), F.expr("array(o_custkey % 5, o_orderkey % 2)").alias("b")),
        "SELECT o_orderkey AS k, [o_orderkey % 5, o_custkey % 7, o_orderkey % 3, o_custkey % 4, o_orderkey % 11] AS a, [o_custkey % 5, o_orderkey % 2] AS b FROM orders",
    ),
}


def _js(x: Column) -> Column:
    return F.array_join(x.cast("array<string>"), ",")


def _r(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits)


_L = lambda e: f"array_to_string({e}, ',')"
_COMP = "translate({}, 'ATGC', 'TACG')"
#: name: (base, Spark column, SQL expression).
SCALARS: dict[str, tuple[str, Callable[[], Column], str]] = {
    # strings
    "upper": ("docs", lambda: s.upper("lang"), "upper(lang)"),
    "lower": ("money", lambda: s.lower("seg"), "lower(seg)"),
    "trim": ("docs", lambda: s.trim(F.concat(F.lit(" \t"), "text", F.lit("\n "))), r"regexp_replace(text, '^\s+|\s+$', '', 'g')"),
    "trim_left": ("docs", lambda: s.trim_left(F.concat(F.lit("\t "), "source")), "source"),
    "trim_right": ("docs", lambda: s.trim_right(F.concat("source", F.lit("\t "))), "source"),
    "starts_with": ("docs", lambda: s.starts_with("text", "Th"), "starts_with(text, 'Th')"),
    "ends_with": ("docs", lambda: s.ends_with("text", "."), "suffix(text, '.')"),
    "contains": ("docs", lambda: s.contains("text", "the"), "contains(text, 'the')"),
    "replace": ("docs", lambda: s.replace("text", "the", "a."), "replace(text, 'the', 'a.')"),
    "str_replace": ("docs", lambda: s.str_replace("text", ".", ""), "replace(text, '.', '')"),
    "split": ("docs", lambda: F.size(s.split("text", ".")).cast("long"), "CAST(len(string_split(text, '.')) AS BIGINT)"),
    "join": ("lists", lambda: s.join("a", "-"), "array_to_string(a, '-')"),
    "substr": ("docs", lambda: s.substr("text", 3, 9), "substr(text, 4, 6)"),
    "char_at": ("docs", lambda: s.char_at("text", 4), "nullif(substr(text, 5, 1), '')"),
    "index_of": ("docs", lambda: s.index_of("text", "an"), "CAST(instr(text, 'an') - 1 AS BIGINT)"),
    "str_len": ("docs", lambda: s.str_len("text"), "CAST(length(text) AS BIGINT)"),
    "byte_len": ("docs", lambda: s.byte_len("text"), "CAST(octet_length(encode(text)) AS BIGINT)"),
    "str_repeat": ("docs", lambda: s.str_repeat("lang", 3), "repeat(lang, 3)"),
    "pad_left": ("docs", lambda: s.pad_left("source", 8, "*"), "CASE WHEN length(source) < 8 THEN lpad(source, 8, '*') ELSE source END"),
    "pad_right": ("docs", lambda: s.pad_right("source", 8, "*"), "CASE WHEN length(source) < 8 THEN rpad(source, 8, '*') ELSE source END"),
    "ascii": ("docs", lambda: s.code_point("lang"), "CAST(ascii(lang) AS BIGINT)"),
    "chr": ("lists", lambda: s.chr_(F.lit(900) + F.get("a", F.lit(4))), "chr((900 + a[5])::INT)"),
    "format": ("docs", lambda: s.format_("{}:{1}-{0}", "lang", "source"), "concat(lang, ':', source, '-', lang)"),
    "lines": ("docs", lambda: F.size(s.lines("text")).cast("long"), r"CAST(len(regexp_split_to_array(text, '\r?\n')) AS BIGINT)"),
    "cut": ("docs", lambda: s.join(s.cut("text", " ", [0]), "|"), r"array_to_string(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: string_split(x, ' ')[1]), '|')"),
    "paste": ("lists", lambda: _js(s.paste("a", "b", "_")), "array_to_string(list_transform([1, 2, 3, 4, 5], lambda i: concat(coalesce(a[i]::VARCHAR, ''), '_', coalesce(b[i]::VARCHAR, ''))), ',')"),
    "wc": ("docs", lambda: s.wc("text")["words"], r"CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT)"),
    "grep": ("docs", lambda: s.join(s.grep("text", "idiot|clown"), "\n"), r"array_to_string(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, 'idiot|clown')), chr(10))"),
    "grep_count": ("docs", lambda: s.grep_count("text", "THE", ignore_case=True), r"CAST(len(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, '(?i)THE'))) AS BIGINT)"),
    "regex_match": ("docs", lambda: s.regex_match("text", "[0-9]{3}"), "regexp_matches(text, '[0-9]{3}')"),
    "regex_find": ("docs", lambda: s.join(s.regex_find("text", "[0-9]+"), ","), "array_to_string(regexp_extract_all(text, '[0-9]+'), ',')"),
    "regex_find_all": ("docs", lambda: F.size(s.regex_find_all("text", "th[a-z]")).cast("long"), "CAST(len(regexp_extract_all(text, 'th[a-z]')) AS BIGINT)"),
    "regex_replace": ("docs", lambda: s.regex_replace("text", "t(h)", "$1T"), r"regexp_replace(text, 't(h)', '\1T', 'g')"),
    "regex_split": ("docs", lambda: F.size(s.regex_split("text", "[,.]")).cast("long"), "CAST(len(regexp_split_to_array(text, '[,.]')) AS BIGINT)"),
    "regex_captures": ("docs", lambda: s.join(s.regex_captures("source", "([a-z]+)([0-9]+)", 2), "/"), "concat(source, '/', regexp_extract(source, '([a-z]+)([0-9]+)', 1), '/', regexp_extract(source, '([a-z]+)([0-9]+)', 2))"),
    "edit_distance": ("dna", lambda: s.edit_distance("s", "t"), "CAST(levenshtein(s, t) AS BIGINT)"),
    "hamming_distance": ("dna", lambda: s.hamming_distance("s", "t"), "CAST(hamming(s, t) AS BIGINT)"),
    # numbers
    "abs": ("money", lambda: n.abs_("x"), "abs(x)"),
    "sqrt": ("money", lambda: _r(n.sqrt(n.abs_("x"))), "round(sqrt(abs(x)), 6)"),
    "pow": ("money", lambda: _r(n.pow_(F.col("x") / 1000, F.lit(3))), "round(pow(x / 1000, 3), 6)"),
    "log": ("money", lambda: _r(n.log(F.abs("x") + 1)), "round(ln(abs(x) + 1), 6)"),
    "log2": ("money", lambda: _r(n.log2(F.abs("x") + 1)), "round(log2(abs(x) + 1), 6)"),
    "log10": ("money", lambda: _r(n.log10(F.abs("x") + 1)), "round(log10(abs(x) + 1), 6)"),
    "exp": ("money", lambda: _r(n.exp(F.col("x") / 10000)), "round(exp(x / 10000), 6)"),
    "ceil": ("money", lambda: n.ceil("x"), "CAST(ceil(x) AS BIGINT)"),
    "floor": ("money", lambda: n.floor("x"), "CAST(floor(x) AS BIGINT)"),
    "round": ("money", lambda: n.round_("x"), "CAST(round(x) AS BIGINT)"),
    "sign": ("money", lambda: n.sign("x"), "CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"),
    "clamp": ("money", lambda: n.clamp("x", F.lit(0.0), F.lit(1000.0)), "least(greatest(x, 0.0), 1000.0)"),
    "sin": ("money", lambda: _r(n.sin("x")), "round(sin(x), 6)"),
    "cos": ("money", lambda: _r(n.cos("x")), "round(cos(x), 6)"),
    "tan": ("money", lambda: _r(n.tan(F.col("x") / 10000)), "round(tan(x / 10000), 6)"),
    "asin": ("money", lambda: _r(n.asin(F.col("x") / 10000)), "round(asin(x / 10000), 6)"),
    "acos": ("money", lambda: _r(n.acos(F.col("x") / 10000)), "round(acos(x / 10000), 6)"),
    "atan": ("money", lambda: _r(n.atan("x")), "round(atan(x), 6)"),
    "atan2": ("money", lambda: _r(n.atan2("x", F.lit(100.0))), "round(atan2(x, 100.0), 6)"),
    "is_nan": ("money", lambda: n.is_nan("x"), "isnan(x)"),
    "is_finite": ("money", lambda: n.is_finite("x"), "isfinite(x)"),
    "pi": ("money", lambda: _r(n.pi() * F.col("x")), "round(pi() * x, 6)"),
    "euler": ("money", lambda: _r(n.euler()), "round(exp(1.0), 6)"),
    "kb": ("lists", lambda: n.kb("k"), "k * 1000"),
    "mb": ("lists", lambda: n.mb("k"), "k * 1000000"),
    "gb": ("lists", lambda: n.gb("k"), "k * 1000000000"),
    "int": ("money", lambda: n.to_int("x"), "CAST(trunc(x) AS BIGINT)"),
    "float": ("lists", lambda: n.to_float("k"), "CAST(k AS DOUBLE)"),
    "bool": ("lists", lambda: n.to_bool(F.get("a", F.lit(0))), "a[1] <> 0"),
    # dates
    "year": ("times", lambda: d.year("ts"), "year(ts)"),
    "month": ("times", lambda: d.month("ts"), "month(ts)"),
    "day": ("times", lambda: d.day("ts"), "day(ts)"),
    "weekday": ("times", lambda: d.weekday("ts"), "dayname(ts)"),
    "date_format": ("times", lambda: d.date_format("ts", "%Y/%m/%d %H:%M:%S"), "strftime(ts, '%Y/%m/%d %H:%M:%S')"),
    "date_parse": ("times", lambda: F.unix_timestamp(d.date_parse(d.date_format("ts", "%Y-%m-%d %H:%M:%S"), "%Y-%m-%d %H:%M:%S")), "CAST(floor(epoch(ts)) AS BIGINT)"),
    "date_add": ("times", lambda: F.date_format(d.date_add("ts", 36, "hours"), "yyyy-MM-dd HH:mm"), "strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M')"),
    "date_diff": ("times", lambda: d.date_diff("ts", F.lit("2020-01-01 00:00:00"), "hours"), "CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) / 3600000000) AS BIGINT)"),
    # arrays, sets, JSON
    "push": ("lists", lambda: _js(c.push("a", F.lit(9).cast("long"))), _L("list_append(a, 9)")),
    "pop": ("lists", lambda: _js(c.pop("a")), _L("a[1:len(a) - 1]")),
    "first": ("lists", lambda: c.first("a"), "a[1]"),
    "last": ("lists", lambda: c.last("a"), "a[-1]"),
    "slice": ("lists", lambda: _js(c.slice_("a", 1, 3)), _L("a[2:3]")),
    "reverse": ("lists", lambda: _js(c.reverse("a")), _L("list_reverse(a)")),
    "sort": ("lists", lambda: _js(c.sort("a")), _L("list_sort(a)")),
    "unique": ("lists", lambda: _js(c.sort(c.unique("a"))), _L("list_sort(list_distinct(a))")),
    "set": ("lists", lambda: F.size(c.set_("a")).cast("long"), "CAST(len(list_distinct(a)) AS BIGINT)"),
    "flatten": ("lists", lambda: _js(c.flatten(F.array("a", "b"))), _L("flatten([a, b])")),
    "chunk": ("lists", lambda: _js(F.transform(c.chunk("a", 2), lambda x: F.size(x))), "'2,2,1'"),
    "window": ("lists", lambda: _js(F.transform(c.window("a", 2), lambda x: F.get(x, F.lit(0)) + F.get(x, F.lit(1)))), _L("list_transform([1, 2, 3, 4], lambda i: a[i] + a[i + 1])")),
    "zip": ("lists", lambda: F.size(c.zip_("a", "b")).cast("long"), "CAST(2 AS BIGINT)"),
    "enumerate": ("lists", lambda: _js(F.transform(c.enumerate_("a"), lambda x: x["index"] * 100 + x["value"])), _L("list_transform([1, 2, 3, 4, 5], lambda i: (i - 1) * 100 + a[i])")),
    "map": ("lists", lambda: _js(c.map_("a", lambda x: x * 2 + 1)), _L("list_transform(a, lambda x: x * 2 + 1)")),
    "filter_list": ("lists", lambda: _js(c.filter_("a", lambda x: x > 2)), _L("list_filter(a, lambda x: x > 2)")),
    "flat_map": ("lists", lambda: _js(c.flat_map("a", lambda x: F.array(x, x + 1))), _L("flatten(list_transform(a, lambda x: [x, x + 1]))")),
    "reduce": ("lists", lambda: c.reduce("a", F.lit(0).cast("long"), lambda x, y: x + y), "CAST(list_sum(a) AS BIGINT)"),
    "scan": ("lists", lambda: _js(c.scan("a", F.lit(0).cast("long"), lambda x, y: x + y)), _L("list_transform([1, 2, 3, 4, 5], lambda i: list_sum(a[1:i])::BIGINT)")),
    "any": ("lists", lambda: c.any_("a", lambda x: x > 6), "len(list_filter(a, lambda x: x > 6)) > 0"),
    "all": ("lists", lambda: c.all_("a", lambda x: x < 6), "len(list_filter(a, lambda x: x < 6)) = len(a)"),
    "none": ("lists", lambda: c.none("a", lambda x: x > 8), "len(list_filter(a, lambda x: x > 8)) = 0"),
    "count_if": ("lists", lambda: c.count_if("a", lambda x: x % 2 == 0), "CAST(len(list_filter(a, lambda x: x % 2 = 0)) AS BIGINT)"),
    "find": ("lists", lambda: c.find("a", lambda x: x > 3), "list_filter(a, lambda x: x > 3)[1]"),
    "find_index": ("lists", lambda: c.find_index("a", lambda x: x > 3), "CAST(coalesce(list_filter([1, 2, 3, 4, 5], lambda i: a[i] > 3)[1], 0) - 1 AS BIGINT)"),
    "partition": ("lists", lambda: F.size(F.get(c.partition("a", lambda x: x > 3), F.lit(1))).cast("long"), "CAST(len(list_filter(a, lambda x: x <= 3)) AS BIGINT)"),
    "sort_by": ("lists", lambda: _js(c.sort_by("a", lambda x: -x)), _L("list_reverse_sort(a)")),
    "sum_list": ("lists", lambda: c.total("a"), "CAST(list_sum(a) AS DOUBLE)"),
    "mean_list": ("lists", lambda: _r(c.mean("a")), "round(list_sum(a) / 5.0, 6)"),
    "union_sets": ("lists", lambda: _js(c.sort(c.union("a", "b"))), _L("list_sort(list_distinct(list_concat(a, b)))")),
    "intersection_sets": ("lists", lambda: _js(c.sort(c.intersection("a", "b"))), _L("list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x))))")),
    "difference_sets": ("lists", lambda: _js(c.sort(c.difference("a", "b"))), _L("list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x))))")),
    "symmetric_difference": ("lists", lambda: _js(c.sort(c.symmetric_difference("a", "b"))), _L("list_sort(list_distinct(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))))")),
    "is_subset": ("lists", lambda: c.is_subset("b", "a"), "len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0"),
    "is_superset": ("lists", lambda: c.is_superset("a", "b"), "len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0"),
    "jaccard": ("lists", lambda: _r(c.jaccard("a", "b")), "round(len(list_distinct(list_filter(a, lambda x: list_contains(b, x))))::DOUBLE / len(list_distinct(list_concat(a, b))), 6)"),
    "json_keys": ("times", lambda: _js(c.sort(c.json_keys("props"))), _L("list_sort(json_keys(props))")),
    "parse_info": ("lists", lambda: c.parse_info(F.concat(F.lit("DP="), F.col("k").cast("string"), F.lit(";DB;AF=0.5")), "DP"), "CAST(k AS VARCHAR)"),
    "parse_attr": ("lists", lambda: c.parse_attr(F.concat(F.lit("ID=g"), F.col("k").cast("string"), F.lit(";Name=x")), "ID"), "concat('g', k)"),
    "parse_qual": ("dna", lambda: _js(c.parse_qual("s")), "array_to_string(list_transform(string_split(s, ''), lambda x: ascii(x) - 33), ',')"),
    # digests
    "md5": ("docs", lambda: h.md5("text"), "md5(text)"),
    "sha1": ("docs", lambda: h.sha1("text"), "sha1(text)"),
    "sha256": ("docs", lambda: h.sha256("text"), "sha256(text)"),
    "base64_encode": ("docs", lambda: h.base64_encode("text"), "base64(encode(text))"),
    "base64_decode": ("docs", lambda: h.base64_decode(h.base64_encode("text")), "text"),
    # sequences
    "transcribe": ("dna", lambda: q.transcribe("s"), "translate(s, 'Tt', 'Uu')"),
    "complement": ("dna", lambda: q.complement("s"), _COMP.format("s")),
    "reverse_complement": ("dna", lambda: q.reverse_complement("s"), f"reverse({_COMP.format('s')})"),
    "seq_len": ("dna", lambda: q.seq_len("s"), "CAST(length(s) AS BIGINT)"),
    "subseq": ("dna", lambda: q.subseq("s", 4, 12), "substr(s, 5, 8)"),
    "gc_content": ("dna", lambda: _r(q.gc_content("s")), "round(length(regexp_replace(s, '[^GC]', '', 'g'))::DOUBLE / length(s), 6)"),
    "base_counts": ("dna", lambda: q.base_counts("s")["A"], "CAST(length(regexp_replace(s, '[^A]', '', 'g')) AS BIGINT)"),
    "dna": ("dna", lambda: q.dna("s"), "s"),
    "rna": ("dna", lambda: q.rna("s"), "CASE WHEN contains(s, 'T') THEN NULL ELSE s END"),
    "validate_seq": ("dna", lambda: q.validate_seq("hex")["valid"], "regexp_full_match(hex, '[ACGTNacgtn]*')"),
    "translate": (
        "dna",
        lambda: q.translate("s"),
        "regexp_replace(array_to_string(list_transform(range(0, 10), lambda i: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', "
        "(16 * (instr('TCAG', substr(s, (3 * i + 1)::INT, 1)) - 1) + 4 * (instr('TCAG', substr(s, (3 * i + 2)::INT, 1)) - 1) + instr('TCAG', substr(s, (3 * i + 3)::INT, 1)))::INT, 1)), ''), '\\*.*$', '')",
    ),
    "codon_usage": ("dna", lambda: F.size(q.codon_usage("s")).cast("long"), "CAST(len(list_distinct(list_transform(range(0, 10), lambda i: substr(s, (3 * i + 1)::INT, 3)))) AS BIGINT)"),
    "kmers": ("dna", lambda: _js(q.kmers("s", 5)), "array_to_string(list_transform(range(1, 29), lambda i: substr(s, i::INT, 5)), ',')"),
    "kmer_canonical": ("dna", lambda: q.kmer_canonical("s"), f"least(s, reverse({_COMP.format('s')}))"),
    "kmer_encode": ("dna", lambda: q.kmer_encode(q.subseq("s", 0, 8)), "CAST(list_sum(list_transform(range(0, 8), lambda i: (instr('ACGT', substr(s, (i + 1)::INT, 1)) - 1) * (4 ** (7 - i)))) AS BIGINT)"),
    "kmer_decode": ("dna", lambda: q.kmer_decode(q.kmer_encode(q.subseq("s", 0, 8)), 8), "substr(s, 1, 8)"),
    "kmer_rc": ("dna", lambda: q.kmer_decode(q.kmer_rc(q.kmer_encode(q.subseq("s", 0, 8)), 8), 8), f"reverse({_COMP.format('substr(s, 1, 8)')})"),
    "find_motif": ("dna", lambda: _js(q.find_motif("s", "ca")), "array_to_string(list_transform(list_filter(range(1, 32), lambda i: substr(s, i::INT, 2) = 'CA'), lambda i: i - 1), ',')"),
    "motif_count": ("dna", lambda: q.motif_count("s", "RYR"), "CAST(len(regexp_extract_all(s, '[AG][CT][AG]')) AS BIGINT)"),
    "motif_find": ("dna", lambda: _js(F.transform(q.motif_find("s", "RYR"), lambda x: x["match"])), "array_to_string(regexp_extract_all(s, '[AG][CT][AG]'), ',')"),
    "restriction_sites": ("dna", lambda: F.size(q.restriction_sites("s", "GAT")).cast("long"), "CAST(len(list_filter(range(1, 31), lambda i: substr(s, i::INT, 3) = 'GAT')) AS BIGINT)"),
    "tm": ("dna", lambda: _r(q.tm("s")), "round(64.9 + 41 * (length(regexp_replace(s, '[^GC]', '', 'g')) - 16.4) / length(s), 6)"),
    "mean_phred": ("dna", lambda: _r(q.mean_phred("s")), "round(list_avg(list_transform(string_split(s, ''), lambda x: ascii(x) - 33)), 6)"),
    "min_phred": ("dna", lambda: q.min_phred("s"), "CAST(list_min(list_transform(string_split(s, ''), lambda x: ascii(x) - 33)) AS BIGINT)"),
    "error_rate": ("dna", lambda: F.round(q.error_rate("s"), 9), "round(list_avg(list_transform(string_split(s, ''), lambda x: 10 ** (-(ascii(x) - 33) / 10.0))), 9)"),
    "ani": ("dna", lambda: _r(q.ani("s", "s", 5)), "1.0::DOUBLE"),
    # variants
    "is_snp": ("alleles", lambda: v.is_snp("ref", "alt"), "length(ref) = 1 AND length(alt) = 1"),
    "is_indel": ("alleles", lambda: v.is_indel("ref", "alt"), "length(ref) <> length(alt)"),
    "is_transition": ("alleles", lambda: v.is_transition("ref", "alt"), "(ref || alt) IN ('AG', 'GA', 'CT', 'TC')"),
    "is_transversion": ("alleles", lambda: v.is_transversion("ref", "alt"), "length(ref) = 1 AND length(alt) = 1 AND (ref || alt) NOT IN ('AG', 'GA', 'CT', 'TC')"),
    "is_multiallelic": ("alleles", lambda: v.is_multiallelic("alt"), "contains(alt, ',')"),
    "variant_type": ("alleles", lambda: v.variant_type("ref", "alt"), "CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'Snp' WHEN length(ref) = length(alt) THEN 'Mnp' ELSE 'Indel' END"),
    "is_het": ("alleles", lambda: v.is_het("gt"), "split_part(gt, '/', 1) <> split_part(gt, '/', 2)"),
    "is_hom_ref": ("alleles", lambda: v.is_hom_ref("gt"), "gt = '0/0'"),
    "is_hom_alt": ("alleles", lambda: v.is_hom_alt("gt"), "split_part(gt, '/', 1) = split_part(gt, '/', 2) AND split_part(gt, '/', 1) <> '0'"),
    # distributions
    "dnorm": ("money", lambda: F.round(st.dnorm(F.col("x") / 5000), 9), "round(exp(-(x / 5000) * (x / 5000) / 2) / sqrt(2 * pi()), 9)"),
    "dunif": ("money", lambda: st.dunif("x", 0.0, 4.0), "CASE WHEN x >= 0 AND x <= 4 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END"),
    "punif": ("money", lambda: _r(st.punif("x", 0.0, 9000.0)), "round(least(greatest(x / 9000.0, 0.0), 1.0), 6)::DOUBLE"),
    "dexp": ("money", lambda: F.round(st.dexp(F.col("x") / 1000, 2.0), 9), "CASE WHEN x >= 0 THEN round(2 * exp(-2 * (x / 1000)), 9) ELSE 0.0::DOUBLE END"),
    "pexp": ("money", lambda: F.round(st.pexp(F.col("x") / 1000, 2.0), 9), "CASE WHEN x >= 0 THEN round(1 - exp(-2 * (x / 1000)), 9) ELSE 0.0::DOUBLE END"),
    "dpois": ("lists", lambda: F.round(st.dpois(F.get("a", F.lit(4)), 3.0), 9), "round(3.0 ** a[5] * exp(-3.0) / factorial(a[5]::INT), 9)::DOUBLE"),
    "dbinom": ("lists", lambda: F.round(st.dbinom(F.get("a", F.lit(0)), 4, 0.25), 9), "round(factorial(4) / (factorial(a[1]::INT) * factorial((4 - a[1])::INT)) * 0.25 ** a[1] * 0.75 ** (4 - a[1]), 9)::DOUBLE"),
    "interval_bin": ("times", lambda: F.floor(F.col("value") / 16).cast("long"), "CAST(floor(value / 16) AS BIGINT)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(base: str, column: Callable[[], Column]):
        return lambda spark, sf_dir: BASES[base][0](spark, sf_dir).select("k", column().alias("v"))

    return {f"fn_{name}": make(base, column) for name, (base, column, _) in SCALARS.items()}


def oracle_sql() -> dict[str, str]:
    return {f"fn_{name}": f"SELECT k, {sql} AS v FROM ({BASES[base][1]}) AS base" for name, (base, _, sql) in SCALARS.items()}
