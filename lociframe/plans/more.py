"""Queries of the verbs, predicates, plots' data and files that catalog.py does not hold, each with its SQL."""

from __future__ import annotations

import types
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import collections as c
from ..functions import hashing as h
from ..functions import kinds as k
from ..functions import sequences as q
from ..functions import stats as st
from ..operators import alignment as al
from ..operators import graph as gr
from ..operators import intervals as iv
from ..operators import matrix as mx
from ..operators import modelling as md
from ..operators import sequences as sq
from ..operators import tables as tb
from ..operators.store import shared_folder
from ..sources import files as fl
from ..sources import formats as fm
from ..streaming import batches as sb
from . import control as ct
from . import plots as pl
from . import scalars
from .catalog import _AL, _AS, _DNA, _DS, _RD, _VAR, _VS, Tables, _r, _sp, _spans, query


def _kept(name: str, base: str, column, sql: str) -> None:
    rows, text = scalars.BASES[base]
    query(f"fn_{name}", lambda t: rows(t._spark, t._dir).select("k", column().alias("v")), f"SELECT k, {sql} AS v FROM ({text}) AS base")


# ---------------------------------------------------------------- kinds of values
_HALF = lambda: F.when(F.col("k") % 3 == 0, F.col("x"))
_kept("is_nil", "money", lambda: k.is_nil(_HALF()), "k % 3 <> 0 OR x IS NULL")
_kept("is_int", "money", lambda: k.is_int("k"), "k IS NOT NULL AND typeof(k) IN ('INTEGER', 'BIGINT')")
_kept("is_float", "money", lambda: k.is_float(_HALF()), "k % 3 = 0 AND x IS NOT NULL AND typeof(x) = 'DOUBLE'")
_kept("is_num", "money", lambda: k.is_num(F.when(F.col("k") % 2 == 0, F.col("k"))), "k % 2 = 0")
_kept("is_str", "money", lambda: k.is_str("name"), "name IS NOT NULL AND typeof(name) = 'VARCHAR'")
_kept("is_bool", "money", lambda: k.is_bool(F.nullif(F.col("x") > 0, F.lit(False))), "x > 0")
_kept("is_list", "lists", lambda: k.is_list(F.when(F.col("k") % 2 == 0, F.col("a"))), "k % 2 = 0")
_kept("is_map", "lists", lambda: k.is_map(F.create_map("k", "a")), "typeof(MAP {k: a}) LIKE 'MAP%'")
_kept("is_record", "lists", lambda: k.is_record(F.struct("k", "a")), "typeof({'k': k, 'a': a}) LIKE 'STRUCT%'")
_kept("is_matrix", "lists", lambda: k.is_matrix(F.array("a", "b")), "typeof([a, b]) LIKE '%[][]'")
_kept("is_set", "lists", lambda: k.is_set("a"), "len(list_distinct(a)) = len(a)")
_kept("is_range", "lists", lambda: k.is_range(F.when(F.col("k") % 2 == 0, F.struct(F.lit(0).alias("start"), F.col("k").alias("stop"), F.lit(1).alias("step")))), "k % 2 = 0")
_kept("is_enum", "lists", lambda: k.is_enum(F.struct(F.lit("A").alias("variant"), F.col("k").alias("value"))), "k IS NOT NULL")
_kept("is_sparse", "lists", lambda: k.is_sparse(F.struct(F.col("k").alias("i"), F.col("k").alias("j"))), "k IS NULL")
_kept("is_dna", "dna", lambda: k.is_dna(F.when(F.col("k") % 2 == 0, F.col("s")).otherwise(F.col("hex"))), "regexp_full_match(CASE WHEN k % 2 = 0 THEN s ELSE hex END, '[ACGTNacgtn]+')")
_kept("is_rna", "dna", lambda: k.is_rna(q.transcribe("s")), "regexp_full_match(translate(s, 'T', 'U'), '[ACGUN]+')")
_kept("is_protein", "dna", lambda: k.is_protein(F.translate("hex", "0123456789", "ACDEFGHIKB")), "regexp_full_match(translate(hex, '0123456789', 'ACDEFGHIKB'), '[ACDEFGHIKLMNPQRSTVWYXacdefghiklmnpqrstvwyx*]+')")
_kept("is_kmer", "dna", lambda: k.is_kmer(F.concat("s", F.when(F.col("k") % 2 == 0, "A").otherwise(""))), "k % 2 <> 0")
_kept("is_quality", "docs", lambda: k.is_quality("text"), "coalesce(regexp_full_match(text, '[!-~]+'), false)")
_kept("is_interval", "lists", lambda: k.is_interval(F.struct(F.lit("chr1").alias("chrom"), F.col("k").alias("start"), (F.col("k") + 1).alias("end"))), "k IS NOT NULL")
_kept("is_variant", "alleles", lambda: k.is_variant(F.when(F.col("k") % 2 == 0, k.variant(F.lit("chr1"), "k", "ref", "alt"))), "k % 2 = 0")
_kept("is_gene", "lists", lambda: k.is_gene(k.gene(F.lit("TP53"), F.lit("chr17"), "k", F.col("k") + 9)), "k IS NOT NULL")
_kept("is_genome", "lists", lambda: k.is_genome(k.genome(F.lit("hg38"), F.create_map(F.lit("chr1"), "k"))), "k IS NOT NULL")
_kept("is_aligned_read", "lists", lambda: k.is_aligned_read(k.aligned_read(F.lit("r"), F.lit(0), F.lit("chr1"), "k", F.lit("9M"))), "k IS NOT NULL")
_kept("variant", "alleles", lambda: k.variant(F.lit("chr1"), "k", "ref", "alt")["alt"], "alt")
_kept("gene", "lists", lambda: k.gene(F.lit("TP53"), F.lit("chr17"), "k", F.col("k") + 9)["end"], "k + 9")
_kept("genome", "lists", lambda: k.genome(F.lit("hg38"), F.create_map(F.lit("chr1"), "k"))["chromosomes"]["chr1"], "k")
_kept("aligned_read", "lists", lambda: k.aligned_read(F.lit("r"), F.lit(4), F.lit("chr1"), "k", F.lit("9M"))["pos"], "k")
_kept("protein", "dna", lambda: k.protein("hex"), "CASE WHEN regexp_full_match(hex, '[acdefghiklmnpqrstvwyx]+') THEN upper(hex) END")
_kept("typeof", "money", lambda: k.typeof(_HALF()), "CASE WHEN k % 3 = 0 AND x IS NOT NULL THEN 'Float' ELSE 'Nil' END")
_kept("type", "lists", lambda: k.type_("a"), "'List'")
_kept("str", "lists", lambda: k.str_("k"), "k::VARCHAR")
_kept("to_string", "money", lambda: k.to_string(F.when(F.col("k") % 3 == 0, F.col("name"))), "CASE WHEN k % 3 = 0 THEN name ELSE 'nil' END")
_kept("compare", "lists", lambda: k.compare(F.get("a", F.lit(0)), F.get("b", F.lit(0))), "CASE WHEN a[1] < b[1] THEN -1 WHEN a[1] = b[1] THEN 0 ELSE 1 END")
_kept("coalesce", "money", lambda: k.coalesced(_HALF(), F.lit(0.0)), "CASE WHEN k % 3 = 0 THEN x ELSE 0.0::DOUBLE END")
_kept("in", "lists", lambda: k.in_(F.lit(3).cast("long"), "a"), "list_contains(a, 3)")
_kept("not_in", "money", lambda: k.not_in("seg", ["BUILDING", "MACHINERY"]), "seg NOT IN ('BUILDING', 'MACHINERY')")
_kept("given", "money", lambda: k.given(F.col("x") < 0, F.lit("debt"), F.col("x") > 5000, F.lit("rich"), otherwise="plain"), "CASE WHEN x < 0 THEN 'debt' WHEN x > 5000 THEN 'rich' ELSE 'plain' END")
_kept("match", "money", lambda: k.match("seg", {"BUILDING": 1, "MACHINERY": 2}, 0), "CASE seg WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END")
_kept("take_while", "lists", lambda: F.array_join(c.take_while("a", lambda x: x < 5).cast("array<string>"), ","), "array_to_string(a[1:coalesce(list_filter([1, 2, 3, 4, 5], lambda i: a[i] >= 5)[1], 6) - 1], ',')")
_kept("json_parse", "times", lambda: F.size(F.json_object_keys(F.to_json(c.json_parse("props")))), "len(json_keys(props))::INT")
_kept("json_pretty", "times", lambda: F.regexp_replace(c.json_pretty("props"), r"[\s]", ""), r"regexp_replace(props, '\s', '', 'g')")
_kept("parse_vcf_info", "lists", lambda: F.get(c.parse_vcf_info(F.concat(F.lit("DB;AC=1,"), F.col("k").cast("string")))["AC"], F.lit(1)), "k::VARCHAR")
_M = lambda: F.map_from_arrays(F.array(F.lit("p"), F.lit("q")), F.array(F.get("a", F.lit(0)), F.get("a", F.lit(1))))
_kept("keys", "lists", lambda: F.array_join(c.keys(_M()), ","), "'p,q'")
_kept("values", "lists", lambda: F.array_join(c.values(_M()).cast("array<string>"), ","), "concat(a[1], ',', a[2])")
_kept("merge", "lists", lambda: c.merge(_M(), F.create_map(F.lit("q"), F.lit(7).cast("long")))["q"], "CAST(7 AS BIGINT)")
_kept("has_key", "lists", lambda: c.has_key(_M(), "p") & ~c.has_key(_M(), "z"), "k IS NOT NULL")
_kept("remove_key", "lists", lambda: F.size(c.remove_key(_M(), "p")), "1")
_kept("parse_json", "times", lambda: F.to_json(c.parse_json("props")).isNotNull(), "props IS NOT NULL")
_kept("json_stringify", "lists", lambda: F.regexp_replace(c.json_stringify(_M()), r"\s", ""), "concat('{\"p\":', a[1], ',\"q\":', a[2], '}')")
_kept("range", "lists", lambda: F.size(c.range_(0, 10, 3)) + F.lit(0) * F.col("k"), "CAST(4 AS BIGINT)")
_kept("bp", "lists", lambda: scalars.n.bp("k"), "k")
_kept("hmac_sha256", "docs", lambda: F.length(h.hmac_sha256("text", "key")), "CASE WHEN text IS NOT NULL THEN 64 END")
_kept("pnorm", "money", lambda: F.round(st.pnorm(F.col("x") / 5000) + st.pnorm(-F.col("x") / 5000), 6), "1.0::DOUBLE")
_kept("pbinom", "lists", lambda: F.round(st.pbinom(F.get("a", F.lit(2)), 2, 0.5), 9), "CAST(CASE a[3] WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 ELSE 1 END AS DOUBLE)")
_kept("ppois", "lists", lambda: F.round(st.ppois(F.get("a", F.lit(2)), 2.0), 9), "round(exp(-2.0) * [1.0, 3.0, 5.0][a[3] + 1], 9)")

# ---------------------------------------------------------------- verbs
_GAP = lambda t: t.part.select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_size").cast("long")).alias("size"))
_GS = "(SELECT p_partkey, CASE WHEN p_size > 20 THEN p_size::BIGINT END AS size FROM part)"
query("fill_null", lambda t: tb.fill_null(_GAP(t), -1), f"SELECT p_partkey, coalesce(size, -1) AS size FROM {_GS}")
query("drop_null", lambda t: tb.drop_null(_GAP(t), "size"), f"SELECT * FROM {_GS} WHERE size IS NOT NULL")
query("take_while_rows", lambda t: tb.take_while(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", F.col("o_custkey") % 97 != 0), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < (SELECT coalesce(min(o_orderkey) FILTER (o_custkey % 97 = 0), max(o_orderkey) + 1) FROM orders)")
query("col_mean", lambda t: tb.col_mean(t.part, "p_retailprice").select(_r("mean").alias("mean")), "SELECT round(avg(p_retailprice), 4) AS mean FROM part")
query("col_sum", lambda t: tb.col_sum(t.part, "p_size"), "SELECT sum(p_size)::DOUBLE AS sum FROM part")
query("col_min", lambda t: tb.col_min(t.part, "p_retailprice"), "SELECT min(p_retailprice) AS min FROM part")
query("col_max", lambda t: tb.col_max(t.part, "p_retailprice"), "SELECT max(p_retailprice) AS max FROM part")
query("min", lambda t: tb.min_(t.orders, "o_totalprice"), "SELECT min(o_totalprice) AS min FROM orders")
query("max", lambda t: tb.max_(t.orders, "o_totalprice"), "SELECT max(o_totalprice) AS max FROM orders")
query("col_stdev", lambda t: tb.col_stdev(t.part, "p_retailprice").select(_r("stdev").alias("stdev")), "SELECT round(stddev_samp(p_retailprice), 4) AS stdev FROM part")
query("col", lambda t: tb.col(t.customer, "c_name"), "SELECT c_name FROM customer")
query("col_values", lambda t: tb.col_values(t.nation, "n_name"), "SELECT n_name FROM nation")
query("scatter_by", lambda t: tb.scatter_by(t.orders, F.col("o_orderkey") % 7), "SELECT o_orderkey % 7 AS key, count(*) AS count FROM orders GROUP BY 1")
query("filter_pass", lambda t: tb.filter_pass(t.orders.select("o_orderkey", F.expr("element_at(array('PASS', 'q10', '.', ''), cast(o_orderkey % 4 as int) + 1)").alias("filter"))), "SELECT * FROM (SELECT o_orderkey, ['PASS', 'q10', '.', ''][o_orderkey % 4 + 1] AS filter FROM orders) WHERE filter <> 'q10'")
query("classify_variants", lambda t: tb.classify_variants(_VAR(t)), f"SELECT chrom, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' ELSE 'INDEL' END AS variant_type FROM {_VS}")
_SHAPE = lambda t, rows: t._spark.createDataFrame(rows, "name string, value string")
query("table_col_types", lambda t: _SHAPE(t, list(tb.table_col_types(t.region.select("r_name")).items())), "SELECT 'r_name' AS name, 'string' AS value")
query("ncols", lambda t: _SHAPE(t, [("nation", str(tb.ncols(t.nation))), ("region", str(tb.ncol(t.region)))]), "SELECT 'nation' AS name, (SELECT count(*)::VARCHAR FROM (DESCRIBE nation)) AS value UNION ALL SELECT 'region', (SELECT count(*)::VARCHAR FROM (DESCRIBE region))")
query("columns", lambda t: _SHAPE(t, [(n, "") for n in tb.columns(t.region)]), "SELECT column_name AS name, '' AS value FROM (DESCRIBE region)")
query("colnames", lambda t: _SHAPE(t, [(n, "") for n in tb.colnames(t.nation)]), "SELECT column_name AS name, '' AS value FROM (DESCRIBE nation)")
query("from_table", lambda t: _SHAPE(t, [(r["r_name"], str(r["r_regionkey"])) for r in tb.from_table(t.region)]), "SELECT r_name AS name, r_regionkey::VARCHAR AS value FROM region")
query("collect", lambda t: _SHAPE(t, [(r["n_name"], str(r["n_regionkey"])) for r in tb.collect(t.nation)]), "SELECT n_name AS name, n_regionkey::VARCHAR AS value FROM nation")
query("to_table", lambda t: tb.to_table(t._spark, list(tb.to_records(t.region))), "SELECT * FROM region")
query("summary", lambda t: tb.summary(t.customer.select("c_custkey")).select("column", "count", "min", "max"), "SELECT 'c_custkey' AS \"column\", count(*) AS count, min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max FROM customer")
query("len", lambda t: _SHAPE(t, [("orders", str(tb.len_(t.orders)))]), "SELECT 'orders' AS name, count(*)::VARCHAR AS value FROM orders")

# ---------------------------------------------------------------- intervals, matrices, graphs, models
query("interval_tree", lambda t: iv.interval_tree(_spans(t)).select("event_id", "bin"), f"SELECT event_id, unnest(range(start // 16384, (\"end\" - 1) // 16384 + 1)) AS bin FROM {_sp()}")
query("to_interval", lambda t: iv.to_interval(_spans(t).withColumnRenamed("chrom", "seqid")), f"SELECT chrom, start, \"end\", '.' AS strand FROM {_sp()}")
query("coord_system", lambda t: iv.coord_vcf(t.nation.select("n_name")).select("n_name", "coord_system"), "SELECT n_name, 'vcf' AS coord_system FROM nation")
for _name in iv.SYSTEMS:
    query(f"coord_{_name}", lambda t, fn=getattr(iv, f"coord_{_name}"): fn(t.region).select("r_regionkey", iv.coord_system(fn(t.region)).alias("system")), f"SELECT r_regionkey, '{_name}' AS system FROM region")
query("diag", lambda t: mx.diag(t._spark, [3.0, 1.0, 2.0]), "SELECT i, j, CASE WHEN i = j THEN ([3.0, 1.0, 2.0][i + 1])::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(3) a(i), range(3) b(j)")
query("sparse_matrix", lambda t: mx.sparse_matrix(t.orders.withColumns({"row": F.col("o_custkey") % 50, "v": F.col("o_orderkey") % 3 - 1}), "o_custkey", "row", "v"), "SELECT o_custkey AS i, o_custkey % 50 AS j, sum(o_orderkey % 3 - 1)::DOUBLE AS v FROM orders GROUP BY ALL HAVING v <> 0")
query("node_attr", lambda t: _SHAPE(t, [("7", gr.Graph(t.nation.select(F.col("n_nationkey").alias("id"), "n_name"), t.nation.select(F.col("n_nationkey").alias("from"), F.col("n_regionkey").alias("to"), F.lit(1.0).alias("weight"))).node_attr(7, "n_name"))]), "SELECT '7' AS name, n_name AS value FROM nation WHERE n_nationkey = 7")

# ---------------------------------------------------------------- plots
query("plot", lambda t: pl.plot(t.part, "p_size", "p_retailprice"), "SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part")
query("scatter", lambda t: pl.scatter(t.orders, "o_custkey", "o_totalprice"), "SELECT o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders")
query("histogram", lambda t: pl.histogram(t.orders, "o_custkey", 0.0, 1000.0, 10).select("bin", "count"), "SELECT greatest(0, least(floor(o_custkey / 100.0), 9))::BIGINT AS bin, count(*) AS count FROM orders GROUP BY 1")
_GRID = "SELECT {by}greatest(0, least(floor((p_size - 0.0) / (50.0 / {f})), {f} - 1)) AS c, count(*) AS n FROM part GROUP BY ALL"
_DENS = "SELECT {by}\"at\", round(sum(n * exp(-((\"at\" - x) / 2.5) * ((\"at\" - x) / 2.5) / 2)) / sum(n) / (2.5 * sqrt(2 * pi())), 8) AS density FROM (SELECT {by}n, (c + 0.5) * (50.0 / {f}) AS x, \"at\" FROM ({grid}), (SELECT (i + 0.5) * (50.0 / {p}) AS \"at\" FROM range({p}) r(i))) GROUP BY ALL"
query("density", lambda t: pl.density(t.part, "p_size", 0.0, 50.0, 16).withColumn("density", _r("density", 8)), _DENS.format(by="", f=128, p=16, grid=_GRID.format(by="", f=128)))
query("violin", lambda t: pl.violin(t.part, "p_brand", "p_size", 0.0, 50.0, 8).withColumn("density", _r("density", 8)), _DENS.format(by="p_brand, ", f=64, p=8, grid=_GRID.format(by="p_brand, ", f=64)))
_BOX = "SELECT {k}count(p_size) AS count, quantile_cont(p_size, 0.25) AS q1, quantile_cont(p_size, 0.5) AS median, quantile_cont(p_size, 0.75) AS q3 FROM part{g}"
query("boxplot", lambda t: pl.boxplot(t.part, "p_size", "p_brand"), "SELECT p_brand, count, q1, median, q3, min(p_size) AS low, max(p_size) AS high FROM (" + _BOX.format(k="p_brand, ", g=" GROUP BY 1") + ") JOIN part USING (p_brand) WHERE p_size BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL")
_HEAT = "SELECT o_orderpriority AS row, o_orderstatus AS col, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY ALL"
for _name in ("heatmap", "heatmap_ascii"):
    query(_name, lambda t, fn=getattr(pl, _name): fn(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice").withColumn("value", _r("value", 2)), _HEAT)
query("clustered_heatmap", lambda t: pl.clustered_heatmap(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice").select("row", "col", "row_at", "col_at"),
      "WITH c AS (SELECT o_orderpriority AS row, o_orderstatus AS col, avg(o_totalprice) AS value FROM orders GROUP BY ALL), a AS (SELECT row, row_number() OVER (ORDER BY avg(value), row) AS row_at FROM c GROUP BY row), b AS (SELECT col, row_number() OVER (ORDER BY avg(value), col) AS col_at FROM c GROUP BY col) SELECT row, col, row_at, col_at FROM c JOIN a USING (row) JOIN b USING (col)")
_CHG = lambda t: t.part.select(((F.col("p_size") - 25) / 8).alias("lfc"), (F.col("p_partkey") % 100 / 400).alias("p"))
_CHS = "(SELECT (p_size - 25) / 8 AS lfc, p_partkey % 100 / 400 AS p FROM part)"
_SIDE = "CASE WHEN p > 0.05 THEN 'none' WHEN lfc >= 1 THEN 'up' WHEN lfc <= -1 THEN 'down' ELSE 'none' END"
for _name in ("volcano", "volcano_plot"):
    query(_name, lambda t, fn=getattr(pl, _name): fn(_CHG(t), "lfc", "p").withColumn("minus_log10", _r("minus_log10", 6)), f"SELECT lfc AS log2fc, round(-log10(greatest(p, 1e-300)), 6) AS minus_log10, {_SIDE} AS side FROM {_CHS}")
query("ma_plot", lambda t: pl.ma_plot(t.part, "p_size", "p_retailprice").select(_r("mean", 6).alias("mean"), _r("change", 6).alias("change")), "SELECT round((log2(p_size + 1) + log2(p_retailprice + 1)) / 2, 6) AS mean, round(log2(p_retailprice + 1) - log2(p_size + 1), 6) AS change FROM part")
query("genome_track", lambda t: pl.genome_track(_spans(t), 86400), f"SELECT chrom, start // 86400 AS bin, count(*)::DOUBLE AS value FROM {_sp()} GROUP BY ALL")
query("ideogram", lambda t: pl.ideogram(_spans(t)), f"SELECT chrom, min(start) AS start, max(\"end\") AS \"end\", count(*) AS features FROM {_sp()} GROUP BY 1")
query("cnv_plot", lambda t: pl.cnv_plot(_spans(t).withColumns({"a": F.col("end") - F.col("start"), "b": F.col("event_id") % 50}), 864000, "a", "b").withColumn("log2_ratio", _r("log2_ratio", 6)), f"SELECT chrom, start // 864000 AS bin, round(log2((avg(\"end\" - start) + 1) / (avg(event_id % 50) + 1)), 6) AS log2_ratio FROM {_sp()} GROUP BY ALL")
query("rainfall", lambda t: pl.rainfall(_spans(t)).withColumn("log10_distance", _r("log10_distance", 6)), f"SELECT chrom, pos, round(log10(pos - last), 6) AS log10_distance FROM (SELECT chrom, pos, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS last FROM (SELECT DISTINCT chrom, start AS pos FROM {_sp()})) WHERE last IS NOT NULL")
_PV = lambda t: t.orders.select(F.lit("chr1").alias("chrom"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 1000 / 1000 + 1e-6).alias("p"))
_PS = "(SELECT 'chr1' AS chrom, o_orderkey AS pos, o_orderkey % 1000 / 1000 + 1e-6 AS p FROM orders)"
query("manhattan", lambda t: pl.manhattan(_PV(t), "chrom", "pos", "p").withColumn("minus_log10", _r("minus_log10", 6)), f"SELECT chrom, pos, round(-log10(p), 6) AS minus_log10 FROM {_PS}")
query("qq_plot", lambda t: pl.qq_plot(_PV(t), "p").select(_r("expected", 6).alias("expected"), _r("observed", 6).alias("observed")), f"SELECT round(-log10((row_number() OVER (ORDER BY p) - 0.5) / count(*) OVER ()), 6) AS expected, round(-log10(p), 6) AS observed FROM {_PS}")
query("forest_plot", lambda t: pl.forest_plot(t.orders, "o_orderpriority", "o_totalprice").select("o_orderpriority", *[_r(x, 2).alias(x) for x in ("estimate", "low", "high")]), "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS estimate, round(avg(o_totalprice) - h, 2) AS low, round(avg(o_totalprice) + h, 2) AS high FROM (SELECT o_orderpriority, o_totalprice, 1.959963984540054 * stddev_samp(o_totalprice) OVER w / sqrt(count(*) OVER w) AS h FROM orders WINDOW w AS (PARTITION BY o_orderpriority)) GROUP BY o_orderpriority, h")
_UPSET = "SELECT sets, count(*) AS count FROM (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '&' ORDER BY o_orderstatus) AS sets FROM orders GROUP BY 1) GROUP BY 1"
for _name in ("venn", "upset", "upset_plot"):
    query(_name, lambda t, fn=getattr(pl, _name): fn(t.orders, "o_custkey", "o_orderstatus"), _UPSET)
query("oncoprint", lambda t: pl.oncoprint(t.orders, "o_custkey", "o_orderstatus", "o_orderpriority"), "SELECT o_custkey AS gene, o_orderstatus AS sample, string_agg(DISTINCT o_orderpriority, '+' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY ALL")
query("lollipop", lambda t: pl.lollipop(t.part, "p_size", "p_brand"), "SELECT p_size AS pos, p_brand AS kind, count(*) AS count FROM part GROUP BY ALL")
query("sequence_logo", lambda t: pl.sequence_logo(_DNA(t), "s").withColumn("height", _r("height", 6)), f"WITH n AS (SELECT (i - 1)::INT AS pos, substr(s, i::INT, 1) AS letter, count(*) AS n FROM {_DS}, range(1, 33) r(i) GROUP BY ALL) SELECT pos, letter, round(n / m * (2 - (log2(m) - e / m)), 6) AS height FROM n JOIN (SELECT pos, sum(n) AS m, sum(n * log2(n)) AS e FROM n GROUP BY 1) USING (pos)")
query("hic_map", lambda t: pl.hic_map(t.lineitem, "l_partkey", "l_suppkey", 50), "SELECT least(l_partkey // 50, l_suppkey // 50)::BIGINT AS i, greatest(l_partkey // 50, l_suppkey // 50)::BIGINT AS j, count(*) AS count FROM lineitem GROUP BY ALL")
query("sashimi", lambda t: pl.sashimi(t.lineitem.select(F.col("l_returnflag").alias("chrom"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 7).alias("end"))), "SELECT l_returnflag AS chrom, l_linenumber AS start, l_linenumber + 7 AS \"end\", count(*) AS reads FROM lineitem GROUP BY ALL")
for _name in ("circos", "circos_plot"):
    query(_name, lambda t, fn=getattr(pl, _name): fn(t.lineitem.select("l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus"), "SELECT least(l_returnflag, l_linestatus) AS a, greatest(l_returnflag, l_linestatus) AS b, count(*) AS links FROM lineitem GROUP BY ALL")
query("quality_plot", lambda t: pl.quality_plot(_DNA(t), "hex").withColumn("mean", _r("mean", 6)), f"SELECT (i - 1)::INT AS pos, round(avg(ascii(substr(hex, i::INT, 1)) - 33), 6) AS mean, quantile_cont(ascii(substr(hex, i::INT, 1)) - 33, 0.25) AS q1, quantile_cont(ascii(substr(hex, i::INT, 1)) - 33, 0.5) AS median, quantile_cont(ascii(substr(hex, i::INT, 1)) - 33, 0.75) AS q3 FROM {_DS}, range(1, 33) r(i) GROUP BY 1")
query("dotplot", lambda t: pl.dotplot(_DNA(t).select("k", "s", "t"), "s", "t", 4).select("k", "i", "j"), f"SELECT k, (i - 1)::INT AS i, (j - 1)::INT AS j FROM {_DS}, range(1, 30) a(i), range(1, 30) b(j) WHERE substr(s, i::INT, 4) = substr(t, j::INT, 4)")


# ---------------------------------------------------------------- files: written, then read again
def _folder(spark: SparkSession, ending: str) -> str:
    return f"{shared_folder(spark)}/lociframe/files-{uuid.uuid4().hex}.{ending}"


def _round_trip(name: str, ending: str, rows, write, read, sql: str) -> None:
    def run(t: Tables) -> DataFrame:
        path = _folder(t._spark, ending)
        write(rows(t), path)
        return read(t._spark, path)

    query(name, run, sql)


_PART = lambda t: t.part.select("p_partkey", "p_size", "p_retailprice")
_PQ = "SELECT p_partkey, p_size, p_retailprice FROM part"
_PL = "SELECT p_partkey::BIGINT AS p_partkey, p_size::BIGINT AS p_size, p_retailprice FROM part"
for _name in ("read_csv", "csv", "write_csv"):
    _round_trip(_name, "csv", _PART, fm.write_csv, fm.read_csv, _PL)
for _name in ("read_tsv", "tsv", "write_tsv"):
    _round_trip(_name, "tsv", _PART, fm.write_tsv, fm.read_tsv, _PL)
for _name in ("read_parquet", "write_parquet"):
    _round_trip(_name, "parquet", _PART, fm.write_parquet, fm.read_parquet, _PQ)
for _name in ("read_json", "write_json"):
    _round_trip(_name, "json", lambda t: t.nation.select("n_name", F.col("n_nationkey").cast("long").alias("n_nationkey")), fm.write_json, lambda s, p: s.read.json(p), "SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation")
_NAMES = lambda t: t.customer.select("c_name")
for _name in ("read_lines", "write_lines", "stream_lines"):
    _round_trip(_name, "txt", _NAMES, fm.write_lines, fm.read_lines, "SELECT c_name AS value FROM customer")
_round_trip("count_lines", "txt", _NAMES, fm.write_lines, fm.count_lines, "SELECT count(*) AS lines FROM customer")
_round_trip("append_text", "txt", _NAMES, lambda df, p: (fm.write_lines(df, p), fm.append_text(df, p)), fm.count_lines, "SELECT 2 * count(*) AS lines FROM customer")
for _name in ("read_text", "write_text"):
    _round_trip(_name, "txt", lambda t: t, lambda t, p: fm.write_text(t._spark, "one\ntwo", p), lambda s, p: fm.read_text(s, p).select(F.regexp_replace("value", r"\s+$", "").alias("value")).filter("value <> ''"), "SELECT 'one' || chr(10) || 'two' AS value")

_SEQ = lambda t: t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("description"), F.translate(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTNacgtnACGTNacgtnACGTNA").alias("seq")).filter("seq <> ''")
_SEQS = "(SELECT concat('d', doc_id) AS id, source AS description, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTNacgtnACGTNacgtnACGTNA') AS seq FROM documents) WHERE seq <> ''"
for _name in ("read_fasta", "fasta", "write_fasta"):
    _round_trip(_name, "fa", _SEQ, fm.write_fasta, fm.read_fasta, f"SELECT id, description, seq, length(seq) AS length FROM {_SEQS}")
for _name in ("read_fastq", "fastq", "write_fastq"):
    _round_trip(_name, "fq", lambda t: _SEQ(t).withColumn("quality", F.translate("seq", "ACGTNacgtn", "!#+5:;?@FI")), fm.write_fastq, lambda s, p: fm.read_fastq(s, p).select("id", "seq", "length", "quality"), f"SELECT id, seq, length(seq) AS length, translate(seq, 'ACGTNacgtn', '!#+5:;?@FI') AS quality FROM {_SEQS}")
_BED = lambda t: _spans(t).select("chrom", "start", "end", F.concat(F.lit("e"), "event_id").alias("name"), (F.col("event_id") % 1000).cast("long").alias("score"), F.lit("+").alias("strand"))
_BEDS = f"SELECT chrom, start, \"end\", concat('e', event_id) AS name, (event_id % 1000)::BIGINT AS score, '+' AS strand FROM {_sp()}"
for _name in ("read_bed", "bed", "write_bed"):
    _round_trip(_name, "bed", _BED, fm.write_bed, fm.read_bed, _BEDS)
_TABBED = lambda *cols: F.concat_ws("\t", *[x.cast("string") for x in cols]).alias("value")
_LINES = lambda df, p: df.write.mode("overwrite").text(p)
for _name in ("read_bedgraph", "bedgraph"):
    _round_trip(_name, "bedgraph", lambda t: _spans(t).select(_TABBED(F.col("chrom"), F.col("start"), F.col("end"), F.col("event_id") % 9)), _LINES, fm.read_bedgraph, f"SELECT chrom, start, \"end\", (event_id % 9)::DOUBLE AS value FROM {_sp()}")
_GFF = lambda t: _spans(t).select(F.col("chrom").alias("seqid"), F.lit("src").alias("source"), F.lit("exon").alias("type"), "start", "end", (F.col("event_id") % 10).cast("double").alias("score"), F.lit("-").alias("strand"), F.lit("0").alias("phase"), F.concat(F.lit("ID=e"), "event_id").alias("attributes"))
for _name in ("read_gff", "gff", "write_gff", "read_gtf"):
    _round_trip(_name, "gff", _GFF, fm.write_gff, fm.read_gtf if _name == "read_gtf" else fm.read_gff, f"SELECT chrom AS seqid, 'src' AS source, 'exon' AS type, start, \"end\", (event_id % 10)::DOUBLE AS score, '-' AS strand, '0' AS phase, concat('ID=e', event_id) AS attributes FROM {_sp()}")
_VCF = lambda t: _VAR(t).select("chrom", "pos", F.concat(F.lit("rs"), "k").alias("id"), "ref", "alt", "qual", F.lit("PASS").alias("filter"), F.concat(F.lit("DP="), F.col("k") % 50).alias("info"))
_VCFS = f"(SELECT chrom, pos, concat('rs', k) AS id, ref, alt, qual, 'PASS' AS filter, (k % 50)::VARCHAR AS dp FROM {_VS})"
_READ_VCF = lambda s, p: fm.read_vcf(s, p).withColumn("dp", F.try_element_at("info", F.lit("DP"))).drop("info")
for _name in ("read_vcf", "vcf", "write_vcf"):
    _round_trip(_name, "vcf", _VCF, fm.write_vcf, _READ_VCF, f"SELECT * FROM {_VCFS}")
_round_trip("vcf_filter", "vcf", _VCF, fm.write_vcf, lambda s, p: fm.vcf_filter(s, p, "QUAL >= 30 && DP > 10").select("id"), f"SELECT id FROM {_VCFS} WHERE qual >= 30 AND dp::INT > 10")
_SAM = lambda t: _AL(t).select(_TABBED(F.concat(F.lit("r"), "pos"), F.col("flag"), F.col("rname"), F.col("pos"), F.lit(60), F.lit("32M"), F.lit("="), F.lit(1), F.col("tlen"), F.col("seq"), F.col("seq")))
for _name in ("read_sam", "sam"):
    _round_trip(_name, "sam", _SAM, _LINES, lambda s, p: fm.read_sam(s, p).select("qname", "flag", "rname", "pos", "mapq", "cigar", "tlen", "seq"), f"SELECT concat('r', pos) AS qname, flag, rname, pos, 60::BIGINT AS mapq, '32M' AS cigar, tlen, seq FROM {_AS}")
_round_trip("sam_header", "sam", lambda t: t.nation.select(F.concat(F.lit("@SQ\tSN:"), "n_name", F.lit("\tLN:"), "n_nationkey").alias("value")), _LINES, lambda s, p: fm.sam_header(s, p).select("type", F.col("tags")["SN"].alias("name"), F.col("tags")["LN"].alias("length")), "SELECT 'SQ' AS type, n_name AS name, n_nationkey::VARCHAR AS length FROM nation")
for _name in ("read_maf", "maf"):
    _round_trip(_name, "maf", lambda t: t.nation.select(F.col("n_name").alias("Hugo_Symbol"), F.concat(F.lit("chr"), "n_nationkey").alias("Chromosome")), lambda df, p: fm.write_tsv(df, p), fm.read_maf, "SELECT n_name AS Hugo_Symbol, concat('chr', n_nationkey) AS Chromosome FROM nation")
_round_trip("read_gmt", "gmt", lambda t: t.region.select(_TABBED(F.col("r_name"), F.lit("about"), F.lit("A"), F.lit("B"))), _LINES, lambda s, p: fm.read_gmt(s, p).select("name", "description", F.array_join("genes", ",").alias("genes")), "SELECT r_name AS name, 'about' AS description, 'A,B' AS genes FROM region")
_round_trip("validate", "bed", _BED, fm.write_bed, fm.validate, "SELECT true AS valid, 'bed' AS format, 0::BIGINT AS errors, count(*) AS lines_checked FROM events")
_round_trip("file_size", "txt", _NAMES, fm.write_lines, lambda s, p: s.createDataFrame([("is_dir", fl.is_dir(s, p)), ("some", fl.file_size(s, p) > 0), ("exists", fl.file_exists(s, p)), ("is_file", fl.is_file(s, p))], "name string, value boolean"), "SELECT unnest(['is_dir', 'some', 'exists', 'is_file']) AS name, unnest([true, true, true, false]) AS value")


def _sql_rows(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("lociframe_nation")
    return fm.sql(t._spark, "SELECT n_regionkey, count(*) AS n FROM lociframe_nation WHERE n_nationkey > :low GROUP BY 1", {"low": 3})


query("sql", _sql_rows, "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")
query("sqlite", _sql_rows, "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")


def _schema_rows(t: Tables) -> DataFrame:
    t.region.createOrReplaceTempView("lociframe_region")
    return fm.sql_schema(t._spark, "lociframe_region").select("cid", "name")


query("sql_schema", _schema_rows, "SELECT unnest([0, 1])::BIGINT AS cid, unnest(['r_regionkey', 'r_name']) AS name")




# ---------------------------------------------------------------- graphs
def _graph(t: Tables, directed: bool = False) -> gr.Graph:
    """Orders of a customer follow each other: chains of many steps."""
    at = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    edges = t.orders.select(F.col("o_orderkey").alias("from"), F.lead("o_orderkey").over(at).alias("to"), F.lit(1.0).alias("weight")).filter("to IS NOT NULL")
    return gr.graph(t.orders.select(F.col("o_orderkey").alias("id")), edges, directed)


_EDGES = "(SELECT o_orderkey AS \"from\", lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS \"to\", 1.0::DOUBLE AS weight FROM orders QUALIFY \"to\" IS NOT NULL)"
query("graph", lambda t: _graph(t).degrees(), f"SELECT o_orderkey AS id, count(e.x) AS degree FROM orders LEFT JOIN (SELECT unnest([\"from\", \"to\"]) AS x FROM {_EDGES}) e ON e.x = o_orderkey GROUP BY 1")
query("nodes", lambda t: _graph(t).nodes, "SELECT o_orderkey AS id FROM orders")
query("edges", lambda t: _graph(t).edges, f"SELECT * FROM {_EDGES}")
query("connected_components", lambda t: _graph(t).connected_components(), "SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
query("add_node", lambda t: _graph(t).add_node(-1).nodes, "SELECT o_orderkey AS id FROM orders UNION ALL SELECT -1")
query("add_edge", lambda t: _graph(t).add_edge(-1, -2).edges, f"SELECT * FROM {_EDGES} UNION ALL SELECT -1, -2, 1.0")
query("remove_edge", lambda t: gr.graph(t.nation.select(F.col("n_nationkey").alias("id")), t.nation.select(F.col("n_nationkey").alias("from"), F.col("n_regionkey").alias("to"))).remove_edge(7, 4 - 4).edges.select("from", "to"), "SELECT n_nationkey AS \"from\", n_regionkey AS \"to\" FROM nation WHERE NOT (n_nationkey = 7 AND n_regionkey = 0)")
_FLAGS = lambda t, **got: t._spark.createDataFrame([(n, bool(v)) for n, v in got.items()], "name string, value boolean")
query("has_node", lambda t: _FLAGS(t, a=_graph(t).has_node(1), b=_graph(t).has_node(-5)), "SELECT 'a' AS name, EXISTS (FROM orders WHERE o_orderkey = 1) AS value UNION ALL SELECT 'b', false")
query("has_edge", lambda t: _FLAGS(t, a=_graph(t).has_edge(1, 2), b=_graph(t).has_edge(-5, 1)), f"SELECT 'a' AS name, EXISTS (FROM {_EDGES} WHERE (\"from\" = 1 AND \"to\" = 2) OR (\"from\" = 2 AND \"to\" = 1)) AS value UNION ALL SELECT 'b', false")


def _path(t: Tables) -> DataFrame:
    """Along the line of nations by number, the longest path that the table has."""
    line = t.nation.select(F.col("n_nationkey").alias("from"), (F.col("n_nationkey") + 1).alias("to")).filter("to < 25")
    path = gr.graph(t.nation.select(F.col("n_nationkey").alias("id")), line).shortest_path(2, 9)
    return t._spark.createDataFrame(list(enumerate(path)), "step int, id int")


query("shortest_path", _path, "SELECT (n_nationkey - 2)::INT AS step, n_nationkey AS id FROM nation WHERE n_nationkey BETWEEN 2 AND 9")

# ---------------------------------------------------------------- matrices on the driver
_SQUARE = [[4.0, 1.0, 0.0], [1.0, 3.0, 1.0], [0.0, 1.0, 2.0]]
_VALUES = lambda t, got: t._spark.createDataFrame([(i, round(float(v), 9) + 0.0) for i, v in enumerate(got)], "i int, v double")
query("matrix", lambda t: mx.matrix(t._spark, _SQUARE), "SELECT (i // 3)::BIGINT AS i, i % 3 AS j, [4.0, 1.0, 0.0, 1.0, 3.0, 1.0, 0.0, 1.0, 2.0][i + 1]::DOUBLE AS v FROM range(9) r(i)")
query("determinant", lambda t: _VALUES(t, [mx.determinant(mx.matrix(t._spark, _SQUARE))]), "SELECT 0 AS i, (4 * (3 * 2 - 1) - 1 * (1 * 2 - 0))::DOUBLE AS v")
query("solve", lambda t: mx.solve(mx.matrix(t._spark, _SQUARE), mx.matrix(t._spark, [[6.0], [10.0], [8.0]])).select("i", F.round("v", 9).alias("v")), "SELECT unnest([0, 1, 2])::BIGINT AS i, unnest([1.0, 2.0, 3.0])::DOUBLE AS v")
query("inverse", lambda t: mx.dot(mx.inverse(mx.matrix(t._spark, _SQUARE)), mx.matrix(t._spark, _SQUARE)).select("i", "j", (F.round("v", 9) + 0.0).alias("v")), "SELECT i, j, (CASE WHEN i = j THEN 1 ELSE 0 END)::DOUBLE AS v FROM range(3) a(i), range(3) b(j)")
query("eigenvalues", lambda t: _VALUES(t, [sum(mx.eigenvalues(mx.matrix(t._spark, _SQUARE)))]), "SELECT 0 AS i, 9.0::DOUBLE AS v")
query("svd", lambda t: _VALUES(t, [sum(d * d for d in mx.svd(mx.matrix(t._spark, _SQUARE))["d"])]), "SELECT 0 AS i, (16 + 9 + 4 + 4 * 1)::DOUBLE AS v")
query("row", lambda t: mx.row(mx.matrix(t._spark, _SQUARE), 1).select("j", "v"), "SELECT unnest([0, 1, 2])::BIGINT AS j, unnest([1.0, 3.0, 1.0])::DOUBLE AS v")
query("sparse_get", lambda t: mx.sparse_get(mx.to_sparse(mx.matrix(t._spark, _SQUARE)), 1, 1).select("v"), "SELECT 3.0::DOUBLE AS v")
query("pca", lambda t: mx.pca(t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"], 2).agg(F.round(F.sum(F.aggregate(vector_to_array("components"), F.lit(0.0), lambda a, x: a + x * x)) / 1e6, 3).alias("spread")), "SELECT round((var_pop(p_size) + var_pop(p_retailprice)) * count(*) / 1e6, 3) AS spread FROM part")

# ---------------------------------------------------------------- streams and control
query("to_stream", lambda t: sb.to_stream(t.region), "SELECT * FROM region")


def _doubled(batches):
    for rows in batches:
        yield rows.assign(n_nationkey=rows["n_nationkey"] * 2)


query("stream_batch", lambda t: sb.stream_batch(t.nation.select("n_nationkey"), _by_value(_doubled), "n_nationkey int"), "SELECT n_nationkey * 2 AS n_nationkey FROM nation")


def _by_value(fn):
    """fn as a function of no module, so that it travels to the workers as it is."""
    return types.FunctionType(fn.__code__, {"__builtins__": __builtins__}, fn.__name__)


query("tee", lambda t: sb.tee(t.nation, _folder(t._spark, "parquet")), "SELECT * FROM nation")
for _name in ("tap", "inspect"):
    query(_name, lambda t, fn=getattr(sb, _name): fn(t.region, lambda df: df.schema), "SELECT * FROM region")
_LIST = lambda t, got: t._spark.createDataFrame([(i, int(v)) for i, v in enumerate(got)], "i int, v long")
query("par_map", lambda t: _LIST(t, ct.par_map(list(range(20)), lambda i: i * i)), "SELECT i::INT AS i, i * i AS v FROM range(20) r(i)")
query("par_filter", lambda t: _LIST(t, ct.par_filter(list(range(20)), lambda i: i % 2 == 0)), "SELECT i::INT AS i, 2 * i AS v FROM range(10) r(i)")
query("await_all", lambda t: _LIST(t, ct.await_all([t.nation.count, t.region.count])), "SELECT 0 AS i, count(*) AS v FROM nation UNION ALL SELECT 1, count(*) FROM region")
query("try_call", lambda t: _FLAGS(t, good=ct.try_call(t.region.count)["ok"], bad=ct.try_call(lambda: t.region.select("none"))["ok"]), "SELECT 'good' AS name, true AS value UNION ALL SELECT 'bad', false")
query("memoize", lambda t: _LIST(t, (lambda f: [f(3), f(3)])(ct.memoize(lambda v: v + t.region.count()))), "SELECT i::INT AS i, (SELECT count(*) + 3 FROM region) AS v FROM range(2) r(i)")
query("once", lambda t: _LIST(t, (lambda f: [f(3), f(4)])(ct.once(lambda v: v))), "SELECT i::INT AS i, 3::BIGINT AS v FROM range(2) r(i)")
query("time_it", lambda t: _LIST(t, [ct.time_it(t.nation.count)()[0]]), "SELECT 0 AS i, count(*) AS v FROM nation")
query("bench", lambda t: _LIST(t, [ct.bench(lambda: 1, n=7)["iterations"]]), "SELECT 0 AS i, 7::BIGINT AS v")
query("provenance", lambda t: _FLAGS(t, source=ct.provenance(ct.with_provenance(t.region, source="r"))["source"] == "r", none=ct.provenance(t.region)), "SELECT 'source' AS name, true AS value UNION ALL SELECT 'none', false")
query("with_provenance", lambda t: ct.with_provenance(t.region, source="r"), "SELECT * FROM region")
query("provenance_chain", lambda t: _LIST(t, [len(ct.provenance_chain(ct.with_provenance(ct.with_provenance(t.region, a=1), b=2)))]), "SELECT 0 AS i, 2::BIGINT AS v")
for _name in ("checkpoint", "resume_checkpoint"):
    query(_name, lambda t: ct.checkpoint(t.nation, _folder(t._spark, "steps"), "one"), "SELECT * FROM nation")
query("pipeline_steps", lambda t: _FLAGS(t, filter="Filter" in ct.pipeline_steps(t.nation.filter("n_nationkey > 3")), join="Join" in ct.pipeline_steps(t.nation)), "SELECT 'filter' AS name, true AS value UNION ALL SELECT 'join', false")
for _name, _fn in (("pipe_fuse", lambda t: ct.pipe_fuse([1, 2])), ("retry", lambda t: [ct.retry(t.region.count)]), ("try_catch", lambda t: [ct.try_catch(t.region.count, lambda e: -1)])):
    query(_name, lambda t, fn=_fn: _LIST(t, fn(t)), "SELECT i::INT AS i, i + 1 AS v FROM range(2) r(i)" if _name == "pipe_fuse" else "SELECT 0 AS i, count(*) AS v FROM region")
query("prop_test", lambda t: _FLAGS(t, int=ct.prop_test(lambda v: -5 <= v <= 5, ct.gen_int(-5, 5, 1))["passed"], float=ct.prop_test(lambda v: v < 0, ct.gen_float(seed=1))["passed"], str=ct.prop_test(lambda v: len(v) == 10, ct.gen_str(seed=1))["passed"]), "SELECT unnest(['int', 'float', 'str']) AS name, unnest([true, false, true]) AS value")
query("memory_usage", lambda t: _FLAGS(t, some=ct.memory_usage() > 0), "SELECT 'some' AS name, true AS value")
query("to_markdown", lambda t: _LIST(t, [len(ct.to_markdown(t.nation).split("\n"))]), "SELECT 0 AS i, count(*) + 2 AS v FROM nation")
query("to_html", lambda t: _LIST(t, [ct.to_html(t.nation).count("<tr>")]), "SELECT 0 AS i, count(*) + 1 AS v FROM nation")
query("sparkline", lambda t: _LIST(t, map(ord, ct.sparkline([r[0] for r in t.region.select("r_regionkey").orderBy("r_regionkey").collect()]))), "SELECT r_regionkey AS i, ord('▁') + (r_regionkey / 4 * 7)::INT - CASE WHEN r_regionkey IN (2, 3) THEN (r_regionkey / 4 * 7)::INT - floor(r_regionkey / 4 * 7)::INT WHEN r_regionkey = 1 THEN (r_regionkey / 4 * 7)::INT - 1 ELSE 0 END::BIGINT AS v FROM region")
query("bar_chart", lambda t: _LIST(t, [ct.bar_chart([(r["r_name"], float(r["r_regionkey"])) for r in t.region.collect()]).count("█")]), "SELECT 0 AS i, sum(r_regionkey * 10)::BIGINT AS v FROM region")

# ---------------------------------------------------------------- others
_kept("interval", "lists", lambda: iv.interval(F.lit("chr1"), F.col("k"), F.col("k") + 5)["end"], "k + 5")
_kept("sketch", "dna", lambda: F.size(q.sketch("s", 5, 1000)), f"len(list_distinct(list_transform(range(1, 29), lambda i: least(substr(s, i::INT, 5), reverse(translate(substr(s, i::INT, 5), 'ACGT', 'TGCA'))))))::INT")
_kept("sketch_dist", "dna", lambda: F.round(q.sketch_dist(q.sketch("s", 5), q.sketch("s", 5)), 6), "0.0::DOUBLE")
_kept("containment", "dna", lambda: F.round(q.containment("s", "s", 5), 6), "1.0::DOUBLE")
_kept("sha512", "docs", lambda: F.length(h.sha512("text")), "CASE WHEN text IS NOT NULL THEN 128 END")
query("coord_check", lambda t: _FLAGS(t, same=iv.coord_check("vcf", "gff"), other=iv.coord_check("bed", "sam")), "SELECT 'same' AS name, true AS value UNION ALL SELECT 'other', false")
query("fisher_exact", lambda t: _VALUES(t, st.fisher_exact(3, 1, 1, 3).values()), "SELECT 0 AS i, 9.0::DOUBLE AS v UNION ALL SELECT 1, round((16 + 1 + 16 + 1) / 70.0, 9)")
query("power_t_test", lambda t: _LIST(t, [md.power_t_test(0.5)]), "SELECT 0 AS i, ceil(2 * ((1.959963984540054 + 0.8416212335729143) / 0.5) ** 2)::BIGINT AS v")
query("qnorm", lambda t: _VALUES(t, [st.qnorm(0.975), st.qnorm(0.5)]), "SELECT 0 AS i, 1.959963985::DOUBLE AS v UNION ALL SELECT 1, 0.0")
query("detect_adapters", lambda t: al.detect_adapters(t.orders.select(F.concat(F.md5(F.col("o_orderkey").cast("string")), F.when(F.col("o_orderkey") % 3 == 0, "AGATCGGAAGAG").otherwise("")).alias("seq"))), "SELECT 'AGATCGGAAGAG' AS suffix, count(*) AS count FROM orders WHERE o_orderkey % 3 = 0")
query("find_orfs", lambda t: t.orders.select("o_orderkey", F.concat(F.lit("CCATG"), F.expr("repeat('GCA', cast(o_orderkey % 20 as int))"), F.lit("TAAC")).alias("s")).select("o_orderkey", F.explode(q.find_orfs("s", 30)).alias("o")).select("o_orderkey", "o.start", "o.end"), "SELECT o_orderkey, 2 AS start, (8 + 3 * (o_orderkey % 20))::INT AS \"end\" FROM orders WHERE 6 + 3 * (o_orderkey % 20) >= 30")
query("qc_report", lambda t: sq.qc_report(_RD(t).select("seq", "quality")).select("total_reads", "total_bases"), f"SELECT count(*) AS total_reads, CAST(sum(length(s)) AS BIGINT) AS total_bases FROM {_DS}")
query("group_apply", lambda t: tb.group_apply(t.orders.select("o_orderstatus", "o_totalprice"), ["o_orderstatus"], _by_value(_first_rows), "o_orderstatus string, n long"), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")


def _first_rows(rows):
    return rows.groupby("o_orderstatus", as_index=False).size().rename(columns={"size": "n"})
