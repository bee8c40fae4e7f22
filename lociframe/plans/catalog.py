"""Queries of the table, interval, sequence, matrix, graph and stream operators over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import variants as var
from ..operators import alignment as al
from ..operators import graph as gr
from ..operators import intervals as iv
from ..operators import matrix as mx
from ..operators import modelling as md
from ..operators import sequences as sq
from ..operators import tables as tb
from ..streaming import batches as sb
from . import scalars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(name: str, fn: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    if sql:
        SQL[name] = sql


def _r(x, digits: int = 4):
    return F.round(x, digits)


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"

# ---------------------------------------------------------------- projection, filters, schema
query("select", lambda t: tb.select(t.customer, "c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer")
query("drop_cols", lambda t: tb.drop_cols(t.nation, "n_name", "missing"), "SELECT n_nationkey, n_regionkey FROM nation")
query("rename", lambda t: tb.rename(t.region, "r_name", "name"), "SELECT r_regionkey, r_name AS name FROM region")
query("mutate", lambda t: tb.mutate(_orders(t), "with_tax", lambda r: r.o_totalprice * 2 + r.o_custkey), f"SELECT {_O}, o_totalprice * 2 + o_custkey AS with_tax FROM orders")
query("filter", lambda t: tb.filter_(_orders(t), lambda r: (r.o_totalprice > 100000) & (r.o_orderstatus == "F")), f"SELECT {_O} FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
query("where", lambda t: tb.where(t.part, lambda r: r.p_size < 10).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size < 10")
query("filter_by", lambda t: tb.filter_by(t.part, "p_name", "contains", "a").select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(p_name, 'a')")
query("filter_by_ne", lambda t: tb.filter_by(_orders(t), "o_orderstatus", "!=", "F"), f"SELECT {_O} FROM orders WHERE o_orderstatus <> 'F'")
query("multi_filter_by", lambda t: tb.multi_filter_by(_orders(t), "o_totalprice", ">=", 50000.0, "o_orderstatus", "==", "O"), f"SELECT {_O} FROM orders WHERE o_totalprice >= 50000 AND o_orderstatus = 'O'")
query("count_where", lambda t: tb.count_where(t.orders, "o_totalprice", "<", 1000.0), "SELECT count(*) AS count FROM orders WHERE o_totalprice < 1000")
query("partition_matching", lambda t: tb.partition(_orders(t), lambda r: r.o_totalprice > 150000)[0], f"SELECT {_O} FROM orders WHERE o_totalprice > 150000")
query("partition_rest", lambda t: tb.partition(_orders(t), lambda r: r.o_totalprice > 150000)[1], f"SELECT {_O} FROM orders WHERE NOT o_totalprice > 150000")
query("case_when", lambda t: t.part.select("p_partkey", tb.case_when(F.col("p_size") < 10, "small", F.col("p_size") < 30, "middle", otherwise="large").alias("size")), "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size FROM part")
query("any_rows", lambda t: tb.any_(t.orders, lambda r: r.o_totalprice > 400000), "SELECT coalesce(bool_or(o_totalprice > 400000), false) AS \"any\" FROM orders")
query("all_rows", lambda t: tb.all_(t.orders, lambda r: r.o_totalprice > 0), "SELECT coalesce(bool_and(o_totalprice > 0), true) AS \"all\" FROM orders")
query("table_cast", lambda t: tb.table_cast(t.documents.select("doc_id", F.regexp_replace("source", "src", "").alias("n")), "n", "Int"), "SELECT doc_id, TRY_CAST(replace(source, 'src', '') AS BIGINT) AS n FROM documents")
query("table_validate", lambda t: tb.table_validate(tb.table_set_col_type(t.documents.select("doc_id", "lang"), "lang", "Int")), "SELECT 'lang' AS \"column\", count(*) FILTER (lang IS NOT NULL AND TRY_CAST(lang AS BIGINT) IS NULL) AS errors FROM documents")
query("describe", lambda t: tb.describe(t.customer.select("c_custkey", "c_name")).select("column", "count", "null_count", _r("mean").alias("mean"), _r("std", 2).alias("std"), "min", "max"),
      "SELECT 'c_custkey' AS \"column\", count(c_custkey) AS count, count(*) - count(c_custkey) AS null_count, round(avg(c_custkey), 4) AS mean, round(stddev_pop(c_custkey), 2) AS std, min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max FROM customer UNION ALL SELECT 'c_name', count(c_name), count(*) - count(c_name), NULL, NULL, NULL, NULL FROM customer")
query("nrow", lambda t: t.lineitem.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem")
query("table_schema", lambda t: tb.table_schema(t.region).select("name"), "SELECT 'r_regionkey' AS name UNION ALL SELECT 'r_name'")
query("diff_table", lambda t: tb.diff_table(t.orders.filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus"), t.orders.filter("o_orderkey % 3 <> 1").select("o_orderkey", F.expr("if(o_orderkey % 2 = 0, 'X', o_orderstatus)").alias("o_orderstatus")), "o_orderkey"),
      "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus = b.s THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 <> 1) b ON a.o_orderkey = b.o_orderkey")

# ---------------------------------------------------------------- joins
_CUST = lambda t: t.customer.select(F.col("c_custkey").alias("key"), "c_name")
_ORD = lambda t: t.orders.select(F.col("o_custkey").alias("key"), "o_orderkey")
_CS, _OS = "(SELECT c_custkey AS key, c_name FROM customer)", "(SELECT o_custkey AS key, o_orderkey FROM orders)"
query("inner_join", lambda t: tb.inner_join(_CUST(t), _ORD(t), "key"), f"SELECT key, c_name, o_orderkey FROM {_CS} JOIN {_OS} USING (key)")
query("left_join", lambda t: tb.left_join(_CUST(t), _ORD(t), "key"), f"SELECT key, c_name, o_orderkey FROM {_CS} LEFT JOIN {_OS} USING (key)")
query("right_join", lambda t: tb.right_join(_ORD(t), _CUST(t), "key"), f"SELECT key, c_name, o_orderkey FROM {_CS} LEFT JOIN {_OS} USING (key)")
query("outer_join", lambda t: tb.outer_join(_CUST(t).filter("key % 2 = 0"), _ORD(t), "key"), f"SELECT key, c_name, o_orderkey FROM (SELECT * FROM {_CS} WHERE key % 2 = 0) FULL JOIN {_OS} USING (key)")
query("semi_join", lambda t: tb.semi_join(_CUST(t), _ORD(t), "key"), f"SELECT key, c_name FROM {_CS} WHERE key IN (SELECT o_custkey FROM orders)")
query("anti_join", lambda t: tb.anti_join(_CUST(t), _ORD(t).filter("o_orderkey % 5 = 0"), "key"), f"SELECT key, c_name FROM {_CS} WHERE key NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
query("cross_join", lambda t: tb.cross_join(t.nation.select("n_name"), t.region.select("r_name")), "SELECT n_name, r_name FROM nation, region")
query("multi_key_join", lambda t: tb.inner_join(t.lineitem.select("l_partkey", "l_suppkey", "l_quantity"), t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")), ["l_partkey", "l_suppkey"]),
      "SELECT l_partkey, l_suppkey, l_quantity, n FROM lineitem JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) USING (l_partkey, l_suppkey)")
query("null_key_join", lambda t: tb.inner_join(t.lineitem.groupBy(F.nullif("l_linenumber", F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("n")), t.lineitem.groupBy(F.nullif("l_linenumber", F.lit(1)).alias("k")).agg(F.sum("l_orderkey").alias("s")), "k"),
      "SELECT nullif(l_linenumber, 1) AS k, count(*) AS n, sum(l_orderkey)::BIGINT AS s FROM lineitem GROUP BY 1")
query("bio_join", lambda t: tb.bio_join(t.customer.select(F.upper("c_mktsegment").alias("symbol"), "c_custkey"), t.customer.groupBy(F.lower("c_mktsegment").alias("symbol")).agg(F.count(F.lit(1)).alias("n")), "symbol"),
      "SELECT upper(c_mktsegment) AS symbol, c_custkey, n FROM customer JOIN (SELECT lower(c_mktsegment) AS s, count(*) AS n FROM customer GROUP BY 1) ON lower(c_mktsegment) = s")
query("bind_cols", lambda t: tb.bind_cols(t.nation.select("n_nationkey"), t.nation.select("n_name"), "n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r FROM nation) USING (r)")

# ---------------------------------------------------------------- grouping
query("group_stats", lambda t: tb.group_stats(t.orders, "o_orderstatus", "o_totalprice", "mean").select("o_orderstatus", _r("value", 2).alias("value")), "SELECT o_orderstatus, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1")
query("group_stats_stdev", lambda t: tb.group_stats(t.orders, "o_orderstatus", "o_totalprice", "stdev").select("o_orderstatus", _r("value", 2).alias("value")), "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 2) AS value FROM orders GROUP BY 1")
query("summarize", lambda t: tb.summarize(t.lineitem, ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)), qty=F.sum("l_quantity"), price=_r(F.avg("l_extendedprice"), 2)), "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_extendedprice), 2) AS price FROM lineitem GROUP BY ALL")
query("group_by", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")), "SELECT l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
query("count_by", lambda t: tb.count_by(t.events, "event_type"), "SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1")
query("value_counts", lambda t: tb.value_counts(t.customer, "c_mktsegment"), "SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1")
query("frequencies", lambda t: tb.frequencies(t.documents, "source"), "SELECT source AS value, count(*) AS count FROM documents GROUP BY 1")
query("mode", lambda t: tb.mode(t.lineitem, "l_quantity"), "SELECT v AS mode FROM (SELECT CAST(round(l_quantity) AS BIGINT) AS v, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, v LIMIT 1")
query("quantile", lambda t: tb.quantile(t.orders, "o_totalprice", 0.9).select(_r("quantile").alias("quantile")), "SELECT round(quantile_cont(o_totalprice, 0.9), 4) AS quantile FROM orders")
query("median", lambda t: t.orders.agg(_r(F.median("o_totalprice")).alias("median")), "SELECT round(median(o_totalprice), 4) AS median FROM orders")
query("stdev", lambda t: t.orders.agg(_r(F.stddev_samp("o_totalprice"), 2).alias("stdev")), "SELECT round(stddev_samp(o_totalprice), 2) AS stdev FROM orders")
query("variance", lambda t: t.lineitem.agg(_r(F.var_samp("l_quantity")).alias("variance")), "SELECT round(var_samp(l_quantity), 4) AS variance FROM lineitem")
query("cor", lambda t: tb.cor(t.lineitem, "l_quantity", "l_extendedprice").select(_r("cor", 6).alias("cor")), "SELECT round(corr(l_quantity, l_extendedprice), 6) AS cor FROM lineitem")
query("rollup", lambda t: tb.rollup_stats(t.lineitem, ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("n")), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
query("cube", lambda t: tb.cube_stats(t.lineitem, ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("n")), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
query("count_distinct", lambda t: t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n")), "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")

# ---------------------------------------------------------------- order and windows
query("row_number", lambda t: tb.row_number(_orders(t), "o_orderkey").select("o_orderkey", "row_number"), "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders")
query("rank", lambda t: tb.rank(t.part.select("p_partkey", "p_size"), "p_size"), "SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) AS rank FROM part")
query("lag", lambda t: tb.lag(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 2), "SELECT o_orderkey, o_custkey, lag(o_custkey, 2) OVER (ORDER BY o_orderkey) AS o_custkey_lag2 FROM orders")
query("lead", lambda t: tb.lead(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey"), "SELECT o_orderkey, o_custkey, lead(o_custkey) OVER (ORDER BY o_orderkey) AS o_custkey_lead1 FROM orders")
query("cumsum", lambda t: tb.cumsum(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey"), "SELECT o_orderkey, o_custkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey) AS DOUBLE) AS o_custkey_cumsum FROM orders")
query("cummax", lambda t: tb.cummax(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey"), "SELECT o_orderkey, o_totalprice, max(o_totalprice) OVER (ORDER BY o_orderkey) AS o_totalprice_cummax FROM orders")
query("cummin", lambda t: tb.cummin(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey"), "SELECT o_orderkey, o_totalprice, min(o_totalprice) OVER (ORDER BY o_orderkey) AS o_totalprice_cummin FROM orders")
query("rolling_mean", lambda t: tb.rolling_mean(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 5).withColumn("o_custkey_rmean5", _r("o_custkey_rmean5")), "SELECT o_orderkey, o_custkey, CASE WHEN count(o_custkey) OVER w = 5 THEN round(avg(o_custkey) OVER w, 4) END AS o_custkey_rmean5 FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
query("rolling_sum", lambda t: tb.rolling_sum(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 3), "SELECT o_orderkey, o_custkey, CASE WHEN count(o_custkey) OVER w = 3 THEN CAST(sum(o_custkey) OVER w AS DOUBLE) END AS o_custkey_rsum3 FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
query("normalize_zscore", lambda t: tb.normalize(t.part.select("p_partkey", F.col("p_retailprice").alias("x")), "x").withColumn("x", _r("x")), "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 4) AS x FROM part")
query("normalize_minmax", lambda t: tb.normalize(t.part.select("p_partkey", F.col("p_retailprice").alias("x")), "x", "minmax").withColumn("x", _r("x")), "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 4) AS x FROM part")
query("arrange", lambda t: tb.arrange(_orders(t), "o_orderstatus", "-o_totalprice"), f"SELECT {_O} FROM orders ORDER BY o_orderstatus, o_totalprice DESC")
query("head", lambda t: tb.head(_orders(t), 7, "o_orderkey"), f"SELECT {_O} FROM orders ORDER BY o_orderkey LIMIT 7")
query("tail", lambda t: tb.tail(_orders(t), "o_orderkey", 7), f"SELECT {_O} FROM orders ORDER BY o_orderkey DESC LIMIT 7")
query("drop", lambda t: tb.drop(_orders(t), "o_orderkey", 10), f"SELECT {_O} FROM orders ORDER BY o_orderkey OFFSET 10")
query("slice", lambda t: tb.slice_(_orders(t), "o_orderkey", 5, 25), f"SELECT {_O} FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 5")
query("reverse", lambda t: tb.reverse(t.nation, "n_nationkey"), "SELECT * FROM nation ORDER BY n_nationkey DESC")
query("sample", lambda t: tb.sample(t.orders.select("o_orderkey"), 100, "o_orderkey"), "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, greatest(1, count(*) OVER () // 100) AS s FROM orders) WHERE r % s = 0 AND r / s < 100")
query("distinct", lambda t: tb.distinct(t.orders.select("o_orderstatus", "o_orderpriority")), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
query("distinct_by", lambda t: tb.distinct(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"]), "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
query("top_k", lambda t: tb.top_k(_orders(t), "o_orderpriority", ["-o_totalprice", "o_orderkey"], 3), f"SELECT {_O} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")

# ---------------------------------------------------------------- stacking and reshaping
_NAT = lambda t, test: t.nation.filter(test).select("n_name")
query("concat", lambda t: tb.concat(_NAT(t, "n_nationkey < 15"), _NAT(t, "n_nationkey > 10")), "SELECT n_name FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_name FROM nation WHERE n_nationkey > 10")
query("union", lambda t: tb.union(_NAT(t, "n_nationkey < 15"), _NAT(t, "n_nationkey > 10")), "SELECT n_name FROM nation WHERE n_nationkey < 15 UNION SELECT n_name FROM nation WHERE n_nationkey > 10")
query("intersection", lambda t: tb.intersection(_NAT(t, "n_nationkey < 15"), _NAT(t, "n_nationkey > 10")), "SELECT n_name FROM nation WHERE n_nationkey < 15 INTERSECT SELECT n_name FROM nation WHERE n_nationkey > 10")
query("difference", lambda t: tb.difference(_NAT(t, "n_nationkey < 15"), _NAT(t, "n_nationkey > 10")), "SELECT n_name FROM nation WHERE n_nationkey < 15 EXCEPT SELECT n_name FROM nation WHERE n_nationkey > 10")
query("explode", lambda t: tb.explode(t.documents.select("doc_id", F.split("text", "\n", -1).alias("line")), "line"), "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
query("pivot_longer", lambda t: tb.pivot_longer(t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), ["size", "price"]), "SELECT p_partkey, 'size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
query("pivot_wider", lambda t: tb.pivot_wider(t.orders.groupBy("o_orderpriority", "o_orderstatus").count(), "o_orderstatus", "count", ["F", "O", "P"]), "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
query("chunk", lambda t: tb.chunk(t.orders.select("o_orderkey"), "o_orderkey", 100), "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS chunk FROM orders")
query("flat_map", lambda t: tb.flat_map(t.nation.select("n_nationkey"), "v", lambda r: F.array(r.n_nationkey, r.n_nationkey * 10)), "SELECT n_nationkey, unnest([n_nationkey, n_nationkey * 10]) AS v FROM nation")

# ---------------------------------------------------------------- intervals


def _spans(t: Tables, test: str = "true") -> DataFrame:
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.events.filter(test).select(F.col("event_type").alias("chrom"), start.alias("start"), (start + 1 + F.floor(F.col("value") * 40).cast("long")).alias("end"), "event_id")


def _sp(test: str = "true") -> str:
    return f"(SELECT event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 1 + CAST(floor(value * 40) AS BIGINT) AS \"end\", event_id FROM events WHERE {test})"


_ODD, _EVEN = "event_id % 2 = 1", "event_id % 2 = 0"
_HIT = "a.chrom = b.chrom AND a.start < b.\"end\" AND b.start < a.\"end\""
query("overlap_pairs", lambda t: iv.overlap_pairs(_spans(t, _ODD), _spans(t, _EVEN)).select("event_id", "b_event_id"), f"SELECT a.event_id, b.event_id AS b_event_id FROM {_sp(_ODD)} a JOIN {_sp(_EVEN)} b ON {_HIT}")
query("intersect", lambda t: iv.intersect(_spans(t, _ODD), _spans(t, _EVEN)), f"SELECT * FROM {_sp(_ODD)} a WHERE EXISTS (SELECT 1 FROM {_sp(_EVEN)} b WHERE {_HIT})")
query("subtract", lambda t: iv.subtract(_spans(t, _ODD), _spans(t, _EVEN)), f"SELECT * FROM {_sp(_ODD)} a WHERE NOT EXISTS (SELECT 1 FROM {_sp(_EVEN)} b WHERE {_HIT})")
query("bulk_overlaps", lambda t: iv.bulk_overlaps(_spans(t, _ODD), _spans(t, _EVEN)), f"SELECT count(*) AS count FROM {_sp(_EVEN)} a JOIN {_sp(_ODD)} b ON {_HIT}")
query("query_overlaps", lambda t: iv.query_overlaps(_spans(t), "click", 1704067200, 1704672000), f"SELECT * FROM {_sp()} WHERE chrom = 'click' AND start < 1704672000 AND \"end\" > 1704067200")
query("count_overlaps", lambda t: iv.count_overlaps(_spans(t), "view", 1704067200, 1706745600), f"SELECT count(*) AS count FROM {_sp()} WHERE chrom = 'view' AND start < 1706745600 AND \"end\" > 1704067200")
query("query_nearest", lambda t: iv.query_nearest(_spans(t), "click", 1705000000, 5).select("start", "end", "distance"), f"SELECT start, \"end\", greatest(0, start - 1705000000, 1705000000 - \"end\" + 1) AS distance FROM {_sp()} WHERE chrom = 'click' ORDER BY distance, start, \"end\" LIMIT 5")
query("closest", lambda t: iv.closest(_spans(t, _ODD), _spans(t, _EVEN)).select("event_id", "distance"), f"SELECT a.event_id, min(abs((a.start + a.\"end\") // 2 - (b.start + b.\"end\") // 2)) AS distance FROM {_sp(_ODD)} a LEFT JOIN {_sp(_EVEN)} b USING (chrom) GROUP BY 1")
query("merge_intervals", lambda t: iv.merge_intervals(_spans(t)), f"SELECT chrom, min(start) AS start, max(\"end\") AS \"end\" FROM (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start <= max(\"end\") OVER (PARTITION BY chrom ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {_sp()})) GROUP BY chrom, g")
query("coverage", lambda t: iv.coverage(_spans(t)), f"SELECT chrom, start, \"end\", depth FROM (SELECT chrom, pos AS start, lead(pos) OVER w AS \"end\", CAST(sum(d) OVER w AS BIGINT) AS depth FROM (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM {_sp()} UNION ALL SELECT chrom, \"end\", -1 FROM {_sp()}) GROUP BY ALL) WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE depth > 0")
query("flank", lambda t: iv.flank(_spans(t), 100).select("event_id", "start", "end"), f"SELECT event_id, greatest(start - 100, 0) AS start, start AS \"end\" FROM {_sp()} UNION ALL SELECT event_id, \"end\", \"end\" + 100 FROM {_sp()}")
query("windows", lambda t: iv.windows(_spans(t), 5000).select("event_id", "start", "end"), f"SELECT event_id, s AS start, least(s + 5000, e) AS \"end\" FROM (SELECT event_id, \"end\" AS e, unnest(range(start, \"end\", 5000)) AS s FROM {_sp()})")
query("coord_convert", lambda t: _spans(t).select("event_id", iv.coord_convert(F.col("start"), "bed", "vcf").alias("start")), f"SELECT event_id, start + 1 AS start FROM {_sp()}")
query("add_chr", lambda t: t.nation.select("n_nationkey", iv.add_chr(F.col("n_nationkey").cast("string")).alias("chrom")), "SELECT n_nationkey, concat('chr', n_nationkey) AS chrom FROM nation")
query("strip_chr", lambda t: t.nation.select("n_nationkey", iv.strip_chr(F.concat(F.lit("chr"), F.col("n_nationkey"))).alias("chrom")), "SELECT n_nationkey, n_nationkey::VARCHAR AS chrom FROM nation")
query("normalize_chrom", lambda t: t.region.select("r_regionkey", iv.normalize_chrom(F.concat(F.lit("CHR"), F.expr("element_at(array('mt', 'x', '1', 'Y', 'M'), r_regionkey + 1)"))).alias("chrom")), "SELECT r_regionkey, ['chrM', 'chrX', 'chr1', 'chrY', 'chrM'][r_regionkey + 1] AS chrom FROM region")
_CNT = lambda t: t.orders.groupBy(F.col("o_custkey").alias("gene")).agg(F.count(F.lit(1)).alias("count"))
_LEN = lambda t: t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("gene"), (F.col("c_custkey") % 500 + 200).alias("length"))
_CL = "(SELECT o_custkey AS gene, count(*) AS count FROM orders GROUP BY 1) LEFT JOIN (SELECT c_custkey AS gene, c_custkey % 500 + 200 AS length FROM customer WHERE c_custkey % 3 <> 0) USING (gene)"
query("tpm", lambda t: iv.tpm(_CNT(t), _LEN(t)).withColumn("tpm", _r("tpm")), f"SELECT gene, count, round(count / (coalesce(length, 1000) / 1000) / sum(count / (coalesce(length, 1000) / 1000)) OVER () * 1e6, 4) AS tpm FROM {_CL}")
query("fpkm", lambda t: iv.fpkm(_CNT(t), _LEN(t), 15000.0).withColumn("fpkm", _r("fpkm")), f"SELECT gene, count, round(count / (15000.0::DOUBLE / 1e6 * coalesce(length, 1000) / 1e3), 4) AS fpkm FROM {_CL}")
query("cpm", lambda t: iv.cpm(_CNT(t)).withColumn("cpm", _r("cpm")), "SELECT o_custkey AS gene, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 1e6, 4) AS cpm FROM orders GROUP BY 1")

# ---------------------------------------------------------------- sequences and variants
_DNA = lambda t: scalars.BASES["dna"][0](t._spark, t._dir)
_DS = f"({scalars.BASES['dna'][1]})"
_VAR = lambda t: scalars.BASES["alleles"][0](t._spark, t._dir).withColumns({"chrom": F.concat(F.lit("chr"), F.col("k") % 5), "pos": F.col("k"), "qual": (F.col("k") % 60).cast("double")})
_VS = f"(SELECT *, concat('chr', k % 5) AS chrom, k AS pos, (k % 60)::DOUBLE AS qual FROM ({scalars.BASES['alleles'][1]}))"
_KM = f"(SELECT least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT substr(s, i::INT, 5) AS m FROM {_DS}, range(1, 29) AS r(i)))"
query("kmer_count", lambda t: sq.kmer_count(_DNA(t), "s", 5), f"SELECT kmer, count(*) AS count FROM {_KM} GROUP BY 1")
query("kmer_count_top", lambda t: sq.kmer_count(_DNA(t), "s", 5, 20), f"SELECT kmer, count(*) AS count FROM {_KM} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
query("kmer_distinct", lambda t: sq.kmer_distinct(_DNA(t), "s", 5), f"SELECT count(DISTINCT kmer) AS \"distinct\" FROM {_KM}")
query("kmer_spectrum", lambda t: sq.kmer_spectrum(sq.kmer_count(_DNA(t), "s", 5)), f"SELECT count, count(*) AS kmers FROM (SELECT kmer, count(*) AS count FROM {_KM} GROUP BY 1) GROUP BY 1")
query("de_bruijn_graph", lambda t: sq.de_bruijn_edges(_DNA(t), "s", 6), f"SELECT left(m, 5) AS \"from\", right(m, 5) AS \"to\", count(*) AS weight FROM (SELECT substr(s, i::INT, 6) AS m FROM {_DS}, range(1, 28) AS r(i)) GROUP BY ALL")
query("consensus", lambda t: sq.consensus(_DNA(t), "s"), f"SELECT pos, arg_max(base, (n, base)) AS base FROM (SELECT (i - 1)::INT AS pos, substr(s, i::INT, 1) AS base, count(*) AS n FROM {_DS}, range(1, 33) AS r(i) GROUP BY ALL) GROUP BY 1")
query("pwm", lambda t: sq.pwm(_DNA(t), "s").select("pos", *[_r(b, 6).alias(b) for b in "ACGT"]), f"SELECT (i - 1)::INT AS pos, " + ", ".join(f"round(count(*) FILTER (substr(s, i::INT, 1) = '{b}')::DOUBLE / count(*), 6) AS {b}" for b in "ACGT") + f" FROM {_DS}, range(1, 33) AS r(i) GROUP BY 1")
query("conservation_scores", lambda t: sq.conservation_scores(_DNA(t), "s").select("pos", _r("score", 6).alias("score")), f"SELECT pos, round(1 - (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)), 6) AS score FROM (SELECT (i - 1)::INT AS pos, substr(s, i::INT, 1) AS base, count(*) AS n FROM {_DS}, range(1, 33) AS r(i) GROUP BY ALL) GROUP BY 1")
query("fasta_stats", lambda t: sq.sequence_stats(t.documents.select(F.col("text").alias("seq"))).select("count", "total", "min", "max", "n50"), "SELECT (SELECT count(*) FROM documents) AS count, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS total, (SELECT CAST(min(length(text)) AS BIGINT) FROM documents) AS min, (SELECT CAST(max(length(text)) AS BIGINT) FROM documents) AS max, (SELECT CAST(max(n) AS BIGINT) FROM (SELECT n, sum(n) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS a FROM (SELECT length(text) AS n FROM documents)) WHERE 2 * run >= a) AS n50")
query("variant_summary", lambda t: sq.variant_summary(_VAR(t)).withColumn("mean_qual", _r("mean_qual")), f"SELECT chrom AS \"group\", count(*) AS total, count(*) FILTER (length(ref) = 1 AND length(alt) = 1) AS snps, count(*) FILTER (length(ref) <> length(alt)) AS indels, round(avg(qual), 4) AS mean_qual FROM {_VS} GROUP BY 1")
_TS, _SNP = "(ref || alt) IN ('AG', 'GA', 'CT', 'TC')", "length(ref) = 1 AND length(alt) = 1"
query("tstv_ratio", lambda t: sq.tstv_ratio(_VAR(t)).select(_r("tstv", 6).alias("tstv")), f"SELECT round(count(*) FILTER ({_TS})::DOUBLE / count(*) FILTER ({_SNP} AND NOT {_TS}), 6) AS tstv FROM {_VS}")
query("variant_stats", lambda t: sq.variant_stats(_VAR(t)).select("snp", "indel", "mnp", "ts", "tv"), f"SELECT count(*) FILTER ({_SNP}) AS snp, count(*) FILTER (length(ref) <> length(alt)) AS indel, count(*) FILTER (length(ref) = length(alt) AND length(ref) > 1) AS mnp, count(*) FILTER ({_TS}) AS ts, count(*) FILTER ({_SNP} AND NOT {_TS}) AS tv FROM {_VS}")
query("het_hom_ratio", lambda t: sq.het_hom_ratio(_VAR(t)).select(_r("ratio", 6).alias("ratio")), f"SELECT round(count(*) FILTER (split_part(gt, '/', 1) <> split_part(gt, '/', 2))::DOUBLE / count(*) FILTER (gt = '1/1'), 6) AS ratio FROM {_VS}")
query("decompose_mnp", lambda t: _VAR(t).select("k", F.explode(var.decompose_mnp("pos", "ref", "alt")).alias("v")).select("k", "v.pos", "v.ref", "v.alt"), f"SELECT k, pos + i - 1 AS pos, substr(ref, i::INT, 1) AS ref, substr(alt, i::INT, 1) AS alt FROM {_VS}, range(1, 4) AS r(i) WHERE length(ref) = length(alt) AND i <= length(ref) AND substr(ref, i::INT, 1) <> substr(alt, i::INT, 1) UNION ALL SELECT k, pos, ref, alt FROM {_VS} WHERE length(ref) <> length(alt)")
query("flagstat", lambda t: sq.flagstat(t.orders.select((F.col("o_orderkey") % 4096).alias("flag"))).select("total", "mapped", "paired", "duplicate"), "SELECT count(*) AS total, count(*) FILTER ((o_orderkey % 4096) & 4 = 0) AS mapped, count(*) FILTER ((o_orderkey % 4096) & 1 <> 0) AS paired, count(*) FILTER ((o_orderkey % 4096) & 1024 <> 0) AS duplicate FROM orders")

_AL = lambda t: t.orders.select((F.col("o_orderkey") % 4096).alias("flag"), F.concat(F.lit("chr"), F.col("o_custkey") % 4).alias("rname"), (F.col("o_orderkey") * 13 + 1).alias("pos"), (F.col("o_custkey") % 700 - 200).alias("tlen"), F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
_AS = "(SELECT o_orderkey % 4096 AS flag, concat('chr', o_custkey % 4) AS rname, o_orderkey * 13 + 1 AS pos, o_custkey % 700 - 200 AS tlen, translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM orders)"
query("mapping_rate", lambda t: sq.mapping_rate(_AL(t)).select("total", "mapped", "primary_mapped", "proper_pair", _r("mapping_rate", 6).alias("mapping_rate")), f"SELECT count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 = 0 AND flag & 256 = 0 AND flag & 2048 = 0) AS primary_mapped, count(*) FILTER (flag & 2 <> 0) AS proper_pair, round(count(*) FILTER (flag & 4 = 0)::DOUBLE / count(*), 6) AS mapping_rate FROM {_AS}")
query("insert_size", lambda t: sq.insert_size(_AL(t)).select("count", _r("mean").alias("mean"), "median", "p25", "p75", "min", "max"), f"SELECT count(*) AS count, round(avg(tlen), 4) AS mean, median(tlen) AS median, quantile_cont(tlen, 0.25) AS p25, quantile_cont(tlen, 0.75) AS p75, min(tlen) AS min, max(tlen) AS max FROM {_AS} WHERE flag & 2 <> 0 AND tlen > 0")
query("depth", lambda t: sq.depth(_AL(t), 100000).withColumn("mean_depth", _r("mean_depth")), f"SELECT count(*) AS total_reads, count(*) FILTER (flag & 4 = 0) AS mapped_reads, CAST(sum(length(seq)) FILTER (flag & 4 = 0) AS BIGINT) AS total_aligned_bases, 100000::BIGINT AS genome_size, round(sum(length(seq)) FILTER (flag & 4 = 0) / 100000.0, 4)::DOUBLE AS mean_depth FROM {_AS}")
query("coverage_hist", lambda t: sq.coverage_hist(_AL(t), 5000), f"SELECT rname, (pos - 1) // 5000 AS bin, count(*) AS reads FROM {_AS} WHERE flag & 4 = 0 GROUP BY ALL")
query("gc_bias", lambda t: sq.gc_bias(_AL(t)), f"SELECT least(CAST(floor(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) * 20) AS BIGINT), 19) AS gc_bin, count(*) AS reads FROM {_AS} GROUP BY 1")
query("on_target", lambda t: sq.on_target(_AL(t), t.nation.select(F.concat(F.lit("chr"), F.col("n_nationkey") % 4).alias("chrom"), (F.col("n_nationkey") * 1000).cast("long").alias("start"), (F.col("n_nationkey") * 1000 + 400).cast("long").alias("end"))).select(_r("fraction", 6).alias("fraction")),
      f"SELECT round(count(*) FILTER (EXISTS (SELECT 1 FROM nation WHERE concat('chr', n_nationkey % 4) = rname AND pos - 1 < n_nationkey * 1000 + 400 AND n_nationkey * 1000 < pos - 1 + length(seq)))::DOUBLE / count(*), 6) AS fraction FROM {_AS} WHERE flag & 4 = 0")
query("liftover", lambda t: sq.liftover(_spans(t), t.events.groupBy(F.col("event_type").alias("chrom")).agg(F.lit(0).cast("long").alias("start"), F.lit(4000000000).alias("end"), F.first("event_type").alias("to_chrom"), F.lit(1000).cast("long").alias("offset"))), f"SELECT chrom, start + 1000 AS start, \"end\" + 1000 AS \"end\", event_id FROM {_sp()}")
query("scan_bio", lambda t: sq.scan_bio(t.orders.select("o_orderkey", F.concat(F.lit("see rs"), F.col("o_orderkey"), F.lit(" and ACGTACGTACGTA")).alias("x")), "x").select("o_orderkey", "kind", "value"), "SELECT o_orderkey, 'dna' AS kind, 'ACGTACGTACGTA' AS value FROM orders UNION ALL SELECT o_orderkey, 'rsid', concat('rs', o_orderkey) FROM orders WHERE o_orderkey >= 100")

# ---------------------------------------------------------------- statistics
query("lm", lambda t: st.lm(t.lineitem, "l_quantity", "l_extendedprice").select(_r("slope").alias("slope"), _r("r_squared", 6).alias("r_squared")), "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem")
query("hist", lambda t: st.hist(t.orders, "o_totalprice", 20), "SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 20)) AS BIGINT), 19) AS bin, count(*) AS count FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
query("average_ranks", lambda t: st.average_ranks(t.part.select("p_partkey", "p_size"), "p_size", "r"), "SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS r FROM part")
query("p_adjust", lambda t: st.p_adjust(t.orders.select("o_orderkey", (F.col("o_orderkey") / 1048576).alias("p")), "p").withColumn("adjusted", _r("adjusted", 5)), "SELECT o_orderkey, o_orderkey / 1048576 AS p, round(least(o_orderkey / 1048576 * count(*) OVER () / row_number() OVER (ORDER BY o_orderkey), 1.0), 5) AS adjusted FROM orders")
query("kaplan_meier", lambda t: st.kaplan_meier(t.part.select("p_size", (F.col("p_partkey") % 3 > 0).alias("e")), "p_size", "e").withColumn("survival", _r("survival", 6)), "WITH a AS (SELECT p_size AS time, count(*) AS n, count(*) FILTER (p_partkey % 3 > 0) AS d FROM part GROUP BY 1), b AS (SELECT time, d, CAST(sum(n) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM a) SELECT time, at_risk, round(exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE -1e9 END) OVER (ORDER BY time)), 6) AS survival FROM b WHERE d > 0")


def _numbers(name: str, fn: Callable[[Tables], dict], **sql: str) -> None:
    """A row for each number that SQL gives as well (rounded to nine significant digits); tests check the p-values."""
    def run(t: Tables) -> DataFrame:
        got = fn(t)
        return t._spark.createDataFrame([(k, float(f"{float(got[k]):.9g}")) for k in sql], "name string, value double")

    source = sql.pop("source")
    digits = lambda e: f"CAST(printf('%.9g', CAST({e} AS DOUBLE)) AS DOUBLE)"
    query(name, run, " UNION ALL ".join(f"SELECT '{k}' AS name, {digits(e)} AS value FROM ({source})" for k, e in sql.items()))


_numbers("ttest", lambda t: st.ttest(t.lineitem, "l_quantity", "l_tax"), source="SELECT count(*) AS n, avg(l_quantity) AS a, avg(l_tax) AS b, (var_samp(l_quantity) + var_samp(l_tax)) / 2 AS v FROM lineitem", t_statistic="(a - b) / sqrt(v * 2 / n)", df="2 * n - 2")
_numbers("ttest_one", lambda t: st.ttest_one(t.lineitem, "l_quantity", 25.0), source="SELECT count(*) AS n, avg(l_quantity) AS a, var_samp(l_quantity) AS v FROM lineitem", t_statistic="(a - 25) / sqrt(v / n)", df="n - 1")
_numbers("ttest_paired", lambda t: st.ttest_paired(t.lineitem, "l_discount", "l_tax"), source="SELECT count(*) AS n, avg(l_discount - l_tax) AS a, var_samp(l_discount - l_tax) AS v FROM lineitem", t_statistic="a / sqrt(v / n)", df="n - 1")
_numbers("anova", lambda t: st.anova(t.orders, "o_orderstatus", "o_totalprice"), source="SELECT count(*) AS k, sum(n) AS n, sum(n * (m - g) * (m - g)) AS b, sum(w) AS w FROM (SELECT count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) * (count(*) - 1) AS w, (SELECT avg(o_totalprice) FROM orders) AS g FROM orders GROUP BY o_orderstatus)", f_statistic="(b / (k - 1)) / (w / (n - k))", df_between="k - 1", df_within="n - k")
_numbers("chi_square", lambda t: st.chi_square(t.events.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("o"), F.lit(2000.0).alias("e")), "o", "e"), source="SELECT sum((o - 2000.0) * (o - 2000.0) / 2000.0) AS x, count(*) AS k FROM (SELECT count(*) AS o FROM events GROUP BY event_type)", chi_square="x", df="k - 1")
_RANKS = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"
_numbers("spearman", lambda t: st.spearman(t.part.select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")), "a", "b"), source=f"SELECT corr(a, b) AS r, count(*) AS n FROM (SELECT {_RANKS.format('p_size')} AS a, {_RANKS.format('p_retailprice')} AS b FROM part)", coefficient="r", n="n")

_numbers("wilcoxon", lambda t: md.wilcoxon(t.orders.filter("o_orderstatus <> 'P'").select("o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice"), source=f"SELECT count(*) FILTER (s = 'F') AS n, count(*) FILTER (s <> 'F') AS m, sum(r) FILTER (s = 'F') - count(*) FILTER (s = 'F') * (count(*) FILTER (s = 'F') + 1) / 2.0 AS u FROM (SELECT o_orderstatus AS s, {_RANKS.format('o_totalprice')} AS r FROM orders WHERE o_orderstatus <> 'P')", u_statistic="u", z="(u - n * m / 2.0) / sqrt(n * m * (n + m + 1) / 12.0)")
_numbers("ks_test", lambda t: md.ks_test(t.orders.filter("o_orderstatus <> 'P'"), "o_orderstatus", "o_totalprice"), source="SELECT max(abs(f / n - o / m)) AS d FROM (SELECT sum(a) OVER w AS f, sum(b) OVER w AS o, sum(a) OVER () AS n, sum(b) OVER () AS m FROM (SELECT o_totalprice AS x, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) WINDOW w AS (ORDER BY x))", d_statistic="d")
_numbers("kendall", lambda t: md.kendall(t.part, "p_size", "p_retailprice"), source="SELECT sum(sign((a.p_size - b.p_size) * (a.p_retailprice - b.p_retailprice))) AS s, (SELECT count(*) FROM part) AS n FROM part a JOIN part b ON a.p_partkey < b.p_partkey", tau="s / (n * (n - 1) / 2.0)")
query("glm", lambda t: t._spark.createDataFrame([(k, round(v, 6)) for k, v in md.glm(t.orders.select("o_custkey", (F.col("o_totalprice") / 1e5).alias("y"), (F.col("o_orderkey") % 13).alias("x")), "y", ["x"], "gaussian").items()], "name string, value double"), "SELECT 'intercept' AS name, round(regr_intercept(o_totalprice / 1e5, o_orderkey % 13), 6) AS value FROM orders UNION ALL SELECT 'x', round(regr_slope(o_totalprice / 1e5, o_orderkey % 13), 6) FROM orders")
query("glm_binomial", lambda t: t._spark.createDataFrame([(k, float(v)) for k, v in md.glm(t.orders.select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 1e5).alias("x")), "y", ["x"]).items()], "name string, value double"))
query("diff_expr", lambda t: md.diff_expr(t.lineitem.filter("l_linestatus IN ('F', 'O')"), "l_suppkey", "l_linestatus", "l_quantity").select("l_suppkey", _r("log2fc").alias("log2fc"), _r("t").alias("t")),
      "SELECT l_suppkey, round(log2((avg(l_quantity) FILTER (l_linestatus = 'O') + 1) / (avg(l_quantity) FILTER (l_linestatus = 'F') + 1)), 4) AS log2fc, round((avg(l_quantity) FILTER (l_linestatus = 'O') - avg(l_quantity) FILTER (l_linestatus = 'F')) / sqrt(var_samp(l_quantity) FILTER (l_linestatus = 'F') / count(*) FILTER (l_linestatus = 'F') + var_samp(l_quantity) FILTER (l_linestatus = 'O') / count(*) FILTER (l_linestatus = 'O')), 4) AS t FROM lineitem GROUP BY 1")
query("enrich", lambda t: md.enrich(t.part.filter("p_size < 15").select(F.col("p_partkey").alias("gene")), t.part.groupBy(F.col("p_brand").alias("name")).agg(F.collect_list("p_partkey").alias("genes")), 400).select("term", "overlap", "size"), "SELECT p_brand AS term, count(*) FILTER (p_size < 15) AS overlap, count(*) AS size FROM part GROUP BY 1 HAVING overlap > 0")
query("enrichment_score", lambda t: md.enrichment_score(t.nation.select(F.col("n_name").alias("gene"), F.col("n_nationkey").cast("double").alias("score")), ["FRANCE", "CHINA"]).select(_r("score").alias("score")), "SELECT round(avg(n_nationkey) FILTER (n_name IN ('FRANCE', 'CHINA')) - avg(n_nationkey), 4) AS score FROM nation")
query("gsea_score", lambda t: md.gsea_score(t.orders.select(F.col("o_orderkey").alias("gene"), F.col("o_totalprice").alias("score")), t.orders.filter("o_orderkey % 17 = 0").select(F.col("o_orderkey").alias("gene"))).select(_r("score").alias("score")),
      "WITH m AS (SELECT o_orderkey AS gene, o_totalprice AS score, o_orderkey % 17 = 0 AS hit FROM orders), s AS (SELECT *, CASE WHEN hit THEN abs(score) / (SELECT sum(abs(score)) FROM m WHERE hit) ELSE -1.0 / (SELECT count(*) FROM m WHERE NOT hit) END AS step FROM m), r AS (SELECT sum(step) OVER (ORDER BY score DESC, gene) AS run FROM s) SELECT round(arg_max(run, abs(run)), 4) AS score FROM r")
query("kmeans", lambda t: md.kmeans(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
query("roc_curve", lambda t: md.roc_curve(t.orders.select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_custkey").alias("s")), "y", "s").select("score", _r("fpr", 6).alias("fpr"), _r("tpr", 6).alias("tpr")),
      "SELECT score, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr FROM (SELECT o_custkey AS score, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus <> 'F') AS n FROM orders GROUP BY 1) WINDOW w AS (ORDER BY score DESC)")

# ---------------------------------------------------------------- alignment and reads
_RD = lambda t: _DNA(t).select(F.col("k").alias("id"), "s", "t", F.col("s").alias("seq"), F.translate("hex", "0123456789abcdef", "!#%+-3579;=?ACEI").alias("quality"))
query("align", lambda t: al.align(_DNA(t).select("k", "s", "t"), "s", "t").select("k", "score", "gaps"))
query("minimizers", lambda t: _DNA(t).select("k", F.size(al.minimizers("s", 5, 4)).alias("n")))
query("pwm_scan", lambda t: _DNA(t).select("k", F.size(al.pwm_scan("s", [{"A": 1.0}, {"C": 1.0}, {"A": 1.0}])).cast("long").alias("n")), f"SELECT k, CAST(len(list_filter(range(1, 31), lambda i: substr(s, i::INT, 3) = 'ACA')) AS BIGINT) AS n FROM {_DS}")
query("distance_matrix", lambda t: al.distance_matrix(_DNA(t).join(t.nation.select(F.col("n_nationkey").cast("long").alias("k")), "k"), "k", "s").withColumn("distance", _r("distance", 6)), f"SELECT a.k AS a, b.k AS b, round(hamming(a.s, b.s) / 32.0::DOUBLE, 6) AS distance FROM {_DS} a JOIN {_DS} b ON a.k < b.k WHERE a.k < 25 AND b.k < 25")
# of 32 places, so six digits hold every distance as it is
query("distance_matrix_all", lambda t: al.distance_matrix(_DNA(t), "k", "s"), f"SELECT a.k AS a, b.k AS b, round(hamming(a.s, b.s) / 32.0::DOUBLE, 6) AS distance FROM {_DS} a JOIN {_DS} b ON a.k < b.k")
query("trim_quality", lambda t: al.trim_quality(_RD(t), 30).select("id", F.char_length("seq").cast("long").alias("n")), f"SELECT k AS id, CAST(coalesce(list_max(list_filter(range(1, 33), lambda i: ascii(substr(translate(hex, '0123456789abcdef', '!#%+-3579;=?ACEI'), i::INT, 1)) - 33 >= 30)), 0) AS BIGINT) AS n FROM {_DS}")
query("trim_reads", lambda t: al.trim_reads(_RD(t), 4, 10.0, 8).select("id", F.char_length("seq").alias("n")))
query("trim_adapters", lambda t: al.trim_adapters(_RD(t), ["ACGTA"], 5).select("id", "seq"), f"SELECT k AS id, CASE WHEN instr(s, 'ACGTA') > 0 THEN left(s, instr(s, 'ACGTA') - 1) ELSE s END AS seq FROM {_DS}")
query("filter_reads", lambda t: al.filter_reads(_RD(t), 10, 500, 20.0).select("id"), f"SELECT k AS id FROM {_DS} WHERE list_avg(list_transform(range(1, 33), lambda i: ascii(substr(translate(hex, '0123456789abcdef', '!#%+-3579;=?ACEI'), i::INT, 1)) - 33)) >= 20")
query("read_stats", lambda t: sq.read_stats(_RD(t)).select("total_reads", "total_bases", _r("mean_quality").alias("mean_quality"), _r("gc_mean").alias("gc_mean")), f"SELECT count(*) AS total_reads, CAST(sum(length(s)) AS BIGINT) AS total_bases, round(avg(list_avg(list_transform(range(1, 33), lambda i: ascii(substr(translate(hex, '0123456789abcdef', '!#%+-3579;=?ACEI'), i::INT, 1)) - 33))), 4) AS mean_quality, round(avg(length(regexp_replace(s, '[^GC]', '', 'g')) / 32.0), 4) AS gc_mean FROM {_DS}")
query("dereplicate", lambda t: al.dereplicate(_DNA(t).select("k", "s"), "k", "s", 1.0, 11).select("s"), f"SELECT DISTINCT s FROM {_DS}")
query("dereplicate_similar", lambda t: al.dereplicate(_DNA(t).select("k", "s"), "k", "s", 0.05, 11).select("k", "members", "size"))

# ---------------------------------------------------------------- matrices
_M = lambda t: t.lineitem.groupBy((F.col("l_linenumber") - 1).cast("long").alias("i"), (F.col("l_suppkey") % 6).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))
_MS = "(SELECT (l_linenumber - 1)::BIGINT AS i, l_suppkey % 6 AS j, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL)"
query("transpose", lambda t: mx.transpose(_M(t)), f"SELECT j AS i, i AS j, v FROM {_MS}")
query("mat_add", lambda t: mx.mat_add(_M(t), _M(t)), f"SELECT i, j, v + v AS v FROM {_MS}")
query("mat_sub", lambda t: mx.mat_sub(_M(t), mx.mat_scale(_M(t), 3.0)), f"SELECT i, j, v - 3 * v AS v FROM {_MS}")
query("mat_mul", lambda t: mx.mat_mul(_M(t), _M(t)), f"SELECT i, j, v * v AS v FROM {_MS}")
query("mat_scale", lambda t: mx.mat_scale(_M(t), 0.5), f"SELECT i, j, v * 0.5 AS v FROM {_MS}")
query("mat_map", lambda t: mx.mat_map(_M(t), lambda v: v * v + 1), f"SELECT i, j, v * v + 1 AS v FROM {_MS}")
query("dot", lambda t: mx.dot(_M(t), mx.transpose(_M(t))), f"SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM {_MS} a JOIN {_MS} b ON a.j = b.j GROUP BY ALL")
query("row_sums", lambda t: mx.row_sums(_M(t)), f"SELECT i, sum(v) AS v FROM {_MS} GROUP BY 1")
query("col_sums", lambda t: mx.col_sums(_M(t)), f"SELECT j, sum(v) AS v FROM {_MS} GROUP BY 1")
query("row_means", lambda t: mx.mat_map(mx.row_means(_M(t)), _r), f"SELECT i, round(avg(v), 4) AS v FROM {_MS} GROUP BY 1")
query("col_means", lambda t: mx.mat_map(mx.col_means(_M(t)), _r), f"SELECT j, round(avg(v), 4) AS v FROM {_MS} GROUP BY 1")
query("mat_row", lambda t: mx.row(_M(t), 2), f"SELECT j, v FROM {_MS} WHERE i = 2")
query("mat_col", lambda t: mx.mat_col(_M(t), 2), f"SELECT i, v FROM {_MS} WHERE j = 2")
query("trace", lambda t: mx.trace(_M(t)), f"SELECT sum(v) AS v FROM {_MS} WHERE i = j")
query("norm", lambda t: mx.mat_map(mx.norm(_M(t)), _r), f"SELECT round(sqrt(sum(v * v)), 4) AS v FROM {_MS}")
query("dim", lambda t: mx.dim(_M(t)), f"SELECT max(i) + 1 AS rows, max(j) + 1 AS cols FROM {_MS}")
query("nnz", lambda t: mx.nnz(_M(t)), f"SELECT count(*) FILTER (v <> 0) AS nnz FROM {_MS}")
query("to_sparse", lambda t: mx.to_sparse(_M(t)), f"SELECT i, j, v FROM {_MS} WHERE v <> 0")
query("to_dense", lambda t: mx.to_dense(_M(t), 8, 7), f"SELECT i, j, coalesce(v, 0) AS v FROM (SELECT a.i, b.j FROM range(8) a(i), range(7) b(j)) LEFT JOIN {_MS} USING (i, j)")
query("eye", lambda t: mx.eye(t._spark, 5), "SELECT i, i AS j, 1.0::DOUBLE AS v FROM range(5) r(i)")
query("zeros", lambda t: mx.zeros(t._spark, 3, 4), "SELECT a.i, b.j, 0.0::DOUBLE AS v FROM range(3) a(i), range(4) b(j)")
query("ones", lambda t: mx.ones(t._spark, 3, 4), "SELECT a.i, b.j, 1.0::DOUBLE AS v FROM range(3) a(i), range(4) b(j)")
query("matrix_to_table", lambda t: mx.matrix_to_table(_M(t), 6), "SELECT i, " + ", ".join(f"coalesce(sum(v) FILTER (j = {k}), 0) AS c{k}" for k in range(6)) + f" FROM {_MS} GROUP BY 1")
query("matrix_from_table", lambda t: mx.matrix_from_table(t.part, "p_partkey", ["p_size", "p_retailprice"]), "SELECT p_partkey AS i, 0::BIGINT AS j, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part")
query("dist_matrix", lambda t: mx.mat_map(mx.dist_matrix(_M(t)), _r), f"SELECT a.i, b.i AS k, round(sqrt(sum((a.v - b.v) ** 2)), 4) AS v FROM {_MS} a JOIN {_MS} b ON a.j = b.j AND a.i < b.i GROUP BY ALL")
query("normalize_sparse", lambda t: mx.mat_map(mx.normalize_sparse(_M(t)), _r), f"SELECT i, j, round(ln(1 + v / sum(v) OVER (PARTITION BY j) * 1e6), 4) AS v FROM {_MS}")
query("cor_matrix", lambda t: mx.mat_map(mx.cor_matrix(t.lineitem, ["l_quantity", "l_tax"]), lambda v: _r(v, 6)), " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS v FROM lineitem" for a in ("l_quantity", "l_tax") for b in ("l_quantity", "l_tax")))
query("cov_matrix", lambda t: mx.mat_map(mx.cov_matrix(t.lineitem, ["l_quantity", "l_tax"]), lambda v: _r(v, 6)), " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(covar_samp({a}, {b}), 6) AS v FROM lineitem" for a in ("l_quantity", "l_tax") for b in ("l_quantity", "l_tax")))

# ---------------------------------------------------------------- graphs: nations and the regions they trade with
_G = lambda t: gr.graph(t.part.select(F.col("p_partkey").alias("id")), t.part.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("from"), (F.col("p_partkey") + 7).alias("to")).join(t.part.select(F.col("p_partkey").alias("to")), "to"))
_E = "(SELECT a.p_partkey AS f, a.p_partkey + 7 AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 7 WHERE a.p_partkey % 7 <> 0)"
query("node_count", lambda t: _G(t).node_count(), "SELECT count(*) AS nodes FROM part")
query("edge_count", lambda t: _G(t).edge_count(), f"SELECT count(*) AS edges FROM {_E}")
query("neighbors", lambda t: _G(t).neighbors(20), f"SELECT DISTINCT id FROM (SELECT t AS id FROM {_E} WHERE f = 20 UNION ALL SELECT f FROM {_E} WHERE t = 20)")
query("degree", lambda t: _G(t).degrees(), f"SELECT p_partkey AS id, count(n) AS degree FROM part LEFT JOIN (SELECT f AS n FROM {_E} UNION ALL SELECT t FROM {_E}) ON n = p_partkey GROUP BY 1")
query("subgraph", lambda t: _G(t).subgraph(t.part.filter("p_partkey < 500").select(F.col("p_partkey").alias("id"))).edges.select("from", "to"), f"SELECT f AS \"from\", t AS \"to\" FROM {_E} WHERE f < 500 AND t < 500")
query("remove_node", lambda t: _G(t).remove_node(20).edges.select("from", "to"), f"SELECT f AS \"from\", t AS \"to\" FROM {_E} WHERE f <> 20 AND t <> 20")

# ---------------------------------------------------------------- streams
query("stream_take", lambda t: sb.stream_take(t.events.select("event_id"), "event_id", 25), "SELECT event_id FROM events ORDER BY event_id LIMIT 25")
query("stream_skip", lambda t: sb.stream_skip(t.events.select("event_id"), "event_id", 25), "SELECT event_id FROM events ORDER BY event_id OFFSET 25")
query("stream_chunks", lambda t: sb.stream_chunks(t.events.select("event_id"), "event_id", 50).select("chunk", F.size("rows").alias("n")), "SELECT chunk, count(*)::INT AS n FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 50 AS chunk FROM events) GROUP BY 1")
query("stream_concat", lambda t: sb.stream_concat(t.events.select("event_id"), t.events.select("event_id")), "SELECT event_id FROM events UNION ALL SELECT event_id FROM events")
_EV = lambda t: t.events.withColumn("ts", F.col("ts").cast("timestamp"))
query("tumbling_window", lambda t: sb.tumbling(_EV(t), "ts", "1 day", ["event_type"], n=F.count(F.lit(1))).select(F.unix_seconds("start").alias("start"), "event_type", "n"), "SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
query("sliding_window", lambda t: sb.sliding(_EV(t), "ts", "2 hours", "1 hour", [], n=F.count(F.lit(1))).select(F.unix_seconds("start").alias("start"), "n"), "SELECT s AS start, count(*) AS n FROM (SELECT unnest([CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT), CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) - 3600]) AS s FROM events) GROUP BY 1")
query("session_window", lambda t: sb.sessions(_EV(t), "ts", "6 hours", ["user_id"], n=F.count(F.lit(1))).select("user_id", F.unix_micros("start").alias("start"), "n"), "SELECT user_id, min(u) AS start, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, g")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing summary of shipped lines: one scan, one partial and one final aggregation."""
    t = Tables(spark, sf_dir)
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = tb.filter_(t.lineitem, lambda r: r.l_shipdate <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return tb.summarize(rows, ["l_returnflag", "l_linestatus"], sum_qty=F.sum("l_quantity"), sum_price=_r(F.sum("l_extendedprice"), 2), sum_disc_price=_r(F.sum(price), 2), avg_qty=_r(F.avg("l_quantity")), avg_disc=_r(F.avg("l_discount")), n=F.count(F.lit(1)))


QUERIES["pricing_summary"] = flagship
SQL["pricing_summary"] = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"


def queries() -> dict[str, Query]:
    from . import more  # noqa: F401  it registers its queries

    return {**QUERIES, **scalars.queries()}


def oracle_sql() -> dict[str, str]:
    from . import more  # noqa: F401

    return {**SQL, **scalars.oracle_sql()}
