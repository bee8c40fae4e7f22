"""Table verbs: projection, filters, joins, grouping, order, reshaping, set operations.

Where a verb depends on the order of rows it takes the columns that give the order; without a partition it runs over all
rows by range partitions and per-partition offsets, never in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

# ---------------------------------------------------------------- construction and schema


def table(spark, records: list[dict]) -> DataFrame:
    """Rows of the first record's columns, sorted by name; what a later record lacks is null."""
    names = sorted(records[0]) if records else []
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], names)


from_records = to_table = table


def to_records(df: DataFrame):
    """An iterator of dicts that holds one partition at a time."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


from_table = to_records


def col_values(df: DataFrame, name: str) -> DataFrame:
    """One column; an error if it is not there."""
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.select(name)


col = col_values


def table_col_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def col_width(df: DataFrame, width: int, rows: int = 20) -> str:
    """The first rows as text, values cut to a width."""
    return df._show_string(rows, width, False)


def next_(rows):
    """The next record of an iterator, or None at its end."""
    return next(rows, None)


def collect(df: DataFrame, most: int = 1_000_000) -> list[dict]:
    """All records as a list; refuses tables of more than so many rows, which belong into a sink."""
    got = [r.asDict(recursive=True) for r in df.limit(most + 1).toLocalIterator()]
    if len(got) > most:
        raise ValueError(f"more than {most} rows; write them, or read them by to_records")
    return got


def nrow(df: DataFrame) -> int:
    return df.count()


def ncol(df: DataFrame) -> int:
    return len(df.columns)


def colnames(df: DataFrame) -> list[str]:
    return df.columns


ncols, columns = ncol, colnames


def table_schema(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(n, t) for n, t in df.dtypes], "name string, type string")


def table_cast(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Casts a column; what does not convert becomes null."""
    spark_type = {"Int": "long", "Float": "double", "Str": "string", "Bool": "boolean"}.get(kind, kind)
    return df.withColumn(col, F.col(col).try_cast(spark_type))


def table_set_col_type(df: DataFrame, col: str, kind: str) -> DataFrame:
    return df.withMetadata(col, {**df.schema[col].metadata, "declared": kind})


def table_validate(df: DataFrame) -> DataFrame:
    """For each column with a declared type: how many values do not convert to it."""
    kinds = {"Int": "long", "Float": "double", "Str": "string", "Bool": "boolean"}
    declared = {f.name: f.metadata["declared"] for f in df.schema if "declared" in f.metadata}
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kinds.get(k, k)).isNull()).alias(c) for c, k in declared.items()]
    if not bad:
        return df.sparkSession.createDataFrame([], "column string, errors long")
    return df.agg(*bad).unpivot([], list(declared), "column", "errors")


def describe(df: DataFrame) -> DataFrame:
    """column, dtype, count, null_count, mean, std (population), min, max; numbers only for the last four."""
    rows = []
    for name, kind in df.dtypes:
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        x = F.col(f"`{name}`").cast("double") if numeric else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("dtype"), F.count(f"`{name}`").alias("count"), F.count_if(F.col(f"`{name}`").isNull()).alias("null_count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


summary = describe


def diff_table(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged."""
    rest = [c for c in a.columns if c != key and c in b.columns]
    left = a.select(F.col(key).alias("k"), F.struct(*rest).alias("x") if rest else F.lit(0).alias("x"), F.lit(True).alias("in_a"))
    right = b.select(F.col(key).alias("k2"), F.struct(*rest).alias("y") if rest else F.lit(0).alias("y"), F.lit(True).alias("in_b"))
    both = left.join(right, F.col("k").eqNullSafe(F.col("k2")), "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("x").eqNullSafe(F.col("y")), "unchanged").otherwise("changed")
    return both.select(F.when(F.col("in_a").isNull(), F.col("k2")).otherwise(F.col("k")).alias(key), change.alias("change"))


# ---------------------------------------------------------------- projection and filters


def select(df: DataFrame, *cols) -> DataFrame:
    return df.select(*cols)


def drop_cols(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def fill_null(df: DataFrame, value) -> DataFrame:
    """value instead of null in every column whose type it has; numbers go into every numeric column."""
    return df.fillna(value)


def drop_null(df: DataFrame, col: str | None = None) -> DataFrame:
    """Rows without a null, in one column or in any."""
    return df.na.drop(subset=[col] if col else None)


def take_while(df: DataFrame, order, test: Column) -> DataFrame:
    """The rows, in order, before the first that does not meet the test (null does not meet it)."""
    order = [order] if isinstance(order, str) else list(order)
    failed = df.withColumn("__f", F.when(F.coalesce(test, F.lit(False)), 0).otherwise(1))
    return around(failed, None, order, before={"__n": (F.sum, "__f", True)}).filter("__n = 0").drop("__f", "__n")


def filter_pass(df: DataFrame, col: str = "filter") -> DataFrame:
    """Variants that passed: PASS, a dot, or nothing."""
    return df.filter(F.col(col).isin("PASS", ".", ""))


def classify_variants(df: DataFrame, ref: str = "ref", alt: str = "alt", chrom: str = "chrom") -> DataFrame:
    """(chrom, variant_type): SNP where both alleles are one letter, else INDEL."""
    return df.select(F.col(chrom).alias("chrom"), F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNP").otherwise("INDEL").alias("variant_type"))


def each(df: DataFrame, fn: Callable) -> DataFrame:
    """Calls fn with each partition's rows, on the executors, and goes on with df."""
    df.foreachPartition(fn)
    return df


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise ValueError(f"no column {old}")
    return df.withColumnRenamed(old, new)


class Row:
    """Stands for a row in a lambda: attributes and items are columns."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __getattr__(self, name: str) -> Column:
        return F.col(f"`{name}`")

    __getitem__ = __getattr__


def traced(df: DataFrame, fn) -> Column:
    """The column that a lambda over a row stands for; columns and names pass."""
    out = fn(Row(df)) if callable(fn) and not isinstance(fn, Column) else fn
    return out if isinstance(out, Column) else F.col(out) if isinstance(out, str) and out in df.columns else F.lit(out)


def mutate(df: DataFrame, name: str, fn) -> DataFrame:
    return df.withColumn(name, traced(df, fn))


def filter_(df: DataFrame, fn) -> DataFrame:
    return df.filter(F.coalesce(traced(df, fn), F.lit(False)))


where = filter_
_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: ~a.eqNullSafe(b), ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith,
}


def predicate(field: str, op: str, value) -> Column:
    return F.coalesce(_OPS[op](F.col(field), F.lit(value)), F.lit(False)) if op in _OPS else F.lit(False)


def filter_by(df: DataFrame, field: str, op: str, value) -> DataFrame:
    return df.filter(predicate(field, op, value))


def multi_filter_by(df: DataFrame, *triples) -> DataFrame:
    tests = [predicate(*triples[i : i + 3]) for i in range(0, len(triples), 3)]
    return df.filter(fold(lambda a, b: a & b, tests, F.lit(True)))


def count_where(df: DataFrame, field: str, op: str, value) -> DataFrame:
    return df.agg(F.count_if(predicate(field, op, value)).alias("count"))


def partition(df: DataFrame, fn) -> tuple[DataFrame, DataFrame]:
    test = F.coalesce(traced(df, fn), F.lit(False))
    return df.filter(test), df.filter(~test)


def case_when(*pairs, otherwise=None) -> Column:
    out = F
    for i in range(0, len(pairs), 2):
        out = out.when(pairs[i], pairs[i + 1])
    return out.otherwise(otherwise)


def any_(df: DataFrame, fn) -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(traced(df, fn)), F.lit(False)).alias("any"))


def all_(df: DataFrame, fn) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(F.coalesce(traced(df, fn), F.lit(False))), F.lit(True)).alias("all"))


# ---------------------------------------------------------------- joins


def _keyed(left: DataFrame, right: DataFrame, key, how: str) -> DataFrame:
    """Equi join in which null equals null; the right key is dropped."""
    keys = [key] if isinstance(key, str) else list(key)
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = fold(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    out = left.join(right, on, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how == "full":
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(f"__r_{k}")) for k in keys})
    return out.drop(*[f"__r_{k}" for k in keys])


def inner_join(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return _keyed(left, right, key, "inner")


def left_join(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return _keyed(left, right, key, "left")


def right_join(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return _keyed(right, left, key, "left")


def outer_join(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return _keyed(left, right, key, "full")


def semi_join(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return _keyed(left, right, key, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, key) -> DataFrame:
    return _keyed(left, right, key, "left_anti")


def cross_join(left: DataFrame, right: DataFrame, limit: int = 10_000_000) -> DataFrame:
    """The product; refused above so many rows."""
    if left.count() * right.count() > limit:
        raise ValueError(f"the product has more than {limit} rows")
    return left.crossJoin(right)


# fixed values: names under which identifiers of genes and places are looked for
BIO_KEYS = ["gene", "gene_id", "gene_name", "symbol", "gene_symbol", "id", "name", "chrom", "sample"]


def bio_join(left: DataFrame, right: DataFrame, on: str | None = None, how: str = "inner") -> DataFrame:
    """Joins on identifiers without regard to case and, for ENS ids, version; clashing names get _right."""
    key = on or next(k for k in BIO_KEYS if k in left.columns and k in right.columns)
    norm = lambda c: F.when(F.lower(c).startswith("ens"), F.regexp_replace(F.lower(c), r"\.\d+$", "")).otherwise(F.lower(c))
    r = right.select(norm(F.col(key)).alias("__k"), *[F.col(c).alias(f"{c}_right" if c in left.columns else c) for c in right.columns if c != key])
    return left.withColumn("__k", norm(F.col(key))).join(r, "__k", how).drop("__k")


def bind_cols(a: DataFrame, b: DataFrame, order_a, order_b) -> DataFrame:
    left, right = ordinal(a, order_a, "__n"), ordinal(b, order_b, "__n")
    return left.join(right, "__n").drop("__n")


# ---------------------------------------------------------------- grouping


def group_stats(df: DataFrame, key, col: str, agg: str) -> DataFrame:
    fn = {"mean": F.avg, "sum": F.sum, "count": F.count, "stdev": F.stddev_samp, "min": F.min, "max": F.max, "median": F.median}[agg]
    return df.groupBy(key).agg(fn(col).alias("value"))


def _of_column(fn: Callable, name: str) -> Callable[[DataFrame, str], DataFrame]:
    def run(df: DataFrame, col: str) -> DataFrame:
        return df.agg(F.coalesce(fn(F.col(col).try_cast("double")), F.lit(float("nan"))).alias(name))

    run.__name__ = f"col_{name}"
    run.__doc__ = f"The {name} of a column's numbers; what is no number is passed over, and NaN stands for none at all."
    return run


col_mean, col_sum, col_min, col_max = _of_column(F.avg, "mean"), _of_column(F.sum, "sum"), _of_column(F.min, "min"), _of_column(F.max, "max")
col_stdev = _of_column(F.stddev_samp, "stdev")
min_, max_, len_ = col_min, col_max, nrow


def scatter_by(df: DataFrame, key: Column, *aggs: Column) -> DataFrame:
    """Groups by what an expression gives: its value and the aggregates (the count if none is given)."""
    return df.groupBy(key.alias("key")).agg(*(aggs or [F.count(F.lit(1)).alias("count")]))


def set_seed(n: int) -> Callable[[], Column]:
    """A source of random columns that a seed fixes, for plans whose rows come in a fixed order."""
    state = [n]

    def draw() -> Column:
        state[0] += 1
        return F.rand(state[0])

    return draw


def summarize(df: DataFrame, keys, **exprs) -> DataFrame:
    """Grouped aggregates; columns sorted by name behind the keys."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(*[exprs[n].alias(n) for n in sorted(exprs)])


def group_apply(df: DataFrame, keys, fn, schema) -> DataFrame:
    return df.groupBy(keys).applyInPandas(fn, schema)


def count_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("key")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "key")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")


frequencies = uniq_count = value_counts


def mode(df: DataFrame, col: str) -> DataFrame:
    """The most frequent rounded value; the smallest of several."""
    n = df.filter(F.col(col).isNotNull()).groupBy(F.round(F.col(col)).cast("long").alias("v")).count()
    return n.agg(F.max_by("v", F.struct("count", -F.col("v"))).alias("mode"))


def quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    return df.agg(F.percentile(col, q).alias("quantile"))


def cor(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.coalesce(F.corr(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(float("nan"))).alias("cor"))


def rollup_stats(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.rollup(*keys).agg(*aggs)


def cube_stats(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.cube(*keys).agg(*aggs)


# ---------------------------------------------------------------- order: whole-table windows by range partitions


def _parts(df: DataFrame, order) -> tuple[DataFrame, list[Column]]:
    """df in range partitions of its order, numbered by __p; kept, as two jobs read it."""
    keys = [_asc(o) for o in ([order] if isinstance(order, str | Column) else list(order))]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id())
    return dealt.persist(StorageLevel.DISK_ONLY), keys


def _asc(o) -> Column:
    """A name, `-name` for descending (nulls are smallest), or a column."""
    if isinstance(o, Column):
        return o
    return F.desc_nulls_last(o[1:]) if o.startswith("-") else F.asc_nulls_first(o)


def _offsets(parts: DataFrame, aggs: dict[str, Column], combine: dict[str, Callable]) -> DataFrame:
    """For each partition what the ones before it add up to: one row a partition, so the window over them is small."""
    totals = parts.groupBy("__p").agg(*[a.alias(n) for n, a in aggs.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select(F.col("__p"), *[combine[n](n).over(before).alias(f"__before_{n}") for n in aggs]))


def ordinal(df: DataFrame, order, name: str = "row_number") -> DataFrame:
    """1..n in the given order."""
    parts, keys = _parts(df, order)
    off = _offsets(parts, {"n": F.count(F.lit(1))}, {"n": F.sum})
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
    return parts.withColumn(name, local).join(off, "__p").withColumn(name, (F.col(name) + F.coalesce("__before_n", F.lit(0))).cast("long")).drop("__p", "__before_n")


row_number = ordinal


def rank(df: DataFrame, col: str) -> DataFrame:
    """Competition rank: 1 + rows with a smaller value.  Equal values share a range partition."""
    parts, keys = _parts(df, [col])
    off = _offsets(parts, {"n": F.count(F.lit(1))}, {"n": F.sum})
    local = F.rank().over(Window.partitionBy("__p").orderBy(*keys))
    return parts.withColumn("rank", local).join(off, "__p").withColumn("rank", (F.col("rank") + F.coalesce("__before_n", F.lit(0))).cast("long")).drop("__p", "__before_n")


def _running(df: DataFrame, col: str, order, fn, combine: Callable, name: str) -> DataFrame:
    parts, keys = _parts(df, order)
    off = _offsets(parts, {"v": fn(F.col(col))}, {"v": fn})
    w = Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn(name, fn(F.col(col)).over(w)).join(off, "__p")
    both = F.when(F.col(col).isNotNull(), combine(F.col(name), F.col("__before_v")))
    return out.withColumn(name, both).drop("__p", "__before_v")


def around(df: DataFrame, by: str | None, order: list, before: dict | None = None, after: dict | None = None) -> DataFrame:
    """Running aggregates over all rows, or the rows of each value of by, in range partitions of the order.  before and after
    map names to (aggregate, column, whether the row itself counts): over the rows up to it, or from it on.  Aggregates are
    F.sum, F.max, F.min or F.count; of no rows they are null."""
    group = ["__p"] + ([by] if by else [])
    parts, keys = _parts(df, [*([by] if by else []), *order])
    keys = keys[1:] if by else keys
    wanted = {**{n: (x, True) for n, x in (before or {}).items()}, **{n: (x, False) for n, x in (after or {}).items()}}
    totals = parts.groupBy(*group).agg(*[fn(col).alias(f"__t_{n}") for n, ((fn, col, _), _) in wanted.items()])
    edge = {True: (Window.unboundedPreceding, -1), False: (1, Window.unboundedFollowing)}
    whole = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("__p")
    again = {F.count: F.sum}
    carried = totals.select(F.col("__p").alias("__q"), *([F.col(by).alias("__by")] if by else []), *[again.get(fn, fn)(f"__t_{n}").over(whole.rowsBetween(*edge[up])).alias(f"__c_{n}") for n, ((fn, _, _), up) in wanted.items()])
    local = Window.partitionBy(*group).orderBy(*keys)
    # what follows is read as what precedes in the opposite order, so that no frame is worked out anew for each row
    turned = Window.partitionBy(*group).orderBy(*[_turned(k) for k in ([o for o in order])])
    for n, ((fn, col, own), up) in wanted.items():
        parts = parts.withColumn(f"__l_{n}", fn(col).over((local if up else turned).rowsBetween(Window.unboundedPreceding, 0 if own else -1)))
    met = F.col("__p") == F.col("__q")
    out = parts.join(carried, met & F.col(by).eqNullSafe(F.col("__by")) if by else met, "left")
    for n, ((fn, _, _), _) in wanted.items():
        a, b = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        both = {F.max: F.greatest(a, b), F.min: F.least(a, b)}.get(fn, F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))
        out = out.withColumn(n, both)
    return out.drop("__q", "__by", "__p", *[f"__{x}_{n}" for n in wanted for x in "lc"])


def _turned(o) -> Column:
    """The opposite of _asc."""
    return F.asc_nulls_first(o[1:]) if o.startswith("-") else F.desc_nulls_last(o)


def cumsum(df: DataFrame, col: str, order) -> DataFrame:
    return _running(df, col, order, F.sum, lambda a, b: (a + F.coalesce(b, F.lit(0))).cast("double"), f"{col}_cumsum")


def cummax(df: DataFrame, col: str, order) -> DataFrame:
    return _running(df, col, order, F.max, F.greatest, f"{col}_cummax")


def cummin(df: DataFrame, col: str, order) -> DataFrame:
    return _running(df, col, order, F.min, F.least, f"{col}_cummin")


def _neighbours(df: DataFrame, order, name: str, reach: int, fn: Callable[[Window], Column]) -> DataFrame:
    """A window function that looks at most reach rows back or ahead, over all rows: each block of rows also gets the reach
    rows on both sides."""
    numbered = ordinal(df, order, "__n")
    size = max(1024, 4 * reach)
    block = F.floor((F.col("__n") - 1) / size)
    edges = F.array_distinct(F.array(block, F.floor((F.col("__n") - 1 - reach) / size), F.floor((F.col("__n") - 1 + reach) / size)))
    wide = numbered.withColumn("__own", block).withColumn("__b", F.explode(edges))
    w = Window.partitionBy("__b").orderBy("__n")
    return wide.withColumn(name, fn(w)).filter("__b = __own").drop("__n", "__own", "__b")


def lag(df: DataFrame, col: str, order, n: int = 1) -> DataFrame:
    return _neighbours(df, order, f"{col}_lag{n}", n, lambda w: F.lag(col, n).over(w))


def lead(df: DataFrame, col: str, order, n: int = 1) -> DataFrame:
    return _neighbours(df, order, f"{col}_lead{n}", n, lambda w: F.lead(col, n).over(w))


def rolling_mean(df: DataFrame, col: str, order, width: int) -> DataFrame:
    """Null unless width values are there."""
    def fn(w):
        rows = w.rowsBetween(-(width - 1), 0)
        return F.when(F.count(col).over(rows) == width, F.avg(col).over(rows))
    return _neighbours(df, order, f"{col}_rmean{width}", width, fn)


def rolling_sum(df: DataFrame, col: str, order, width: int) -> DataFrame:
    def fn(w):
        rows = w.rowsBetween(-(width - 1), 0)
        return F.when(F.count(col).over(rows) == width, F.sum(F.col(col).cast("double")).over(rows))
    return _neighbours(df, order, f"{col}_rsum{width}", width, fn)


def normalize(df: DataFrame, col: str, method: str = "zscore") -> DataFrame:
    if method == "quantile":
        n = df.count()
        return rank(df, col).withColumn(col, (F.col("rank") - 1) / max(n - 1, 1)).drop("rank")
    lo, hi, m, s = df.agg(F.min(col), F.max(col), F.avg(col), F.stddev_samp(col)).first()
    x = F.col(col).cast("double")
    if method == "minmax":
        return df.withColumn(col, (x - lo) / (hi - lo) if hi != lo else F.lit(0.0))
    return df.withColumn(col, (x - m) / s if s else F.lit(0.0))


def arrange(df: DataFrame, *keys) -> DataFrame:
    return df.orderBy(*[_asc(k) for k in keys])


def head(df: DataFrame, n: int = 5, order=None) -> DataFrame:
    return (arrange(df, *([order] if isinstance(order, str) else order)) if order else df).limit(n)


take = head


def tail(df: DataFrame, order, n: int = 5) -> DataFrame:
    keys = [order] if isinstance(order, str) else list(order)
    back = [k[1:] if k.startswith("-") else f"-{k}" for k in keys]
    return arrange(arrange(df, *back).limit(n), *keys)


def drop(df: DataFrame, order, n: int = 1) -> DataFrame:
    return ordinal(df, order, "__n").filter(F.col("__n") > n).drop("__n")


def slice_(df: DataFrame, order, start: int, end: int | None = None) -> DataFrame:
    out = ordinal(df, order, "__n").filter(F.col("__n") > start)
    return (out if end is None else out.filter(F.col("__n") <= end)).drop("__n")


def reverse(df: DataFrame, order) -> DataFrame:
    keys = [order] if isinstance(order, str) else list(order)
    return arrange(df, *[k[1:] if k.startswith("-") else f"-{k}" for k in keys])


def sample(df: DataFrame, n: int, order) -> DataFrame:
    """Every k-th row."""
    total = df.count()
    step = max(1, total // n) if n else 1
    return ordinal(df, order, "__n").filter(((F.col("__n") - 1) % step == 0) & ((F.col("__n") - 1) / step < n)).drop("__n")


def distinct(df: DataFrame, col: str | None = None, order=None) -> DataFrame:
    """The first row of each value (in the given order), or distinct rows."""
    if col is None:
        return df.distinct()
    first = df.groupBy(F.col(col).alias("__k")).agg(F.min_by(F.struct(*df.columns), F.struct(*(order or df.columns))).alias("r"))
    return first.select("r.*")


def top_k(df: DataFrame, keys, order, k: int) -> DataFrame:
    w = Window.partitionBy(keys).orderBy(*[_asc(o) for o in order])
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


# ---------------------------------------------------------------- stacking and reshaping


def concat(*dfs: DataFrame) -> DataFrame:
    if any(d.columns != dfs[0].columns for d in dfs):
        raise ValueError("tables to stack need the same columns in the same order")
    return fold(DataFrame.unionAll, dfs)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def explode(df: DataFrame, col: str) -> DataFrame:
    """A row for each element; an empty or null list drops the row."""
    return df.withColumn(col, F.explode(col))


def pivot_longer(df: DataFrame, cols: list[str], name: str = "name", value: str = "value") -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    return df.unpivot([c for c in df.columns if c not in cols], cols, name, value)


def pivot_wider(df: DataFrame, name: str, value: str, values: list | None = None, order: str | None = None) -> DataFrame:
    """Ids are all other columns; of several values the last counts (the largest of order, or of the values)."""
    ids = [c for c in df.columns if c not in (name, value, order)]
    return df.groupBy(*ids).pivot(name, values).agg(F.max_by(value, order or value))


def flat_map(df: DataFrame, name: str, fn) -> DataFrame:
    return df.withColumn(name, F.explode(traced(df, fn)))


def chunk(df: DataFrame, order, n: int) -> DataFrame:
    """Rows with the number of their chunk of n."""
    return ordinal(df, order, "__n").withColumn("chunk", F.floor((F.col("__n") - 1) / n).cast("long")).drop("__n")
