"""Matrices as long DataFrames of cells (i, j, v), counted from 0; missing cells are zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i long, j long, v double")


def matrix_from_table(df: DataFrame, row: str, cols: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).cast("long").alias("j"), F.col(c).cast("double").alias("v")) for k, c in enumerate(cols)])
    return df.select(F.col(row).cast("long").alias("i"), F.explode(cells).alias("c")).select("i", "c.j", "c.v")


def matrix_to_table(m: DataFrame, columns: int) -> DataFrame:
    return m.groupBy("i").agg(*[F.coalesce(F.sum(F.when(F.col("j") == k, F.col("v"))), F.lit(0.0)).alias(f"c{k}") for k in range(columns)])


def zeros(spark: SparkSession, r: int, c: int, value: float = 0.0) -> DataFrame:
    n = spark.range(r * c)
    return n.select(F.floor(F.col("id") / c).cast("long").alias("i"), (F.col("id") % c).alias("j"), F.lit(value).alias("v"))


def ones(spark: SparkSession, r: int, c: int) -> DataFrame:
    return zeros(spark, r, c, 1.0)


def eye(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def dim(m: DataFrame) -> DataFrame:
    return m.agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))


def diag(spark, values: list[float]) -> DataFrame:
    """A square matrix with these values on its diagonal, the rest zeros."""
    return spark.range(len(values)).select(F.col("id").alias("i")).crossJoin(spark.range(len(values)).select(F.col("id").alias("j"))).select("i", "j", F.when(F.col("i") == F.col("j"), F.get(F.array(*map(F.lit, map(float, values))), F.col("i").cast("int"))).otherwise(0.0).alias("v"))


def sparse_matrix(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """The cells (i, j, v) that are not zero; values of the same place are added."""
    return df.groupBy(F.col(row).cast("long").alias("i"), F.col(col).cast("long").alias("j")).agg(F.sum(F.col(value).cast("double")).alias("v")).filter("v <> 0")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _cells(a: DataFrame, b: DataFrame, fn) -> DataFrame:
    right = b.select("i", "j", F.col("v").alias("w"))
    zero = F.lit(0.0)
    return a.join(right, ["i", "j"], "full").select("i", "j", fn(F.coalesce("v", zero), F.coalesce("w", zero)).alias("v"))


def mat_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _cells(a, b, lambda x, y: x + y)


def mat_sub(a: DataFrame, b: DataFrame) -> DataFrame:
    return _cells(a, b, lambda x, y: x - y)


def mat_mul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell by cell; the matrix product is dot."""
    return a.join(b.select("i", "j", F.col("v").alias("w")), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def mat_scale(m: DataFrame, k: float) -> DataFrame:
    return m.withColumn("v", F.col("v") * k)


def mat_map(m: DataFrame, fn) -> DataFrame:
    return m.withColumn("v", fn(F.col("v")))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), "v"), b.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.sum("v").alias("v"))


def col_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sum("v").alias("v"))


def row_means(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.avg("v").alias("v"))


def col_means(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.avg("v").alias("v"))


def row(m: DataFrame, i: int) -> DataFrame:
    return m.filter(F.col("i") == i).select("j", "v")


def mat_col(m: DataFrame, j: int) -> DataFrame:
    return m.filter(F.col("j") == j).select("i", "v")


def trace(m: DataFrame) -> DataFrame:
    return m.filter("i = j").agg(F.sum("v").alias("v"))


def norm(m: DataFrame) -> DataFrame:
    return m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))


def to_sparse(m: DataFrame) -> DataFrame:
    return m.filter("v <> 0")


def nnz(m: DataFrame) -> DataFrame:
    return m.agg(F.count_if(F.col("v") != 0).alias("nnz"))


def sparse_get(m: DataFrame, i: int, j: int) -> DataFrame:
    return m.filter((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def to_dense(m: DataFrame, rows: int, cols: int) -> DataFrame:
    return zeros(m.sparkSession, rows, cols).drop("v").join(m, ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def normalize_sparse(m: DataFrame, method: str = "log1p_cpm", scale: float = 1e6) -> DataFrame:
    """Cells by their column's total, to scale; log1p_cpm takes log(1 + x)."""
    out = m.join(col_sums(m).withColumnRenamed("v", "t"), "j").select("i", "j", (F.col("v") / F.col("t") * scale).alias("v"))
    return mat_map(out, F.log1p) if method == "log1p_cpm" else out


def _by_columns(df: DataFrame, cols: list[str], agg) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), agg(F.col(a).cast("double"), F.col(b).cast("double")).alias("v")) for a in cols for b in cols]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def cor_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson of each two columns; 0 where one does not vary."""
    return _by_columns(df, cols, lambda a, b: F.coalesce(F.corr(a, b), F.lit(0.0)))


def cov_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    return _by_columns(df, cols, F.covar_samp)


def dist_matrix(m: DataFrame, method: str = "euclidean") -> DataFrame:
    """Distances between rows i < k of a dense matrix, through shared columns."""
    other = m.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    d: Column = F.col("v") - F.col("w")
    agg = {"euclidean": F.sqrt(F.sum(d * d)), "manhattan": F.sum(F.abs(d)), "chebyshev": F.max(F.abs(d))}[method]
    return m.join(other, "j").filter("i < k").groupBy("i", "k").agg(agg.alias("v"))


#: Cells of a matrix that the driver takes: 8 bytes each in numpy, about 100 while they come.
DRIVER_CELLS = 4_000_000


def to_numpy(m: DataFrame):
    """A small matrix on the driver; one of more than DRIVER_CELLS cells is refused."""
    import numpy as np

    cells = m.agg((F.max("i") + 1).cast("long") * (F.max("j") + 1)).first()[0] or 0
    if cells > DRIVER_CELLS:
        raise ValueError(f"{cells} cells are too many for the driver (at most {DRIVER_CELLS})")
    rows = m.collect()
    out = np.zeros((max(r.i for r in rows) + 1, max(r.j for r in rows) + 1))
    for r in rows:
        out[r.i, r.j] = r.v
    return out


def determinant(m: DataFrame) -> float:
    import numpy as np

    return float(np.linalg.det(to_numpy(m)))


def inverse(m: DataFrame) -> DataFrame:
    import numpy as np

    return matrix(m.sparkSession, np.linalg.inv(to_numpy(m)).tolist())


def solve(a: DataFrame, b: DataFrame) -> DataFrame:
    import numpy as np

    return matrix(a.sparkSession, np.linalg.solve(to_numpy(a), to_numpy(b)).tolist())


def eigenvalues(m: DataFrame) -> list[float]:
    import numpy as np

    x = to_numpy(m)
    return (np.linalg.eigvalsh(x) if np.allclose(x, x.T) else np.linalg.eigvals(x).real).tolist()


def svd(m: DataFrame):
    import numpy as np

    u, d, vt = np.linalg.svd(to_numpy(m), full_matrices=False)
    return {"u": matrix(m.sparkSession, u.tolist()), "d": d.tolist(), "vt": matrix(m.sparkSession, vt.tolist())}


def pca(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """Rows with their first k principal components, from moments that one aggregation gathers."""
    from pyspark.ml.feature import PCA, VectorAssembler

    mean = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centred = df.withColumns({c: F.col(c).cast("double") - mean[c] for c in cols})
    fit = PCA(k=k, inputCol="__x", outputCol="components")
    x = VectorAssembler(inputCols=cols, outputCol="__x").transform(centred)
    return fit.fit(x).transform(x).drop("__x")


def neighbor_joining(m: DataFrame, names: list[str]) -> str:
    """The neighbour-joining tree of a symmetric matrix of distances, in Newick's form; the matrix goes to the driver."""
    import numpy as np

    d = to_numpy(m)
    nodes = list(names)
    while len(nodes) > 2:
        n, total = len(nodes), d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(np.argmin(q)), n))
        a = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        joined = f"({nodes[i]}:{a:.6g},{nodes[j]}:{d[i, j] - a:.6g})"
        row = (d[i] + d[j] - d[i, j]) / 2
        left = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(left, left)], row[left][:, None]], [row[left][None, :], np.zeros((1, 1))]])
        nodes = [nodes[k] for k in left] + [joined]
    if len(nodes) == 2:
        return f"({nodes[0]}:{d[0, 1]:.6g},{nodes[1]}:0);"
    return f"{nodes[0]};" if nodes else ";"
