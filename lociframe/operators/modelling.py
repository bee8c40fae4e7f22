"""Rank tests, enrichment, differential expression and simple models, from aggregations; only moments reach the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as st
from .tables import around, ordinal


def wilcoxon(df: DataFrame, group: str, x: str) -> dict[str, float]:
    """Mann-Whitney U of the smaller group value against the other, by average ranks; normal p-value without corrections."""
    ranked = st.average_ranks(df.select(group, x), x, "__r")
    rows = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("__r").alias("r")).orderBy(group).collect()
    (n1, r1), n2 = (rows[0]["n"], rows[0]["r"]), rows[1]["n"]
    u = r1 - n1 * (n1 + 1) / 2
    z = (u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return {"u_statistic": u, "z": z, "p_value": math.erfc(abs(z) / math.sqrt(2))}


def ks_test(df: DataFrame, group: str, x: str) -> dict[str, float]:
    """Two-sample Kolmogorov-Smirnov, over counts of distinct values; asymptotic p-value."""
    first = df.agg(F.min(group)).first()[0]
    at = df.groupBy(x).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) != first).alias("b"))
    n1, n2 = at.agg(F.sum("a"), F.sum("b")).first()
    run = around(at, None, [x], before={"__a": (F.sum, "a", True), "__b": (F.sum, "b", True)})
    d = run.agg(F.max(F.abs(F.col("__a") / n1 - F.col("__b") / n2))).first()[0]
    t = d * math.sqrt(n1 * n2 / (n1 + n2))
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)) if t > 0.2 else 1.0
    return {"d_statistic": d, "p_value": min(1.0, max(0.0, p))}


def sign_summer():
    """A function of (x, y, c): the sum over pairs of rows of sign(x' - x) sign(y' - y) c c': by halves, the
    counts below and above looked up in sorted order.  It is made here so that it travels to the workers as it is."""
    import numpy as np

    def sign_sum(x, y, c) -> float:
        order = np.lexsort((y, x))
        x, y, c = x[order], y[order], c[order].astype(np.float64)

        def ordered(a: int, b: int) -> float:  # over pairs a <= i < j < b of sign(y[j] - y[i]) c[i] c[j]
            if b - a <= 256:
                return float(np.triu(np.sign(y[None, a:b] - y[a:b, None]) * c[a:b, None] * c[None, a:b], 1).sum())
            mid = (a + b) // 2
            at = np.argsort(y[a:mid], kind="stable")
            low, sums = y[a:mid][at], np.r_[0.0, np.cumsum(c[a:mid][at])]
            below, upto = sums[np.searchsorted(low, y[mid:b])], sums[np.searchsorted(low, y[mid:b], side="right")]
            return float((c[mid:b] * (below - (sums[-1] - upto))).sum()) + ordered(a, mid) + ordered(mid, b)

        if not len(x):
            return 0.0
        # pairs of the same x came with ascending y and count for nothing
        fresh = np.r_[True, x[1:] != x[:-1]]
        of_x = np.add.reduceat(c, np.flatnonzero(fresh))
        of_both = np.add.reduceat(c, np.flatnonzero(fresh | np.r_[True, y[1:] != y[:-1]]))
        return ordered(0, len(x)) - float((of_x**2).sum() - (of_both**2).sum()) / 2

    return sign_sum


def kendall(df: DataFrame, x: str, y: str) -> dict[str, float]:
    """tau-a.  Distinct pairs of values are dealt into ranges of x and of y: pairs of rows in different ranges of both come from
    the counts of the cells; those in one range of x, and those in one range of y only, are counted where the range lies."""
    import numpy as np
    import pandas as pd

    c = df.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("c")).na.drop()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = c.agg(*[F.percentile_approx(v, [i / parts for i in range(1, parts)] or [0.5], 20 * parts) for v in ("x", "y")]).first()
    place = lambda v, at: F.array_size(F.filter(F.array(*[F.lit(float(k)) for k in sorted(set(at or []))]), lambda k: k < F.col(v)))
    dealt = c.withColumns({"p": place("x", cuts[0]), "q": place("y", cuts[1])})
    cells = np.zeros((parts + 1, parts + 1))
    for p, q, k in dealt.groupBy("p", "q").agg(F.sum("c")).collect():
        cells[p, q] = k

    signs = sign_summer()

    def counted(a: str, b: str):
        return lambda rows: pd.DataFrame({"s": [signs(rows[a].to_numpy(), rows[b].to_numpy(), rows["c"].to_numpy())]})

    inside = sum(dealt.groupBy(key).applyInPandas(counted(*pair), "s double").agg(F.sum("s")).first()[0] or 0.0 for key, pair in (("p", ("x", "y")), ("q", ("p", "y"))))
    before = np.cumsum(np.vstack([np.zeros(parts + 1), cells]), axis=0)[:-1]  # rows of smaller ranges of x, by range of y
    upto = np.cumsum(before, axis=1)
    s = inside + float((cells * (upto - before - (upto[:, -1:] - upto))).sum())
    n = float(cells.sum())
    tau = s / (n * (n - 1) / 2)
    z = 3 * tau * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5))
    return {"tau": tau, "p_value": math.erfc(abs(z) / math.sqrt(2))}


def power_t_test(effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Size of each of two groups, by the normal approximation."""
    return math.ceil(2 * ((st.qnorm(1 - alpha / 2) + st.qnorm(power)) / effect) ** 2)


def diff_expr(df: DataFrame, gene: str, group: str, x: str) -> DataFrame:
    """gene, mean_a, mean_b, log2fc, t (Welch): group a is the smaller group value."""
    first = df.agg(F.min(group)).first()[0]
    a, b = F.when(F.col(group) == first, F.col(x)), F.when(F.col(group) != first, F.col(x))
    m = df.groupBy(gene).agg(*[f(v).alias(f"{k}_{n}") for n, v in (("a", a), ("b", b)) for k, f in (("n", F.count), ("mean", F.avg), ("v", F.var_samp))])
    se = F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b"))
    return m.select(gene, "mean_a", "mean_b", F.log2((F.col("mean_b") + 1) / (F.col("mean_a") + 1)).alias("log2fc"), F.when(se > 0, (F.col("mean_b") - F.col("mean_a")) / se).alias("t"))


def enrich(genes: DataFrame, sets: DataFrame, background: int) -> DataFrame:
    """Over-representation: (term, overlap, size, p_value) of genes (gene) in sets (name, genes), by the hypergeometric upper
    tail.  The distinct (overlap, size) pairs get their p-value once, by logarithms of factorials in a column."""
    drawn = genes.select("gene").distinct()
    n = drawn.count()
    each = sets.select(F.col("name").alias("term"), F.explode(F.array_distinct("genes")).alias("gene"))
    size = each.groupBy("term").agg(F.count(F.lit(1)).alias("size"))
    hit = each.join(drawn, "gene").groupBy("term").agg(F.count(F.lit(1)).alias("overlap"))
    lf = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    choose = lambda m, k: lf(m) - lf(k) - lf(m - k)
    total = F.lit(background)
    tail = F.aggregate(F.sequence(F.col("overlap"), F.least(F.col("size"), F.lit(n).cast("long"))), F.lit(0.0), lambda a, k: a + F.when(total - F.col("size") >= n - k, F.exp(choose(F.col("size"), k) + choose(total - F.col("size"), n - k) - choose(total, F.lit(n)))).otherwise(0.0))
    pairs = hit.join(size, "term").select("overlap", "size").distinct().withColumn("p_value", F.least(tail, F.lit(1.0)))
    return hit.join(size, "term").join(pairs, ["overlap", "size"]).select("term", "overlap", "size", "p_value")


ora = enrich


def enrichment_score(ranked: DataFrame, genes: list[str], gene: str = "gene", score: str = "score") -> DataFrame:
    """Mean of a set against the mean of all."""
    inside = F.when(F.col(gene).isin(*genes), F.col(score))
    return ranked.agg((F.avg(inside) - F.avg(score)).alias("score"))


def gsea_score(ranked: DataFrame, genes: DataFrame, gene: str = "gene", score: str = "score") -> DataFrame:
    """Extreme of the running sum down the ranking: hits step by their share of absolute scores, misses down evenly."""
    marked = ranked.join(genes.select(F.col("gene").alias(gene), F.lit(1).alias("__hit")), gene, "left")
    hits, weight, n = marked.agg(F.count("__hit"), F.sum(F.when(F.col("__hit") == 1, F.abs(score))), F.count(F.lit(1))).first()
    step = F.when(F.col("__hit") == 1, F.abs(score) / (weight or 1.0)).otherwise(F.lit(-1.0 / max(n - hits, 1)))
    from .tables import cumsum

    run = cumsum(marked.withColumn("step", step), "step", [f"-{score}", gene])
    return run.agg(F.max_by("step_cumsum", F.abs("step_cumsum")).alias("score"))


def kmeans(df: DataFrame, cols: list[str], k: int, rounds: int = 20) -> DataFrame:
    """Rows with their cluster: Lloyd from a deterministic start (the longest row, then the farthest each time).  Centres are
    k rows; each round is one aggregation."""
    x = F.array(*[F.col(c).cast("double") for c in cols])
    data = df.withColumn("__x", x)

    def gap(centre: list[float]):
        return sum(((F.get("__x", F.lit(i)) - v) * (F.get("__x", F.lit(i)) - v) for i, v in enumerate(centre)), F.lit(0.0))

    centres = [list(data.orderBy(F.desc(gap([0.0] * len(cols))), *cols).first()["__x"])]
    while len(centres) < k:
        near = F.least(*[gap(c) for c in centres]) if len(centres) > 1 else gap(centres[0])
        centres.append(list(data.orderBy(F.desc(near), *cols).first()["__x"]))

    def labelled():
        return data.withColumn("cluster", F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"])

    for _ in range(rounds):
        new = {r["cluster"]: [r[f"m{i}"] for i in range(len(cols))] for r in labelled().groupBy("cluster").agg(*[F.avg(F.get("__x", F.lit(i))).alias(f"m{i}") for i in range(len(cols))]).collect()}
        after = [new.get(i, c) for i, c in enumerate(centres)]
        if after == centres:
            break
        centres = after
    return labelled().drop("__x")


def glm(df: DataFrame, y: str, xs: list[str], family: str = "binomial", rounds: int = 25) -> dict[str, float]:
    """Coefficients by iteratively reweighted least squares; each round is one aggregation of normal equations."""
    import numpy as np

    x = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    p = len(x)
    beta = np.zeros(p)
    for _ in range(rounds):
        eta = sum((F.lit(float(b)) * v for b, v in zip(beta, x, strict=True)), F.lit(0.0))
        if family == "binomial":
            mu = 1 / (1 + F.exp(-eta))
            w = mu * (1 - mu)
        elif family == "poisson":
            mu = F.exp(eta)
            w = mu
        else:
            mu, w = eta, F.lit(1.0)
        r = F.col(y).cast("double") - mu
        row = df.agg(*[F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)], *[F.sum(x[i] * r).alias(f"g{i}") for i in range(p)]).first()
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        step = np.linalg.solve(h + 1e-12 * np.eye(p), np.array([row[f"g{i}"] for i in range(p)]))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(["intercept", *xs], beta.tolist(), strict=True))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(fpr, tpr) at each distinct score, from the highest."""
    at = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    total = at.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    run = around(at, None, ["-score"], before={"cp": (F.sum, "p", True), "cn": (F.sum, "n", True)})
    return run.crossJoin(F.broadcast(total)).select("score", (F.col("cn") / F.col("tn")).alias("fpr"), (F.col("cp") / F.col("tp")).alias("tpr"))


def manhattan_points(df: DataFrame, chrom: str, pos: str, p: str) -> DataFrame:
    """(chrom, pos, minus_log10)."""
    return df.select(chrom, pos, (-F.log10(F.col(p))).alias("minus_log10"))


def qq_points(df: DataFrame, p: str) -> DataFrame:
    """(expected, observed) of sorted p-values, as -log10."""
    n = df.count()
    return ordinal(df.select(F.col(p).alias("p")), "p", "r").select((-F.log10((F.col("r") - 0.5) / n)).alias("expected"), (-F.log10("p")).alias("observed"))


def cox_ph(df: DataFrame, time: str, event: str, x: str, rounds: int = 25) -> dict[str, float]:
    """Proportional hazards for one covariate, ties after Breslow: Newton steps on sums over the risk set at each time."""
    center = df.agg(F.avg(x)).first()[0]
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), (F.col(x) - center).cast("double").alias("x")).na.drop()
    beta, info = 0.0, 0.0
    for _ in range(rounds):
        w = F.exp(F.col("x") * beta)
        at = rows.groupBy("t").agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("x") ** 2).alias("wxx"), F.sum("e").alias("d"), F.sum(F.col("e") * F.col("x")).alias("dx"))
        risk = around(at, None, ["t"], after={n: (F.sum, c, True) for n, c in (("s0", "w"), ("s1", "wx"), ("s2", "wxx"))}).filter("d > 0")
        mean = F.col("s1") / F.col("s0")
        score, info = risk.agg(F.sum(F.col("dx") - F.col("d") * mean), F.sum(F.col("d") * (F.col("s2") / F.col("s0") - mean * mean))).first()
        if not info:
            break
        beta += score / info
        if abs(score / info) < 1e-10:
            break
    se = 1 / math.sqrt(info) if info else math.inf
    return {"coef": beta, "hazard_ratio": math.exp(beta), "se": se, "z": beta / se, "p_value": math.erfc(abs(beta / se) / math.sqrt(2))}


def gsea(ranked: DataFrame, gene_set: DataFrame, permutations: int = 100, seed: int = 1) -> dict[str, float]:
    """gsea_score with a p-value: the share of random sets of the same size (drawn by hashes of the genes) whose score goes
    as far to the same side."""
    score = gsea_score(ranked, gene_set).first()[0]
    size, beyond, same = gene_set.distinct().count(), 0, 0
    for i in range(permutations):
        drawn = ranked.select("gene").orderBy(F.xxhash64(F.lit(seed * 1_000_003 + i), F.col("gene").cast("string")), "gene").limit(size)
        other = gsea_score(ranked, drawn).first()[0]
        same += other * score > 0
        beyond += other * score > 0 and abs(other) >= abs(score)
    return {"score": score, "p_value": (beyond + 1) / (same + 1)}


def go_enrichment(genes: DataFrame, terms: DataFrame, background: int) -> DataFrame:
    """enrich over ontology terms (term, gene), one row a pair: the terms' sets are gathered first."""
    sets = terms.groupBy(F.col("term").alias("name")).agg(F.collect_set("gene").alias("genes"))
    return enrich(genes, sets, background)


def ode_solve(fn, start: list[float], times: list[float]) -> list[list[float]]:
    """Classical Runge-Kutta steps between the times; fn(t, y) gives the slopes."""
    out, y = [list(start)], list(start)
    for t, after in zip(times, times[1:], strict=False):
        h = after - t
        step = lambda k, part: [a + part * h * b for a, b in zip(y, k, strict=True)]  # noqa: B023, E731
        k1 = fn(t, y)
        k2 = fn(t + h / 2, step(k1, 0.5))
        k3 = fn(t + h / 2, step(k2, 0.5))
        k4 = fn(after, step(k3, 1.0))
        y = [a + h / 6 * (p + 2 * q + 2 * r + s) for a, p, q, r, s in zip(y, k1, k2, k3, k4, strict=True)]
        out.append(y)
    return out
