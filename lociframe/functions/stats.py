"""Distributions as columns, and tests from moments that one aggregation gathers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._args import as_col


def dnorm(x, mean: float = 0.0, sd: float = 1.0) -> Column:
    z = (as_col(x) - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def pnorm(x, mean: float = 0.0, sd: float = 1.0) -> Column:
    """By a rational approximation of the error function (error below 2e-7)."""
    z = (as_col(x) - mean) / (sd * math.sqrt(2))
    a = F.abs(z)
    t = 1 / (1 + 0.3275911 * a)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-a * a)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def _log_factorial(n: int) -> float:
    return math.lgamma(n + 1)


def dbinom(k, n: int, p: float) -> Column:
    """Probability of k, for k of 0..n (a table of n + 1 values)."""
    table = [math.exp(_log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) + (i * math.log(p) if i else 0) + ((n - i) * math.log1p(-p) if n - i else 0)) for i in range(n + 1)]
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in table]), as_col(k).cast("int")), F.lit(0.0))


def pbinom(k, n: int, p: float) -> Column:
    total, table = 0.0, []
    for i in range(n + 1):
        total += math.exp(_log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) + (i * math.log(p) if i else 0) + ((n - i) * math.log1p(-p) if n - i else 0))
        table.append(min(total, 1.0))
    k = as_col(k).cast("int")
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(F.get(F.array(*[F.lit(v) for v in table]), k))


def dpois(k, rate: float) -> Column:
    k = as_col(k).cast("int")
    return F.pow(F.lit(rate), k) * math.exp(-rate) / F.factorial(k)


def ppois(k, rate: float) -> Column:
    k = as_col(k).cast("int")
    return F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, i: a + F.pow(F.lit(rate), i) * math.exp(-rate) / F.factorial(i))


def dunif(x, a: float = 0.0, b: float = 1.0) -> Column:
    x = as_col(x)
    return F.when((x >= a) & (x <= b), 1 / (b - a)).otherwise(0.0)


def punif(x, a: float = 0.0, b: float = 1.0) -> Column:
    return F.least(F.greatest((as_col(x) - a) / (b - a), F.lit(0.0)), F.lit(1.0))


def dexp(x, rate: float = 1.0) -> Column:
    x = as_col(x)
    return F.when(x >= 0, rate * F.exp(-rate * x)).otherwise(0.0)


def pexp(x, rate: float = 1.0) -> Column:
    x = as_col(x)
    return F.when(x >= 0, 1 - F.exp(-rate * x)).otherwise(0.0)


def qnorm(p: float, mean: float = 0.0, sd: float = 1.0) -> float:
    from statistics import NormalDist

    return NormalDist(mean, sd).inv_cdf(p)


def rnorm(mean: float = 0.0, sd: float = 1.0, seed: int | None = None) -> Column:
    return F.randn(seed) * sd + mean


# ---------------------------------------------------------------- tail probabilities, on the driver (single numbers)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / (c if abs(c) > 1e-300 else 1e-300)
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1 - beta_cdf(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2) if f < math.inf else 0.0


def chi_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared, by the series or the continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def _moments(df: DataFrame, *cols: str):
    return df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).first()


def ttest(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Pooled two-sample t of two columns."""
    r = _moments(df, a, b)
    n1, n2 = r[f"n_{a}"], r[f"n_{b}"]
    pooled = ((n1 - 1) * r[f"v_{a}"] + (n2 - 1) * r[f"v_{b}"]) / (n1 + n2 - 2)
    t = (r[f"m_{a}"] - r[f"m_{b}"]) / math.sqrt(pooled * (1 / n1 + 1 / n2))
    return {"t_statistic": t, "df": n1 + n2 - 2, "p_value": t_two_sided(t, n1 + n2 - 2)}


def ttest_one(df: DataFrame, a: str, mu: float) -> dict[str, float]:
    r = _moments(df, a)
    t = (r[f"m_{a}"] - mu) / math.sqrt(r[f"v_{a}"] / r[f"n_{a}"])
    return {"t_statistic": t, "df": r[f"n_{a}"] - 1, "p_value": t_two_sided(t, r[f"n_{a}"] - 1)}


def ttest_paired(df: DataFrame, a: str, b: str) -> dict[str, float]:
    return ttest_one(df.select((F.col(a) - F.col(b)).alias("d")), "d", 0.0)


def anova(df: DataFrame, group: str, x: str) -> dict[str, float]:
    parts = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    s = parts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within")).first()
    between = s["nmm"] - s["nm"] ** 2 / s["n"]
    d1, d2 = s["k"] - 1, s["n"] - s["k"]
    f = (between / d1) / (s["within"] / d2) if s["within"] else math.inf
    return {"f_statistic": f, "p_value": f_tail(f, d1, d2), "df_between": d1, "df_within": d2}


def chi_square(df: DataFrame, observed: str, expected: str) -> dict[str, float]:
    r = df.agg(F.sum(F.pow(F.col(observed) - F.col(expected), F.lit(2)) / F.col(expected)).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return {"chi_square": r["x"], "df": r["n"] - 1, "p_value": chi_tail(r["x"], r["n"] - 1)}


def fisher_exact(a: int, b: int, c: int, d: int) -> dict[str, float]:
    n, row, col = a + b + c + d, a + b, a + c
    log_p = lambda x: -sum(map(_log_factorial, (x, row - x, col - x, n - row - col + x)))
    ways = {x: log_p(x) for x in range(max(0, row + col - n), min(row, col) + 1)}
    top = max(ways.values())
    total = sum(math.exp(v - top) for v in ways.values())
    p = sum(math.exp(v - top) for v in ways.values() if v <= ways[a] + 1e-7) / total
    odds = a * d / (b * c) if b * c else math.inf if a * d else math.nan
    return {"odds_ratio": odds, "p_value": min(1.0, p)}


def average_ranks(df: DataFrame, col: str, name: str, by: str | None = None) -> DataFrame:
    """Ranks in which equal values share their mean, from counts of distinct values."""
    keys = [by] if by else []
    from ..operators.tables import around

    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__n"))
    below = around(counts, by, [col], before={"__below": (F.sum, "__n", False)})
    ranks = below.withColumn(name, F.coalesce("__below", F.lit(0)) + (F.col("__n") + 1) / 2).drop("__n", "__below")
    return df.join(ranks, [*keys, col])


def spearman(df: DataFrame, x: str, y: str) -> dict[str, float]:
    ranked = average_ranks(average_ranks(df.select(x, y), x, "rx"), y, "ry")
    r, n = ranked.agg(F.corr("rx", "ry"), F.count(F.lit(1))).first()
    t = r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 else math.inf
    return {"coefficient": r, "p_value": t_two_sided(t, n - 2) if t < math.inf else 0.0, "n": n}


def p_adjust(df: DataFrame, col: str, method: str = "bh") -> DataFrame:
    """Adds adjusted: bh p * n / rank and holm p * (n - rank + 1), both without a monotone step, or bonferroni p * n."""
    from ..operators.tables import ordinal

    n = df.count()
    if method == "bonferroni":
        return df.withColumn("adjusted", F.least(F.col(col) * n, F.lit(1.0)))
    ranked = ordinal(df, [col, *[c for c in df.columns if c != col]], "__rank")
    factor = F.lit(n) / F.col("__rank") if method == "bh" else F.lit(n) - F.col("__rank") + 1
    return ranked.withColumn("adjusted", F.least(F.col(col) * factor, F.lit(1.0))).drop("__rank")


def lm(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept and r_squared of a straight line."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r_squared"))


def hist(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    low, high = df.agg(F.min(col), F.max(col)).first()
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("long")
    return df.filter(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def kaplan_meier(df: DataFrame, time: str, event: str) -> DataFrame:
    """time, at_risk, survival at each time of an event.  Running sums over distinct times, by range partitions."""
    from ..operators.tables import around

    at = df.groupBy(F.col(time).alias("time")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("d"))
    risk = around(at, None, ["time"], after={"at_risk": (F.sum, "n", True)}).filter("d > 0")
    risk = risk.withColumn("__s", F.when(F.col("d") < F.col("at_risk"), F.log1p(-F.col("d") / F.col("at_risk"))).otherwise(F.lit(-1e9)))
    return around(risk, None, ["time"], before={"__l": (F.sum, "__s", True)}).select("time", "at_risk", F.exp("__l").alias("survival"))


def rbinom(size: int, p: float, seed: int) -> Column:
    """A binomial number for each row: successes of size draws that a seed fixes (for rows in a fixed order)."""
    share = lambda seed, i: F.pmod(F.xxhash64(seed, i), F.lit(1 << 40)) / float(1 << 40)
    return _once(F.rand(seed), lambda x: F.array_size(F.filter(F.sequence(F.lit(1), F.lit(size)), lambda i: share(x, i) < p)).cast("long"))


def _once(draw: Column, fn) -> Column:
    """fn of a number that is drawn once for each row."""
    return F.get(F.transform(F.array(draw), fn), F.lit(0))


def rpois(rate: float, seed: int) -> Column:
    """A Poisson number for each row, by the inverse of its distribution; rates up to 500."""
    if not 0 < rate <= 500:
        raise ValueError("the rate must be above 0 and at most 500")
    top, p, below, bounds = int(rate + 20 * math.sqrt(rate) + 20), math.exp(-rate), 0.0, []
    for k in range(top):
        below += p
        bounds.append(below)
        p *= rate / (k + 1)
    return _once(F.rand(seed), lambda x: F.array_size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < x)).cast("long"))
