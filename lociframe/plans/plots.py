"""The data behind plots, as small tables: bins, quartiles, densities, intersections, tracks.  Aggregation runs in Spark; only
what is to be drawn reaches the driver, where svg() draws points, bars or cells of a bounded number."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matrix import pca
from ..operators.tables import around, ordinal

#: Rows that svg() draws at most; more would hide each other.
MOST_MARKS = 100_000


def plot(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points (x, y), without nulls."""
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()


scatter = plot


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """(bin, start, count) of equal bins from low to high; the ends take what lies beyond."""
    width = (high - low) / bins
    place = F.greatest(F.lit(0), F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1))).cast("long")
    return df.filter(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count")).withColumn("start", F.col("bin") * width + low)


def density(df: DataFrame, col: str, low: float, high: float, points: int = 64, bandwidth: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Gaussian kernel density at equally spaced points, from counts of a grid eight times as fine."""
    by, step = list(by or []), (high - low) / (points * 8)
    h = bandwidth or (high - low) / 20
    cell = F.greatest(F.lit(0), F.least(F.floor((F.col(col) - low) / step), F.lit(points * 8 - 1))).cast("long")
    grid = df.filter(F.col(col).isNotNull()).groupBy(*by, cell.alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + (i + 0.5) * ((high - low) / points))).alias("at")
    spread = grid.select(*by, "__n", (F.lit(low) + (F.col("__c") + 0.5) * step).alias("__x"), at)
    z = (F.col("at") - F.col("__x")) / h
    return spread.groupBy(*by, "at").agg((F.sum(F.col("__n") * F.exp(-z * z / 2)) / F.sum("__n") / (h * math.sqrt(2 * math.pi))).alias("density"))


def violin(df: DataFrame, by: str, col: str, low: float, high: float, points: int = 32) -> DataFrame:
    """A density for each group."""
    return density(df, col, low, high, points, by=[by])


def boxplot(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Quartiles, and the outermost values within 1.5 quartile ranges of them."""
    keys = [by] if by else []
    q = df.groupBy(*keys).agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"), F.count(col).alias("count"))
    q = q.select(*keys, "count", F.get("__q", F.lit(0)).alias("q1"), F.get("__q", F.lit(1)).alias("median"), F.get("__q", F.lit(2)).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    rows = df.select(*keys, F.col(col).alias("__v")).join(q, keys) if keys else df.select(F.col(col).alias("__v")).crossJoin(F.broadcast(q))
    inside = rows.filter((F.col("__v") >= F.col("q1") - reach) & (F.col("__v") <= F.col("q3") + reach))
    return inside.groupBy(*keys, "count", "q1", "median", "q3").agg(F.min("__v").alias("low"), F.max("__v").alias("high"))


def heatmap(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(row, col, value): the mean of each cell."""
    return df.groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(F.avg(value).alias("value"))


heatmap_ascii = heatmap


def clustered_heatmap(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Cells with rows and columns ranked by their means, so that like ones come together."""
    cells = heatmap(df, row, col, value)
    place = lambda key, name: ordinal(cells.groupBy(key).agg(F.avg("value").alias("__m")), ["__m", key], name).select(key, name)
    return cells.join(place("row", "row_at"), "row").join(place("col", "col_at"), "col")


def volcano(df: DataFrame, log2fc: str, p: str, least_change: float = 1.0, most_p: float = 0.05) -> DataFrame:
    """(log2fc, minus_log10, side): up, down or none."""
    change = F.when(F.col(p) > most_p, "none").when(F.col(log2fc) >= least_change, "up").when(F.col(log2fc) <= -least_change, "down").otherwise("none")
    return df.select(F.col(log2fc).alias("log2fc"), (-F.log10(F.greatest(F.col(p), F.lit(1e-300)))).alias("minus_log10"), change.alias("side"))


volcano_plot = volcano


def ma_plot(df: DataFrame, a: str, b: str) -> DataFrame:
    """(mean, change) of two conditions, as log2 of counts and one."""
    x, y = F.log2(F.col(a) + 1), F.log2(F.col(b) + 1)
    return df.select(((x + y) / 2).alias("mean"), (y - x).alias("change"))


def genome_track(df: DataFrame, width: int, value: str | None = None) -> DataFrame:
    """(chrom, bin, value): rows that begin in each bin of a width, or the mean of a value there."""
    fn = F.avg(value) if value else F.count(F.lit(1)).cast("double")
    return df.groupBy("chrom", F.floor(F.col("start") / width).alias("bin")).agg(fn.alias("value"))


def ideogram(df: DataFrame) -> DataFrame:
    """The extent of each chromosome and its number of features."""
    return df.groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("features"))


def cnv_plot(df: DataFrame, width: int, case: str, control: str) -> DataFrame:
    """(chrom, bin, log2_ratio) of the means of two depths, each and one."""
    ratio = F.log2((F.avg(case) + 1) / (F.avg(control) + 1))
    return df.groupBy("chrom", F.floor(F.col("start") / width).alias("bin")).agg(ratio.alias("log2_ratio"))


def rainfall(df: DataFrame, pos: str = "start") -> DataFrame:
    """(chrom, pos, log10_distance) to the position before on the chromosome; the first has none and is left out."""
    at = df.select("chrom", F.col(pos).alias("pos")).distinct()
    near = around(at, "chrom", ["pos"], before={"last": (F.max, "pos", False)})
    return near.filter("last IS NOT NULL").select("chrom", "pos", F.log10(F.col("pos") - F.col("last")).alias("log10_distance"))


def manhattan(df: DataFrame, chrom: str, pos: str, p: str) -> DataFrame:
    """(chrom, pos, minus_log10)."""
    return df.select(F.col(chrom).alias("chrom"), F.col(pos).alias("pos"), (-F.log10(F.greatest(F.col(p), F.lit(1e-300)))).alias("minus_log10"))


def qq_plot(df: DataFrame, p: str) -> DataFrame:
    """(expected, observed) of sorted p-values, as -log10."""
    n = df.count()
    return ordinal(df.select(F.col(p).alias("p")), "p", "r").select((-F.log10((F.col("r") - 0.5) / n)).alias("expected"), (-F.log10("p")).alias("observed"))


def forest_plot(df: DataFrame, by: str, col: str) -> DataFrame:
    """Each group's mean with its 95 % interval by the normal approximation."""
    half = 1.959963984540054 * F.stddev_samp(col) / F.sqrt(F.count(col))
    return df.groupBy(by).agg(F.avg(col).alias("estimate"), (F.avg(col) - half).alias("low"), (F.avg(col) + half).alias("high"))


def upset(df: DataFrame, item: str, group: str) -> DataFrame:
    """How many items lie in just these sets: (sets joined by &, count)."""
    sets = df.groupBy(item).agg(F.array_join(F.sort_array(F.collect_set(F.col(group).cast("string"))), "&").alias("sets"))
    return sets.groupBy("sets").agg(F.count(F.lit(1)).alias("count"))


venn = upset_plot = upset


def oncoprint(df: DataFrame, gene: str, sample: str, kind: str) -> DataFrame:
    """(gene, sample, kinds): the kinds of change of a gene in a sample, sorted."""
    return df.groupBy(F.col(gene).alias("gene"), F.col(sample).alias("sample")).agg(F.array_join(F.sort_array(F.collect_set(kind)), "+").alias("kinds"))


def lollipop(df: DataFrame, pos: str, kind: str) -> DataFrame:
    """(pos, kind, count)."""
    return df.groupBy(F.col(pos).alias("pos"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("count"))


def sequence_logo(df: DataFrame, col: str, letters: str = "ACGT") -> DataFrame:
    """(pos, letter, height): the letter's share of a position times its information, in bits."""
    at = df.select(F.posexplode(F.filter(F.split(F.col(col), ""), lambda c: c != "")).alias("pos", "letter")).filter(F.col("letter").isin(list(letters)))
    n = at.groupBy("pos", "letter").agg(F.count(F.lit(1)).alias("n"))
    all_of = n.groupBy("pos").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    bits = math.log2(len(letters)) - (F.log2("m") - F.col("s") / F.col("m"))
    return n.join(all_of, "pos").select("pos", "letter", (F.col("n") / F.col("m") * bits).alias("height"))


def hic_map(df: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """(i, j, count) of contacts between bins, i <= j."""
    x, y = F.floor(F.col(a) / width), F.floor(F.col(b) / width)
    return df.groupBy(F.least(x, y).alias("i"), F.greatest(x, y).alias("j")).agg(F.count(F.lit(1)).alias("count"))


def sashimi(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """(chrom, start, end, reads) of each junction."""
    return df.groupBy(F.col(chrom).alias("chrom"), F.col(start).alias("start"), F.col(end).alias("end")).agg(F.count(F.lit(1)).alias("reads"))


def circos(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, links) between chromosomes, the smaller name first."""
    return df.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count(F.lit(1)).alias("links"))


circos_plot = circos


def quality_plot(df: DataFrame, col: str) -> DataFrame:
    """(pos, mean, q1, median, q3) of the Phred scores at each position of the reads."""
    at = df.select(F.posexplode(F.filter(F.split(F.col(col), ""), lambda c: c != "")).alias("pos", "c")).select("pos", (F.ascii("c") - 33).alias("q"))
    n = at.groupBy("pos", "q").agg(F.count(F.lit(1)).alias("n"))
    part = lambda x: F.expr(f"percentile(q, {x}, n)")
    return n.groupBy("pos").agg((F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("mean"), part(0.25).alias("q1"), part(0.5).alias("median"), part(0.75).alias("q3"))


def dotplot(df: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """(i, j) where the row's two sequences have the same k letters; rows keep their own columns."""
    words = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - k, F.lit(0))), lambda i: F.struct(i.alias("at"), F.substring(F.col(c), i + 1, F.lit(k)).alias("w")))
    left = df.select("*", F.explode(words(a)).alias("__x"))
    pairs = left.select(*df.columns, F.col("__x.at").alias("i"), F.explode(F.filter(words(b), lambda y: y["w"] == F.col("__x.w"))).alias("__y"))
    return pairs.filter(F.length("__y.w") == k).select(*df.columns, "i", F.col("__y.at").alias("j"))


def pca_plot(df: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    """Rows with their first principal components."""
    return pca(df, cols, k)


def alignment_view(a: str, b: str, width: int = 60) -> str:
    """Two aligned texts in blocks, with a bar between equal letters."""
    out = []
    for at in range(0, max(len(a), len(b)), width):
        x, y = a[at : at + width], b[at : at + width]
        out += [x, "".join("|" if p == q and p != "-" else " " for p, q in zip(x, y, strict=False)), y, ""]
    return "\n".join(out)


def phylo_tree(newick: str) -> list[tuple[str, int, float]]:
    """(name, depth, branch length) of each node of a tree in Newick's form, children before their parents."""
    out, depth = [], 0
    for mark, label in re.findall(r"([(),;])([^(),;]*)", "," + newick.strip()):
        depth += (mark == "(") - (mark == ")")
        name, _, length = label.partition(":")
        if mark == ")" or label:
            out.append((name, depth, float(length or 0)))
    return out


# ---------------------------------------------------------------- drawing


def svg(df: DataFrame, x: str, y: str, kind: str = "points", width: int = 640, height: int = 400) -> str:
    """An SVG of points, bars or a line; refuses tables of more than MOST_MARKS rows."""
    rows = [(float(r[0]), float(r[1])) for r in df.select(F.col(x).cast("double"), F.col(y).cast("double")).na.drop().limit(MOST_MARKS + 1).collect()]
    if len(rows) > MOST_MARKS:
        raise ValueError(f"more than {MOST_MARKS} marks: aggregate first")
    rows.sort()
    xs, ys = [r[0] for r in rows] or [0.0], [r[1] for r in rows] or [0.0]
    low_y = min(0.0, *ys) if kind == "bars" else min(ys)
    px = lambda v: 30 + (v - min(xs)) / ((max(xs) - min(xs)) or 1) * (width - 40)
    py = lambda v: height - 20 - (v - low_y) / ((max(ys) - low_y) or 1) * (height - 40)
    if kind == "points":
        body = "".join(f'<circle cx="{px(a):.1f}" cy="{py(b):.1f}" r="2"/>' for a, b in rows)
    elif kind == "bars":
        wide = max(1.0, (width - 40) / max(1, len(rows)) * 0.9)
        body = "".join(f'<rect x="{px(a):.1f}" y="{py(b):.1f}" width="{wide:.1f}" height="{py(low_y) - py(b):.1f}"/>' for a, b in rows)
    else:
        body = f'<polyline fill="none" stroke="black" points="{" ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in rows)}"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{body}</svg>'


def save_svg(text: str, path: str) -> str:
    """Writes a drawing on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


save_plot = save_svg
