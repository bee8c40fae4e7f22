"""Control, kinds, plots' drawings, files and models against plain versions."""

import gzip as gz
import math
import random

import pytest
from pyspark.sql import functions as F

from lociframe.functions import kinds, stats
from lociframe.operators import graph as gr
from lociframe.operators import intervals as iv
from lociframe.operators import matrix as mx
from lociframe.operators import modelling as md
from lociframe.operators import tables as tb
from lociframe.plans import control as ct
from lociframe.plans import plots as pl
from lociframe.sources import files as fl
from lociframe.sources import formats as fm


def test_control():
    calls = []

    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no")
        return 7

    assert ct.retry(shaky) == 7 and len(calls) == 3
    assert ct.try_catch(lambda: 1 // 0, str).startswith("integer")
    with pytest.raises(ValueError), ct.defer(lambda: calls.append(2)):
        ct.guard(False)
    assert calls[-1] == 2
    with pytest.raises(AssertionError):
        ct.assert_(False, "x")
    with pytest.raises(RuntimeError):
        ct.error("x")
    with pytest.raises(SystemExit):
        ct.exit_(3)
    assert ct.prop_test(lambda v: v < 50, ct.gen_int(0, 100, 1), 200)["passed"] is False
    assert ct.prop_test(lambda v: 0 <= v <= 1, ct.gen_float(seed=2))["passed"]
    assert len(ct.gen_str(5, seed=3)()) == 5
    assert ct.memory_usage() > 1 << 20 and ct.pipe_fuse([1]) == [1]
    assert ct.help_(ct.guard).startswith("guard(test")


def test_printing(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, "a<b"), (2, None)], "x int, y string")
    assert "a<b" in ct.println(df) and "a&lt;b" in ct.to_html(df)
    assert ct.debug(df) is df and ct.debug(3) == 3
    assert "struct<x:int" in capsys.readouterr().out
    assert "| 1 | a<b |" in open(ct.write_markdown(df, str(tmp_path / "t.md"))).read()
    assert "<td>2</td><td></td>" in open(ct.write_html(df, str(tmp_path / "t.html"))).read()
    assert ct.doctor(spark)["spark"] == spark.version and ct.config(spark, "spark.sql.session.timeZone") == "UTC"
    assert "a<b" in tb.col_width(df, 10)


def test_values_of_other_kinds(spark):
    import re
    from concurrent.futures import Future

    df = spark.range(1)
    assert kinds.is_table(df) and not kinds.is_stream(df) and kinds.is_function(len)
    assert kinds.is_regex(re.compile("a")) and kinds.is_future(Future()) and fm.is_db(spark)
    assert tb.next_(iter([])) is None
    with pytest.raises(ValueError):
        tb.collect(spark.range(5), 4)
    with pytest.raises(ValueError):
        tb.col_values(df, "none")


def test_files(spark, tmp_path):
    source, packed, back = (str(tmp_path / n) for n in ("a.txt", "a.gz", "b.txt"))
    text = "".join(f"line {i}\n" for i in range(20_000))
    open(source, "w").write(text)
    assert fl.gzip(spark, source, packed) < len(text) and gz.open(packed, "rt").read() == text
    fl.gunzip(spark, packed, back)
    assert open(back).read() == text
    fl.bgzip(source, packed)
    assert gz.open(packed, "rt").read() == text
    assert fl.abs_path(spark, source).startswith("file:")
    folder, file = fl.temp_dir(spark), fl.temp_file(spark)
    assert fl.is_dir(spark, folder) and fl.is_file(spark, file) and fl.remove_dir(spark, folder)
    assert fl.shell("echo hi; exit 3") == {"stdout": "hi\n", "stderr": "", "exit_code": 3}


def test_drawings(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(5)], "x double, y double")
    for kind in ("points", "bars", "line"):
        assert pl.svg(df, "x", "y", kind).startswith("<svg")
    assert open(pl.save_svg(pl.svg(df, "x", "y"), str(tmp_path / "p.svg"))).read().count("<circle") == 5
    assert pl.alignment_view("AC-G", "ACTG").split("\n")[1] == "|| |"
    assert pl.phylo_tree("((a:1,b:2):3,c:4);") == [("a", 2, 1.0), ("b", 2, 2.0), ("", 1, 3.0), ("c", 1, 4.0), ("", 0, 0.0)]
    assert len(pl.pca_plot(df, ["x", "y"]).first()["components"]) == 2


def test_trees_and_matrices(spark):
    d = [[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]]
    tree = mx.neighbor_joining(mx.matrix(spark, [list(map(float, r)) for r in d]), list("abcde"))
    assert "a:2" in tree and "b:3" in tree
    with pytest.raises(ValueError):
        mx.to_numpy(spark.createDataFrame([(0, 0, 1.0), (9_999_999, 9, 1.0)], "i long, j long, v double"))
    path = [[0.0, 1.0]] + md.ode_solve(lambda t, y: [-y[0]], [1.0], [i / 100 for i in range(101)])
    assert abs(path[-1][0] - math.exp(-1)) < 1e-8


def test_cox(spark):
    rng = random.Random(5)
    rows = [(rng.expovariate(math.exp(0.7 * x)), 1, float(x)) for x in [rng.random() * 2 for _ in range(300)]]
    rows = [(min(t, 1.5), int(t < 1.5), x) for t, _, x in rows]
    got = md.cox_ph(spark.createDataFrame(rows, "t double, e int, x double"), "t", "e", "x")

    def loglik(b):
        return sum(b * x - math.log(sum(math.exp(b * z) for u, _, z in rows if u >= t)) for t, e, x in rows if e)

    assert loglik(got["coef"]) >= max(loglik(got["coef"] - 1e-3), loglik(got["coef"] + 1e-3))
    assert 0.3 < got["coef"] < 1.1


def test_draws(spark):
    df = spark.range(2000, numPartitions=2).select(stats.rbinom(10, 0.3, 4).alias("b"), stats.rpois(4.0, 4).alias("p"))
    got = df.agg(F.avg("b"), F.avg("p"), F.min("b"), F.max("b"), F.var_samp("p")).first()
    assert abs(got[0] - 3) < 0.15 and abs(got[1] - 4) < 0.2 and got[2] >= 0 and got[3] <= 10 and abs(got[4] - 4) < 0.7
    draw = tb.set_seed(3)
    assert spark.range(1).select(draw()).first() != spark.range(1).select(draw()).first()


def test_enrichment_by_permutations(spark):
    ranked = spark.createDataFrame([(f"g{i}", float(50 - i)) for i in range(100)], "gene string, score double")
    top = ranked.filter("score > 44").select("gene")
    got = md.gsea(ranked, top, 5)
    assert got["score"] > 0 and 0 < got["p_value"] <= 1
    terms = spark.createDataFrame([("t1", f"g{i}") for i in range(6)] + [("t2", f"g{i}") for i in range(50, 60)], "term string, gene string")
    assert {r["term"]: r["overlap"] for r in md.go_enrichment(top, terms, 100).collect()}["t1"] == 6


@pytest.mark.parametrize("parts", [1, 7])
def test_around(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(60), rng.choice([None, 1, 5, 9])) for _ in range(300)]
    rows = sorted({(g, o): v for g, o, v in rows}.items(), key=str)
    df = spark.createDataFrame([(g, o, v) for (g, o), v in rows], "g string, o int, v int").repartition(parts)
    got = tb.around(df, "g", ["o"], before={"s": (F.sum, "v", True), "m": (F.max, "v", False)}, after={"n": (F.min, "v", True), "c": (F.count, "v", False)})
    for r in got.collect():
        mine = sorted((o, v) for (g, o), v in rows if g == r.g)
        before, after = [v for o, v in mine if o <= r.o and v is not None], [v for o, v in mine if o >= r.o and v is not None]
        assert r.s == (sum(before) if before else None)
        assert r.m == max((v for o, v in mine if o < r.o and v is not None), default=None)
        assert r.n == (min(after) if after else None)
        assert (r.c or 0) == sum(1 for o, v in mine if o > r.o and v is not None)


def test_intervals_of_one_chromosome(spark):
    rng = random.Random(2)
    rows = [("c", s, s + rng.randrange(0, 30)) for s in [rng.randrange(2000) for _ in range(300)]]
    t = spark.createDataFrame(rows, "chrom string, start long, end long").repartition(5)
    merged, reach = [], None
    for _, s, e in sorted(rows):
        if merged and s <= reach:
            merged[-1][1] = reach = max(reach, e)
        else:
            merged.append([s, e])
            reach = e
    assert sorted((r.start, r.end) for r in iv.merge_intervals(t).collect()) == sorted(map(tuple, merged))
    b = t.filter("start % 3 = 0")
    mids = [(s + e) // 2 for _, s, e in rows if s % 3 == 0]
    want = sorted((s, e, min(abs((s + e) // 2 - m) for m in mids)) for _, s, e in rows)
    assert sorted((r.start, r.end, r.distance) for r in iv.closest(t, b).collect()) == want
    g = gr.Graph(spark.createDataFrame([(1, "x")], "id int, name string"), spark.createDataFrame([(1, 1, 1.0)], "from int, to int, weight double"))
    assert g.node_attr(1, "name") == "x" and g.node_attr(9, "name") is None


def test_tails_against_closed_forms():
    for t in (0.3, 1.0, 4.0):
        assert abs(stats.t_two_sided(t, 1) - (1 - 2 * math.atan(t) / math.pi)) < 1e-9
        assert abs(stats.t_two_sided(t, 2) - (1 - t / math.sqrt(2 + t * t))) < 1e-9
    for x in (0.5, 3.0, 12.0):
        assert abs(stats.chi_tail(x, 2) - math.exp(-x / 2)) < 1e-12
        assert abs(stats.chi_tail(x, 4) - math.exp(-x / 2) * (1 + x / 2)) < 1e-12
        assert abs(stats.f_tail(x, 2, 8) - (1 + 2 * x / 8) ** -4) < 1e-9


def test_p_values_of_the_tests(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0.5, 1), "ab"[i % 2]) for i in range(400)], "x double, y double, g string")
    got = stats.ttest(df, "x", "y")
    assert got["p_value"] == stats.t_two_sided(got["t_statistic"], got["df"]) < 1e-3
    assert 0 < stats.anova(df, "g", "x")["p_value"] <= 1 and 0 < md.ks_test(df, "g", "x")["p_value"] <= 1
    assert 0 < md.wilcoxon(df, "g", "x")["p_value"] <= 1 and 0 < stats.spearman(df, "x", "y")["p_value"] <= 1


@pytest.mark.parametrize("values", [3, 1000])
def test_kendall(spark, values):
    rng = random.Random(values)
    rows = [(float(rng.randrange(values)), float(rng.randrange(values))) for _ in range(500)]
    sign = lambda v: (v > 0) - (v < 0)
    want = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(rows) for b in rows[:i]) / (500 * 499 / 2)
    assert abs(md.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y")["tau"] - want) < 1e-12


@pytest.mark.parametrize("size", ["37b", "300b", "1m"])
def test_fastq_in_blocks(spark, tmp_path, size):
    """Records come back whole however their file is split, with quality lines that begin like a header."""
    rows = [(f"r{i}", "ACGT" * (i % 9 + 1), "@+I!" * (i % 9 + 1)) for i in range(120)]
    (tmp_path / "a.fq").write_text("".join(f"@{i} about {i}\n{s}\n+\n{q}\n" for i, s, q in rows[:70]) + "\n")
    (tmp_path / "b.fq").write_text("".join(f"@{i}\r\n{s}\r\n+\r\n{q}\r\n" for i, s, q in rows[70:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = fm.read_fastq(spark, str(tmp_path / "*.fq")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.id, r.seq, r.quality) for r in got) == sorted(rows)
    assert {r.description for r in got} == {""} | {f"about r{i}" for i in range(70)}
