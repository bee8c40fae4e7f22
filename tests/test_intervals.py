"""Overlaps against plain versions: empty and turned ranges, nulls, repeated rows, dense and very long ranges."""

import random
from collections import Counter

import pytest

from lociframe.operators import intervals as iv


def spans(rng, n, chroms=("x", "y", None)):
    rows = []
    for i in range(n):
        start = rng.choice((rng.randrange(40), rng.randrange(-5, 100_000)))
        end = start + rng.choice((rng.randrange(-3, 9), rng.randrange(30), rng.randrange(70_000)))
        rows.append((rng.choice(chroms), rng.choice((start,) * 9 + (None,)), rng.choice((end,) * 9 + (None,)), i % (n - 5)))
    return rows + rows[:3]


def met(p, q):
    return None not in p[:3] and None not in q[:3] and p[0] == q[0] and p[1] < q[2] and q[1] < p[2]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    a, b = spans(rng, 150), spans(rng, 40, ("x", None, "z"))
    return a, b, *(spark.createDataFrame(x, "chrom string, start long, end long, id long") for x in (a, b))


def test_intersect_and_subtract(sides):
    a, b, left, right = sides
    hit = [any(met(p, q) for q in b) for p in a]
    assert 20 < sum(hit) < len(a) - 20
    for fn, want in ((iv.intersect, True), (iv.subtract, False)):
        got = fn(left, right)
        assert got.columns == left.columns
        assert "__bin" not in got._jdf.queryExecution().analyzed().toString()  # by an order, not by pairs
        assert Counter(map(tuple, got.collect())) == Counter(p for p, h in zip(a, hit) if h == want)


def test_every_overlapping_pair_once(sides):
    a, b, left, right = sides
    got = Counter((tuple(r)[:4], tuple(r)[4:]) for r in iv.overlap_pairs(left, right).collect())
    assert got == Counter((p, q) for p in a for q in b if met(p, q))
    assert iv.bulk_overlaps(right, left).first()[0] == got.total()


def test_long_ranges_touch_few_cells(spark):
    whole = spark.createDataFrame([("x", 0, 1 << 40, i) for i in range(3)], "chrom string, start long, end long, id long")
    points = spark.createDataFrame([("x", i << 30, (i << 30) + 1, i) for i in range(1000)], "chrom string, start long, end long, id long")
    assert iv.overlap_pairs(whole, points).count() == iv.overlap_pairs(points, whole).count() == 3000
