"""Near-duplicate embeddings by tiled comparison in the order of principal components.

Unit vectors are turned so that their leading numbers carry most of the variance.  Rows of one label are dealt into tiles by
their first component; two tiles are compared only if their first components come as close as two linked vectors' must.
A comparison adds up products of leading dimensions first; what the rest can add is bounded by the norms of the rests, so
pairs drop out as soon as their cosine cannot reach the threshold.  Pairs that stay are decided by their full dot product
in double precision.

Equal vectors are compared once, as one; a pair of tiles returns link counts and one edge for each vector and group of
linked vectors within it, never its pairs.  Vectors that are null, zero or hold null or non-finite numbers, and rows without
a label, link with nothing; so do vectors of another length than the rest of their label.  Rows that repeat an id keep a row
each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

#: Bound of the sample from which the rotation is fitted; any rotation gives the same links.
ROTATION_ROWS = 10_000
TILE_ROWS = 1024
#: Dimensions that a comparison adds up at a time.
STEP_DIMS = 16
#: Slack for rounding, below which no pair is dropped early.
SLACK = 1e-9


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal directions of rows, in descending order of variance."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(vectors[:, ::-1])


def linked(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine of at least least between rows of a and b (rotated unit vectors; raw: as given)."""
    dims = a.shape[1]
    tail = lambda x, k: np.sqrt(np.maximum((x[:, k:] ** 2).sum(axis=1), 0))
    k = min(STEP_DIMS, dims)
    part = a[:, :k] @ b[:, :k].T
    i, j = np.nonzero(part + np.outer(tail(a, k), tail(b, k)) >= least - SLACK)
    dot = part[i, j]
    while k < dims and len(i):
        nxt = min(k + STEP_DIMS, dims)
        dot = dot + np.einsum("ij,ij->i", a[i, k:nxt], b[j, k:nxt])
        k = nxt
        stay = dot + tail(a, k)[i] * tail(b, k)[j] >= least - SLACK
        i, j, dot = i[stay], j[stay], dot[stay]
    if not len(i):
        return i, j
    x, y = raw_a[i], raw_b[j]
    cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
    ok = cosine >= least
    return i[ok], j[ok]


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that links (i, j) reach."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _tiles(turn: np.ndarray | None):
    """Rows (label, at, vec_id, copies, embedding) sorted by label and place, to one row for each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, ids, copies, rows = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            raw = np.array(rows, dtype=np.float64)
            unit = raw / np.sqrt((raw**2).sum(axis=1))[:, None]
            first = unit @ turn[:, 0] if turn is not None and turn.shape[0] == raw.shape[1] else unit[:, 0]
            cols = [pa.array([ids[0]], pa.int64()), pa.array([label], pa.string()), pa.array([raw.shape[1]], pa.int32()), pa.array([float(first.min())]), pa.array([float(first.max())])]
            cols += [pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(copies)], pa.list_(pa.int64())), pa.array([raw.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["tile", "label", "dims", "low", "high", "ids", "copies", "vectors"])
            ids.clear()
            copies.clear()
            rows.clear()

        for batch in batches:
            for lab, vec, n, row in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                if lab != label or len(ids) >= TILE_ROWS or (rows and len(rows[0]) != len(row)):
                    yield from flush()
                    label = lab
                ids.append(vec)
                copies.append(n)
                rows.append(row)
        yield from flush()

    return run


def _compare(turn: np.ndarray | None, least: float):
    """Rows (ids, copies, vectors, dims) of two tiles, to counts (node, other null, n) and edges (node, other, 0)."""

    def read(batch: pa.RecordBatch, k: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, copies = (np.array(batch.column(k + c)[at].as_py(), dtype=np.int64) for c in (0, 1))
        return ids, copies, np.frombuffer(batch.column(k + 2)[at].as_py(), dtype=np.float64).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                same = batch.column(0)[at].as_py()
                (ia, ca, ra), (ib, cb, rb) = read(batch, 1, at), read(batch, 4, at)
                ua, ub = (x / np.sqrt((x**2).sum(axis=1))[:, None] for x in (ra, rb))
                if turn is not None and turn.shape[0] == ra.shape[1]:
                    ua, ub = ua @ turn, ub @ turn
                i, j = linked(ua, ub, ra, rb, least)
                if same:
                    up = i < j
                    i, j = i[up], j[up]
                if not len(i):
                    continue
                na, nb = np.bincount(i, weights=cb[j], minlength=len(ia)), np.bincount(j, weights=ca[i], minlength=len(ib))
                ids = np.r_[ia, ib]
                order = np.argsort(ids, kind="stable")
                rank = np.empty(len(ids), dtype=np.int64)
                rank[order] = np.arange(len(ids))
                low = smallest_reachable(len(ids), rank[i], rank[j + len(ia)])
                other = ids[order][low[rank]]
                moved = other != ids
                n = np.r_[na, nb].astype(np.int64)
                count = n > 0
                node = np.r_[ids[count], ids[moved]]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.r_[ids[count], other[moved]]), pa.array(np.r_[n[count], np.zeros(moved.sum(), np.int64)])], names=["node", "other", "n"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    _shared.prepare(spark)
    e = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), e.alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    # -0.0 equals 0.0 as a number and in its cosine, so both count as equal vectors
    rows = rows.withColumn("e", F.when(F.col("fine"), F.transform("e", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))))
    rows = rows.withColumn("key", F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.transform("e", lambda x: x.cast("string"))), 256)))
    classes = rows.filter("fine").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("e").alias("e"))
    classes = _shared.written(classes, "embedding-classes")
    n = classes.count()
    sample = classes.filter(_shared.hash_share("rep", "rotation") < ROTATION_ROWS / max(n, 1)).select("e").toArrow().column("e").to_pylist()
    turn = None
    if sample:
        width = max({len(x) for x in sample}, key=[len(x) for x in sample].count)
        sample = np.array([x for x in sample if len(x) == width])
        turn = rotation(sample / np.sqrt((sample**2).sum(axis=1))[:, None])

    axis = F.array(*[F.lit(float(x)) for x in turn[:, 0]]) if turn is not None else F.array(F.lit(1.0))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    first = F.aggregate(F.zip_with("e", axis, lambda x, y: x * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / norm
    placed = classes.select("label", F.struct(F.size("e").alias("dims"), first.alias("first")).alias("at"), F.col("rep").alias("vec_id"), "copies", "e")
    dealt = placed.repartitionByRange("label", "at", "vec_id").sortWithinPartitions("label", "at", "vec_id")
    tiles = _shared.written(dealt.mapInArrow(_tiles(turn), "tile long, label string, dims int, low double, high double, ids array<long>, copies array<long>, vectors binary"), "embedding-tiles")

    # |x - y| <= sqrt(2 - 2 cos), so linked vectors' first components lie within that reach; tiles meet in cells of its width
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    place = tiles.select("tile", "label", "dims", "low", "high")
    cell = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach)))
    left = place.select(F.col("tile").alias("a"), "label", "dims", F.col("low").alias("la"), F.col("high").alias("ha"), cell(F.col("low"), F.col("high")).alias("cell"))
    right = place.select(F.col("tile").alias("b"), "label", "dims", F.col("low").alias("lb"), F.col("high").alias("hb"), cell(F.col("low") - reach, F.col("high") + reach).alias("cell"))
    meet = left.join(right, ["label", "dims", "cell"]).filter((F.col("a") <= F.col("b")) & (F.col("la") <= F.col("hb") + reach) & (F.col("lb") <= F.col("ha") + reach)).select("a", "b").distinct()
    body = lambda x: tiles.select(F.col("tile").alias(x), F.col("ids").alias(f"ids_{x}"), F.col("copies").alias(f"n_{x}"), F.col("vectors").alias(f"v_{x}"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    pairs = meet.join(body("a"), "a").join(body("b"), "b").select((F.col("a") == F.col("b")).alias("same"), "ids_a", "n_a", "v_a", "ids_b", "n_b", "v_b")
    out = _shared.written(pairs.mapInArrow(_compare(turn, least), "node long, other long, n long"), "embedding-links")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_shared.BATCH_ROWS))

    counts = out.groupBy("node").agg(F.sum("n").alias("n"))
    comps = _shared.components(out.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")), "embedding")
    by_class = classes.select("label", "key", "rep", "copies").join(counts, F.col("rep") == F.col("node"), "left").drop("node")
    by_class = by_class.join(comps, F.col("rep") == F.col("node"), "left")
    by_class = by_class.select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component"))
    # rows that link with nothing pass by the join, where they would all share one null key
    joined = rows.filter("fine").select("vec_id", "label", "key").join(by_class, ["label", "key"])
    alone = rows.filter("NOT fine").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    both = joined.select("vec_id", "links", "component").unionByName(alone)
    return both.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
