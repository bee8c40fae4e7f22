"""Exact set-similarity self-join on word n-grams by PartEnum signatures.

A document's set holds the hashes of its distinct word n-grams.  Sets of like size share a band; two sets of the wanted
Jaccard similarity, the larger in that band, differ in at most k elements.  The hash domain is cut into first-level parts,
and each of them into SECOND second-level parts; every subset of SECOND - 1 second-level parts of a first-level part is a
signature.  With T first-level parts, two such sets share at least 2 T - k signatures: a part with two differences or more
may share none, one with a single difference shares one, one without any shares all, and k differences can spoil no more.
T is SPARE percent above what pigeonholes need (2 T > k), so each set may leave out 2 T - k - 1 of its signatures: those
with fewest rare elements, then fewest elements.  That rank depends on a signature's content alone, so of the signatures
that two sets share the highest is kept by both: 2 T - k - 1 others at least rank below it.  Which elements are rare is a
guess from a bounded sample of the documents; a wrong guess makes more candidates, and never loses a link.

Tasks send signatures as packed blocks, one a part of the signatures' hashes; each block of a part meets the others of that
part in one task.  There each signature gives links to try between its smallest document and the others, not all pairs.
Signatures that many documents of one task share are tried against the task's smallest and sent once; all their documents
count as unsettled.  A link to try is judged first by parity sketches, whose difference never exceeds that of the sets, and
what remains by the sets themselves.

A pair that shares a signature and is not joined by the links found so far is unsettled.  Such documents (those of signatures
that hold different components) are joined once more, exactly: only elements that two components hold count, a document with
too few of them goes, and of the others the rarest elements (as many as any similar set must meet in) lead to candidates.
Frequent elements are dealt in tiles of bounded size.  So no link that joins two components is lost, nothing is capped, and no
group is expanded into its pairs.

Defined results: without words (or text) a set is empty and links with nothing; with fewer words than n the whole sequence
is the one element; equal ids count as one document, which links as any of its texts does; rows without an id keep a null
component; repeated rows come back each for itself; long texts are whole; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._shared import U64, mix64

#: Ids up to this many are broadcast (8 bytes each) to the scan that fetches their texts; beyond it, a join by key.
BROADCAST_IDS = 1_000_000
#: Second-level parts of each first-level part; a signature takes all but one of them.
SECOND = 3
#: First-level parts, in percent, beyond those that pigeonholes need.
SPARE = 25
#: About so many documents show which elements are common: those in COMMON of them or more, COMMON_MOST at most (8 bytes each,
#: broadcast).
SAMPLE, COMMON, COMMON_MOST = 8_000, 3, 500_000
#: Signatures that a task gathers before it sends them on (16 bytes each).
GATHER = 500_000
#: Blocks of signatures for each shuffle partition; a task holds one block's signatures at a time.
BLOCKS = 16
#: Documents of one gathering that share a signature, from which on it is sent once.
HOT = 2_000
#: Documents of one element that a task compares with each other; elements of more are dealt in tiles.
TILE = 250
_SALTS = [U64(0x8CB92BA72F3D8DD7), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5)]
#: Kinds of the rows of the first pass, in column n; a document's row has the size of its set.
_BLOCK, _TRY, _OPEN, _HOT_MARK = -1, -2, -3, -4


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text raw[offsets[i]:offsets[i+1]], A-Z lower-cased."""
    low = _shared.LOWER[raw]
    starts, ends, owner = _shared.word_spans(low, offsets)
    words = _shared.span_hashes(low, starts, ends)
    docs = len(offsets) - 1
    at = np.searchsorted(owner, np.arange(docs + 1))
    out = []
    with np.errstate(over="ignore"):
        gram = np.zeros(max(0, len(words) - n + 1), dtype=U64)
        for k in range(n):
            gram = gram * U64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k] if len(gram) else gram
        gram = mix64(gram)
        for i in range(docs):
            a, b = at[i], at[i + 1]
            if b - a >= n:
                out.append(np.unique(gram[a : b - n + 1]))
            elif b > a:
                h = U64(b - a)
                for w in words[a:b]:
                    h = mix64(np.array([h * U64(0x9E3779B97F4A7C15) + w], dtype=U64))[0]
                out.append(np.array([h], dtype=U64))
            else:
                out.append(np.zeros(0, dtype=U64))
    return out


class Bands:
    """Size bands and the cuts of each, for sets with num * union <= den * intersection."""

    def __init__(self, num: int, den: int, common: np.ndarray | None = None):
        self.num, self.den = num, den
        self.common = common if common is not None else np.zeros(0, dtype=U64)  # sorted
        self.low: list[int] = [1]
        self.high: list[int] = []
        #: (differences, first-level parts, signatures to leave out), or None where only equal sets are similar
        self.cuts: list[tuple[int, int, int] | None] = []
        self.edges: dict[int, np.ndarray] = {}

    def of(self, size: int) -> int:
        while not self.high or self.high[-1] < size:
            lo = self.low[-1]
            hi = max(lo, lo * self.den**2 // self.num**2)
            k = 2 * hi * (self.den - self.num) // (self.den + self.num)
            self.high.append(hi)
            self.low.append(hi + 1)
            self.cuts.append(self._cut(k) if k else None)
        return int(np.searchsorted(self.high, size))

    @staticmethod
    def _cut(k: int) -> tuple[int, int, int]:
        need = k // 2 + 1
        first = need + -(-need * SPARE // 100)
        return k, first, 2 * first - k - 1

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """The signatures of a sorted set, for each band that a similar set at least as large may lie in."""
        size, out = len(s), []
        if not size:
            return np.zeros(0, dtype=U64)
        with np.errstate(over="ignore"):
            sums = np.zeros(size + 1, dtype=U64)
            np.cumsum(mix64(s ^ _SALTS[2]), out=sums[1:])
            place = np.searchsorted(self.common, s)
            rare = np.zeros(size + 1, dtype=np.int64)  # of the elements before; beyond the last common one all are rare
            np.cumsum((place == len(self.common)) | (np.append(self.common, U64(0))[place] != s), out=rare[1:])
            for band in range(self.of(size), self.of(size * self.den // self.num) + 1):
                if self.cuts[band] is None:
                    continue
                _, first, spare = self.cuts[band]
                edges = self.edges.get(band)
                if edges is None:
                    parts = first * SECOND
                    edges = self.edges[band] = np.array([(i << 64) // parts for i in range(1, parts)], dtype=U64)
                at = np.r_[0, np.searchsorted(s, edges), size]
                value, count = (sums[at[1:]] - sums[at[:-1]]).reshape(first, SECOND), np.diff(at).reshape(first, SECOND)
                value = (value.sum(axis=1, keepdims=True, dtype=U64) - value).ravel()
                count = (count.sum(axis=1, keepdims=True) - count).ravel()
                where = np.arange(first * SECOND, dtype=U64) + U64(band << 32)
                if spare:
                    few = np.diff(rare[at]).reshape(first, SECOND)
                    few = (few.sum(axis=1, keepdims=True) - few).ravel()
                    kept = np.lexsort((-count, -few))[: len(count) - spare]
                    value, count, where = value[kept], count[kept], where[kept]
                out.append(mix64(value + mix64(count.astype(U64) * _SALTS[0] + mix64(where * _SALTS[1]))))
        return np.concatenate(out) if out else np.zeros(0, dtype=U64)


# ---------------------------------------------------------------- parity sketches


def parity_sketch(s: np.ndarray) -> bytes:
    """One bit a bucket: whether an odd number of elements falls there; at least two buckets an element, up to 65,536."""
    bits = 1 << min(16, max(8, (2 * len(s) - 1).bit_length() if len(s) else 8))
    odd = np.bincount(((s >> U64(20)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _words(sketches: list[bytes], width: int) -> np.ndarray:
    """The sketches of equal length, folded to width 64-bit words."""
    m = np.frombuffer(b"".join(sketches), dtype=U64).reshape(len(sketches), -1)
    while m.shape[1] > width:
        half = m.shape[1] // 2
        m = m[:, :half] ^ m[:, half:]
    return m


def _may_link(na: np.ndarray, nb: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes that differ in `apart` elements at least can be similar."""
    return (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (apart * (den + num) <= (na + nb) * (den - num))


def _close_pairs(num: int, den: int):
    """Of rows (a, b, na, nb, sa, sb) the pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            sa, sb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            la, lb = np.fromiter(map(len, sa), np.int64, len(sa)), np.fromiter(map(len, sb), np.int64, len(sb))
            apart = np.zeros(len(sa), dtype=np.int64)
            for a, b in {*zip(la.tolist(), lb.tolist(), strict=True)}:
                at, width = np.flatnonzero((la == a) & (lb == b)), min(a, b) // 8
                both = _words([sa[i] for i in at], width) ^ _words([sb[i] for i in at], width)
                apart[at] = np.bitwise_count(both).sum(axis=1)
            keep = pa.array(_may_link(na, nb, apart, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def close_in_group(doc: np.ndarray, comp: np.ndarray, n: np.ndarray, sketches: list[bytes], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs (smaller id first) of different components whose sketches allow the similarity."""
    order = np.argsort(n, kind="stable")
    doc, comp, n = doc[order], comp[order], n[order]
    sketches = [sketches[i] for i in order]
    width = np.fromiter((len(x) // 8 for x in sketches), np.int64, len(sketches))
    levels: dict[int, tuple[int, np.ndarray]] = {}
    for w in np.unique(width).tolist():  # sizes ascend, so do widths: rows from the first of width w on, folded to w
        first = int(np.searchsorted(width, w))
        parts = [_words([sketches[i] for i in range(*np.searchsorted(width, [v, v + 1]))], w) for v in np.unique(width[first:]).tolist()]
        levels[w] = first, np.concatenate(parts)
    for i in range(len(doc) - 1):
        end = int(np.searchsorted(n, n[i] * den // num, side="right"))
        others = i + 1 + np.flatnonzero(comp[i + 1 : end] != comp[i])
        if len(others):
            first, m = levels[int(width[i])]
            apart = np.bitwise_count(m[others - first] ^ m[i - first]).sum(axis=1)
            for j in others[_may_link(n[i], n[others], apart, num, den)].tolist():
                yield min(doc[i], doc[j]), max(doc[i], doc[j])


# ---------------------------------------------------------------- the first pass: documents, signatures, links to try

_ROW = "part int, doc long, h1 long, h2 long, n int, body binary"
_NAMES = ["part", "doc", "h1", "h2", "n", "body"]


def _rows(part, doc, h1, h2, n, body=None, null=None) -> pa.RecordBatch:
    size = len(doc)
    cols = [pa.array(part, pa.int32()), pa.array(doc, pa.int64(), mask=null), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n, pa.int32()), pa.array(body, pa.binary()) if body is not None else pa.nulls(size, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _marks(kind: int, doc: np.ndarray, other: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    return _rows(part.astype(np.int32), doc.astype(np.int64), other, np.zeros(len(doc), U64), np.full(len(doc), kind, dtype=np.int32))


def _pack(sig: np.ndarray, doc: np.ndarray) -> bytes:
    """Signatures' 56 bits and documents, as offsets from the smallest in as few bytes as they need."""
    base = int(doc.min())
    off = (doc - base).view(U64)
    width = max(1, (int(off.max()).bit_length() + 7) // 8)
    head = np.array([base, width, len(sig)], dtype=np.int64)
    return head.tobytes() + sig.view(np.uint8).reshape(-1, 8)[:, :7].tobytes() + off.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    base, width, n = np.frombuffer(body, dtype=np.int64, count=3).tolist()
    sig, off = np.zeros((n, 8), dtype=np.uint8), np.zeros((n, 8), dtype=np.uint8)
    raw = np.frombuffer(body, dtype=np.uint8, offset=24)
    sig[:, :7] = raw[: 7 * n].reshape(n, 7)
    off[:, :width] = raw[7 * n :].reshape(n, width)
    return sig.view(U64).ravel(), off.view(np.int64).ravel() + base


def _first_pass(words: int, num: int, den: int, parts: int, hot: int, common):
    """A row for each document (hashes and size of its set, sketch) and blocks of signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den, common.value)
        sigs: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not sigs:
                return
            s, d = np.concatenate(sigs) >> U64(8), np.concatenate(docs)
            part = (s % U64(parts)).astype(np.int32)
            order = np.lexsort((d, s, part))
            s, d, part = s[order], d[order], part[order]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[first, len(s)])
            if (size > hot).any():
                crowded = np.repeat(size > hot, size)
                low = np.repeat(d[first], size)
                at = crowded & (d != low)
                pairs = np.unique(np.stack([d[at], low[at]], axis=1), axis=0)
                yield _marks(_TRY, pairs[:, 0], pairs[:, 1], pairs[:, 0] % parts)
                members = np.unique(d[crowded])
                yield _marks(_OPEN, members, members, members % parts)
                lead = first[size > hot]
                yield _marks(_HOT_MARK, d[lead], s[lead], part[lead])
                s, d, part = s[~crowded], d[~crowded], part[~crowded]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            ends = np.r_[cut[1:], len(part)]
            for a in range(0, len(cut), 500):
                some = range(a, min(a + 500, len(cut)))
                zero = np.zeros(len(some), U64)
                yield _rows(part[cut[some.start : some.stop]], zero.view(np.int64), zero, zero, np.full(len(some), _BLOCK, dtype=np.int32), [_pack(s[cut[i] : ends[i]], d[cut[i] : ends[i]]) for i in some])
            sigs.clear()
            docs.clear()
            seen.clear()

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for a, b, raw, off in _shared.utf8_parts(texts):
                sets = shingle_sets(raw, off, words)
                h1, h2 = np.zeros(b - a, dtype=U64), np.zeros(b - a, dtype=U64)
                with np.errstate(over="ignore"):
                    for i, s in enumerate(sets):
                        h1[i], h2[i] = mix64(s ^ _SALTS[3]).sum(dtype=U64), mix64(s + _SALTS[0]).sum(dtype=U64)
                        if len(s) and not null[a + i]:
                            same = (int(h1[i]), int(h2[i]))
                            if same not in seen:
                                seen.add(same)
                                got = bands.signatures(s)
                                sigs.append(got)
                                docs.append(np.full(len(got), ids[a + i]))
                                held += len(got)
                yield _rows((ids[a:b] % parts).astype(np.int32), ids[a:b], h1, h2, np.fromiter(map(len, sets), np.int32, b - a), [parity_sketch(s) if len(s) else None for s in sets], null[a:b])
                if held >= GATHER:
                    yield from flush()
                    held = 0
        yield from flush()
        _shared.release()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part: documents as they are, and of each part's signatures the links to try and the unsettled."""
    sig: list[np.ndarray] = []
    doc: list[np.ndarray] = []
    mark: list[np.ndarray] = []
    current = None

    def settle() -> Iterator[pa.RecordBatch]:
        if not sig:
            return
        s, d, m = np.concatenate(sig), np.concatenate(doc), np.concatenate(mark)
        sig.clear(), doc.clear(), mark.clear()
        order = np.lexsort((d, s))
        s, d, m = s[order], d[order], m[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        low = np.repeat(d[first], size)
        at = d != low
        if at.any():
            pairs = np.unique(np.stack([d[at], low[at]], axis=1), axis=0)
            yield _marks(_TRY, pairs[:, 0], pairs[:, 1], pairs[:, 0] * 0)
        if m.any():
            members = np.unique(d[np.repeat(np.maximum.reduceat(m, first), size)])
            yield _marks(_OPEN, members, members, members * 0)

    for batch in batches:
        n = batch.column(4).to_numpy()
        asis = (n >= 0) | (n == _TRY) | (n == _OPEN)
        if asis.any():
            yield batch.filter(pa.array(asis))
        for i in np.flatnonzero(~asis).tolist():
            part = batch.column(0)[i].as_py()
            if part != current:
                yield from settle()
                current = part
            if n[i] == _BLOCK:
                s, d = _unpack(batch.column(5)[i].as_py())
                m = np.zeros(len(s), dtype=bool)
            else:
                s, d, m = np.array([batch.column(2)[i].as_py()], dtype=np.int64).view(U64), np.array([batch.column(1)[i].as_py()], dtype=np.int64), np.ones(1, dtype=bool)
            sig.append(s), doc.append(d), mark.append(m)
    yield from settle()


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in _shared.utf8_parts(batch.column(1)):
                got = shingle_sets(raw, off, words)
                ends = np.r_[0, np.cumsum([len(s) for s in got])].astype(np.int32)
                flat = np.concatenate([*got, np.zeros(0, U64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc", "elements"])

    return run


# ---------------------------------------------------------------- DataFrames


class _Join:
    """The steps over one table of texts (doc, text)."""

    def __init__(self, texts: DataFrame, words: int, num: int, den: int):
        self.texts, self.words, self.num, self.den = texts, words, num, den
        self.spark = texts.sparkSession
        self.made: list[DataFrame] = []
        self.repeated = False

    def written(self, df: DataFrame, name: str, files_per_core: int = 1) -> DataFrame:
        self.made.append(_shared.written(df, f"partenum-{name}", files_per_core))
        return self.made[-1]

    def sets_of(self, ids: DataFrame, name: str) -> DataFrame:
        """The sets (doc, elements) of the documents of ids, read from their texts again."""
        ids = self.written(ids.distinct(), f"{name}-ids")
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        sets = self.texts.join(wanted, "doc", "left_semi").mapInArrow(_sets(self.words), "doc long, elements array<long>")
        return self.written(sets.distinct() if self.repeated else sets, f"{name}-sets", 4)

    def links(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        left = sets.select(F.col("doc").alias("a"), F.col("elements").alias("ea"))
        right = sets.select(F.col("doc").alias("b"), F.col("elements").alias("eb"))
        both = F.size(F.array_intersect("ea", "eb")).cast("long")
        joined = pairs.join(left, "a").join(right, "b").withColumn("both", both)
        return self.written(joined.filter(F.col("both") * self.den >= (F.size("ea") + F.size("eb") - F.col("both")) * self.num).select("a", "b").distinct(), name)


def _common(join: _Join) -> np.ndarray:
    """Sorted hashes of the elements that several documents of a sample have."""
    n = join.texts.count()
    some = join.texts.filter(F.rand(7) < SAMPLE / max(n, 1))
    flat = some.mapInArrow(_sets(join.words), "doc long, elements array<long>").select(F.explode("elements").alias("e"))
    often = flat.groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    got = often.orderBy(F.desc("n"), "e").limit(COMMON_MOST).select("e").toArrow().column("e").to_numpy()
    return np.sort(np.asarray(got, dtype=np.int64).view(U64))


def _needed(n: Column, num: int, den: int) -> Column:
    """The elements that a set of n must share with a similar one."""
    return F.ceil(n.cast("long") * num / den).cast("long")


def _tiled(num: int, den: int):
    """Candidate pairs of rows (e, i, j, doc, comp, n, body) sorted by their tile (e, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key: tuple | None = None
        found: set[tuple[int, int]] = set()

        def compare() -> None:
            doc, comp, n = (np.array([r[k] for r in held], dtype=np.int64) for k in range(3))
            if len(held) > 1 and (comp != comp[0]).any():
                found.update(close_in_group(doc, comp, n, [r[3] for r in held], num, den))

        def out() -> pa.RecordBatch:
            a = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for batch in batches:
            for e, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (e, i, j) != key:
                    compare()
                    held, key = [], (e, i, j)
                held.append(tuple(row))
            if len(found) > 10_000:
                yield out()
        compare()
        yield out()

    return run


def _settle(join: _Join, unsettled: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links between different components of the documents unsettled (doc, comp): an exact join by prefixes of rare elements."""
    num, den = join.num, join.den
    sets = join.sets_of(unsettled.select("doc"), "open")
    flat = sets.join(unsettled, "doc").select("doc", "comp", F.explode("elements").alias("e"))
    often = flat.groupBy("e").agg(F.count(F.lit(1)).alias("f"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("e", "f")
    often = join.written(often, "open-shared", 4)
    have = flat.select("doc", "e").join(often, "e").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("d"))
    known = unsettled.join(sketches.select("doc", "n").distinct(), "doc")
    have = join.written(have.join(known, "doc").filter(F.size("d") >= _needed(F.col("n"), num, den)), "open-rare", 4)
    # of the n - needed + 1 rarest elements, those that no other component holds lead nowhere
    lead = F.size("d") - _needed(F.col("n"), num, den) + 1
    keyed = join.written(have.select("doc", "comp", "n", F.explode(F.transform(F.slice("d", F.lit(1), lead.cast("int")), lambda x: x["e"])).alias("e")), "open-prefixes", 4)
    size = keyed.groupBy("e").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
    size = join.written(size.select("e", F.ceil(F.col("m") / TILE).cast("int").alias("b")), "open-tiles")
    mine = F.pmod(F.xxhash64("doc"), F.col("b")).cast("int")
    dealt = keyed.join(size, "e").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    dealt = dealt.join(sketches.select("doc", "body"), "doc").select("e", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "doc", "comp", "n", "body")
    tiles = dealt.repartition("e", "i", "j").sortWithinPartitions("e", "i", "j")
    pairs = join.written(tiles.mapInArrow(_tiled(num, den), "a long, b long").distinct(), "open-pairs")
    return join.links(pairs, sets, "open-links")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id, the smallest id that links of Jaccard similarity
    num / den or more reach (its own id without a link)."""
    spark = docs.sparkSession
    _shared.prepare(spark)
    join = _Join(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")), words, num, den)
    common = spark.sparkContext.broadcast(_common(join))
    parts = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = join.texts.mapInArrow(_first_pass(words, num, den, parts, HOT, common), _ROW)
    table = _shared.written(first.repartition("part").sortWithinPartitions("part").mapInArrow(_meet, _ROW), "partenum-rows", 4)

    all_docs = table.filter("n >= 0").select("doc", "h1", "h2", "n")
    classes = all_docs.filter("n > 0 AND doc IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("members"))
    join.repeated = _repeated(all_docs)
    several = join.written(classes.filter("members > 1").drop("members"), "several")
    copies = join.written(all_docs.join(several, ["h1", "h2", "n"]).filter("doc <> rep").select("doc", "rep").distinct(), "copies")

    def by_rep(df: DataFrame, col: str) -> DataFrame:
        return df.join(copies.withColumnRenamed("doc", col), col, "left").withColumn(col, F.coalesce("rep", col)).drop("rep")

    sketches = table.filter("n > 0 AND doc IS NOT NULL").select("doc", "n", "body")
    tries = table.filter(F.col("n") == _TRY).select(F.col("doc").alias("a"), F.col("h1").alias("b")).distinct()
    tries = join.written(by_rep(by_rep(tries, "a"), "b").filter("a <> b").distinct(), "tries")
    sides = [sketches.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("body").alias(f"s{x}")) for x in "ab"]
    near = tries.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_close_pairs(num, den), "a long, b long")
    near = join.written(near.distinct(), "near")
    links = join.links(near, join.sets_of(near.select(F.col("a").alias("doc")).union(near.select(F.col("b").alias("doc"))), "near"), "links")
    if join.repeated:  # an id with several texts joins the classes of all of them
        links = join.written(links.union(copies.select(F.col("doc").alias("a"), F.col("rep").alias("b"))), "links")
    comps = join.written(_shared.components(links, "partenum"), "components")

    # a smallest document with which some other has not been joined leaves all that share its signatures unsettled
    def with_comp(df: DataFrame, col: str, comp: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(col), F.col("component_id").alias(comp)), col, "left").withColumn(comp, F.coalesce(comp, col))

    known = join.written(with_comp(with_comp(tries, "a", "ca"), "b", "cb"), "known")
    bad = join.written(known.filter("ca <> cb").select("b").distinct(), "bad")
    unsettled = known.join(bad, "b", "left_semi").select(F.col("a").alias("doc"), F.col("ca").alias("comp"))
    flagged = by_rep(table.filter(F.col("n") == _OPEN).select("doc"), "doc")
    unsettled = join.written(unsettled.union(with_comp(flagged, "doc", "comp").select("doc", "comp")).distinct(), "unsettled")
    if unsettled.head(1):
        more = _settle(join, unsettled, sketches)
        if more.head(1):
            comps = join.written(_shared.components(comps.select(F.col("node").alias("a"), F.col("component_id").alias("b")).union(more), "partenum"), "components")
    moved = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component_id", "rep").alias("component_id"), "members", "rep")
    moved = _shared.written(moved.filter("members > 1 OR component_id <> rep").drop("members", "rep"), "partenum-classes", 1)
    for made in join.made:
        _shared.discard(made)
    out = all_docs.join(moved, ["h1", "h2", "n"], "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def _repeated(all_docs: DataFrame) -> bool:
    """Whether an id occurs twice."""
    return bool(all_docs.filter("doc IS NOT NULL").groupBy("doc").count().filter("count > 1").limit(1).count())
