"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class in its context times that of the token within its class in the same context.  The
class, one of CLASSES, comes from a word's first and last letters and its length.  Both factors are softmaxes over the same
kinds of features of the context: the word before, the word two before (a skip feature), both, each by their group, and the
word before by its own hash.  Within a class, every word is a member: the OWN most frequent words of the class have weights of
their own, and the others share weights, by a finer hash of the same letters, in SHARED members.  The add-one relative count
of a word in its class is its prior, which the weights multiply; words that share weights differ by their priors alone, so the
softmax over all words of a class sums over its members, and nothing is left out of its normaliser.  Each shared member also
keeps one count for words not seen.  A word's group, as context, is its class and member.

Weights are trained by distributed gradient updates: the training documents are cut into ROUNDS by a hash of their ids; in
each round every task sums the observed and expected counts of its documents' features under the present weights, and their
ratio, smoothed, moves the weights.

Word counts cover all training tokens.  The most frequent words (at most HEAD_WORDS) go to every task; a document's other
words are looked up by a join.  Words are compared by 54 bits of a hash and by class and shared member.  Null and empty texts
are one end token; very long texts are read whole; repeated rows are scored each for itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._shared import U64, mix64

CLASSES = 16
#: Members of a class: words that share weights come first, then words with weights of their own.
SHARED, OWN = 32, 16
MEMBERS = SHARED + OWN
#: Rows of weights of each feature: of the classes, and of the members of a class.
BUCKET_BITS, INNER_BITS = 12, 13
FEATURES = 4
ROUNDS = 3
RATE = 0.45
#: Added to observed and expected counts, and the most that their ratio moves a weight by.
SMOOTH, MOST = 3.0, 20.0
HEAD_WORDS = 500_000
#: Distinct words that a task gathers before it sends their counts on.
GATHER = 400_000
#: Tokens whose softmaxes are worked out together, and rows of sums that travel together.
TOKENS, BLOCK = 1 << 15, 256
#: Rows of up to so many tokens are summed together, others each for itself.
FEW = 48
END = np.int64(-32)  # the end token: class 0
_START = U64(CLASSES * MEMBERS)
_LOW, _SLOT = U64(31), U64(SHARED - 1)
_SHAPE = _LOW | _SLOT << U64(5)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word keys with their class in the low five bits and their shared member in the next five, owning text), the end token behind each text's words."""
    low = _shared.LOWER[raw]
    starts, ends, owner = _shared.word_spans(low, offsets)
    h = _shared.span_hashes(low, starts, ends)
    docs = len(offsets) - 1
    if len(starts):
        first = low[starts].astype(U64)
        letter = (low >= 97) & (low <= 122) | (low >= 128)
        tail = np.where(letter[ends - 1], ends - 1, np.maximum(ends - 2, starts))  # before a closing mark
        with np.errstate(over="ignore"):
            shape = first * U64(31) + low[tail].astype(U64) * U64(1009) + low[np.maximum(tail - 1, starts)].astype(U64) * U64(9176) + np.minimum(ends - starts, 9).astype(U64) // U64(4)
        mixed = mix64(shape)
        kind = U64(1) + mixed % U64(CLASSES - 1)
        key = ((h & ~_SHAPE) | (mixed >> U64(40) & _SLOT) << U64(5) | kind).view(np.int64)
    else:
        key = np.zeros(0, dtype=np.int64)
    at = np.searchsorted(owner, np.arange(docs), side="right") + np.arange(docs)
    out = np.empty(len(key) + docs, dtype=np.int64)
    own = np.empty(len(out), dtype=np.int64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[at] = True
    out[is_end], own[is_end] = END, np.arange(docs)
    out[~is_end], own[~is_end] = key, owner
    return out, own


def contexts(key: np.ndarray, own: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(FEATURES, tokens) rows of the classes' weights and of the members' weights: the groups of the word before, of the word
    two before and of both, and the word before itself."""
    g, k = group.astype(U64), key.view(U64)
    kind = k & _LOW
    one, two, word = np.full(len(k), _START), np.full(len(k), _START), np.full(len(k), _START)
    near, far = own[1:] == own[:-1], own[2:] == own[:-2]
    one[1:] = np.where(near, g[:-1], _START)
    word[1:] = np.where(near, k[:-1], _START)
    two[2:] = np.where(far, g[:-2], _START)
    with np.errstate(over="ignore"):
        both = mix64(one * U64(7) ^ mix64(two))
        word = mix64(word * U64(11))
        outer = np.stack([mix64(one * U64(3)), mix64(two * U64(5) + U64(1)), both, word]) >> U64(64 - BUCKET_BITS)
        inner = mix64(np.stack([one * U64(3), two * U64(5) + U64(1), both, word]) ^ mix64(kind + U64(1))) >> U64(64 - INNER_BITS)
    return outer.astype(np.int64), inner.astype(np.int64)


def _scores(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of bias and each feature's row of weights, its exponential, and the sum of that.  Weights are bounded by MOST
    and ROUNDS, and bias is at most 0, so nothing overflows."""
    z = np.take(weights[0], rows[0], axis=0)
    for f in range(1, FEATURES):
        z += np.take(weights[f], rows[f], axis=0)
    z += bias
    e = np.exp(z)
    return z, e, np.einsum("ij->i", e)


@dataclass
class Model:
    """weights: (FEATURES, buckets, classes); inner: (FEATURES, buckets, members); bias: log of each class's share of tokens;
    prior: log of each member's share of its class, by class and member, and spread: log10 of its add-one counts; own: sorted
    keys of the words with weights of their own, own_member: their members; the head's keys, sorted, and counts; tokens,
    types: N and V."""

    weights: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    prior: np.ndarray
    spread: np.ndarray
    own: np.ndarray
    own_member: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray
    tokens: int
    types: int

    def members(self, key: np.ndarray) -> np.ndarray:
        """Each word's member in its class."""
        shared = (key >> 5 & (SHARED - 1)).astype(np.int64)
        if not len(self.own):
            return shared
        at = np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)
        return np.where(self.own[at] == key, self.own_member[at], shared)

    def classes(self, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores of each class."""
        return _scores(self.weights, outer, self.bias)

    def in_class(self, inner: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores of each member of the token's class."""
        return _scores(self.inner, inner, np.take(self.prior, kind, axis=0))

    def log10_in_context(self, key: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 of each token's probability, but for log10 of its add-one count."""
        kind, member = (key & 31).astype(np.int64), self.members(key)
        outer, inner = contexts(key, own, kind * MEMBERS + member)
        out = np.empty(len(key))
        for a in range(0, len(key), TOKENS):
            part = slice(a, a + TOKENS)
            at = np.arange(len(key[part]))
            z, _, total = self.classes(outer[:, part])
            y, _, in_class = self.in_class(inner[:, part], kind[part])
            out[part] = z[at, kind[part]].astype(np.float64) + y[at, member[part]] - np.log(total) - np.log(in_class)
        return out / np.log(10.0) - self.spread[kind, member]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, inv = np.unique(key, return_inverse=True)
        return u, np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        if parts:
            u, n = merged()
            for a in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(u[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)])], names=["w", "n"])
        parts.clear()

    for batch in batches:
        for _, _, raw, off in _shared.utf8_parts(batch.column(0)):
            u, n = np.unique(tokens(raw, off)[0], return_counts=True)
            parts.append((u, n))
            held += len(u)
        if held >= GATHER:
            parts[:] = [merged()]
            held = len(parts[0][0])
            if held >= GATHER // 2:
                yield from flush()
                held = 0
    yield from flush()


def _add_expected(expected: np.ndarray, rows: np.ndarray, p: np.ndarray) -> None:
    """Adds the probabilities p of each token to its row of each feature."""
    for f in range(FEATURES):
        order = np.argsort(rows[f].astype(np.uint16), kind="stable")
        in_order, sums = rows[f][order], expected[f]
        at = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
        size = np.diff(np.r_[at, len(order)])
        long = size > FEW
        for r, x, n in zip(in_order[at[long]].tolist(), at[long].tolist(), size[long].tolist(), strict=True):
            sums[r] += np.einsum("ij->j", np.take(p, order[x : x + n], axis=0))
        at, size = at[~long], size[~long]
        for i in range(FEW):  # the next token of every row that has one more: no row twice
            at, size = at[size > i], size[size > i]
            sums[in_order[at]] += np.take(p, order[at + i], axis=0)


def _gradient(sent):
    """Observed and expected counts of each feature and class, and of each feature and member, over the documents of a task:
    in blocks of BLOCK rows of weights, those of the classes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        sums = [(np.zeros(w.shape), np.zeros(w.shape, np.float32)) for w in (model.weights, model.inner)]
        some = False
        for batch in batches:
            for _, _, raw, off in _shared.utf8_parts(batch.column(0)):
                key, own = tokens(raw, off)
                kind, member = (key & 31).astype(np.int64), model.members(key)
                outer, inner = contexts(key, own, kind * MEMBERS + member)
                some = some or len(key) > 0
                for (seen, _), rows, hit in zip(sums, (outer, inner), (kind, member), strict=True):
                    for f in range(FEATURES):
                        seen[f] += np.bincount(rows[f] * seen.shape[2] + hit, minlength=seen[f].size).reshape(seen[f].shape)
                for a in range(0, len(key), TOKENS):
                    part = slice(a, a + TOKENS)
                    for (_, expected), rows, (_, e, total) in zip(sums, (outer[:, part], inner[:, part]), (model.classes(outer[:, part]), model.in_class(inner[:, part], kind[part])), strict=True):
                        e /= total[:, None]
                        _add_expected(expected, rows, e)
        first = 0
        for seen, expected in sums if some else ():
            both = np.concatenate([seen, expected], axis=2).astype(np.float32).reshape(-1, BLOCK * 2 * seen.shape[2])
            for i in np.flatnonzero(both.any(axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([first + int(i)], pa.int32()), pa.array([both[i].tobytes()], pa.binary())], names=["block", "g"])
            first += len(both)
        _shared.release()

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, g in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = np.frombuffer(g.as_buffer(), dtype=np.float32)
            if block in sums:
                sums[block] += values
            else:
                sums[block] = values.astype(np.float64)
    for block, g in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([g.astype(np.float32).tobytes()], pa.binary())], names=["block", "g"])


def _moved(model: Model, sums: pa.Table) -> None:
    """Moves the weights by the summed counts."""
    got = dict(zip(sums.column("block").to_pylist(), sums.column("g").to_pylist(), strict=True))
    first = 0
    for name in ("weights", "inner"):
        w = getattr(model, name)
        flat = w.reshape(-1, BLOCK, w.shape[2]).astype(np.float64)
        for i in range(len(flat)):
            if first + i in got:
                g = np.frombuffer(got[first + i], dtype=np.float32).reshape(BLOCK, 2 * w.shape[2]).astype(np.float64)
                seen, expected = g[:, : w.shape[2]], g[:, w.shape[2] :]
                flat[i] += RATE * np.log(np.clip((seen + SMOOTH) / (expected + SMOOTH), 0.05, MOST))
        setattr(model, name, flat.reshape(w.shape).astype(np.float32))
        first += len(flat)


def _model(by_shape: dict[int, tuple[int, int]], key: np.ndarray, c: np.ndarray) -> Model:
    """A model of no weights: by_shape has the tokens and types of each class and shared member (the low bits of their keys);
    key, c are the head."""
    n, v = np.zeros((CLASSES, MEMBERS)), np.zeros((CLASSES, MEMBERS))
    for low, (many, types) in by_shape.items():
        n[low & 31, low >> 5], v[low & 31, low >> 5] = many, types
    tokens, types, in_class = int(n.sum()), int(v.sum()), n.sum(axis=1)
    order = np.lexsort((key, -c, key & 31))
    kind = (key & 31)[order]
    rank = np.arange(len(order)) - np.searchsorted(kind, kind)
    top = order[(rank < OWN) & (kind > 0)]  # class 0 has the end alone
    member = SHARED + rank[(rank < OWN) & (kind > 0)]
    k, slot = key[top] & 31, key[top] >> 5 & (SHARED - 1)
    np.subtract.at(n, (k, slot), c[top])
    np.subtract.at(v, (k, slot), 1)
    n[k, member], v[k, member] = c[top], 1
    mass = n + v
    mass[1:, :SHARED] += 1  # words not seen
    mass[0, int(END) >> 5 & (SHARED - 1)] = max(1.0, mass[0].sum())
    with np.errstate(divide="ignore"):
        spread, prior = np.log10(mass), np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32)
    bias = np.log((in_class + 1) / (tokens + CLASSES)).astype(np.float32)
    by_key, sorted_own = np.argsort(key), np.argsort(key[top])
    zeros = [np.zeros((FEATURES, 1 << bits, size), dtype=np.float32) for bits, size in ((BUCKET_BITS, CLASSES), (INNER_BITS, MEMBERS))]
    return Model(*zeros, bias, prior, spread, key[top][sorted_own], member[sorted_own], key[by_key], c[by_key], tokens, types)


def fit(docs: DataFrame, may_learn: Column, text_col: str = "text", id_col: str = "doc_id") -> tuple[Model, DataFrame]:
    """The model and the table (w, c) of word counts, from the documents for which may_learn holds."""
    spark = docs.sparkSession
    _shared.prepare(spark)
    learn = docs.filter(may_learn)
    text = F.col(text_col).cast("string").alias("text")
    counts = _shared.written(learn.select(text).mapInArrow(_count, "w long, n long").groupBy("w").agg(F.sum("n").alias("c")), "lm-counts")
    by_shape = {r[0]: (r[1], r[2]) for r in counts.groupBy(F.expr(f"cast(w & {int(_SHAPE)} as int)")).agg(F.sum("c"), F.count(F.lit(1))).collect()}
    # the least count of the head: as low as HEAD_WORDS allows
    # counts in bins that widen with them: the highest bins hold few words each, however large the corpus
    fine = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 384).cast("int")
    least, room = 1 << 62, HEAD_WORDS
    for _, low, many in sorted((tuple(r) for r in counts.groupBy(fine.alias("bin")).agg(F.min("c"), F.count(F.lit(1))).collect()), reverse=True):
        if many > room:
            break
        least, room = low, room - many
    got = counts.filter(F.col("c") >= least).toArrow()
    model = _model(by_shape, got.column("w").to_numpy(), got.column("c").to_numpy())
    deal = F.pmod(F.xxhash64(F.lit("round"), F.col(id_col)), F.lit(ROUNDS))
    # a task's sums are of one size however few documents it reads: two partitions a task, if that leaves one for each core
    tasks = max(1, spark.sparkContext.defaultParallelism, learn.rdd.getNumPartitions() // 2)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(replace(model, head=model.head[:0], head_counts=model.head_counts[:0]))
        part = learn.filter(deal == turn).select(text).coalesce(tasks)
        blocks = part.mapInArrow(_gradient(sent), "block int, g binary").repartition("block")
        _moved(model, blocks.mapInArrow(_sum_blocks, "block int, g binary").toArrow())
        sent.unpersist()
    return model, counts


def _score(sent):
    """Document rows (row, id, n, known, logs, rest) and rows of words beyond the head (row, null, w, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        logs = np.log10(m.head_counts + 1.0)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b, raw, off in _shared.utf8_parts(batch.column(1)):
                docs = b - a
                key, own = tokens(raw, off)
                part = m.log10_in_context(key, own)
                at = np.searchsorted(m.head, key)
                hit = (at < len(m.head)) & (m.head[np.minimum(at, len(m.head) - 1)] == key) if len(m.head) else np.zeros(len(key), bool)
                total = lambda w: np.bincount(own, weights=w, minlength=docs)
                known = np.where(hit, logs[np.minimum(at, len(logs) - 1)], 0.0) if len(logs) else np.zeros(len(key))
                rows = row + np.arange(docs)
                ids = batch.column(0).slice(a, docs)
                null = pa.nulls(docs, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows), ids, null, pa.array(np.bincount(own, minlength=docs)), pa.array(total(hit).astype(np.int64)), pa.array(total(known)), pa.array(total(part))], names=_SCORED)
                if not hit.all():
                    w, o = key[~hit], own[~hit]
                    order = np.lexsort((w, o))
                    w, o = w[order], o[order]
                    head = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])])
                    times = np.diff(np.r_[head, len(w)])
                    k = len(head)
                    yield pa.RecordBatch.from_arrays([pa.array(row + o[head]), pa.nulls(k, ids.type), pa.array(w[head]), pa.array(times), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())], names=_SCORED)
                row += docs

    return run


_SCORED = ["row", "doc_id", "w", "n", "known", "logs", "rest"]


def score(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    spark = docs.sparkSession
    _shared.prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_score(sent), f"row long, doc_id {kind}, w long, n long, known long, logs double, rest double")
    rows = _shared.written(rows, "lm-scored")
    least = int(model.head_counts.min()) if len(model.head) else 1 << 62
    rare = counts.filter(F.col("c") < least)
    found = rows.filter("w IS NOT NULL").select("row", "w", "n").join(rare, "w").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    out = rows.filter("w IS NULL").drop("w").join(found, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = logs - F.col("n") * float(np.log10(model.tokens + model.types + 1))
    return out.select("doc_id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (logs + F.col("rest")).alias("score"))
