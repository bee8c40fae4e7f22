"""Document quality by a linear-chain conditional random field over lines.

Each line has numbers that describe it (character classes, word lengths, repeats) and those of the lines before and after
it; the field labels every line good or bad.  Forward-backward gives each line's probability of good; a document's quality
is their mean, weighted by line length, mapped to a probability by a logistic curve fitted on documents kept from training.
Labels are per document, so in training every line carries its document's label.

Empty and null texts are one empty line and get a score; very long texts are read whole, their lines in blocks; repeated rows are scored each for
itself; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared

#: Bound of the training sample: about so many documents of each label.
TRAIN_PER_LABEL = 1000
#: Texts of more characters are not learned from, so that the sample is bounded in bytes as well.
LONGEST_SAMPLE = 50_000
#: Lines whose features are held at a time (about 600 bytes each), and chains that are taken run by run.
BLOCK_LINES = 20_000
LONG_CHAIN = 2_000
STEPS = 150
PENALTY = 1e-3
LEAST_SCALE, FEATURE_BOUND = 0.02, 6.0
CLASSES = 10  # lower, upper, digit, blank, bar, bang, symbol, sentence mark, other ASCII, beyond ASCII


def _byte_classes() -> np.ndarray:
    c = np.full(256, 8, dtype=np.uint8)
    c[128:] = 9
    for chars, k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\r\x0b\x0c", 3), (b"|", 4), (b"!", 5), (b"#$%&*@^~<>{}[]\\+=_", 6), (b".,;:?'\"-()", 7)):
        c[list(chars)] = k
    return c


_CLASS = _byte_classes()


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document, whether an equal line of the document comes before) of each line of the texts
    raw[offsets[i]:offsets[i+1]].  Every text has a line at least."""
    docs = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(docs), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.r_[starts[1:] - 1, 0]
    last = np.r_[doc[1:] != doc[:-1], True]
    ends[last] = offsets[1:][doc[last]]
    line_hash = _shared.span_hashes(raw, starts, ends)
    key = np.lexsort((line_hash, doc))
    twin = np.zeros(len(starts), dtype=bool)
    twin[key[1:]] = (line_hash[key][1:] == line_hash[key][:-1]) & (doc[key][1:] == doc[key][:-1])
    return starts, ends, doc, twin


def _own(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, twin: np.ndarray, stop: int) -> np.ndarray:
    """What describes each of the lines raw[starts[i]:ends[i]], which follow each other; the next one begins at stop."""
    base = int(starts[0])
    raw, starts, ends = raw[base:stop], starts - base, ends - base
    n, size = len(starts), ends - starts
    kind = _CLASS[raw]
    if len(raw) > 1:  # capitals of Latin-1
        kind = kind.copy()
        kind[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)] = 1
    line_of = np.searchsorted(starts, np.arange(len(raw)), side="right") - 1 if len(raw) else np.zeros(0, np.int64)
    counts = np.bincount(line_of * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    share = counts / np.maximum(size, 1)[:, None]
    ws, we, _ = _shared.word_spans(raw, np.r_[starts, len(raw)])
    wl = line_of[ws] if len(ws) else np.zeros(0, np.int64)
    words = np.bincount(wl, minlength=n)
    chars = np.bincount(wl, weights=(we - ws), minlength=n)
    h = _shared.span_hashes(raw, ws, we) if len(ws) else np.zeros(0, np.uint64)
    again = np.zeros(len(ws), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (wl[1:] == wl[:-1])
    repeats = np.bincount(wl, weights=again, minlength=n) / np.maximum(words, 1)
    caps = (_CLASS[raw[ws]] == 1) if len(ws) else np.zeros(0, bool)
    capital = np.bincount(wl, weights=caps, minlength=n) / np.maximum(words, 1)
    odd_end = (np.isin(_CLASS[raw[we - 1]], (4, 5, 6))) if len(ws) else np.zeros(0, bool)
    odd = np.bincount(wl, weights=odd_end, minlength=n) / np.maximum(words, 1)
    uniq = np.zeros(n)
    if len(ws):
        key = np.lexsort((h, wl))
        fresh = np.r_[True, (h[key][1:] != h[key][:-1]) | (wl[key][1:] != wl[key][:-1])]
        uniq = np.bincount(wl[key], weights=fresh, minlength=n)
    variety = np.where(words > 0, uniq / np.maximum(words, 1) ** 0.9, 0)
    mean = chars / np.maximum(words, 1)
    return np.column_stack([
        share, np.log1p(size) / 6, np.minimum(mean, 30) / 10, repeats, capital, odd, variety, twin, size == 0,
        np.sqrt(share[:, 1]), np.sqrt(share[:, 4]), np.sqrt(share[:, 6]), np.sqrt(share[:, 5]), words == 1,
    ])


def line_blocks(raw: np.ndarray, offsets: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, bytes, document) of the lines, in blocks: each line's numbers and those of its neighbours in the text."""
    starts, ends, doc, twin = _lines(raw, offsets)
    size, first, last = ends - starts, np.r_[True, doc[1:] != doc[:-1]], np.r_[doc[1:] != doc[:-1], True]
    for a in range(0, len(starts), block):
        b = min(a + block, len(starts))
        lo, hi = max(a - 1, 0), min(b + 1, len(starts))
        own = _own(raw, starts[lo:hi], ends[lo:hi], twin[lo:hi], int(starts[hi]) if hi < len(starts) else len(raw))
        edge = np.zeros((1, own.shape[1]))
        before, after = np.r_[edge, own[:-1]], np.r_[own[1:], edge]
        before[first[lo:hi]], after[last[lo:hi]] = 0, 0
        rows = slice(a - lo, b - lo)
        yield np.column_stack([own[rows], before[rows], after[rows], first[a:b], last[a:b], np.ones(b - a)]), size[a:b], doc[a:b]


def line_table(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, document) of each line."""
    parts = list(line_blocks(raw, offsets, 1 << 62))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def chains(doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of documents of like length: (document numbers, line index matrix with -1 beyond a document's end)."""
    docs, starts, n = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        limit = max(8, int(n[order[at]] * 1.5))
        end = int(np.searchsorted(n[order], limit, side="right"))
        end = min(max(end, at + 1), at + 4096)
        pick = order[at:end]
        step = np.arange(int(n[pick].max()))
        yield docs[pick], np.where(step < n[pick][:, None], starts[pick][:, None] + step, -1)
        at = end


def forward_backward(unary: np.ndarray, move: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (documents, steps, 2), summed pair marginals (2, 2) and log normalisers of chains; unary: scores by line."""
    b, t = lines.shape
    real = lines >= 0
    u = np.where(real[:, :, None], unary[np.maximum(lines, 0)], 0.0)
    fwd, back = np.zeros((b, t, 2)), np.zeros((b, t, 2))
    fwd[:, 0] = u[:, 0]
    for k in range(1, t):
        step = np.logaddexp(fwd[:, k - 1, :1] + move[0], fwd[:, k - 1, 1:] + move[1]) + u[:, k]
        fwd[:, k] = np.where(real[:, k, None], step, fwd[:, k - 1])
    for k in range(t - 2, -1, -1):
        nxt = u[:, k + 1] + back[:, k + 1]
        step = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
        back[:, k] = np.where(real[:, k + 1, None], step, 0.0)
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    marg = np.exp(fwd + back - z[:, None, None]) * real[:, :, None]
    pair = np.zeros((2, 2))
    if t > 1:
        both = real[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                pair[i, j] = (np.exp(fwd[:, :-1, i] + move[i, j] + u[:, 1:, j] + back[:, 1:, j] - z[:, None]) * both).sum()
    return marg, pair, z


def _log_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices of logarithms."""
    return np.logaddexp(a[..., :, :1] + b[..., :1, :], a[..., :, 1:] + b[..., 1:, :])


def long_marginals(unary: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Marginals of one long chain, (lines, 2): products of the steps within runs of about the square root of its length, all
    runs at a time, and then from run to run."""
    n = len(unary)
    width = max(1, int(np.sqrt(n)))
    runs = -(-n // width)
    unit = np.array([[0.0, -np.inf], [-np.inf, 0.0]])
    step = np.empty((runs * width, 2, 2))
    step[:n] = move[None] + unary[:, None, :]
    step[0], step[n:] = unit, unit
    step = step.reshape(runs, width, 2, 2)
    up, down = np.empty_like(step), np.empty_like(step)
    up[:, 0], down[:, -1] = step[:, 0], unit
    for s in range(1, width):
        up[:, s] = _log_product(up[:, s - 1], step[:, s])
        down[:, -1 - s] = _log_product(step[:, -s], down[:, -s])
    enter, leave = np.empty((runs, 1, 2)), np.zeros((runs, 2, 1))
    enter[0] = unary[0]
    for r in range(1, runs):
        enter[r] = _log_product(enter[r - 1], up[r - 1, -1])
    for r in range(runs - 2, -1, -1):
        leave[r] = _log_product(_log_product(step[r + 1, 0], down[r + 1, 0]), leave[r + 1])
    fwd = _log_product(enter[:, None], up).reshape(-1, 2)[:n]
    back = _log_product(down, leave[:, None]).reshape(-1, 2)[:n]
    return np.exp(fwd + back - np.logaddexp(fwd[-1, 0], fwd[-1, 1]))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features by mean and scale, within bounds, so that what training hardly saw does not decide alone."""
    return np.clip((x - mean) / scale, -FEATURE_BOUND, FEATURE_BOUND)


@dataclass
class LineField:
    """weights: (features, 2) of the line scores, move: (2, 2) of neighbouring labels; mean and scale of the features;
    slope and shift of the logistic curve from mean marginals to scores."""

    weights: np.ndarray | None = None
    move: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0

    def good_share(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted mean probability of good lines, for each text."""
        unary, size, doc = zip(*((standard(x, self.mean, self.scale) @ self.weights, size, doc) for x, size, doc in line_blocks(raw, offsets, BLOCK_LINES)), strict=True)
        unary, size, doc = np.concatenate(unary), np.concatenate(size), np.concatenate(doc)
        w = np.maximum(size, 1).astype(np.float64)
        p = np.zeros(len(size))
        for _, lines in chains(doc):
            if lines.shape[1] > LONG_CHAIN:
                for one in lines:
                    one = one[one >= 0]
                    p[one] = long_marginals(unary[one], self.move)[:, 1]
                continue
            marg, _, _ = forward_backward(unary, self.move, lines)
            ok = lines >= 0
            p[lines[ok]] = marg[:, :, 1][ok]
        n = len(offsets) - 1
        return np.bincount(doc, weights=p * w, minlength=n) / np.bincount(doc, weights=w, minlength=n)

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offsets) - 1, 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.good_share(raw, offsets) + self.shift, -30, 30)))


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def train(texts: list[str], labels: list[int]) -> LineField:
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return LineField()
    hold = np.arange(len(texts)) % 4 == 3 if len(texts) >= 40 else np.zeros(len(texts), bool)
    fit = np.flatnonzero(~hold)
    parts = [line_table(*flat([texts[i] for i in fit[at : at + 100]])) for at in range(0, len(fit), 100)]
    x, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] + 100 * k for k, p in enumerate(parts)])
    del parts
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), LEAST_SCALE)
    mean[-1], scale[-1] = 0.0, 1.0
    x = standard(x, mean, scale)
    target = y[fit][doc]
    blocks = list(chains(doc))
    hit = np.zeros((len(doc), 2))
    hit[np.arange(len(doc)), target] = 1
    seen_pairs = np.zeros((2, 2))
    inner = doc[1:] == doc[:-1]
    np.add.at(seen_pairs, (target[:-1][inner], target[1:][inner]), 1)
    theta = np.zeros(x.shape[1] * 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = len(fit)
    for step in range(1, STEPS + 1):
        w, move = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        unary = x @ w
        p, pairs = np.zeros((len(doc), 2)), np.zeros((2, 2))
        for _, lines in blocks:
            marg, pair, _ = forward_backward(unary, move, lines)
            ok = lines >= 0
            p[lines[ok]] = marg[ok]
            pairs += pair
        grad = np.r_[(x.T @ (p - hit)).ravel(), (pairs - seen_pairs).ravel()] / total + PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field = LineField(theta[:-4].reshape(-1, 2).copy(), theta[-4:].reshape(2, 2).copy(), mean, scale)
    check = np.flatnonzero(hold) if hold.any() and len(set(y[hold].tolist())) == 2 else fit
    share = np.concatenate([field.good_share(*flat([texts[i] for i in check[at : at + 100]])) for at in range(0, len(check), 100)])
    a, b = 4.0, -2.0
    lab = y[check]
    for _ in range(400):  # logistic curve with the usual softened targets
        goal = np.where(lab == 1, (lab.sum() + 1) / (lab.sum() + 2), 1 / ((1 - lab).sum() + 2))
        p = 1 / (1 + np.exp(-(a * share + b)))
        g = p - goal
        h = p * (1 - p) + 1e-6
        hess = np.array([[(h * share * share).sum() + 1e-3, (h * share).sum()], [(h * share).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(g * share).sum(), g.sum()])
        a, b = a - 0.5 * da, b - 0.5 * db
    field.slope, field.shift = float(max(a, 0.1)), float(b)
    return field


def fit_quality(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, per_label: int = TRAIN_PER_LABEL) -> LineField:
    """Learns from a bounded sample (about per_label documents of each label).  The sample's ids, bounded likewise, are
    broadcast to the one scan that fetches their texts.  Repeated labels of a document: the lowest counts."""
    rows = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if may_learn is not None:
        rows = rows.filter(may_learn)
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = _shared.labelled_sample(rows, "quality", per_label, "quality")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= LONGEST_SAMPLE)
    got = texts.join(F.broadcast(picked), "doc_id").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(got.column("text").to_pylist(), got.column("quality").to_pylist())


def score_quality(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Adds score, under this or another name, to the columns keep (the id alone if not given), in one narrow pass.  A name
    that a kept column has raises a ValueError."""
    spark = docs.sparkSession
    _shared.prepare(spark)
    sent = spark.sparkContext.broadcast(field)
    kept = list(keep or [id_col])
    schema = _shared.with_results(docs, kept, f"{_shared.quoted(name)} double")
    text = F.col(_shared.quoted(text_col)).cast("string").alias(_shared.unused("text", kept))
    rows = docs.select(*[F.col(_shared.quoted(c)) for c in kept], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch in batches:
            got = [f.scores(raw, off) for _, _, raw, off in _shared.utf8_parts(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(np.concatenate([*got, []]))], names=[*kept, name])
        _shared.release()

    return rows.mapInArrow(run, schema)
