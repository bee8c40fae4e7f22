"""Language identification: averaged hashed subword embeddings and a linear softmax, trained in numpy by stochastic
gradient descent, with a temperature and a rejection threshold fitted on texts that training did not see.

A text becomes lower-case letters with single blanks between words; its subwords are all runs of two and three of those
characters, hashed into BUCKETS rows of an embedding table.  Scoring folds embedding and softmax into one table.

Null texts and texts without a letter are `und` with score 0 and rejected; very long texts are read whole; repeated rows
are scored each for itself; an empty table learns no language, so every prediction would be `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

BUCKET_BITS = 16
DIMS = 16
#: Bound of the training sample: about so many documents of each language.
TRAIN_PER_LANG = 600
#: Texts of more characters are not learned from, so that the sample is bounded in bytes as well.
LONGEST_SAMPLE = 50_000
EPOCHS = 4
RATE = 0.5
#: Share of confident, right validation texts that the threshold may reject.
REJECT_SHARE = 0.0005

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, number of subwords per text) of texts, in their order."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # lower() may change lengths, so the texts' ends are found by a count of characters after it
    sizes = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)
    owner = np.zeros(len(codes), dtype=np.int32)
    owner[ends[:-1]] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    is_letter = _letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of several other characters stands for the gap
    keep[ends] = True
    keep[0] = True
    c = np.where(is_letter, codes, np.uint32(32))[keep]
    who = owner[keep]
    mul = lambda x, k: x * np.uint32(k)
    with np.errstate(over="ignore"):
        two = mul(c[:-1], 2654435761) ^ mul(c[1:], 2246822519)
        three = mul(two[:-1], 3266489917) ^ mul(c[2:], 668265263)
        two = (mul(two ^ (two >> np.uint32(15)), 2246822519)) >> np.uint32(32 - BUCKET_BITS)
        three = (mul(three ^ (three >> np.uint32(13)), 3266489917)) >> np.uint32(32 - BUCKET_BITS)
    blank = c == 32
    ok2 = ~(blank[:-1] & blank[1:]) & (who[:-1] == who[1:])
    ok3 = ok2[:-1] & ok2[1:]
    idx = np.concatenate([two[ok2], three[ok3]]).astype(np.int32)
    own = np.concatenate([who[:-1][ok2], who[:-2][ok3]])
    order = np.argsort(own, kind="stable")
    return idx[order], np.bincount(own, minlength=len(texts))[: len(texts)]


@dataclass
class LanguageModel:
    """langs; table: (buckets, langs) logits of each subword; bias; temperature; threshold of acceptance."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        idx, n = subwords(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        some = n > 0
        if some.any():
            at = np.r_[0, np.cumsum(n)[:-1]][some]
            for k in range(len(self.langs)):
                sums[some, k] = np.add.reduceat(self.table[k][idx], at, dtype=np.float64)
        return sums / np.maximum(n, 1)[:, None] + self.bias, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, accepted) of each text."""
        has = np.fromiter((bool(t) for t in texts), bool, len(texts))
        if not self.langs or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        z, n = self.logits([t or "" for t in texts])
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        has &= n > 0
        for i in np.flatnonzero(~has & np.fromiter((bool(t) for t in texts), bool, len(texts))):
            has[i] = any(c.isalpha() for c in texts[i])
        score = np.where(has, p[np.arange(len(best)), best], 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], score, has & (score >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct subwords and their shares, for each text."""
    out = []
    for at in range(0, len(texts), 50):
        idx, n = subwords(texts[at : at + 50])
        for part in np.split(idx, np.cumsum(n)[:-1]):
            u, c = np.unique(part, return_counts=True)
            out.append((u, (c / max(1, len(part))).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], seed: int = 0) -> LanguageModel:
    """Fits embeddings and softmax on four fifths of the texts and on short cuts of them, and temperature and threshold on
    the last fifth."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel()
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(v) for v in labels])
    hold = np.arange(len(texts)) % 5 == 4
    if len(texts) < 25:
        hold[:] = False

    def cuts(which: np.ndarray) -> tuple[list[str], list[int]]:
        out, lab = [], []
        for i in which:
            words = texts[i].split()
            if len(words) > 4:
                k = int(rng.integers(2, 13))
                a = int(rng.integers(0, max(1, len(words) - k)))
                out.append(" ".join(words[a : a + k]))
                lab.append(int(y[i]))
        return out, lab

    fit = np.flatnonzero(~hold)
    short, short_y = cuts(fit)
    data, target = bags([texts[i] for i in fit] + short), np.r_[y[fit], np.array(short_y, int)]
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMS)).astype(np.float32)
    out = np.zeros((DIMS, len(langs)), dtype=np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)
    steps, done = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            u, share = data[i]
            if not len(u):
                continue
            rate = RATE * (1 - done / steps)
            done += 1
            h = share @ emb[u]
            p = softmax((h @ out + bias)[None])[0]
            p[target[i]] -= 1
            back = out @ p
            out -= rate * np.outer(h, p)
            bias -= rate * 0.1 * p
            emb[u] -= rate * 8 * np.outer(share / share.max(), back)
    model = LanguageModel(langs, np.ascontiguousarray((emb @ out).T), bias.astype(np.float64))
    check = np.flatnonzero(hold)
    if len(check):
        short, short_y = cuts(check)
        z, n = model.logits([texts[i] for i in check] + short)
        t = np.r_[y[check], np.array(short_y, int)]
        z, t = z[n > 0], t[n > 0]
        if len(t):
            grid = np.geomspace(0.05, 20, 60)
            loss = [-np.mean(np.log(softmax(z / g)[np.arange(len(t)), t] + 1e-12)) for g in grid]
            model.temperature = float(grid[int(np.argmin(loss))])
            p = softmax(z / model.temperature)
            right = p.max(axis=1)[p.argmax(axis=1) == t]
            if len(right):
                model.threshold = float(min(0.5, 0.9 * np.quantile(right, REJECT_SHARE)))
    return model


def fit_language(docs: DataFrame, may_learn=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> LanguageModel:
    """Learns from a bounded sample of docs (about per_lang rows of each language, all where there are fewer) for which the
    condition may_learn holds and text and language are there."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= LONGEST_SAMPLE))
    if may_learn is not None:
        rows = rows.filter(may_learn)
    got = _shared.labelled_sample(rows, "lang", per_lang, "language").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(got.column("text").to_pylist(), got.column("lang").to_pylist())


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """Adds lang_pred, score and accepted, under these or other names, to the columns keep (the id alone if not given).  One
    narrow pass; the model is a fixed-size broadcast.  Names that kept columns have raise a ValueError."""
    spark = docs.sparkSession
    _shared.prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = list(keep or [id_col])
    schema = _shared.with_results(docs, kept, "{} string, {} double, {} boolean".format(*map(_shared.quoted, names)))
    text = F.col(_shared.quoted(text_col)).cast("string").alias(_shared.unused("text", kept))
    rows = docs.select(*[F.col(_shared.quoted(c)) for c in kept], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(len(kept))
            langs, scores, oks = [], [], []
            for a, b, _, _ in _shared.utf8_parts(texts):
                got = m.predict(texts.slice(a, b - a).to_pylist())
                langs += got[0]
                scores.append(got[1])
                oks.append(got[2])
            cols = [batch.column(i) for i in range(len(kept))]
            cols += [pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, []])), pa.array(np.concatenate([*oks, []]).astype(bool))]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *names])
        _shared.release()

    return rows.mapInArrow(run, schema)
