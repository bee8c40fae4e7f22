"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

Every distinct blank-delimited word of a batch becomes a segment of one flat numpy array of symbols.  A round finds each
segment's smallest pair rank (a segmented minimum), merges its leftmost non-overlapping pairs of that rank at once, as far
as one-by-one merging would do the same, and compacts the arrays; segments without a pair drop out; it ends when no pair
remains.  A bounded per-worker table keeps the ids of words seen before.

Null and empty texts have the end id only and decode to the empty text; extra columns do not matter; repeated rows are
encoded each for itself; very long texts and words are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

MARK = "▁"
#: Words whose ids a worker keeps; beyond that the table starts anew (it is only a memo, results do not depend on it).
MEMO_WORDS = 200_000
NONE = np.int64(1 << 40)


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or train.model_type != 2 or not train.byte_fallback:
        raise ValueError("only BPE models with byte fallback, a dummy prefix and the identity normaliser are supported")
    return [(p.piece, p.score, p.type) for p in model.pieces]


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does, in numpy."""

    def __init__(self, path: str):
        pieces = read_pieces(path)
        normal = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind == 1}
        self.eos = next((i for i, (p, _, kind) in enumerate(pieces) if kind == 3 and p == "</s>"), 2)
        self.byte_ids = np.zeros(256, dtype=np.int64)
        self.out: list[bytes] = []
        self.is_byte = np.zeros(len(pieces), dtype=bool)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
                self.is_byte[i] = True
                self.out.append(bytes([int(p[3:5], 16)]))
            else:
                self.out.append(b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(MARK, " ").encode())
        order = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        self.mark_id = normal[MARK][0]
        self.runs = {len(p): i for p, (i, _) in normal.items() if p.strip(MARK) == ""}
        self.longest_run = max(self.runs)
        if any(MARK in p[1:] and p.strip(MARK) for p in normal) or len({normal[p][1] for p in normal if p.strip(MARK) == "" and len(p) > 1}) > 1:
            raise ValueError("white space pieces of this model compete with others")
        self.run_parts = [self._grown(n) for n in range(self.longest_run + 1)]
        if self.run_parts[-1] != [self.longest_run]:
            raise ValueError("runs of white space of this model do not repeat")
        left, right, merged, rank = [], [], [], []
        self.char_ids: dict[str, int] = {p: i for p, (i, _) in normal.items() if len(p) == 1}
        for p, (i, s) in normal.items():
            if p.strip(MARK) == "":
                continue
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a and b:
                    left.append(a[0])
                    right.append(b[0])
                    merged.append(i)
                    rank.append(order[s])
        self._table(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64), np.array(rank, np.int64))
        top = max(map(ord, self.char_ids)) + 1
        self.by_code = np.full(top, -1, dtype=np.int64)
        for c, i in self.char_ids.items():
            self.by_code[ord(c)] = i
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.decimal = [str(i).encode() for i in range(len(pieces))]

    def _grown(self, n: int) -> list[int]:
        """Lengths that a run of n MARKs ends in, when pairs of equal score merge leftmost first."""
        stuck: list[int] = []
        while n:
            grow, n = 1, n - 1
            while True:
                if stuck and stuck[-1] + grow in self.runs:
                    grow += stuck.pop()
                elif n and grow + 1 in self.runs:
                    grow, n = grow + 1, n - 1
                else:
                    break
            stuck.append(grow)
        return stuck

    def _table(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank: np.ndarray) -> None:
        """Open addressing: key (left, right) to (merged, rank)."""
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.merged = np.zeros(size, dtype=np.int64)
        self.rank = np.full(size, NONE, dtype=np.int64)
        key = (left << 32) | right
        at, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            slot = at[todo]
            free = self.keys[slot] == -1
            _, firsts = np.unique(slot[free], return_index=True)
            won = todo[free][firsts]
            self.keys[at[won]], self.merged[at[won]], self.rank[at[won]] = key[won], merged[won], rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; rank NONE if it is no piece."""
        rank, merged = np.full(len(left), NONE, dtype=np.int64), np.zeros(len(left), dtype=np.int64)
        key = (left << 32) | right
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(key[todo])
        while len(todo):
            have = self.keys[at]
            hit = have == key[todo]
            rank[todo[hit]], merged[todo[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            go = ~hit & (have != -1)
            todo, at = todo[go], (at[go] + 1) & (len(self.keys) - 1)
        return rank, merged

    def merge_rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sym: symbols (ids, or negative for what is no piece), seg: ascending segment numbers.  Returns the symbols, their
        segments and how many first symbols each stands for, once no pair is left."""
        place = np.arange(len(sym))
        done_sym, done_place = [], []
        rank, merged = self._pairs(sym, seg)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():  # compaction: segments without a pair are ready
                keep = np.repeat(live, size)
                done_sym.append(sym[~keep])
                done_place.append(place[~keep])
                sym, seg, place, rank, merged = sym[keep], seg[keep], place[keep], rank[keep], merged[keep]
                size, low = size[live], low[live]
                if not len(sym):
                    break
                starts = np.r_[0, np.cumsum(size)[:-1]]
            at = np.flatnonzero(rank == np.repeat(low, size))
            # leftmost non-overlapping ones: in a run of neighbouring pairs every second
            new_run = np.r_[True, np.diff(at) != 1]
            nth = np.arange(len(at)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            at = at[nth % 2 == 0]
            # one-by-one merging goes on to a pair that a merge creates if its rank is as good: stop behind that merge
            z = merged[at]
            before, after = at - 1, at + 2
            b = np.where((before >= 0) & (seg[np.maximum(before, 0)] == seg[at]), sym[np.maximum(before, 0)], -1)
            was = np.r_[False, (at[1:] - at[:-1] == 2) & (seg[at[1:]] == seg[at[:-1]])]
            b[was] = z[np.flatnonzero(was) - 1]
            last = len(sym) - 1
            a = np.where((after <= last) & (seg[np.minimum(after, last)] == seg[at]), sym[np.minimum(after, last)], -1)
            now = rank[at]
            better = np.minimum(self.pair(b, z)[0], self.pair(z, a)[0]) <= now
            if better.any():
                owner = np.searchsorted(starts, at, side="right") - 1
                count = np.cumsum(better)
                head = np.r_[True, owner[1:] != owner[:-1]]
                base = (count - better)[np.flatnonzero(head)][np.cumsum(head) - 1]
                ok = (count - better - base) == 0
                at, z = at[ok], z[ok]
            sym[at] = z
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, seg, place, rank, merged = sym[keep], seg[keep], place[keep], rank[keep], merged[keep]
            at = moved[at]
            for touched in (at, at[at > 0] - 1):
                nxt = touched + 1
                fits = nxt < len(sym)
                fits[fits] = seg[nxt[fits]] == seg[touched[fits]]
                rank[touched] = NONE
                t = touched[fits]
                rank[t], merged[t] = self.pair(sym[t], sym[t + 1])
        sym, place = np.concatenate([*done_sym, sym]), np.concatenate([*done_place, place])
        order = np.argsort(place, kind="stable")
        return sym[order], place[order], order

    def _pairs(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(sym), NONE, dtype=np.int64), np.zeros(len(sym), dtype=np.int64)
        if len(sym) > 1:
            same = np.flatnonzero(seg[1:] == seg[:-1])
            rank[same], merged[same] = self.pair(sym[same], sym[same + 1])
        return rank, merged

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each MARK + word, on its own; runs of MARK are not joined yet."""
        if not words:
            return []
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sym = np.where(codes < len(self.by_code), self.by_code[np.minimum(codes, len(self.by_code) - 1)], -1)
        sym = np.where(sym < 0, -1 - codes, sym)
        first = np.r_[0, np.cumsum(lens)[:-1]]
        # what is no piece never merges, so it ends a segment too
        cut = np.zeros(len(sym), dtype=bool)
        cut[first] = True
        odd = sym < 0
        cut[odd] = True
        cut[1:] |= odd[:-1]
        sym, place, _ = self.merge_rounds(sym, np.cumsum(cut))
        owner = np.searchsorted(first, place, side="right") - 1
        odd = np.flatnonzero(sym < 0)
        if len(odd):  # byte fallback
            raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in sym[odd].tolist()]
            times = np.ones(len(sym), dtype=np.int64)
            times[odd] = [len(x) for x in raw]
            end = np.cumsum(times)
            owner, full = np.repeat(owner, times), np.repeat(sym, times)
            fill = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            full[np.repeat(sym < 0, times)] = fill
            sym = full
            del end
        ends = np.searchsorted(owner, np.arange(len(words)), side="right")
        return np.split(sym, ends[:-1])

    def join_runs(self, ids: np.ndarray) -> np.ndarray:
        """Runs of lone MARKs become pieces of several MARKs, from the left."""
        lone = np.r_[False, ids == self.mark_id, False]
        at, end = np.flatnonzero(lone[1:] & ~lone[:-1]), np.flatnonzero(lone[:-1] & ~lone[1:])
        long = end - at > 1
        parts, done = [], 0
        for a, b in zip(at[long].tolist(), end[long].tolist(), strict=True):
            whole, rest = divmod(b - a, self.longest_run)
            parts += [ids[done:a], np.array([self.runs[n] for n in [self.longest_run] * whole + self.run_parts[rest]], dtype=ids.dtype)]
            done = b
        return np.concatenate([*parts, ids[done:]])

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """(ids with the end id, their decimals joined by one space) of each text."""
        split = [(t or "").replace(MARK, " ").split(" ") if t else None for t in texts]
        memo = self.memo
        new = list({w for ws in split if ws for w in ws if w not in memo})
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list({w for ws in split if ws for w in ws})
        at = 0
        while at < len(new):
            part, size = [], 0
            while at < len(new) and size < 400_000:
                part.append(new[at])
                size += len(new[at]) + 1
                at += 1
            for w, ids in zip(part, self.encode_words(part), strict=True):
                memo[w] = (ids.astype("<u4").tobytes(), b" ".join([self.decimal[i] for i in ids.tolist()]))
        end, end_raw = self.decimal[self.eos], np.array([self.eos], "<u4").tobytes()
        for t, ws in zip(texts, split, strict=True):
            if ws is None:
                yield np.array([self.eos], dtype=np.uint32), end
                continue
            got = [memo[w] for w in ws]
            ids = np.frombuffer(b"".join([g[0] for g in got]) + end_raw, dtype="<u4")
            if len(ws) > 1 and "" in ws:
                joined = self.join_runs(ids)
                if len(joined) != len(ids):
                    yield joined, b" ".join([self.decimal[i] for i in joined.tolist()])
                    continue
            yield ids, b" ".join([g[1] for g in got]) + b" " + end

    def encode(self, text: str | None) -> list[int]:
        return next(iter(self.encode_batch([text])))[0].tolist()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: control ids vanish, the dummy prefix's blank goes, bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, dtype=np.int64)
        out = self.out
        raw = b"".join([out[i] for i in ids.tolist()])
        shown = ids[[bool(out[i]) for i in ids[:2].tolist()].index(True)] if len(ids) and any(out[i] for i in ids[:2].tolist()) else -1
        if raw[:1] == b" " and shown >= 0 and not self.is_byte[shown] and out[shown] != out[0]:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            text, at = [], 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        text.append(raw[at : at + n].decode("utf-8"))
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    at += 1
            return "".join(text)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded text.  A single
    narrow pass; nothing is shuffled.  model_path must be readable on every executor (an installed package's file)."""
    _shared.prepare(docs.sparkSession)
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = batch.column(1)
            done = [[] for _ in fields]
            for at in range(0, len(texts), 200):
                for ids, decimals in c.encode_batch(texts.slice(at, 200).to_pylist()):
                    text = c.decode(ids)
                    row = [len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                    for x, y in zip(done, row + ([ids.astype(np.int32), text] if with_ids else []), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(done, fields, strict=True))], names=[id_col, *(f.name for f in fields)])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
