"""Packing documents into token sequences of a fixed capacity: dominance reduction after Martello and Toth, then best fit.

Pieces of equal length are interchangeable, so the instance is the count of each length, at most `capacity` numbers.  On
these the reduction fixes a full sequence, a piece that nothing fits beside, a pair that fills a sequence, and a pair
that dominates every other set with its larger piece; whole counts are fixed at a time.  What remains is packed by best fit
in descending length.  The result is a list of patterns, each with how many sequences repeat it; pieces get their places by
their rank among the pieces of their length, from ranks within each task's rows and counts by task.  So only counts reach
the driver, and no task sees more than its own rows.

Null and empty texts are one piece of the end id; repeated rows and ids are packed each for itself; very long texts are cut
into pieces of the capacity; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared

CAPACITY = 2048
#: Chunks whose ids a worker keeps in each of two generations, about 150 bytes each.
MEMO_CHUNKS = 250_000
#: Letters below this code point are their own composed form and have plain lower case (or one that is no letter).
_LATIN_END = "\u0250"
_MARKS = ".,!?;:#$%&*\"()-|"
#: Bytes of text that are taken apart together: the more, the fewer look-ups of the same word.
PART_BYTES = 2 << 20


#: What a byte is: part of a Latin letter (U+00C0 to U+023F, but for what _NOT_PLAIN has), a mark, or neither.
_OTHER, _LETTER, _MARK, _LEAD, _TRAIL = range(5)
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[ord(m) for m in _MARKS]] = _MARK
_KIND[0xC3:0xC9], _KIND[0x80:0xC0] = _LEAD, _TRAIL
#: The signs of multiplication and division, and the I whose lower case ends in a combining dot.
_NOT_PLAIN = [c.encode() for c in "\u00d7\u00f7\u0130"]


def _parts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words raw[starts:ends] taken apart, without the white space between: bytes, offsets, owners.  Letters go in lower
    case (A to Z) and apart from the marks around them, if a word has nothing else; other words stay whole and as they are."""
    kind = _KIND[raw]
    trail = np.zeros(len(raw), dtype=bool)
    trail[1:] = (kind[1:] == _TRAIL) & (kind[:-1] == _LEAD)
    letter = (kind == _LETTER) | (kind == _LEAD) | trail
    for lead, last in _NOT_PLAIN:
        at = np.flatnonzero(raw[1:] == last)
        at = at[raw[at] == lead]
        letter[at] = letter[at + 1] = False
    # bounds of runs of letters, which white space and other bytes end
    edge = np.diff(np.r_[False, letter, False].view(np.int8))
    begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    neither = np.flatnonzero(~letter & (kind != _MARK) & ~_shared.IS_SPACE[raw])
    runs = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
    plain = (np.searchsorted(neither, starts) == np.searchsorted(neither, ends)) & (runs[1] - runs[0] == 1)
    begins, stops = begins[runs[0][plain]], stops[runs[0][plain]]
    bound = np.zeros(len(raw) + 1, dtype=bool)
    bound[starts] = bound[begins] = True
    bound[stops[stops < ends[plain]]] = True
    first = np.flatnonzero(bound)
    word = np.searchsorted(starts, first, side="right") - 1
    size = np.minimum(np.r_[first[1:], len(raw)], ends[word]) - first
    lower = np.zeros(len(raw) + 1, dtype=np.int8)
    lower[begins], lower[stops] = 1, -1
    low = np.cumsum(lower[:-1], dtype=np.int8).view(bool)
    return np.where(low, _shared.LOWER[raw], raw)[~_shared.IS_SPACE[raw]], np.r_[0, np.cumsum(size)], owner[word]


class WordTokens:
    """Token ids of texts by a tokenizer whose tokens never span white space; words seen before come from a memo."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.closes[i] = token.endswith("</w>")
        self.raw: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _look_up(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of each of parts; words of letters and runs of marks, which are one word each to the tokenizer, go together."""
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            raw, first = ids.tobytes(), 0
            if len(ends) != len(some):
                raise ValueError("a word of the tokenizer ends in more than one token")
            for end in (ends * 4).tolist():
                yield raw[first:end]
                first = end

    def _learn(self, chunks: set[str]) -> None:
        """Fills the memo for chunks; plain Latin words and runs of marks are looked up many at a time."""
        if len(self.raw) > MEMO_CHUNKS:
            self.old, self.raw = self.raw, {"": b""}
        raw, old = self.raw, self.old
        plain: list[str] = []
        odd: list[str] = []
        for c in chunks:
            have = old.get(c)
            if have is not None:
                raw[c] = have
            elif c.isalpha() and (c.isascii() or max(c) < _LATIN_END and c.lower().isalpha()) or not c.strip(_MARKS):
                plain.append(c)
            else:
                odd.append(c)
        raw.update(zip(plain, self._look_up(plain), strict=True))
        for c, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            raw[c] = np.array(e.ids, dtype="<u4").tobytes()

    def ids(self, raw: np.ndarray, offsets: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts raw[offsets[i]:offsets[i+1]], each with an end id, in one array, and where each text ends.
        Arrow gives words and the marks around them numbers; only distinct ones are looked up one by one."""
        chunks, ends, owner = _shared.word_spans(raw, offsets)
        docs = len(offsets) - 1
        if not len(chunks):
            return np.full(docs, end_id, dtype="<u4"), np.arange(1, docs + 1)
        text, first, owner = _parts(raw, chunks, ends, owner)
        words = pa.LargeStringArray.from_buffers(len(owner), pa.py_buffer(first), pa.py_buffer(text))
        coded = words.dictionary_encode()
        number = coded.indices.to_numpy()
        distinct = coded.dictionary.to_pylist()
        seen = set(distinct)
        new = seen.difference(self.raw)
        if new:
            self._learn(seen if len(self.raw) + len(new) > MEMO_CHUNKS else new)
        found = list(map(self.raw.__getitem__, distinct))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, first = np.frombuffer(b"".join(found), dtype="<u4"), np.r_[0, np.cumsum(size)[:-1]]
        each = size[number]
        ends = np.cumsum(each)
        # each word's ids begin behind those of all words before it and the end ids of all texts before its own
        by_text = np.searchsorted(owner, np.arange(docs + 1))
        text_ends = np.r_[0, ends][by_text[1:]] + np.arange(1, docs + 1)
        out = np.full(int(text_ends[-1]), end_id, dtype="<u4")
        take = np.arange(int(ends[-1])) + np.repeat(first[number] - (ends - each), each)
        inside = np.ones(len(out), dtype=bool)
        inside[text_ends - 1] = False
        out[inside] = pool[take]
        return out, text_ends


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


# ---------------------------------------------------------------- the instance: counts of lengths

Pattern = tuple[tuple[int, ...], int]


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello-Toth reduction: (fixed patterns with their numbers, what remains)."""
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[Pattern] = []
    lengths = sorted(left)

    def smallest(k: int, without: int) -> list[int] | None:
        """The k smallest pieces besides one of length without."""
        out: list[int] = []
        for n in lengths:
            c = left.get(n, 0) - (n == without)
            if c > 0:
                out += [n] * min(c, k - len(out))
            if len(out) == k:
                return out
        return None

    for j in reversed(lengths):
        while left.get(j, 0):
            room = capacity - j
            low = smallest(3, j)
            one = low or smallest(2, j) or smallest(1, j) or []
            if not one or one[0] > room:  # nothing fits beside it
                fixed.append(((j,), left.pop(j)))
                break
            at = bisect_left(lengths, room + 1) - 1
            while at >= 0 and left.get(lengths[at], 0) - (lengths[at] == j) <= 0:
                at -= 1
            i = lengths[at]
            if i < room:
                pair_only = low is None or sum(low) > room
                single_only = len(one) < 2 or one[0] + one[1] > room
                if not single_only and not (pair_only and _best_pair(left, lengths, j, room) <= i):
                    break  # no dominating set is known: leave it to best fit
                # the set may rest on pieces that are few now; fix one at a time unless only one other piece ever fits
                times = min(left[j], left[i]) if single_only and i != j else left[j] // 2 if single_only else 1
            else:
                times = min(left[j], left[i]) if i != j else left[j] // 2
            times = max(1, times)
            fixed.append(((j, i), times))
            for n in (j, i):
                left[n] -= times
            for n in {j, i}:
                if left[n] <= 0:
                    del left[n]
    return fixed, left


def _best_pair(left: dict[int, int], lengths: list[int], without: int, room: int) -> int:
    """The largest sum of two pieces besides one of length without that fits the room; 0 if none does."""
    have = [n for n in lengths if n < room and left.get(n, 0) - (n == without) > 0]
    best, a, b = 0, 0, len(have) - 1
    while a <= b:
        s = have[a] + have[b]
        if s > room or (a == b and left[have[a]] - (have[a] == without) < 2):
            b -= 1
        else:
            best = max(best, s)
            a += 1
    return best


def best_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in descending length, with all pieces of a length and all sequences of like room at a time."""
    rooms: dict[int, list[list]] = defaultdict(list)  # room -> [pieces, number]
    keys: list[int] = []  # rooms that occur, ascending

    def put(room: int, pieces: tuple[int, ...], number: int) -> None:
        at = bisect_left(keys, room)
        if at == len(keys) or keys[at] != room:
            keys.insert(at, room)
        for have in rooms[room]:
            if have[0] == pieces:
                have[1] += number
                return
        rooms[room].append([pieces, number])

    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            at = bisect_left(keys, n)
            if at == len(keys):
                each = capacity // n
                if c >= each:
                    put(capacity - each * n, (n,) * each, c // each)
                if c % each:
                    put(capacity - (c % each) * n, (n,) * (c % each), 1)
                break
            room = keys[at]
            pieces, number = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(at)
            each = min(room // n, c)
            full = min(number, c // each)
            put(room - each * n, pieces + (n,) * each, full)
            if number > full:
                put(room, pieces, number - full)
            c -= full * each
    return [(pieces, number) for got in rooms.values() for pieces, number in got]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce_counts(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]]:
    """For each length: first ranks of its runs, their first sequences, pieces of it in a sequence, and their offsets."""
    runs: dict[int, list[tuple[int, int, int, list[int]]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pieces, number in patterns:
        at, offsets = 0, defaultdict(list)
        for n in pieces:
            offsets[n].append(at)
            at += n
        for n, offs in offsets.items():
            runs[n].append((used[n], sequence, len(offs), offs))
            used[n] += number * len(offs)
        sequence += number
    return {n: (np.array([r[0] for r in got]), np.array([r[1] for r in got]), np.array([r[2] for r in got]), [r[3] for r in got]) for n, got in runs.items()}


# ---------------------------------------------------------------- DataFrames


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the task and rank (among its pieces of that length) in
    which it was cut."""
    _shared.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = word_tokens(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for a, b, raw, off in _shared.utf8_parts(batch.column(1), PART_BYTES):
                ids, ends = words.ids(raw, off)
                begins = np.r_[0, ends[:-1]]
                pieces = -(-(ends - begins) // capacity)
                of = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, (ends - begins)[of] - start)
                at, data = (begins[of] + start) * 4, memoryview(ids).cast("B")
                crc = np.fromiter((zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + length * 4).tolist(), strict=True)), np.int64, len(of))
                order = np.argsort(length, kind="stable")
                same = length[order]
                rank = np.empty(len(of), dtype=np.int64)
                rank[order] = np.arange(len(of)) - np.searchsorted(same, same) + seen[same]
                seen += np.bincount(length, minlength=capacity + 1)
                cols = [batch.column(0).slice(a, b - a).take(pa.array(of)), pa.array(piece.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (start, length, crc)), pa.array(np.full(len(of), task, dtype=np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
        _shared.release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives each piece its sequence_id and offset.  pieces: as from cut_documents, written (its tasks must not be dealt
    anew)."""
    spark = pieces.sparkSession
    by_task = _shared.written(pieces.groupBy("task", "length").count(), "packing-counts")
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("count")).collect()}
    sent = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = by_task.select("task", "length", before.alias("first"))
    ranked = pieces.join(first, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = sent.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(part):
                    continue
                starts, seqs, each, offs = where[int(length[part[0]])]
                at = np.searchsorted(starts, rank[part], side="right") - 1
                inside = rank[part] - starts[at]
                sequence[part] = seqs[at] + inside // each[at]
                offset[part] = [offs[a][b] for a, b in zip(at.tolist(), (inside % each[at]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(_shared.written(cut_documents(docs, tokenizer_path, capacity), "packing-pieces"), capacity)
