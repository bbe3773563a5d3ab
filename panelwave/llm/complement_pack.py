"""Packing of tokenised documents into sequences of a fixed length.

Tokens.  Texts are cut in front of every space between two visible characters, where the
tokenizer's own splitting always starts a new piece, so a text's ids are the ids of its chunks one
after the other.  A special token's string either is that token's id, as the tokenizer has it by
default, or is split like other text (``special_as_text``); it holds no space, so a cut never
falls inside it.  Each task encodes every distinct chunk once, keeps the ids in a bounded cache
and gathers them with numpy.

Plan.  Only the number of pieces of each length matters, at most ``limit`` counts.  Going down
from the longest length, the gap that a piece leaves is looked up among single lengths, sums of two
and sums of three lengths that are still available, and as many sequences as the counts allow are
closed at once with that combination.  What has no exact complement is packed best-fit, longest
first.  The plan is a list of length patterns with counts, bounded by ``limit`` too.

Assignment.  The pieces of a length are ranked (in salted groups, so one common length is spread
over many tasks) and a piece's rank says which pattern slot it fills.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwave.llm.common import by_slices, stored, texts_of
from panelwave.llm.wordscan import _TABLE, BYTE_BASE, U, prefix, run_hash

Pattern = tuple[int, ...]

# ---------------------------------------------------------------------------------------- tokens


class ChunkTokenizer:
    """Ids of many texts by way of their distinct chunks."""

    def __init__(self, path: str, cached: int = 1_500_000, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.cached = cached
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.width[i] = len(piece)  # byte-level pieces have one character for a byte
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, U)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Add chunks (sorted by hash, none of them known) to the cache."""
        long = np.array([len(c) for c in chunks], np.int64)
        joins = np.array([c[0] == 0x20 and 0x20 < c[-1] < 0x7F for c in chunks], bool)
        plain, other = np.flatnonzero(joins), np.flatnonzero(~joins)
        parts, sizes = [], []
        for some in (plain[i : i + 512] for i in range(0, len(plain), 512)):
            got = np.array(self._encode([b"".join([chunks[i] for i in some.tolist()]).decode()])[0], np.uint32)
            cuts = np.searchsorted(np.cumsum(self.width[got]), np.cumsum(long[some])) + 1
            cuts[-1] = len(got)
            parts.append(got), sizes.append(np.diff(cuts, prepend=0))
        lists = self._encode([chunks[i].decode("utf-8", "replace") for i in other.tolist()])
        parts += [np.array([x for part in lists for x in part], np.uint32)]
        sizes += [np.array([len(part) for part in lists], np.int64)]
        # back into the order of the chunks
        order, each = np.append(plain, other), np.concatenate(sizes)
        size, begin = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        size[order], begin[order] = each, np.cumsum(each) - each
        ids = np.concatenate(parts)[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        if len(self.known) + len(chunks) > self.cached:
            self._reset()
        place = np.searchsorted(self.known, hashes)
        sizes = np.insert(np.diff(self.at), place, size)
        self.ids = np.insert(self.ids, np.repeat(self.at[place], size), ids)
        self.known = np.insert(self.known, place, hashes)
        self.at = np.append(0, np.cumsum(sizes))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by id 0, and the offset of each text."""
        text = texts_of(column)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        start = np.union1d(_boundaries(data), offsets[:-1])
        start = start[start < len(data)]
        end = np.append(start[1:], len(data))
        h = run_hash(prefix(_TABLE[data], BYTE_BASE), start, end, BYTE_BASE)
        distinct, first, which = _distinct(h)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            new = self.known[near] != distinct
        if new.any():
            body = data.tobytes()
            if len(self.known) + new.sum() > self.cached:
                self._reset()
                new[:] = True
            self._learn(distinct[new], [body[start[i] : end[i]] for i in first[new]])
        place = np.searchsorted(self.known, distinct)[which]
        size = self.at[place + 1] - self.at[place]
        total = np.append(0, np.cumsum(size))
        row_of = np.searchsorted(offsets, start, side="right") - 1
        out = np.zeros(total[-1] + len(text), np.uint32)
        moved = np.repeat(row_of, size)  # every earlier text has its id 0
        source = np.repeat(self.at[place] - total[:-1], size) + np.arange(total[-1])
        out[np.arange(total[-1]) + moved] = self.ids[source]
        counts = np.bincount(row_of, size, minlength=len(text)).astype(np.int64) + 1
        return out, np.append(0, np.cumsum(counts))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the first place of each, and which of them every value is."""
    coded = pa.array(values).dictionary_encode()
    seen, which = np.asarray(coded.dictionary), np.asarray(coded.indices)  # in order of appearance
    first = np.empty(len(seen), np.int64)
    first[which[::-1]] = np.arange(len(values))[::-1]
    order = np.argsort(seen)
    rank = np.empty(len(seen), np.int64)
    rank[order] = np.arange(len(seen))
    return seen[order], first[order], rank[which]


def _boundaries(data: np.ndarray) -> np.ndarray:
    """Places of spaces between two characters that are certainly visible.

    Characters whose first byte can start a space outside ASCII never border a cut."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, after = data[at - 1], data[at + 1]
    good = (before > 0x20) & (after > 0x20) & ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))
    wide = before >= 0x80
    good &= ~(wide & (data[np.maximum(at - 2, 0)] == 0xC2))
    good &= ~(wide & np.isin(data[np.maximum(at - 3, 0)], (0xE1, 0xE2, 0xE3)))
    return at[good]


_TOKENIZERS: dict[tuple[str, int, bool], ChunkTokenizer] = {}


def tokenizer(path: str, cached: int = 1_500_000, special_as_text: bool = True) -> ChunkTokenizer:
    """One for each worker process, kept between tasks."""
    key = (path, cached, special_as_text)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = ChunkTokenizer(*key)
    return _TOKENIZERS[key]


# ------------------------------------------------------------------------------------------ plan


def _single(gap: int, left: np.ndarray) -> Pattern | None:
    return (gap,) if gap > 0 and left[gap] else None


def _pair(gap: int, left: np.ndarray, most: int | None = None) -> Pattern | None:
    """Two available lengths with this sum, the longer one as long as possible (at most ``most``)."""
    if gap < 2:
        return None
    low = np.arange(max(1, gap - (most or gap)), gap // 2 + 1)
    fits = np.flatnonzero((left[low] > 0) & (left[gap - low] > 0) & ((2 * low != gap) | (left[low] > 1)))
    return (int(gap - low[fits[0]]), int(low[fits[0]])) if len(fits) else None


def _triple(gap: int, left: np.ndarray) -> Pattern | None:
    for longest in np.flatnonzero(left[: max(gap - 1, 1)])[::-1].tolist():
        if 3 * longest < gap:
            return None
        left[longest] -= 1
        rest = _pair(gap - longest, left, longest)
        left[longest] += 1
        if rest:
            return (longest, *rest)
    return None


def plan(counts: dict[int, int], limit: int) -> list[tuple[Pattern, int]]:
    """Length patterns with counts that place every piece: exact complements, then best fit."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[Pattern, int]] = []
    residual: list[tuple[int, int]] = []
    for length in range(limit, 0, -1):
        while left[length]:
            gap = limit - length
            left[length] -= 1
            fill = () if gap == 0 else _single(gap, left) or _pair(gap, left) or _triple(gap, left)
            left[length] += 1
            if fill is None:
                residual.append((length, int(left[length])))
                left[length] = 0
                break
            pattern = (length, *fill)
            times = int(min(left[x] // n for x, n in Counter(pattern).items()))
            for x in pattern:
                left[x] -= times
            out.append((pattern, times))
    return out + _best_fit(residual, limit)


def _best_fit(residual: list[tuple[int, int]], limit: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first; equal pieces and equal gaps are handled together."""
    bins: dict[int, Counter[Pattern]] = defaultdict(Counter)
    for length, n in residual:
        while n:
            gap = min((g for g in bins if g >= length and bins[g]), default=0)
            if not gap:
                each = min(limit // length, n)
                full, rest = divmod(n, each)
                bins[limit - each * length][(length,) * each] += full
                if rest:
                    bins[limit - rest * length][(length,) * rest] += 1
                break
            pattern, available = next(iter(bins[gap].items()))
            take = min(n, available)
            bins[gap][pattern] -= take
            if not bins[gap][pattern]:
                del bins[gap][pattern]
            bins[gap - length][(*pattern, length)] += take
            n -= take
    return [(p, n) for group in bins.values() for p, n in group.items() if n]


def slots(patterns: list[tuple[Pattern, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first rank), first sequence and offset of each pattern slot."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append(((length << 44) + used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    key, first, offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return key, first, offset


# -------------------------------------------------------------------------------------- operator


#: Bytes of pieces that one ranking task takes, about.
_RANK_BYTES = 64 << 20


def pack(
    docs: DataFrame,
    path: str,
    text: str = "text",
    doc_id: str = "doc_id",
    limit: int = 2048,
    with_ids: bool = False,
    special_as_text: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its text's ids and id 0.  The string of a special token becomes that token's id
    unless ``special_as_text``.  Longer ones are cut, the first piece taking the odd
    rest.  A null text counts as empty and makes a piece of one id.  Repeated rows are packed as
    often as they occur; a null id stays null.  An empty table gives an empty result.  Only the
    two named columns are read.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, offset = tokenizer(path, special_as_text=special_as_text).encode(part.column("text"))
        length = np.diff(offset)
        pieces = -(-length // limit)
        row = np.repeat(np.arange(len(length)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(pieces)[:-1]), pieces)
        odd = length - limit * (pieces - 1)
        start = np.where(piece == 0, 0, odd[row] + limit * (piece - 1))
        size = np.where(piece == 0, odd[row], limit)
        begin = offset[row] + start
        crc = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(begin.tolist(), size.tolist())]
        lists = [ids[a : a + n].astype(np.int32) for a, n in zip(begin.tolist(), size.tolist())] if with_ids else [None] * len(row)
        arrays = [
            part.column("doc_id").take(pa.array(row)),
            pa.array(piece.astype(np.int32)),
            pa.array(start.astype(np.int64)),
            pa.array(size.astype(np.int64)),
            pa.array(crc, pa.int64()),
            pa.array(lists, pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, ids array<int>"
    # A row number in the hash spreads equal rows; it is written with the pieces, so it stays.
    spread = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    pieces = stored(rows.mapInArrow(by_slices(cut, "text"), schema).withColumn("spread", spread), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `limit` rows
    key, first, offset = slots(plan(counts, limit))

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = sum(n * (100 + (4 * length if with_ids else 0)) for length, n in counts.items())
    salts = max(parts, weight // _RANK_BYTES + 1)
    salted = pieces.withColumn("salt", F.pmod("spread", F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .count()
        .withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count"))
        .select("length", "salt", "base")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = (
        salted.repartition(salts, "length", "salt")
        .withColumn("nth", F.row_number().over(within) - 1)
        .join(before, ["length", "salt"])
        .withColumn("key", F.shiftleft("length", 44) + F.col("base") + F.col("nth"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "key")
    )

    def place(batches):
        for batch in batches:
            k = np.asarray(batch.column("key"))
            at = np.searchsorted(key, k, side="right") - 1
            arrays = [*batch.columns[:-1], pa.array(first[at] + k - key[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
    out = placed.withColumnRenamed("doc_id", doc_id)
    return out if with_ids else out.drop("ids")
