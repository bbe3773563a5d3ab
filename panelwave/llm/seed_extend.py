"""Removal of repeated passages by seed and extend.

A window is ``span`` consecutive words.  Every window owns one *seed*: the ``seed``-word run with
the smallest hash inside it (winnowing).  Equal windows own equal seeds at the same place, so a
window whose seed occurs only once cannot be repeated.  Successive windows of a text that own the
same seed occurrence form a *cell*; about one word in twelve starts a cell.

1. Count seeds over all documents (map-side combined) together with the smallest and the largest
   content hash of their cells, and join the seeds that occur twice or more back to their cells.
2. Extension, cheap case: all cells of a seed have the same content.  Then each window of these
   cells is repeated, and the whole cell is a repeat.
3. Extension, general case: the cells of a seed differ.  Their windows are hashed one by one,
   counted (map-side combined) and joined back.
4. Overlapping repeated windows merge into maximal repeats; their words go.

No pairs of occurrences are made: the work is linear in the number of windows whose seed is
repeated, however large a group of copies is.  Joins on seeds and windows are ordinary shuffled
joins that adaptive execution can split when one seed is very common.  Lists exist only per
document, by a hash of its id and text, and hold each place once: rows that repeat or lack an id
have lists of their own, and rows equal in both share one, so a list is bounded by one text.
Seeds, cells and windows are compared by 64-bit
hashes of their words, and so are ids with their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwave.llm.common import by_slices, cut, stored, texts_of
from panelwave.llm.wordscan import SECOND_BASE, WORD_BASE, U, Words, mix, prefix, run_hash

#: A place packs the first word and, less one, the number of windows (5 bits).
_START = 5


def _cells(w: Words, span: int, seed: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, seed hash and content hash of each cell."""
    at = w.windows(span)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U), none.astype(U)
    sums = prefix(w.hash, WORD_BASE)
    grams = np.arange(len(w.doc) - seed + 1)
    gram = run_hash(sums, grams, grams + seed, WORD_BASE)
    most = len(w.doc) - span + 1
    best, place = gram[:most].copy(), np.zeros(most, np.int8)
    for j in range(1, span - seed + 1):
        other = gram[j : j + most]
        less = other < best
        np.copyto(best, other, where=less)
        place[less] = j
    owner = at + place[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(at) != 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    first, owner = at[begin], owner[begin]
    content = run_hash(prefix(mix(w.hash), SECOND_BASE), first, first + count + span - 1, SECOND_BASE)
    content = mix(content ^ mix((owner - first).astype(U)))
    return first, count, gram[owner], content


def _pack(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << _START) | (count.astype(np.int64) - 1)


def _places(part: pa.RecordBatch, column: str, w: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First word (within the slice) and window count of the listed places of each text."""
    lists = part.column(column)
    lists = lists if isinstance(lists, pa.Array) else lists.combine_chunks()
    size = np.asarray(lists.value_lengths().fill_null(0))
    value = np.asarray(lists.flatten())
    row = np.repeat(np.arange(len(lists)), size)
    start, count = value >> _START, (value & 31) + 1
    good = start + count + span - 1 <= w.count[row]
    return w.first[:-1][row[good]] + start[good], count[good]


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U else values)


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", span: int = 35, seed: int = 12, with_text: bool = True
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (words joined by one space; null
    unless ``with_text``) and kept_sha256, after the removal of every word that a window with
    another occurrence covers.

    Each row is a document: repeated rows are copies of each other and lose their repeated words
    both.  A null or empty text has no words and keeps the empty text; a text shorter than
    ``span`` words keeps all.  A null id is kept and stands for one more id.  An empty table gives
    an empty result.  Columns other than the two named are not read.
    """
    if not 0 < seed <= span <= seed + 31:
        raise ValueError("seed must be at most span, and span at most seed + 31")
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("k"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("k", "text"))

    def cells(part: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(part.column("text"))
        first, count, h, content = _cells(w, span, seed)
        row = w.doc[first]
        key = np.asarray(part.column("key"))
        place = _pack(first - w.first[row], count)
        return pa.RecordBatch.from_arrays(
            [_column(h), _column(content), pa.array(key[row]), pa.array(place)], names=["h", "c", "key", "p"]
        )

    found = rows.mapInArrow(by_slices(cells, "text"), "h long, c long, key long, p long")
    # Small tables are written before they are joined: a join of two exchanges can be split where
    # one seed is very common, and nothing is computed twice.
    common = stored(
        found.groupBy("h")
        .agg(F.count("*").alias("n"), (F.min("c") == F.max("c")).alias("alike"))
        .where("n > 1")
        .select("h", "alike"),
        "common",
    )
    seeds = found.select("h", "key", "p").join(common, "h")
    listed = seeds.groupBy(F.col("key").alias("seed_key")).agg(
        F.collect_set(F.when(F.col("alike"), F.col("p"))).alias("whole"),
        F.collect_set(F.when(~F.col("alike"), F.col("p"))).alias("mixed"),
    )
    # The one exchange of all texts: each text meets its places.  A text without mixed cells is
    # finished there; only the others are kept with their text.
    placed = rows.join(stored(listed, "places").hint("shuffle_hash"), F.col("key") == F.col("seed_key"), "left").select(
        "k", "key", "text", "whole", "mixed"
    )
    results = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    result_schema = "n_words long, n_removed long, kept_text string, kept_sha256 string"

    def kept(part: pa.RecordBatch, lists: tuple[str, ...]) -> list[pa.Array]:
        w = Words(part.column("text"))
        edge = np.zeros(len(w.doc) + 1, np.int64)
        for column in lists:
            first, count = _places(part, column, w, span)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + count + span - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.bincount(w.doc[gone], minlength=w.rows)
        body = w.data.tobytes()
        left = []
        for r in range(w.rows):
            words = body[w.offsets[r] : w.offsets[r + 1]].split()
            if removed[r]:
                words = [words[i] for i in np.flatnonzero(~gone[w.first[r] : w.first[r + 1]])]
            left.append(b" ".join(words))
        return [
            pa.array(w.count.astype(np.int64)),
            pa.array(removed.astype(np.int64)),
            pa.array([x.decode("utf-8", "replace") if with_text else None for x in left], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in left]),
        ]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["k", "key", "text", "whole", "mixed"]
        for batch in batches:
            for part in cut(batch, "text"):
                waits = np.asarray(part.column("mixed").value_lengths().fill_null(0)) > 0
                for mask, finished in ((~waits, True), (waits, False)):
                    some = part.filter(pa.array(mask))
                    if not some.num_rows:
                        continue
                    if finished:
                        out = kept(some, ("whole",))
                        blank = [pa.nulls(some.num_rows, some.column(c).type) for c in columns[2:]]
                        arrays = [some.column("k"), some.column("key"), *blank, *out]
                    else:
                        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                        arrays = [*(some.column(c) for c in columns), *(pa.nulls(some.num_rows, t) for t in kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=columns + results)

    lists = "whole array<long>, mixed array<long>"
    halfway = placed.mapInArrow(first_pass, f"k {id_type}, key long, text string, {lists}, {result_schema}")
    halfway = stored(halfway, "halfway")
    open_texts = halfway.where("kept_sha256 is null")

    def windows(part: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(part.column("text"))
        first, count = _places(part, "mixed", w, span)
        at = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        row = w.doc[at] if len(at) else at
        key = np.asarray(part.column("key"))
        h = run_hash(prefix(mix(w.hash), SECOND_BASE), at, at + span, SECOND_BASE)
        place = _pack(at - w.first[row], np.ones(len(at), np.int64))
        return pa.RecordBatch.from_arrays([_column(h), pa.array(key[row]), pa.array(place)], names=["w", "key", "p"])

    single = open_texts.select("key", "text", "mixed").mapInArrow(by_slices(windows, "text"), "w long, key long, p long")
    again = stored(single.groupBy("w").count().where("count > 1").select("w"), "windows")
    confirmed = single.join(again, "w").groupBy(F.col("key").alias("window_key")).agg(F.collect_set("p").alias("single"))

    def finish(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("k"), *kept(part, ("whole", "single"))], names=["k", *results])

    closed = open_texts.join(confirmed.hint("shuffle_hash"), F.col("key") == F.col("window_key"), "left")
    late = closed.select("k", "text", "whole", "single").mapInArrow(by_slices(finish, "text"), f"k {id_type}, {result_schema}")
    done = halfway.where("kept_sha256 is not null").select("k", *results).unionByName(late)
    return done.select(F.col("k").alias(doc_id), *results)
