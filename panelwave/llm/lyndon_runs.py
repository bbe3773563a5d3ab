"""Detection and removal of periodic stretches of words (runs) by Baier grouping.

A run is a stretch of words with smallest period q that no neighbouring word extends.  Its words
contain a Lyndon word of length q, a *root*, and under one of the two orders of the words (any
order and its reverse) the root is the longest Lyndon word that starts at its place.

1. *Stretches.*  In a run of at least ``exponent`` periods every short run of words (a gram) occurs
   again one period on or back.  Only stretches that repeated grams of a text cover can hold runs;
   they are found for whole slices of texts at once.
2. *Grouping.*  The first phase of the linear-time suffix sorter of Baier keeps suffixes in groups
   by their longest Lyndon prefix found so far.  Groups are taken from the highest down; each
   suffix points to the nearest one on its left that lies in a lower group, and the suffixes
   pointed at are extended by the group's prefix and move up.  The prefix lengths at the end are
   the Lyndon array: no suffix array is made.  It is done for an order and for its reverse.
3. *Extension.*  A place with the same Lyndon length at the next roots is a candidate; the longest
   common extensions of it and the place one period on, to the left and to the right, give the run.

Everything is local to a text, so the work needs no shuffle.  Words are compared as they are; hashes
only choose the stretches, and a false match there adds work, not runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwave.llm.common import WORD, by_slices
from panelwave.llm.wordscan import WORD_BASE, U, Words, mix, prefix, run_hash


def lyndon_array(ranks: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place (the end counts as smallest)."""
    n = len(ranks)
    values = sorted(set(ranks))
    at = {v: g for g, v in enumerate(values)}
    group = [-1] + [at[r] for r in ranks]  # places from 1; 0 stands before the first
    members: list[list[int]] = [[] for _ in values]
    for i in range(1, n + 1):
        members[group[i]].append(i)
    length = [1] * len(values)
    lower = list(range(-1, len(values) - 1))
    higher = list(range(1, len(values) + 1))
    higher[-1:] = [-1] if values else []
    left = list(range(n + 1))  # a place that is done leads to the nearest open one on its left
    top = len(values) - 1
    while top >= 0:
        done = [i for i in members[top] if group[i] == top]
        members[top] = []
        for i in done:
            left[i] = i - 1
        pointed: dict[int, int] = {}
        for i in done:
            j = i
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            left[i] = j
            if j:
                pointed[j] = pointed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moves.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moves, reverse=True):  # more pointers: higher
            new = len(members)
            members.append(moves[times, old])
            length.append(length[old] + times * length[top])
            above = higher[old]
            lower.append(old)
            higher.append(above)
            higher[old] = new
            if above >= 0:
                lower[above] = new
            for j in members[new]:
                group[j] = new
        top = lower[top]
    return [length[g] for g in group[1:]]


def _common(words: np.ndarray, a: int, b: int, step: int) -> int:
    """Number of equal words from places a < b on, to the right (step 1) or to the left (-1)."""
    most, size, total = (len(words) - b if step > 0 else a + 1), 16, 0
    while total < most:
        size = min(size, most - total)
        x, y = a + step * total, b + step * total
        if step > 0:
            differ = words[x : x + size] != words[y : y + size]
        else:
            differ = words[x - size + 1 : x + 1][::-1] != words[y - size + 1 : y + 1][::-1]
        if differ.any():
            return total + int(differ.argmax())
        total, size = total + size, size * 4
    return total


def find_runs(ids: Sequence[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` words and ``exponent`` periods."""
    words = np.asarray(ids, np.int64)
    n, found = len(words), set()
    for order in (words, -words):
        size = np.asarray(lyndon_array(order.tolist()), np.int64)
        at = np.arange(n)
        for k in range(1, exponent - 1):  # that many whole roots lie in a row
            at = at[at + (k + 1) * size[at] <= n]
            at = at[(size[at + k * size[at]] == size[at]) & (words[at + k * size[at]] == words[at])]
        reach: dict[int, int] = {}
        for i in at.tolist():
            q = int(size[i])
            if i + 2 * q <= reach.get(q, 0):
                continue
            right = _common(words, i, i + q, 1)
            if right < q and exponent > 2:
                continue
            back = _common(words, i - 1, i + q - 1, -1) if i else 0
            start, end = i - back, i + q + right
            reach[q] = max(reach.get(q, 0), end)
            if end - start >= max(least, exponent * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(w: Words, least: int, exponent: int) -> list[tuple[int, int]]:
    """First and last word (exclusive) of the stretches covered by grams that occur twice in their text."""
    gram = min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 1))
    at = w.windows(gram)
    if not len(at):
        return []
    h = run_hash(prefix(w.hash, WORD_BASE), at, at + gram, WORD_BASE) ^ mix(w.doc[at].astype(U) + U(1))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.doc) + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + gram] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    new = covered & np.append(True, ~covered[:-1] | (np.diff(w.doc) != 0))
    end = covered & np.append(~covered[1:] | (np.diff(w.doc) != 0), True)
    return list(zip(np.flatnonzero(new).tolist(), (np.flatnonzero(end) + 1).tolist()))


def collapse_runs(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 6, exponent: int = 4, with_text: bool = True
) -> DataFrame:
    """Runs of every text, and the text with each run reduced to its first period.

    Per row of ``docs``: doc_id, n_runs; start, length, period and exponent_milli (1000 times the
    periods, rounded down) of the longest run (ties: smallest start, then period; null without a
    run); ``runs``, an array of (start, length, period) by start, then period; collapsed_text (kept
    words joined by one space; null unless ``with_text``); runs_sha256 of the lines
    ``start,length,period`` and collapsed_sha256.  A word goes if any run has it after that run's
    first period.  Words are numbered from 0.

    A null, empty or blank text has no words and no runs, and collapses to the empty text.  Each
    row stands for itself: repeated rows and null ids are kept.  An empty table gives an empty
    result.  Columns other than the two named are not read.  Exponents below 3 make every
    word's text a stretch, which is right but slow.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods or more")
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = "doc_id n_runs start length period exponent_milli runs collapsed_text runs_sha256 collapsed_sha256".split()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def collapse(part: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(part.column("text"))
        body = w.data.tobytes()
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(w.rows)]
        for a, b in _stretches(w, least, exponent):
            row = int(w.doc[a])
            first = int(w.first[row])
            number: dict[bytes, int] = {}
            ids = [number.setdefault(body[s:e], len(number)) for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist())]
            runs[row] += [(a - first + s, n, q) for s, n, q in find_runs(ids, least, exponent)]
        best, texts, listed = [], [], []
        for r, found in enumerate(runs):
            found.sort(key=lambda x: (x[0], x[2]))
            words = body[w.offsets[r] : w.offsets[r + 1]].split()
            if found:
                edge = np.zeros(len(words) + 1, np.int64)
                for s, n, q in found:
                    edge[s + q] += 1
                    edge[s + n] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            texts.append(b" ".join(words))
            listed.append("".join(f"{s},{n},{q}\n" for s, n, q in found).encode())
            best.append(min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None)))
        kind = pa.int64()
        arrays = [
            part.column("id"),
            pa.array([len(x) for x in runs], kind),
            *[pa.array([b[k] for b in best], kind) for k in range(3)],
            pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], kind),
            pa.array([[dict(zip(("start", "length", "period"), x)) for x in found] for found in runs], pa.list_(run)),
            pa.array([x.decode("utf-8", "replace") if with_text else None for x in texts], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in listed]),
            pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    longs = ", ".join(f"{c} long" for c in names[1:6])
    schema = (
        f"doc_id {id_type}, {longs}, runs array<struct<start:long,length:long,period:long>>, "
        "collapsed_text string, runs_sha256 string, collapsed_sha256 string"
    )
    return rows.mapInArrow(by_slices(collapse, "text"), schema).withColumnRenamed("doc_id", doc_id)


def with_planted_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) where the ends of about a tenth of the texts are made periodic.

    With h = crc32 of the id in decimal digits, g = h div 10 and n words, a text with h mod 10 = 0
    has its words from a = g mod n on replaced by repeats of p = 1 + (n - a) div (3 + g mod 8)
    words.  Rows without an id, and texts without words, stay as they are.
    """
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = rows.withColumns({"chosen": F.coalesce(h % 10 == 0, F.lit(False)), "g": F.floor(h / 10).cast("long")})
    words = F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    head = F.slice("words", 1, F.col("a"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), 1, F.col("n") - F.col("a"))
    made = F.concat_ws(" ", F.concat(head, tail))
    return rows.select(F.col("doc_id").alias(doc_id), F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias(text))


def oracle() -> str:
    """DuckDB SQL for the runs of ``with_planted_runs(documents)``: equal words a period apart, as islands."""
    return r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1)))) AS h FROM documents),
e AS (SELECT row, doc_id, w, len(w) AS n, h % 10 = 0 AS chosen, h // 10 AS g FROM d),
a AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM e),
v AS (SELECT row, doc_id, n, CASE WHEN chosen AND n > 0
  THEN list_transform(range(n), lambda i: w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT) + 1]) ELSE w END AS w FROM a),
t AS (SELECT row, n, unnest(w) AS word, unnest(range(n)) AS i FROM v),
gram AS (SELECT row, n, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
  || ' ' || lead(word, 4) OVER o AS g FROM t WINDOW o AS (PARTITION BY row ORDER BY i)),
again AS (SELECT row, g FROM gram WHERE g IS NOT NULL GROUP BY row, g HAVING count(*) > 1),
twice AS (SELECT gram.* FROM gram JOIN again USING (row, g)),
same AS (SELECT x.row, x.i, y.i - x.i AS q FROM twice x JOIN twice y ON x.row = y.row AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isle AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k FROM same),
run AS (SELECT row, start, length, min(q) AS period FROM
  (SELECT row, q, min(i) AS start, count(*) + q + 4 AS length FROM isle GROUP BY row, q, k)
  WHERE length >= greatest(6, 4 * q) GROUP BY row, start, length),
r AS (SELECT row, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, {'l': -length, 's': start, 'p': period}) AS b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM run GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS body FROM t ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM v LEFT JOIN r USING (row) LEFT JOIN kept USING (row)"""
