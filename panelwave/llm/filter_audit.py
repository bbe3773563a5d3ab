"""Audit of the interaction of document filters with decision diagrams.

Which documents a filter removes depends on the filters before it.  Every document has a mask of
the filters that it fails; per part of the corpus there are at most ``2**filters`` masks, so Spark
counts them (map-side combined) and one small diagram per part holds all that an audit needs.

A diagram has one level per filter.  A node leads to the node of the documents that pass the
filter of its level and to the node of those that fail it, equal nodes are shared, and each node
carries the summed weights of its documents.  Swapping two neighbouring levels rewrites the nodes
of these two levels alone; a walk of such swaps visits every order of the filters.  In each order
the path of passes from the root gives the steps: the pass side is what the step keeps, the fail
side what it removes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwave.llm.common import WORD, stored

#: Weights of a document: one, whether it is labelled good, whether it is labelled toxic.
WEIGHTS = ("n", "good", "toxic")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


class _Node:
    __slots__ = ("passed", "failed", "total")

    def __init__(self, passed: _Node | None, failed: _Node | None, total: tuple[int, ...]):
        self.passed, self.failed, self.total = passed, failed, total


class Diagram:
    """Count-weighted decision diagram of the failure masks of one part.

    ``counts`` maps a mask (bit i is set where filter i fails) to its weights.  ``order`` is the
    filter of each level, ``levels`` the nodes of each level by their pass and fail sides.
    """

    def __init__(self, counts: Mapping[int, tuple[int, ...]], filters: int):
        self.order = list(range(filters))
        self.levels: list[dict[tuple[int, int], _Node]] = [{} for _ in range(filters)]
        self.leaves: dict[tuple[int, ...], _Node] = {}
        zero = (0,) * len(next(iter(counts.values()), ()))
        row = []
        for place in range(1 << filters):  # the first filter is the highest bit of a place
            mask = sum(1 << f for f in range(filters) if place >> (filters - 1 - f) & 1)
            total = tuple(counts.get(mask, zero))
            row.append(self.leaves.setdefault(total, _Node(None, None, total)))
        for level in reversed(range(filters)):
            row = [self._node(level, row[i], row[i + 1]) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _node(self, level: int, passed: _Node, failed: _Node) -> _Node:
        key = id(passed), id(failed)
        if key not in self.levels[level]:
            total = tuple(a + b for a, b in zip(passed.total, failed.total))
            self.levels[level][key] = _Node(passed, failed, total)
        return self.levels[level][key]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next level."""
        upper = list(self.levels[level].values())
        self.levels[level], self.levels[level + 1] = {}, {}
        for node in upper:  # a node stays what it is to the levels above
            a, b = node.passed, node.failed
            node.passed = self._node(level + 1, a.passed, b.passed)
            node.failed = self._node(level + 1, a.failed, b.failed)
        self.levels[level] = {(id(n.passed), id(n.failed)): n for n in upper}
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """Filter, weights kept and weights removed of each step of the present order."""
        node = self.root
        for f in self.order:
            yield f, node.passed.total, node.failed.total
            node = node.passed


def adjacent_swaps(size: int) -> list[int]:
    """Levels to swap, one after the other, to meet every order of ``size`` filters once."""
    if size < 2:
        return []
    out: list[int] = []
    down = True
    for inner in [*adjacent_swaps(size - 1), None]:  # the last filter sweeps through each order of the others
        out += range(size - 2, -1, -1) if down else range(size - 1)
        if inner is not None:
            out.append(inner + 1 if down else inner)
        down = not down
    return out


def audit_part(part: str, counts: Mapping[int, tuple[int, int, int]], names: Sequence[str]) -> list[tuple]:
    """Rows of the audit of one part, every order and step."""
    size = len(names)
    diagram = Diagram(counts, size)
    fails = [sum(w[0] for m, w in counts.items() if m >> f & 1) for f in range(size)]
    only = [counts.get(1 << f, (0,))[0] for f in range(size)]
    shapley, rows = [0] * size, []
    for level in [None, *adjacent_swaps(size)]:
        if level is not None:
            diagram.swap(level)
        order = "".join(names[f] for f in diagram.order)
        for step, (f, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[f] += removed[0]
            rows.append((order, step, f, kept[0], removed[0], fails[f] - removed[0], only[f], removed[1], removed[2]))
    return [(part, o, s, *rest, shapley[f]) for o, s, f, *rest in rows]


def interaction_audit(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, from rows (part, mask, n, good, toxic).

    Columns: part, filter_order, step (from 1), kept (documents after the step), removed (here),
    redundant (failing this filter but removed before), unique_fails (failing this filter alone),
    good_lost and toxic_lost (labelled documents removed here) and shapley (what the filter
    removes, summed over all orders).  ``names`` are one letter each, for the bits of ``mask``
    from the lowest; there are ``filters!`` orders, so at most six filters are taken.

    Rows of equal part and mask add up.  A null part is the empty string.  Each part that has a
    row gets all its rows, zeros included; an empty table gives an empty result.
    """
    if not 1 <= len(names) <= 6:
        raise ValueError("between one and six filters")
    part = F.coalesce(F.col("part"), F.lit("")).alias("part")
    counts = masks.groupBy(part, "mask").agg(*[F.sum(w).alias(w) for w in WEIGHTS])
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("masks"))  # 2**filters at most

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counted = {m["mask"]: tuple(m[w] for w in WEIGHTS) for m in row["masks"]}
                columns = zip(*audit_part(row["part"], counted, names))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _STEPS.split(", ")])

    return per_part.mapInArrow(audit, _STEPS)


def _text_rules(text: Column, words: Column) -> list[Column]:
    """Failure conditions on a text alone, for filters A to D."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return [
        n < 50,
        100 * F.size(F.array_distinct(words)) < 65 * n,
        100 * capitals > 5 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def failure_masks(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source"
) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters.

    The filters, from the lowest bit: A fewer than 50 words; B distinct words under 65 % of the
    words; C capitals A-Z over 5 % of the code points; D any of ``#$%&*|``; E the same text as a
    document with a smaller id, anywhere in the table.

    A null text is empty.  Rows without an id fail E never and count for no other row; rows that
    repeat an id with its text are no smaller than each other.  A document is good (toxic) if any
    label row of its id says 1.  Empty tables give an empty result.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    read = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("text")
    ).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(_text_rules(F.col("text"), F.col("words")))]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    # One pass over the texts; the joins below move 32 bytes of a text's digest.
    rows = stored(read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask.alias("mask")), "masks")
    least = rows.where("id is not null").groupBy(F.col("key").alias("first_key")).agg(F.min("id").alias("first_id"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # Rows without an id have no partner; the second key spreads them over the tasks.
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("key")).otherwise(0))
    told = told.withColumn("no_spread", F.lit(0).cast("long"))
    known = rows.join(told, (rows["id"] == told["label_id"]) & (rows["spread"] == told["no_spread"]), "left")
    judged = known.join(least, (known["key"] == least["first_key"]) & (known["id"] == least["first_id"]), "left")
    again = F.col("id").isNotNull() & F.col("first_id").isNull()
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(w, F.lit(0))).alias(w) for w in ("good", "toxic")]]
    return judged.groupBy("part", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask")).agg(*sums)


def oracle() -> str:
    """DuckDB SQL for ``interaction_audit(failure_masks(documents, labels), "ABCDE")``."""
    return r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w JOIN m USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a JOIN x b ON b.v <> a.v JOIN x c ON c.v NOT IN (a.v, b.v)
  JOIN x d ON d.v NOT IN (a.v, b.v, c.v) JOIN x e ON e.v NOT IN (a.v, b.v, c.v, d.v)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS v, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, v, n, good, toxic, fails, contains(fails, v) AS bad,
  length(translate(before, fails, '')) < length(before) AS gone FROM c, s),
t AS (SELECT part, filter_order, CAST(step AS INT) AS step, v,
  coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS removed,
  coalesce(sum(n) FILTER (gone AND bad), 0) AS redundant, coalesce(sum(n) FILTER (fails = v), 0) AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND bad), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND bad), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, v)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, v) AS BIGINT) AS shapley FROM t"""
