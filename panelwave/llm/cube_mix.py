"""Mixing of sources to target weights by the cube method.

Every document of a source should be taken ``rate`` = target / size of the source times: its
whole part always, and once more with the fractional part as its inclusion probability.  The cube
method settles those probabilities at 0 or 1 so that the taken documents and their words keep
their expected totals: three open documents at a time, the vector of their probabilities moves
along the null space of the two balance equations until one of them is settled (flight phase).
Chunks of a source fly independently and leave at most two open documents each; those are pooled
and fly again, until a source has one chunk.  There a dozen documents of spread sizes stay behind
and are landed together with the last open ones by trying all outcomes.
Chunks are bounded, so a source with any share of the rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwave.llm.common import WORD, stored
from panelwave.session import local_table

_CLOSE = 1e-9


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size; what is cut
    off is shared again by weight among the rest."""
    share = [0.0] * len(sizes)
    rest, open_ = float(sum(sizes)), list(range(len(sizes)))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            share[i] = float(most * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        rest -= sum(share[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return share


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities, keeping their sum and their sum weighted by size, until at most two of
    them lie between 0 and 1."""
    p, s = prob.tolist(), size.tolist()
    draws = rng.random(len(p)).tolist()
    pool: list[int] = []
    for step, i in enumerate(range(len(p))):
        pool.append(i)
        if len(pool) < 3:
            continue
        a, b, c = pool
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(pool, u) if x)
        down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(pool, u) if x)
        move = up if draws[step] * (up + down) < down else -down
        for k, x in zip(pool, u):
            q = p[k] + move * x
            p[k] = 0.0 if q < _CLOSE else 1.0 if q > 1 - _CLOSE else q
        pool = [k for k in pool if 0 < p[k] < 1]
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the open documents (few) by trying all outcomes: the one nearest to their expected
    words, where a document too many or too few counts like some words."""
    open_ = np.flatnonzero((prob > 0) & (prob < 1))
    if not len(open_):
        return prob
    tried = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(tried @ size[open_] - (prob * size)[open_].sum())
    count = np.abs(tried.sum(1) - prob[open_].sum())
    out = prob.copy()
    out[open_] = tried[np.argmin(np.round(words + 0.02 * size[open_].mean() * count, 6))]
    return out


def settle_last(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator, reserve: int = 12) -> np.ndarray:
    """Flight of a last chunk (sorted by size) without a reserve of documents of spread sizes,
    then the landing of that reserve with what the flight left open."""
    open_ = np.flatnonzero((prob > 0) & (prob < 1))
    kept = np.unique(np.linspace(0, len(open_) - 1, min(reserve, len(open_))).astype(int)) if len(open_) else open_
    flies = np.delete(open_, kept)
    out = prob.copy()
    out[flies] = flight(prob[flies], size[flies], rng)
    return land(out, size)


#: Equal rows that one task numbers.
_ALIKE = 4096


def _numbered(rows: DataFrame) -> DataFrame:
    """The same rows with ``number``, which counts rows that are equal in all columns from 0.

    Equal rows are counted (map-side combined) and made again from their count, in blocks that
    are dealt over the tasks, so a row that repeats for a third of the table is no one task's work.
    """
    names = rows.columns
    counted = rows.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("__n"))
    few = counted.where(F.col("__n") <= _ALIKE).withColumn("__from", F.lit(0).cast("long"))
    many = counted.where(F.col("__n") > _ALIKE).withColumn("__block", F.explode(F.expr(f"sequence(0, (__n - 1) div {_ALIKE})")))
    many = many.repartition(F.xxhash64(*[F.col(f"`{c}`") for c in names], "__block")).select(
        *[F.col(f"`{c}`") for c in names],
        F.least(F.col("__n") - F.col("__block") * _ALIKE, F.lit(_ALIKE)).alias("__n"),
        (F.col("__block") * _ALIKE).cast("long").alias("__from"),
    )
    both = few.unionByName(many)
    number = F.explode(F.expr("sequence(__from, __from + __n - 1)")).alias("number")
    return both.select(*[F.col(f"`{c}`") for c in names], number)


def _row_hash(key: list[str], seed: int, carry: tuple[str, ...]) -> Column:
    """Hash of a row; the number of a repeated row takes part in it."""
    h = F.xxhash64(*key, F.lit(seed), *[F.col(f"`{c}`") for c in carry])
    return F.when(F.col("number") > 0, F.xxhash64(h, "number")).otherwise(h)


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    most: int = 3,
    chunk: int = 4096,
    seed: int = 11,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, copies (and the columns
    ``carry``, which must have other names).

    Sources are weighted by ``weights`` in turn, in code-point order with null last.  A null or
    empty text has size 0 and takes 0 words.  Repeated rows are mixed one by one and may get
    different copies; a null id is an id like another.  Equal seeds give equal results.  An empty
    table gives an empty result.  The totals of the sources pass through the driver, one row each.
    """
    names = ("number", "__n", "__from", "__block", "doc_id", "source", "size", "source_size", "target", "taken", "copies", "open", "chunk", "last", "h")
    if clash := set(carry) & set(names):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    base = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *[F.col(f"`{c}`") for c in carry],
    )
    base = stored(_numbered(base).withColumn("h", _row_hash(["doc_id", "size"], seed, carry)).drop("number"), "sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    share = targets([r["s"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    plan = [
        (r["source"], i, r["s"], t, max(1, -(-r["n"] // chunk))) for i, (r, t) in enumerate(zip(totals, share))
    ]
    known = local_table(docs.sparkSession, plan, "source string, nth int, source_size long, target double, chunks long")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = base.withColumnRenamed("source", "own").join(known, F.col("own").eqNullSafe(known["source"]))
    ready = joined.withColumns({"copies": F.floor(rate + _CLOSE).cast("int"), "open": rate - F.floor(rate + _CLOSE)})
    ready = ready.withColumn("open", F.when(F.col("open") < _CLOSE, 0.0).otherwise(F.col("open")))
    fields = ["doc_id", "size", "source_size", "target", "copies", "open", "nth", "h", *carry]
    types = {f: ready.schema[f].dataType.simpleString() for f in fields}
    schema = ", ".join(f"`{f}` {types[f]}" for f in fields)

    def fly(group: pa.Table) -> pa.Table:
        size, h = np.asarray(group["size"]), np.asarray(group["h"])
        order = np.lexsort((h, size))
        group = group.take(pa.array(order))
        prob, size = np.asarray(group["open"]), size[order].astype(float)
        key = [seed, int(group["nth"][0].as_py()), int(group["chunk"][0].as_py()), int(group["level"][0].as_py())]
        settle = settle_last if group["last"][0].as_py() else flight
        prob = settle(prob, size, np.random.default_rng(key))
        copies = np.asarray(group["copies"]) + (prob == 1)
        group = group.set_column(group.schema.get_field_index("copies"), "copies", pa.array(copies.astype(np.int32)))
        open_ = np.where(prob < 1, prob, 0.0)
        group = group.set_column(group.schema.get_field_index("open"), "open", pa.array(open_))
        return group.select(fields)

    done = [ready.where("open = 0").select(*fields)]
    waiting, level = ready.where("open > 0").select(*fields, "chunks"), 0
    while True:
        dealt = waiting.withColumns(
            {
                "chunk": F.pmod(F.xxhash64("h", F.lit(level)), F.col("chunks")),
                "last": F.col("chunks") == 1,
                "level": F.lit(level),
            }
        )
        flown = stored(dealt.groupBy("nth", "chunk").applyInArrow(fly, schema), "flown")
        done.append(flown.where("open = 0"))
        waiting = flown.where("open > 0")
        left = {r["nth"]: r["count"] for r in waiting.groupBy("nth").count().collect()}
        if not left:
            break
        level += 1
        again = [(i, max(1, -(-n // chunk))) for i, n in left.items()]
        waiting = waiting.join(local_table(docs.sparkSession, again, "nth int, chunks long"), "nth").select(*fields, "chunks")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("doc_id").alias(doc_id), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *carry
    )
