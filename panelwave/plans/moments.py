"""Sums of products of an array column over all rows: cross products, the sufficient
statistics of linear estimators, and multiplier sums, the draws of the bootstrap.

Both read every row once, as Arrow batches, and keep one matrix per group in a task: no row
is multiplied by its products or draws.  A task passes on its matrices as rows, and an
ordinary aggregation adds the tasks up.  The functions that run in tasks are nested, so
that Spark ships them whole; executors need no copy of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

Batches = Iterator[pa.RecordBatch]


def _by_group(
    by: Sequence[str],
    vec: str,
    schema: pa.Schema,
    add: Callable,
    rows: Callable,
) -> Callable[[Batches], Batches]:
    """A function for ``mapInArrow``: ``add(total, batch, picked, z)`` adds the rows ``picked`` of a
    batch, whose vectors are ``z``, to a group's total; ``rows(total)`` gives the total's columns."""
    by = list(by)

    def run(batches: Batches) -> Batches:
        import numpy as np

        totals: dict[tuple, object] = {}
        for batch in batches:
            lists = batch.column(vec)
            here = np.flatnonzero(np.asarray(lists.is_valid()))
            if not len(here):
                continue
            size = len(lists.flatten()) // len(here)
            matrix = np.zeros((batch.num_rows, size))
            matrix[here] = np.asarray(lists.flatten()).reshape(len(here), size)
            code = np.zeros(len(here), np.int64)
            for c in by:
                coded = batch.column(c).dictionary_encode(null_encoding="encode")
                code = code * len(coded.dictionary) + np.asarray(coded.indices)[here]
            order = np.argsort(code, kind="stable")
            for part in np.split(here[order], np.flatnonzero(np.diff(code[order])) + 1):
                key = tuple(batch.column(c)[int(part[0])].as_py() for c in by)
                totals[key] = add(totals.get(key), batch, part, matrix[part])
        for key, total in totals.items():
            columns = rows(total)
            n = len(columns[0])
            keys = [pa.array([k], schema.field(c).type).take(pa.array(np.zeros(n, np.int64))) for c, k in zip(by, key)]
            names = schema.names[len(by) :]
            values = [pa.array(v, schema.field(c).type) for c, v in zip(names, columns)]
            yield pa.RecordBatch.from_arrays([*keys, *values], schema=schema)

    return run


def _schema(df: DataFrame, by: Sequence[str], more: str) -> tuple[T.StructType, pa.Schema]:
    fields = [T.StructField(c, df.schema[c].dataType) for c in by]
    spark = T.StructType([*fields, *T.StructType.fromDDL(more).fields])
    return spark, to_arrow_schema(spark)


def gram(df: DataFrame, vec: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Sum of v[i] * v[j] over the rows, per ``by`` group, as rows (by, i, j, m).

    The vector has a fixed length p and no missing elements; rows without a vector are left
    out.  A task forms Z'Z of each Arrow batch and keeps p x p sums a group.  Both (i, j) and
    (j, i) are returned.
    """
    by = list(by)
    rows = df.select(*by, vec, *([weight.cast("double").alias("__w")] if weight is not None else []))
    target, arrow = _schema(rows, by, "i int, j int, m double")
    weighted = weight is not None

    def add(total, batch, picked, z):
        import numpy as np

        left = z * np.asarray(batch.column("__w"))[picked][:, None] if weighted else z
        product = left.T @ z
        return product if total is None else total + product

    def products(total):
        import numpy as np

        p = np.arange(len(total), dtype=np.int32)
        return np.repeat(p, len(p)), np.tile(p, len(p)), total.ravel()

    sums = rows.mapInArrow(_by_group(by, vec, arrow, add, products), target)
    return sums.groupBy(*by, "i", "j").agg(F.sum("m").alias("m"))


#: Fixed values of the counter-based generator Philox 2x32: multiplier, key step and rounds.
PHILOX_MULTIPLIER, PHILOX_STEP, PHILOX_ROUNDS = 0xD256D193, 0x9E3779B9, 10
#: A multiplier takes its low value where 32 uniform bits are below this.
LOW_SHARE = ceil((5.0**0.5 + 1) / (2 * 5.0**0.5) * 2**32)
LOW, HIGH = (1 - 5.0**0.5) / 2, (1 + 5.0**0.5) / 2


def multiplier_keys(seed: int, key: Column) -> tuple[Column, Column]:
    """Two 32-bit numbers that name a unit's stream of multipliers."""
    digits = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return tuple(F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in (0, 1))


def keyed_sums(df: DataFrame, vec: str, size: int, draws: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Multiplier-weighted sums of an array column: rows (by, draw, idx, q) with
    q = sum over the units of multiplier[unit, draw] * vec[idx].

    Multipliers have two points, mean 0 and variance 1 (Mammen).  A counter-based generator
    makes them from the unit's key and the draw's number, so they belong to the unit: they do
    not depend on how the rows are partitioned, and a recomputed task gets them again.  One
    round of the generator gives the bits of two draws.  Each batch adds one product of its
    draws x units and units x ``size`` matrices; a task passes on ``draws`` rows a group.
    """
    by = list(by)
    k0, k1 = multiplier_keys(seed, F.col("unit"))
    rows = df.select(*by, vec, k0.alias("__k0"), k1.alias("__k1"))
    names = [f"q{i}" for i in range(size)]
    target, arrow = _schema(rows, by, ", ".join(["draw int", *[f"{c} double" for c in names]]))
    multiplier, step, rounds, cut, low, high = PHILOX_MULTIPLIER, PHILOX_STEP, PHILOX_ROUNDS, LOW_SHARE, LOW, HIGH

    def add(total, batch, picked, z):
        import numpy as np

        u = np.uint64
        counters = np.arange((draws + 1) // 2, dtype=u)[:, None]
        total = np.zeros((2 * len(counters), z.shape[1])) if total is None else total
        keys = [np.asarray(batch.column(c)).astype(u)[picked] for c in ("__k0", "__k1")]
        rows_at_once = max(1, (1 << 20) // draws)
        for a in range(0, len(picked), rows_at_once):
            key, right = (k[None, a : a + rows_at_once] for k in keys)
            left = np.broadcast_to(counters, (len(counters), key.shape[1]))
            right = np.broadcast_to(right, left.shape)
            for _ in range(rounds):
                product = left * u(multiplier)
                left, right = (product >> u(32)) ^ key ^ right, product & u(0xFFFFFFFF)
                key = (key + u(step)) & u(0xFFFFFFFF)
            part = z[a : a + rows_at_once]
            sums = part.sum(0)
            for nth, bits in enumerate((left, right)):
                total[nth::2] += high * sums + (low - high) * ((bits < u(cut)).astype(np.float64) @ part)
        return total

    def drawn(total):
        import numpy as np

        return np.arange(1, draws + 1, dtype=np.int32), *total[:draws].T

    sums = rows.mapInArrow(_by_group(by, vec, arrow, add, drawn), target)
    added = sums.groupBy(*by, "draw").agg(F.array(*[F.sum(c) for c in names]).alias("q"))
    return added.select(*by, "draw", F.posexplode("q").alias("idx", "q"))
