"""Nearest neighbours by randomly rotated one-bit codes.

Index.  Every vector is normalised, padded with zeros to ``bits`` dimensions and rotated by a
random orthogonal matrix; the signs of the result are its code, packed into bytes.  One scalar is
kept with the code: the inner product of the rotated vector with its own code vector.

Search.  A rotated query's inner product with a vector is estimated as its product with the code
divided by that scalar; the error stays below ``width`` standard errors sqrt((1 - a * a) / (a * a) /
(bits - 1)) but for a small share of pairs.  Within a block of vectors, those whose upper
bound reaches the k-th best lower bound are ranked again by their exact cosine in double precision.

Equal vectors share one code.  Only the smallest ids of such a class can be a query's answer, so a
class keeps k + 1 ids, found by a ranking that drops rows before the shuffle; queries with equal
vectors are searched once.  Blocks are dealt by a hash of the vector: chunks of queries meet blocks
of vectors in tasks of bounded size, and only k + 1 candidates for each query and block leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwave.llm.common import stored


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """The first ``dim`` columns of a random orthogonal matrix, transposed: dim x bits."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction scalar of unit vectors."""
    y = x @ turn
    return np.packbits(y > 0, axis=1), np.abs(y).sum(1) / np.sqrt(turn.shape[1])


def bounds(q: np.ndarray, code: np.ndarray, scalar: np.ndarray, turn: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and the half width of their interval."""
    bits = turn.shape[1]
    sign = np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1
    dot = (q @ turn).astype(np.float32) @ sign.T / np.sqrt(bits)
    return dot / scalar, width * np.sqrt(np.maximum(1 - scalar**2, 0) / scalar**2 / (bits - 1))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows whose vector is not null, not all zero and has finite components only."""
    v = F.col(f"`{vector}`")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(
        v.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & fine
    )


def neighbours(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    bits: int = 256,
    width: float = 3.0,
    block: int = 8192,
    chunk: int = 2048,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    seed: int = 3,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine for each row whose id is divisible
    by ``every``, among all other rows; ties to the smaller id.

    Rows with a null id, or whose vector is null, empty, zero or not finite, take no part; vectors
    of another length than the most common one are never near and are an error.  Rows that repeat an id
    and a vector count once.  Fewer than k other rows give fewer results; an empty table gives
    none.  Other columns are not read.
    """
    # the smallest ids of each distinct vector; +0.0 makes the two zeros equal
    rows = usable(vectors, vec_id, vector)
    sizes = rows.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    dim = sizes["hi"] or 1
    if sizes["lo"] is not None and sizes["lo"] != dim:
        raise ValueError(f"vectors have {sizes['lo']} to {dim} components")
    keyed = rows.withColumn("v", F.transform("v", lambda x: x.cast("double") + F.lit(0.0)))
    keyed = keyed.withColumn("a", F.xxhash64("v")).withColumn("b", F.hash("v"))
    first = Window.partitionBy("a", "b").orderBy("vec_id")
    smallest = keyed.withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= k + 1)
    ids = smallest.groupBy("a", "b").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"))
    classes = stored(ids, "classes")
    asked = stored(keyed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "a", "b").distinct(), "asked")
    queries = asked.select("a", "b").distinct().join(classes.select("a", "b", "v"), ["a", "b"])
    n_blocks = max(1, -(-classes.count() // block))
    n_chunks = max(1, -(-queries.count() // chunk))
    hashed = F.xxhash64("a", "b", F.lit(seed))
    right = classes.select(
        "a", "b", "v", "ids", F.lit(False).alias("query"), F.pmod(hashed, F.lit(n_blocks)).alias("i"),
        F.explode(F.expr(f"sequence(0L, {n_chunks - 1}L)")).alias("j"),
    )
    left = queries.select(
        "a", "b", "v", F.array().cast("array<long>").alias("ids"), F.lit(True).alias("query"),
        F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")).alias("i"), F.pmod(hashed, F.lit(n_chunks)).alias("j"),
    )

    def search(table: pa.Table) -> pa.Table:
        is_query = np.asarray(table["query"])
        a, b = np.asarray(table["a"]), np.asarray(table["b"])
        order = np.lexsort((b, a, is_query))  # the same order, and so the same result, in every run
        table, is_query, a, b = table.take(pa.array(order)), is_query[order], a[order], b[order]
        raw = _matrix(table["v"], dim)
        # scaling by the largest component first keeps norms of huge and tiny vectors finite
        scaled = raw / np.abs(raw).max(1, keepdims=True)
        unit = scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
        turn = rotation(dim, max(bits, dim), seed)
        q, x = unit[is_query], unit[~is_query]
        code, scalar = encode(x, turn)
        ids = table["ids"].filter(pa.array(~is_query)).to_pylist()
        want = min(k + 1, len(x))
        qa, qb = a[is_query], b[is_query]
        rows_a, rows_b, rows_id, rows_score = [], [], [], []
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            if not want:
                break
            near, half = bounds(part, code, scalar, turn, width)
            floor = np.partition(near - half, len(x) - want, axis=1)[:, len(x) - want]
            for r in range(len(part)):
                few = np.flatnonzero(near[r] + half >= floor[r])
                exact = (x[few] * part[r]).sum(1)
                members = [(-s, i) for s, f in zip(exact.tolist(), few.tolist()) for i in ids[f]]
                members.sort()
                for s, i in members[: k + 1]:
                    rows_a.append(qa[at + r])
                    rows_b.append(qb[at + r])
                    rows_id.append(i)
                    rows_score.append(-s)
        return pa.table(
            {
                "a": pa.array(rows_a, pa.int64()),
                "b": pa.array(rows_b, pa.int32()),
                "vec_id": pa.array(rows_id, pa.int64()),
                "score": pa.array(rows_score, pa.float64()),
            }
        )

    found = right.unionByName(left).groupBy("i", "j").applyInArrow(search, "a long, b int, vec_id long, score double")
    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    answers = asked.join(top, ["a", "b"]).where("vec_id != query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
