"""Near-duplicate groups by HyperMinHash.

Registers.  The shingle hashes of a document fall into 128 buckets by their upper bits.  A bucket
keeps its smallest value in compressed form: the number of leading zeros and the mantissa bits
that follow.  An empty bucket borrows from a non-empty one that a fixed probe sequence of the
bucket finds, so that short documents can be compared as well.

Candidates.  Bands of 4 registers, 32 of them: two sets with a Jaccard similarity of 0.85 differ
in every band with a probability of about 5e-11 (5e-8 at 0.8).  Documents with equal shingle sets form one
class beforehand.  Inside a bucket of a band the members are not paired with each other: each is
compared with one *hub*, the member whose registers meet most others anywhere.  Members that
are not in their hub's component afterwards are compared with the members of other components,
block by block inside tasks, so pairs are never rows; only confirmed links leave a task.

Verification.  Registers give an estimate of the similarity that is corrected for chance
collisions of compressed values.  Pairs far below the limit (six standard errors) are dropped;
all others are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwave.llm.common import by_slices, stored, texts_of
from panelwave.llm.components import components
from panelwave.llm.wordscan import U, Words, mix

BUCKETS, BAND = 128, 4
MANTISSA = 10
#: Chance that two unequal values share a register: r mantissa bits, large sets (a fixed value of the method).
CHANCE = 0.169919487159739 * 2.0**-MANTISSA
_PROBES = np.random.default_rng(7).integers(0, BUCKETS, (24, BUCKETS))


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (row, hash) sorted, and the row offsets.

    Words are lower-cased (A-Z).  A text with fewer words than ``size`` has its whole sequence as
    its only shingle; without words it has none.
    """
    w = Words(column, lower=True)
    at = w.windows(size)
    value = np.full(len(at), size, U)
    for j in range(size):
        value = mix(value * U(0x9FB21C651E98DF25) + w.hash[at + j])
    row = w.doc[at] if len(at) else at
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(short):
        tail = w.count[short].astype(U)
        for j in range(size - 1):
            more = w.count[short] > j
            word = w.hash[np.minimum(w.first[short] + j, len(w.hash) - 1)]
            tail = np.where(more, mix(tail * U(0x9FB21C651E98DF25) + word), tail)
        row, value = np.concatenate([row, short]), np.concatenate([value, tail])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, np.searchsorted(row, np.arange(w.rows + 1))


def registers(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """rows x 128 registers of sorted distinct hashes: leading zeros and mantissa of the smallest."""
    shift = 64 - BUCKETS.bit_length() + 1
    bucket = (value >> U(shift)).astype(np.int64)
    lead = np.ones(len(row), bool)
    lead[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    row, bucket, rest = row[lead], bucket[lead], value[lead] & U((1 << shift) - 1)
    rest = np.maximum(rest, U(1))
    exponent = np.frexp(rest.astype(np.float64))[1]  # position of the highest bit; rounding can raise it by one
    exponent -= rest < (U(1) << np.minimum(exponent - 1, 63).astype(U))
    zeros = shift - exponent
    body = rest << (shift - exponent).astype(U)  # highest bit at position shift - 1
    mantissa = (body >> U(shift - 1 - MANTISSA)) & U((1 << MANTISSA) - 1)
    code = (zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    out, full = np.zeros((rows, BUCKETS), np.uint16), np.zeros((rows, BUCKETS), bool)
    out[row, bucket], full[row, bucket] = code, True
    own = full.copy()
    source = out.copy()
    some = own.any(1)
    for probe in _PROBES:
        use = some[:, None] & ~full & own[:, probe]
        out[use] = source[:, probe][use]
        full |= use
    for step in range(1, BUCKETS):
        if full[some].all():
            break
        use = some[:, None] & ~full & np.roll(own, -step, 1)
        out[use] = np.roll(source, -step, 1)[use]
        full |= use
    return out


def fingerprints(value: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values of each set, from sums over its members."""
    sums = []
    for salt in (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)):
        total = np.zeros(len(value) + 1, U)
        np.cumsum(mix(value ^ salt), dtype=U, out=total[1:])
        sums.append(mix(total[offset[1:]] - total[offset[:-1]] + np.diff(offset).astype(U)).view(np.int64))
    return sums[0], sums[1]


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from registers (n x 128 each), corrected for chance collisions."""
    return ((a == b).mean(1) - CHANCE) / (1 - CHANCE)


def _least(limit: float, sizes: np.ndarray) -> np.ndarray:
    """The estimate under which a pair cannot reach ``limit`` but with negligible probability."""
    return limit - 6 * np.sqrt(limit * (1 - limit) / np.minimum(BUCKETS, np.maximum(sizes, 1) / 2))


def _blocks(table: pa.Table, percent: int, size: int) -> pa.Table:
    """Links of each cell of a table: members on the left side against those on the right.

    A link (a, b) is a pair with different labels whose sets share at least ``percent`` % of
    their union.  One link for each member and each label of the other side is enough to join
    components, so no more leave the task.
    """
    cell = np.asarray(table["cell_at"])
    order = np.argsort(cell, kind="stable")
    table, cell = table.take(pa.array(order)), cell[order]
    row, value, offset = shingles(table["text"], size)
    n = np.diff(offset)
    regs = registers(row, value, len(cell))
    left, node, label = np.asarray(table["left"]), np.asarray(table["cid"]), np.asarray(table["label"])
    found: set[tuple[int, int]] = set()
    for start, end in zip(*_runs(cell)):
        side = left[start:end]
        lo, hi = np.flatnonzero(side) + start, np.flatnonzero(~side) + start
        if not len(lo) or not len(hi):
            continue
        flat = np.concatenate([value[offset[i] : offset[i + 1]] for i in hi])
        owner = np.repeat(np.arange(len(hi)), n[hi])
        sort = np.argsort(flat, kind="stable")
        flat, owner = flat[sort], owner[sort]
        for x in lo:
            fit = (label[hi] != label[x]) & (100 * np.minimum(n[hi], n[x]) >= percent * np.maximum(n[hi], n[x]))
            fit[fit] = estimate(regs[hi[fit]], regs[x][None]) >= _least(percent / 100, np.minimum(n[hi[fit]], n[x]))
            if not fit.any():
                continue
            own = value[offset[x] : offset[x + 1]]
            a, b = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            hits = b - a
            places = np.repeat(a - np.append(0, np.cumsum(hits)[:-1]), hits) + np.arange(hits.sum())
            both = np.bincount(owner[places], minlength=len(hi))
            fit &= 100 * both >= percent * (n[hi] + n[x] - both)
            linked = hi[fit]
            for y in linked[np.unique(label[linked], return_index=True)[1]]:
                found.add((int(node[x]), int(node[y])))
    pairs = sorted(found)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _runs(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    return begin, np.append(begin[1:], len(cell))


def _links(members: DataFrame, texts: DataFrame, percent: int, size: int, block_bytes: int) -> DataFrame:
    """Links inside groups of ``members`` (grp, cid, label, left, right) between left and right.

    A group is cut into blocks of about ``block_bytes`` of text on either side; every block of the
    left meets every block of the right in a cell.  Small groups share tasks of about an eighth of that.
    """
    rows = members.join(texts, "cid")
    weight = rows.groupBy("grp").agg(
        F.sum(F.when(F.col("left"), F.col("bytes")).otherwise(0)).alias("wl"),
        F.sum(F.when(F.col("right"), F.col("bytes")).otherwise(0)).alias("wr"),
    )
    cuts = weight.select(
        "grp",
        F.ceil((F.col("wl") + 1) / block_bytes).cast("int").alias("nl"),
        F.ceil((F.col("wr") + 1) / block_bytes).cast("int").alias("nr"),
        "wl",
        "wr",
    )
    # Written, so that the join below is of two exchanges (split where one group is large) or a broadcast.
    cuts = stored(cuts, "cuts")
    small = cuts.where("nl * nr = 1").agg(F.sum(F.col("wl") + F.col("wr"))).first()[0] or 0
    tasks = small // (block_bytes // 8) + 1  # shingles and registers take many times their text
    placed = members.join(cuts, "grp").withColumns(
        {"i": F.expr("pmod(xxhash64(cid, 1), nl)"), "j": F.expr("pmod(xxhash64(cid, 2), nr)")}
    )
    as_left = placed.where("left").select(
        "grp", "cid", "label", F.lit(True).alias("left"), "i", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), "nl", "nr"
    )
    as_right = placed.where("right").select(
        "grp", "cid", "label", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), "j", "nl", "nr"
    )
    both = as_left.unionByName(as_right).select(
        "cid", "label", "left", F.xxhash64("grp", "i", "j").alias("cell_at"), (F.col("nl") * F.col("nr") == 1).alias("small")
    )
    loads = texts.select("cid", "text")
    dealt = both.join(loads, "cid").withColumn(
        "task", F.when(F.col("small"), F.pmod("cell_at", F.lit(tasks))).otherwise(F.col("cell_at"))
    )

    def run(table: pa.Table) -> pa.Table:
        return _blocks(table, percent, size)

    return dealt.groupBy("task").applyInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = 3,
    percent: int = 85,
    block_bytes: int = 2 << 20,
    carry: tuple[str, ...] = (),
    with_label: bool = False,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept (and the columns ``carry``).

    Two documents are linked if their shingle sets share at least ``percent`` % of their union;
    component_id is the smallest doc_id that links reach, ``kept`` marks the row that carries it.
    A null text, or one without words, has no shingles and is its own component.  Repeated rows
    form one component and are all marked as the kept one, as they share its id.  A null id is
    never the smallest unless the component has no other; such rows have a null component and are
    all marked as kept.  ``with_label`` adds the column label, which tells components apart also
    where ids are null or shared; it is null for rows without shingles.  An empty table gives an
    empty result.  Only the two named columns are read.
    """
    if clash := set(carry) & {"doc_id", "text", "text_hash", "n", "f1", "f2", "regs", "n_shingles", "component_id", "kept", "label"}:
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    carried = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`") for c in carry])
    carried = carried.withColumn("text_hash", F.xxhash64("text"))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def sign(part: pa.RecordBatch) -> pa.RecordBatch:
        row, value, offset = shingles(part.column("text"), size)
        f1, f2 = fingerprints(value, offset)
        regs = registers(row, value, part.num_rows)
        count = np.diff(offset)
        packed = [r.tobytes() if c else None for r, c in zip(regs, count)]
        names = ["doc_id", "text_hash", "n", "f1", "f2", "regs", *carry]
        arrays = [part.column("doc_id"), part.column("text_hash")]
        arrays += [pa.array(count.astype(np.int64)), pa.array(f1), pa.array(f2), pa.array(packed, pa.binary())]
        arrays += [part.column(c) for c in carry]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {id_type}, text_hash long, n long, f1 long, f2 long, regs binary"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    signed = stored(carried.mapInArrow(by_slices(sign, "text"), schema), "signed")
    # The row that stands for a class: the smallest id (null ids last) and one text of that id.
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = stored(
        signed.where("n > 0")
        .groupBy("f1", "f2")
        .agg(least_row.alias("row"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        .select("f1", "f2", "row.doc_id", "row.text_hash", "n", "regs", F.monotonically_increasing_id().alias("cid")),
        "classes",
    )
    keys = [
        F.xxhash64(F.lit(b), F.expr(f"substring(regs, {2 * BAND * b + 1}, {2 * BAND})")) for b in range(BUCKETS // BAND)
    ]
    bands = classes.select("cid", F.explode(F.array(*keys)).alias("band"))
    full = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    met = stored(bands.join(full, "band"), "met")
    fame = met.groupBy("cid").agg(F.sum("members").alias("fame"))
    ranked = met.join(fame, "cid").select("band", "cid", "fame")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("fame", F.negate("cid").alias("low"))).alias("top"))
    pairs = (
        met.join(hubs.select("band", F.negate("top.low").alias("grp")), "band").select("grp", "cid").distinct()
    )
    pairs = stored(pairs, "pairs")
    others = pairs.where("grp != cid")

    # texts of the classes that met another one, with the class that their set confirms
    wanted = classes.join(met.select("cid").distinct(), "cid", "left_semi")
    wanted = wanted.select(F.col("doc_id").alias("class_id"), F.col("text_hash").alias("class_hash"), "cid", "f1", "f2")
    same_row = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    drawn = rows.join(wanted, same_row).select("cid", "f1", "f2", "text")

    def confirm(part: pa.RecordBatch) -> pa.RecordBatch:
        _, value, offset = shingles(part.column("text"), size)
        f1, f2 = fingerprints(value, offset)
        good = (np.asarray(part.column("f1")) == f1) & (np.asarray(part.column("f2")) == f2)
        kept = part.select(["cid", "text"]).filter(pa.array(good))
        length = pa.array([len(x) if x else 0 for x in texts_of(kept.column("text")).cast(pa.large_binary()).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*kept.columns, length], names=["cid", "text", "bytes"])

    texts = stored(
        drawn.mapInArrow(by_slices(confirm, "text"), "cid long, text string, bytes long").dropDuplicates(["cid"]), "texts"
    )
    # first the hubs (left) against the members of their groups (right), each with its own label
    as_hub = others.select("grp").distinct().select(
        "grp", F.col("grp").alias("cid"), F.col("grp").alias("label"), F.lit(True).alias("left"), F.lit(False).alias("right")
    )
    as_member = others.select("grp", "cid", F.col("cid").alias("label"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    stars = stored(_links(as_hub.unionByName(as_member), texts, percent, size, block_bytes), "links")
    first = components(stars)
    # then members outside their hub's component (left) against all other members (right)
    named = pairs.join(first.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    hub_label = named.where("grp = cid").select("grp", F.col("label").alias("hub_label"))
    open_ = (
        named.where("grp != cid")
        .join(hub_label, "grp")
        .withColumns({"left": F.col("label") != F.col("hub_label"), "right": F.lit(True)})
        .select("grp", "cid", "label", "left", "right")
    )
    some = open_.groupBy("grp").agg(F.max("left").alias("any_left"), F.count("*").alias("size")).where("any_left and size > 1")
    rest = stored(_links(open_.join(some.select("grp"), "grp", "left_semi"), texts, percent, size, block_bytes), "links")
    label = components(stars.unionByName(rest).distinct())
    named_class = classes.select("f1", "f2", "cid", "doc_id").join(label.withColumnRenamed("node", "cid"), "cid", "left")
    named_class = named_class.withColumn("label", F.coalesce("label", "cid"))
    least = named_class.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = named_class.join(least, "label").select("f1", "f2", "component_id", "label")
    no_label = F.lit(None).cast("long").alias("label")
    empty = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), no_label, *carry)
    linked = signed.where("n > 0").select("doc_id", "n", "f1", "f2", *carry)
    linked = linked.join(by_class, ["f1", "f2"]).select("doc_id", "n", "component_id", "label", *carry)
    return linked.unionByName(empty).select(
        F.col("doc_id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        *carry,
        *(["label"] if with_label else []),
    )
