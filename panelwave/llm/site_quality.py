"""Document quality by hierarchical empirical Bayes.

A logistic classifier on shape statistics gives each document its own evidence.  Sites say how
good their other documents are: the rate of a host is shrunk toward the global rate, the rate of a
path toward its host's rate, the more so the fewer documents they have.  How strong the shrinkage
is follows from the spread between sites (method of moments).  A document never counts for its own
site, so a site with one document says nothing beyond its prior.  The site's log odds against the
global ones are added to the document's.

Statistics of sites are grouped sums, combined before the shuffle; a host with a third of all rows
is one row of the site table.  Sums are over integers (millionths), so they do not depend on order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwave.llm.common import by_slices, stored
from panelwave.llm.logistic import fit_logistic, probability
from panelwave.llm.wordscan import WORD_BASE, Words, per_row, prefix, run_hash

_UNIT = 1_000_000


def _classes() -> dict[str, np.ndarray]:
    out = {}
    for name, chars in (("symbol", b"#*$%&|<>_~^=+"), ("bang", b"!"), ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))), ("digit", b"0123456789"), ("stop", b".,;:?")):
        mask = np.zeros(256, bool)
        mask[list(chars)] = True
        out[name] = mask
    return out


_CLASS = _classes()
FEATURES = 9


def shape(column: pa.Array) -> np.ndarray:
    """Shape statistics of each text, rows x FEATURES; a text without words has zeros."""
    w = Words(column)
    span, n = w.offsets, np.maximum(w.count, 1)

    def share(name: str) -> np.ndarray:
        total = np.append(0, np.cumsum(_CLASS[name][w.data]))
        return total[span[1:]] - total[span[:-1]]

    chars = np.maximum(per_row(w.doc, w.rows, w.end - w.start), 1)
    upper, lower = share("upper"), share("lower")
    order = np.lexsort((w.hash, w.doc))
    same = (w.hash[order][1:] == w.hash[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
    equal_words = per_row(w.doc[order[1:]][same], w.rows) if len(order) else np.zeros(w.rows, np.int64)
    at = w.windows(4)
    runs = np.zeros(w.rows, np.int64)
    if len(at):
        h, row = run_hash(prefix(w.hash, WORD_BASE), at, at + 4, WORD_BASE), w.doc[at]
        order = np.lexsort((h, row))
        again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        runs = per_row(row[order[1:]][again], w.rows)
    x = np.column_stack(
        [
            np.log1p(w.count),
            chars / n,
            np.sqrt(share("symbol") / chars),
            np.sqrt(share("bang") / n),
            upper / np.maximum(upper + lower, 1),
            share("digit") / chars,
            share("stop") / n,
            equal_words / n,
            runs / n,
        ]
    )
    x[w.count == 0] = 0.0
    return x


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    rate: float  #: share of good documents among those it was fitted on


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> QualityModel:
    """Fit the classifier on at most ``sample`` labelled documents of each label outside the
    held-out fold; without labels every document is as good as its site."""
    from panelwave.llm.zstd_toxicity import sample_labelled

    train = sample_labelled(docs, labels, "quality", sample)

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array(shape(part.column("text")).tolist(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), x, part.column("quality")], names=["doc_id", "x", "quality"])

    schema = f"doc_id {train.schema['doc_id'].dataType.simpleString()}, x array<double>, quality int"
    rows = train.mapInArrow(by_slices(measure, "text"), schema).toPandas().sort_values("doc_id")
    x, y = np.array(rows["x"].tolist()).reshape(len(rows), FEATURES), rows["quality"].to_numpy(float)
    return QualityModel(tuple(fit_logistic(x, y)), float(y.mean()) if len(y) else 0.5)


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: str, least: float = 1.0, most: float = 1000.0) -> float:
    """Pseudo-documents of the prior: mean * (1 - mean) over the variance between groups."""
    r = F.col("s") / _UNIT / F.col("n")
    m = F.col(mean)
    row = groups.where("n > 1").agg(
        F.sum(F.col("n") * (r - m) ** 2).alias("spread"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum("n").alias("n"),
        F.avg(m * (1 - m)).alias("unit"),
    ).first()
    if not row["n"]:
        return 10.0
    between = max((row["spread"] - row["noise"]) / row["n"], 0.0)
    return float(np.clip(row["unit"] / between - 1 if between > 0 else most, least, most))


def judge(
    docs: DataFrame,
    model: QualityModel,
    host: Column,
    path: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    threshold: float = 0.5,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``docs``: doc_id, doc_score, host_rate, path_rate, score, kept (and ``carry``).

    Null hosts and paths are sites like others.  A null or empty text has the statistics of a text
    without words.  Repeated rows are documents of their own and get equal results.  A null id
    stays null.  An empty table gives an empty result.
    """
    ours = {"doc_id", "host", "path", "p", "doc_score", "host_rate", "path_rate", "score", "kept"}
    if clash := ours & set(carry):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    weights = np.array(model.weights)
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
        F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`") for c in carry],
    )
    kept = ["doc_id", "host", "path", *carry]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        p = np.rint(probability(shape(part.column("text")), weights) * _UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(p)], names=[*kept, "p"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", p long"
    scored = stored(rows.mapInArrow(by_slices(run, "text"), schema), "scored")
    paths = stored(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    rate = min(max((total["s"] or 0) / _UNIT / total["n"] if total["n"] else model.rate, 1e-6), 1 - 1e-6)
    of_hosts = hosts.select(F.col("hs").alias("s"), F.col("hn").alias("n"), F.lit(rate).alias("prior"))
    k_host = _strength(of_hosts, "prior")
    shrunk = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).withColumn(
        "host_rate", (F.col("hs") / _UNIT + k_host * rate) / (F.col("hn") + k_host)
    )
    k_path = _strength(shrunk, "host_rate")
    sites = shrunk.select(F.col("host").alias("sh"), F.col("path").alias("sp"), "s", "n", "hs", "hn")
    own = F.col("p") / _UNIT
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("sh")) & F.col("path").eqNullSafe(F.col("sp")))
    out = out.withColumn("host_rate", (F.col("hs") / _UNIT - own + k_host * rate) / (F.col("hn") - 1 + k_host))
    out = out.withColumn("path_rate", (F.col("s") / _UNIT - own + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path))
    odds = _logit(own) + _logit(F.col("path_rate")) - _logit(F.lit(rate))
    out = out.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select(
        F.col("doc_id").alias(doc_id), own.alias("doc_score"), "host_rate", "path_rate", "score",
        (F.col("score") >= threshold).alias("kept"), *carry,
    )
