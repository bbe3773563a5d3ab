"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what is peculiar to toxic
text.  A window of a few words is compressed with the ordinary dictionary and with the two
together; what the toxic part saves is the window's distance.  Since the second dictionary holds
all of the first, ordinary words save nothing.  A window that saves something under a fast search
is compressed once more with an optimal parse.  Counts of savings over a document's windows become
a score through a logistic calibration, so the thresholds are fitted, not chosen.

What is peculiar to toxic text: words that occur in many distinct contexts (neighbours on both
sides) of toxic documents and in few of ordinary ones.  Contexts instead of occurrences keep
copies of one document from voting again.

Fitting uses a bounded sample of the labelled documents (``sample`` of each label, in the order of
a hash of the id); its word counts are Spark aggregations.  Scoring reads every text as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from panelwave.llm.common import by_slices, stored, texts_of
from panelwave.llm.logistic import fit_logistic, probability

_STRIP = b"\"'()[]{}<>.,;:!?*#$%&|-_"
FEATURES = 9


@dataclass(frozen=True)
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    window: int = 4


def words_of(text: str) -> list[bytes]:
    return [w for w in (x.strip(_STRIP) for x in text.lower().encode("utf-8", "replace").split()) if w]


def _parameters(strategy: int, log: int) -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=16, chain_log=log, hash_log=log - 1, search_log=5, min_match=3, target_length=32, strategy=strategy,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )


class Distance:
    """Savings of windows through the toxic dictionary."""

    def __init__(self, model: ToxicModel):
        self.window = model.window
        both = model.toxic + model.ordinary
        self.pairs = [
            (self._compressor(model.ordinary, p), self._compressor(both, p))
            for p in (_parameters(zstandard.STRATEGY_BTLAZY2, 14), _parameters(zstandard.STRATEGY_BTULTRA, 15))
        ]

    @staticmethod
    def _compressor(content: bytes, parameters: zstandard.ZstdCompressionParameters) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters)

    def features(self, text: str) -> np.ndarray:
        """Counts of windows by saving for both searches, largest savings, log number of windows."""
        words = words_of(text)
        n = self.window
        (fast_o, fast_t), (best_o, best_t) = self.pairs
        fast, best = [], []
        for i in range(0, len(words), n):
            w = b" " + b" ".join(words[i : i + n]) + b" "
            saved = len(fast_o.compress(w)) - len(fast_t.compress(w))
            if saved > 0:
                fast.append(saved)
                best.append(len(best_o.compress(w)) - len(best_t.compress(w)))
        f, b = np.array(fast or [0]), np.array(best or [0])
        count = [np.log1p((f >= k).sum()) for k in (2, 4)] + [np.log1p((b >= k).sum()) for k in (1, 2, 4, 6)]
        return np.array([*count, min(f.max(), 12), min(b.max(), 12), np.log1p(len(words) / n)])


def _grouped(words: list[bytes], repeats: list[int], rng: np.random.Generator, size: int = 8) -> list[bytes]:
    """Samples of several words each, as the trainer skips very short samples."""
    every = [w for w, n in zip(words, repeats) for _ in range(n)]
    order = rng.permutation(len(every))
    return [b" " + b" ".join(every[j] for j in order[i : i + size]) + b" " for i in range(0, len(every), size)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Trained dictionary content; too few samples for the trainer are used as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(texts_of(batch.column("text")).to_pylist(), batch.column("toxic").to_pylist()):
            words = words_of(text)
            around = list(zip([b"", *words[:-1]], words, [*words[1:], b""]))
            seen = sorted({(w, hash_context(a, b)) for a, w, b in around})
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s[0] for s in seen], pa.binary()), pa.array([s[1] for s in seen], pa.int64()), pa.array([toxic] * len(seen), pa.int32())],
                    names=["word", "context", "toxic"],
                )


def hash_context(before: bytes, after: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(before + b"\0" + after) - (1 << 63)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, skip_fold: int = 0, folds: int = 5) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` documents of each label value outside the held-out
    fold, the first by a hash of the id.  Labels that are null or not 0 or 1 are not used."""
    train = labels.where(
        F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != skip_fold)
    ).select("doc_id", F.col(label).cast("int").alias(label))
    train = train.groupBy("doc_id").agg(F.max(label).alias(label)).withColumn("h", F.xxhash64("doc_id"))
    one = [train.where(F.col(label) == v).orderBy("h", "doc_id").limit(most) for v in (0, 1)]
    chosen = one[0].unionByName(one[1]).select("doc_id", label)
    return docs.select("doc_id", "text").join(chosen, "doc_id")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6000, sizes: tuple[int, int] = (12288, 4096), window: int = 4) -> ToxicModel:
    """Train both dictionaries and the calibration.  Only labels outside the held-out fold are used."""
    train = stored(sample_labelled(docs, labels, "toxic", sample), "toxic_sample")
    found = train.mapInArrow(_contexts, "word binary, context long, toxic int").distinct()
    counts = stored(
        found.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "contexts"
    )
    total = counts.agg(F.sum("bad"), F.sum("good")).first()
    rate = (total[1] or 0) / max(total[0] or 0, 1)  # ordinary contexts for each toxic one
    peculiar = (
        counts.where((F.col("bad") >= 4) & (F.col("bad") * rate > 8 * (F.col("good") + 1)) & (F.length("word") <= 24))
        .orderBy(F.desc("bad"), "word").limit(2000).collect()
    )
    common = counts.where("good > 1").orderBy(F.desc("good"), "word").limit(6000).collect()
    rare = counts.where("good = 1 and bad = 0").orderBy(F.xxhash64("word"), "word").limit(24000).collect()
    rng = np.random.default_rng(5)
    bad = _grouped([bytes(r["word"]) for r in peculiar], [min(r["bad"], 40) for r in peculiar], rng)
    good = _grouped([bytes(r["word"]) for r in common], [min(1 + r["good"] // 20, 20) for r in common], rng)
    good += _grouped([bytes(r["word"]) for r in rare], [1] * len(rare), rng)
    model = ToxicModel(_dictionary(good, sizes[0]), _dictionary(bad, sizes[1]), (), window)

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        distance = Distance(model)
        x = [distance.features(t).tolist() for t in texts_of(part.column("text")).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column("toxic")], names=["x", "toxic"])

    rows = train.mapInArrow(by_slices(measure, "text"), "x array<double>, toxic int").toPandas()
    x = np.array(rows["x"].tolist()).reshape(len(rows), FEATURES)
    order = np.lexsort(np.column_stack([x, rows["toxic"]]).T)
    weights = fit_logistic(x[order], rows["toxic"].to_numpy(float)[order])
    return ToxicModel(model.ordinary, model.toxic, tuple(weights), window)


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted.

    Null and empty texts have no windows and get the score of that; repeated rows get equal
    scores; a null id is not held out.  An empty table gives an empty result.  Only the text
    enters the score.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for at in range(0, batch.num_rows, 256):
                x = np.array([distance.features(t.as_py()) for t in texts[at : at + 256]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at : at + 256], pa.array(probability(x, weights))], names=["doc_id", "score"]
                )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {id_type}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select(
        F.col("doc_id").alias(doc_id), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
