"""Documents to packed training sequences: the stages of the corpus pipeline.

Decisions are joined back by the document's id and a hash of its text, null-safe, so rows that
repeat an id or lack one keep their own decision.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwave.llm import blob_ledger
from panelwave.llm.common import stored
from panelwave.llm.complement_pack import pack
from panelwave.llm.cube_mix import mix_sources
from panelwave.llm.hyperminhash import near_duplicates
from panelwave.llm.site_quality import fit_quality, judge

def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names for own columns that the table does not use."""
    out = []
    for name in names:
        while name in docs.columns or name in out:
            name = f"_{name}"
        out.append(name)
    return out


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    return docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def _chosen(docs: DataFrame, key: str, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text hash are among the decided ones."""
    the_id, the_key = _free(docs, "__id", "__k")
    decided = decided.select(F.col("doc_id").alias(the_id), F.col(key).alias(the_key)).distinct()
    same = (F.col(f"`{key}`") == F.col(the_key)) & F.col("doc_id").eqNullSafe(F.col(the_id))
    return docs.join(decided, same, "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware classifier rejects go."""
    columns, (key,) = docs.columns, _free(docs, "__text_key")
    docs = _keyed(docs, key)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    result = judge(docs, fit_quality(docs, labels), F.col("source"), F.col("lang"), carry=(key,))
    return _chosen(docs, key, result.where("kept")).select(*_quoted(columns))


def _quoted(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def _one_each(docs: DataFrame, key: str) -> DataFrame:
    """One row for each id and text, the smallest by all columns in turn."""
    columns = [c for c in docs.columns if c != key]
    whole = F.min(F.struct(*_quoted(columns))).alias("row")
    return docs.groupBy(F.col("doc_id").alias("_i"), F.col(f"`{key}`").alias("_k")).agg(whole).select("row.*", F.col("_k").alias(key))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id and then the
    smallest text hash, null ids last; rows equal in id and text leave one row, the smallest by all
    columns; a text without words stays.

    Documents are near duplicates if they share at least 80 % of their five-word shingles."""
    columns, (key,) = docs.columns, _free(docs, "__text_key")
    docs = _keyed(docs, key)
    result = near_duplicates(docs, size=5, percent=80, carry=(key,), with_label=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(f"`{key}`"))  # null ids last
    first = result.where("label is not null").groupBy("label").agg(F.min(order).alias("first")).select("first.*")
    kept = first.select("doc_id", key).unionByName(result.where("label is null").select("doc_id", key))
    return _one_each(_chosen(docs, key, kept), key).select(*_quoted(columns))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; n_chars follows the new text."""
    findings, _ = blob_ledger.find_secrets(docs)
    the_blob, the_found = _free(docs, "__blob", "__found")
    hits = findings.where(F.size("found") > 0).select(F.col("blob").alias(the_blob), F.col("found").alias(the_found)).distinct()
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    hit = F.col(the_found).isNotNull()
    marked = docs.join(hits, blob == F.col(the_blob), "left")
    text = F.when(hit, blob_ledger.redacted(F.col("text"), F.col(the_found))).otherwise(F.col("text"))
    marked = marked.withColumn("text", text)
    length = F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return marked.withColumn("n_chars", length).select(*_quoted(docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it; rows equal in id and text count
    together."""
    columns, (key,) = docs.columns, _free(docs, "__text_key")
    docs = _keyed(docs, key)
    result = mix_sources(docs, carry=(key,))
    the_id, the_key, copies = _free(docs, "__id", "__k", "__copies")
    taken = result.groupBy(F.col("doc_id").alias(the_id), F.col(key).alias(the_key)).agg(F.sum("copies").cast("int").alias(copies))
    same = (F.col(key) == F.col(the_key)) & F.col("doc_id").eqNullSafe(F.col(the_id))
    joined = _one_each(docs, key).join(taken.where(F.col(copies) > 0), same)
    return joined.withColumn(the_key, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*_quoted(columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids and their places in sequences of at most 2048 tokens:
    the ids of a sequence's pieces in order of offset are the sequence."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), special_as_text=False, with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicate_removal", near_duplicate_removal),
    ("secret_removal", secret_removal),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
