"""Named queries of this subpackage over the driver tables, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwave.llm import blob_ledger, filter_audit, lyndon_runs, prefix_decontam
from panelwave.llm.common import stored, table
from panelwave.llm.complement_pack import pack
from panelwave.llm.cube_mix import mix_sources
from panelwave.llm.hyperminhash import near_duplicates
from panelwave.llm.line_clean import clean_lines
from panelwave.llm.rabitq import neighbours
from panelwave.llm import reply_tree
from panelwave.llm.seed_extend import remove_repeats
from panelwave.llm.site_quality import fit_quality, judge
from panelwave.llm.zstd_toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_first_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    return clean_lines(table(spark, sf, "documents"), with_text=False).drop("clean_text")


@query
def op10_seed_and_extend(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents"), with_text=False).drop("kept_text")


@query
def op8_hyperminhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query
def op3_exact_complement_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special_as_text=False)


@query
def op6_cube_method_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents"))


@query
def op4_compression_distance_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf, "labels")))


@query
def op9_blob_ledger_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Scan with the base rules first; the full rules then find those pairs in the ledger."""
    docs = table(spark, sf, "documents")
    blobs = stored(blob_ledger.distinct_blobs(docs), "blobs")
    _, ledger = blob_ledger.find_secrets(docs, rules=blob_ledger.BASE, blobs=blobs)
    findings, _ = blob_ledger.find_secrets(docs, ledger, blobs=blobs)
    return blob_ledger.summary(findings)


@query
def op2_one_bit_code_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(table(spark, sf, "embeddings"))


@query
def op5_reply_tree_formatting(spark: SparkSession, sf: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr(
        "cast(-1 as long) as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{control}' as text"
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages, texts = reply_tree.turns_as_tree(turns)
    formatted = reply_tree.format_paths(reply_tree.chosen_paths(messages), texts)
    return reply_tree.read_back(formatted).drop("path")


@query
def op7_site_shrinkage_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return judge(docs, fit_quality(docs, table(spark, sf, "labels")), F.col("source"), F.col("lang"))


@query
def op11_baier_grouping_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = lyndon_runs.with_planted_runs(table(spark, sf, "documents"))
    return lyndon_runs.collapse_runs(docs, with_text=False).drop("runs", "collapsed_text")


@query
def op12_prefix_filtered_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = prefix_decontam.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("items", "spans")


@query
def op13_decision_diagram_audit(spark: SparkSession, sf: str) -> DataFrame:
    masks = filter_audit.failure_masks(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return filter_audit.interaction_audit(masks, "ABCDE")


ORACLES["op9_blob_ledger_secrets"] = blob_ledger.oracle()
ORACLES["op11_baier_grouping_runs"] = lyndon_runs.oracle()
ORACLES["op12_prefix_filtered_decontamination"] = prefix_decontam.oracle()
ORACLES["op13_decision_diagram_audit"] = filter_audit.oracle()
