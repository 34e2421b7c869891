"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, fmindex, licences, linkgraph, merkle, mincut, mixing, neardup, packing, phrases, quality, sharding, warc
from .common import table


def op6_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.filter_urls(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_digest(table(spark, sf_dir, "pages"))


def op2_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_minimum_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract_pages(table(spark, sf_dir, "pages"))


def op5_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op11_merkle_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op12_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrase_quicksort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_prefix_fingerprints, op3_dart_minhash, op4_minimum_cut_text, op5_concatenate_and_cut, op6_link_graph_filter, op7_quality_rules, op8_hash_tree_shards, op9_pivotal_mix, op10_licence_classifier, op11_merkle_witnesses, op12_fm_decontamination, op13_phrase_quicksort)}
ORACLES: dict[str, str] = {"op1_warc_revisits": warc.SQL, "op11_merkle_witnesses": merkle.SQL, "op12_fm_decontamination": fmindex.SQL, "op13_phrase_quicksort": phrases.SQL}
