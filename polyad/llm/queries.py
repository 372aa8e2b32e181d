"""Queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.llm.cooccurrence import memberships, named_pairs, pair_counts
from polyad.llm.mixing import mix_sources
from polyad.llm.neighbours import similar_vectors
from polyad.llm.residue import residue, without_residue
from polyad.llm.runs import collapse_runs
from polyad.llm.sql import SQL as SQL
from polyad.llm.tokens import encode
from polyad.plans.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    runs = collapse_runs(table(spark, d, "human_long"), "session_id", "timestamp", "message_id", "code", table(spark, d, "codebook"))
    return runs.where("n_events >= 2").select("session_id", F.col("first_id").alias("first_message_id"), F.col("last_id").alias("last_message_id"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run as one event, with its count and duration."""
    return collapse_runs(table(spark, d, "human_long"), "session_id", "timestamp", "message_id", "code", table(spark, d, "codebook"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "hg_nodes")
    m = memberships(table(spark, d, "hyperedges"), table(spark, d, "incidence"), nodes)
    return named_pairs(pair_counts(m, min_count=8, min_lift=5.0), nodes).select("hg", "node_a", "node_b")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that share an edge, with lift and conviction."""
    nodes = table(spark, d, "hg_nodes")
    m = memberships(table(spark, d, "hyperedges"), table(spark, d, "incidence"), nodes)
    out = named_pairs(pair_counts(m), nodes)
    return out.select("hg", "node_a", "node_b", "n_both", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    top = similar_vectors(table(spark, d, "honem"), k=5, least=0.8)
    return top.select(F.least("id", "other").alias("emb_a"), F.greatest("id", "other").alias("emb_b")).distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).documents()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents")).select("doc_id").distinct()


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are no residue."""
    return without_residue(table(spark, d, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p4_found, p4_pairs, p5_found, p6_ids, p7_mix, p7_shares, p8_found, p8_kept)}
