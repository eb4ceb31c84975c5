"""Queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, exactdedup, filteraudit, htmltext, langid, mixing, pii, sharding, simhash, token_codec, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by law `key`. A null text has size 1, null doc_ids share a shard, repeated rows have slots of their own, an empty table gives no rows, further columns aren't read."""
    return sharding.shard_table(_table(spark, sf_dir, "documents"))


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents. Null and empty texts have the lowest score, repeats equal ones; without labels of both kinds all have the prior; an empty table gives no rows, further columns aren't read."""
    return toxicity.toxicity_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents by their sources' rates. A null source is one of its own, rows of one doc_id (null too) have equal counts, an empty table gives no rows, further columns aren't read."""
    return mixing.mix_table(_table(spark, sf_dir, "documents"))


def op4_context_mixing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written and read back. A null text is empty, null doc_ids come first, equal doc_ids in an order of their texts; an empty table gives no rows, further columns aren't read."""
    return token_codec.token_table(_table(spark, sf_dir, "documents"))


def op5_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents. Null and letterless texts are `und`, ties go to the first language by name, repeats have equal results; an empty table gives no rows, further columns aren't read."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of all documents. A null text is empty, repeated rows and doc_ids stand for themselves, an empty table gives no rows, further columns aren't read."""
    return pii.pii_table(_table(spark, sf_dir, "documents"))


def op7_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents. Null and empty texts have no words, repeated items count once by item_id, an empty benchmark hits nothing, empty documents give no rows, further columns aren't read."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents. Null and wordless texts have fingerprint 0, repeats are one node, a component without doc_ids has no id; an empty table gives no rows, further columns aren't read."""
    return simhash.simhash_table(_table(spark, sf_dir, "documents"))


def op9_redirect_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages. Null and malformed urls have empty host and path, null html no links, ties of rules go to allow, repeats are judged alike; an empty table gives no rows, further columns aren't read."""
    return urlfilter.url_table(_table(spark, sf_dir, "pages"))


def op10_fuse_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents. A null text is the empty one, of rows that share the largest doc_id (or have none) one stays; an empty table gives no rows, further columns aren't read."""
    return exactdedup.dedup_table(_table(spark, sf_dir, "documents"))


def op11_density_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages. Null and empty html have none, repeats equal ones, ties go to the outer node; an empty table gives no rows, further columns aren't read."""
    return htmltext.extract_table(_table(spark, sf_dir, "pages"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tokens of all documents. Null and empty texts have zeros, repeats count as documents of their own, ties of best pairs all count; an empty table gives no rows, further columns aren't read."""
    return alignment.alignment_table(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of five filters over all documents. A null text is empty, a null lang the part '', repeats of one doc_id are no earlier texts; an empty table gives no rows, further columns aren't read."""
    return filteraudit.audit_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hash_tree_shards,
        op2_crf_toxicity,
        op3_poisson_mix,
        op4_context_mixing_tokens,
        op5_bitmask_language,
        op6_disclosure_pii,
        op7_wu_manber_decontamination,
        op8_anchor_simhash,
        op9_redirect_urls,
        op10_fuse_exact_dedup,
        op11_density_html_text,
        op12_tokenizer_alignment,
        op13_filter_audit,
    )
}

ORACLES: dict[str, str] = {
    "op3_poisson_mix": mixing.MIX_ORACLE,
    "op7_wu_manber_decontamination": decontaminate.DECONTAMINATE_ORACLE,
    "op9_redirect_urls": urlfilter.URL_ORACLE,
    "op10_fuse_exact_dedup": exactdedup.DEDUP_ORACLE,
    "op13_filter_audit": filteraudit.AUDIT_ORACLE,
}
