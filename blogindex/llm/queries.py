"""The registered queries of the operators, (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from blogindex.llm import (curves, fingerprints, hmm, jaccard, licenses, packing, pfor, pieces, quality, rules, sharding,
                           variants, whitening)
from blogindex.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def op1_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.language_scores(_documents(spark, folder))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality_rules(_documents(spark, folder))


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licences(licenses.document_files(_documents(spark, folder)))


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, folder), n=4, percent=85)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_documents(spark, folder), table(spark, folder, "labels"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_documents(spark, folder))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, folder))


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_decode(_documents(spark, folder), _tokenizer("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, folder), _tokenizer("word_bpe_49k.json"))


def op10_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return pfor.token_round_trip(_documents(spark, folder), _tokenizer("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_curves(spark: SparkSession, folder: str) -> DataFrame:
    return curves.nearest_neighbours(table(spark, folder, "embeddings"))


def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(_documents(spark, folder), one_in=97)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_hidden_markov, op2_quality_rules, op3_licenses, op4_jaccard, op5_quality, op6_fingerprints, op7_sharding,
    op8_pieces, op9_packing, op10_token_output, op11_whitening, op12_curves, op13_variants)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {
    "op2_quality_rules": rules.QUALITY_SQL,
    "op3_licenses": licenses.licence_scan_sql(),
    "op4_jaccard": jaccard.component_sql(4, 85),
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
