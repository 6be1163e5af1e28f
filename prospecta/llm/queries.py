"""The registered queries of this subpackage: every operator over its whole table."""

from __future__ import annotations

from prospecta.llm import (
    fingerprint,
    language,
    lines,
    minhash,
    mixing,
    negatives,
    oracles,
    packing,
    pii,
    sharding,
    sitetree,
    urlrules,
    vectors,
    whitening,
)


def _over(table: str, operator):
    return lambda spark, folder: operator(spark.read.parquet(f"{folder}/{table}.parquet"))


def all_queries() -> dict:
    return {
        "op1_sharding": _over("documents", sharding.documents_in_shards),
        "op2_language_id": _over("documents", language.languages_of_documents),
        "op3_line_dedup": _over("documents", lines.deduplicated_documents),
        "op4_minhash_near_dedup": _over("documents", minhash.near_duplicates),
        "op5_html_extraction": _over("pages", sitetree.extract),
        "op6_mixing": _over("documents", mixing.mixed_documents),
        "op7_fingerprints": _over("documents", fingerprint.fingerprint_documents),
        "op8_embedding_near_dedup": _over("embeddings", vectors.near_vectors),
        "op9_packing": _over("documents", packing.pack),
        "op10_url_filters": _over("pages", urlrules.judge),
        "op11_hard_negatives": _over("embeddings", negatives.hard_negatives),
        "op12_pii": _over("documents", pii.private_spans),
        "op13_whitening": _over("embeddings", whitening.whitened),
    }


def all_sql() -> dict:
    return {
        "op3_line_dedup": oracles.LINES,
        "op4_minhash_near_dedup": oracles.NEAR_DUPLICATES,
        "op6_mixing": oracles.MIX,
        "op8_embedding_near_dedup": oracles.COSINES,
        "op10_url_filters": oracles.URLS,
        "op11_hard_negatives": oracles.NEGATIVES,
    }
