"""Registered queries of the training-data operators, with DuckDB SQL where SQL can
express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import (common, langid, minhash, mixing, neighbours, periodic, phrases, prefixtrie, quality, secretscan,
                        simhash, tokenfile, triebpe, warc)


def _over(table: str, fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(common.read(common.ready(spark), sf_dir, table))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_fingerprints": _over("documents", minhash.op1),
        "op2_simhash_near_dedup": _over("documents", simhash.op2),
        "op3_warc_normaliser": _over("pages", warc.op3),
        "op4_weighted_mixing": _over("documents", mixing.op4),
        "op5_language_id": _over("documents", langid.op5),
        "op6_quality_ledger": _over("documents", quality.op6),
        "op7_token_files": _over("documents", tokenfile.op7),
        "op8_trie_bpe": _over("documents", triebpe.op8),
        "op9_repeated_phrases": _over("documents", phrases.op9),
        "op10_secret_scan": _over("documents", secretscan.op10),
        "op11_nearest_neighbours": _over("embeddings", neighbours.op11),
        "op12_periodic_runs": _over("documents", periodic.op12),
        "op13_prefix_trie": _over("conversations", prefixtrie.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_normaliser": warc.SQL,
        "op4_weighted_mixing": mixing.SQL,
        "op6_quality_ledger": quality.SQL,
        "op9_repeated_phrases": phrases.SQL,
        "op12_periodic_runs": periodic.SQL,
        "op13_prefix_trie": prefixtrie.SQL,
    }
