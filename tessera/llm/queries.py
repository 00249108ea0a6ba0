"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, infill, language, lattice, manifest, mixing, ngrams, pieces, pii, secrets, simhash, substring, warc
from tessera.llm._common import table


def _over(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": _over("documents", secrets.op1),
        "op2_simhash_near_dedup": _over("documents", simhash.op2),
        "op3_exact_dedup": _over("documents", exact.op3),
        "op4_substring_dedup": _over("documents", substring.op4),
        "op5_pii": _over("documents", pii.op5),
        "op6_sentencepiece": _over("documents", pieces.op6),
        "op7_embedding_near_dedup": _over("embeddings", lattice.op7),
        "op8_language_id": _over("documents", language.op8),
        "op9_source_mixing": _over("documents", mixing.op9),
        "op10_warc_revisits": _over("pages", warc.op10),
        "op11_lm_scoring": _over("documents", ngrams.op11),
        "op12_merkle_manifest": _over("documents", manifest.op12),
        "op13_fill_in_middle": _over("documents", infill.op13),
    }


OP3_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g ON t.x = g.x
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op10_warc_revisits": warc.OP10_SQL, "op12_merkle_manifest": manifest.OP12_SQL, "op13_fill_in_middle": infill.OP13_SQL}
