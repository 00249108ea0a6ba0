"""The pipeline's near-dedup stage by fingerprints."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import shingles, simhash


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """Without the bands, pairs that fingerprints propose are linked, and only if their sets are similar."""
    monkeypatch.setattr(shingles, "similar", lambda docs, words, least: spark.createDataFrame([], "a long, b long"))
    long = " ".join(f"word{i * i % 1009}" for i in range(3000))
    rows = [(1, long), (2, long + " end"), (3, "a text of a few words only"), (4, None), (5, " ")]
    prints = [simhash.fingerprint(t) & (1 << 64) - 1 for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 and prints[3] == prints[4] == 0
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]
    apart = shingles.compared(spark.createDataFrame(rows[:3], "doc_id long, text string"), spark.sql(f"SELECT xxhash64('{long}') AS a, xxhash64('{rows[2][1]}') AS b, 1L AS n"))
    assert apart.count() == 0
