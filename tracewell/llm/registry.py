"""Queries of the subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import fingerprints, lattice, mixing, neardup, oracles, pieces, quality, secrets, substrings, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_cumulative_link_toxicity,
        substrings.op2_fm_index_repeats,
        lattice.op3_e8_lattice,
        pieces.op4_merge_rounds,
        quality.op5_bradley_terry_quality,
        warc.op6_revisit_resolution,
        secrets.op7_blob_ledger_secrets,
        neardup.op8_minhash_forest,
        fingerprints.op9_order_minhash,
        mixing.op10_weighted_fair_mix,
    )
}

SQL: dict[str, str] = oracles.SQL
