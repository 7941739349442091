"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import classifier, embeddings, lines, minhash, mixing, packing, rules, sharding, suffixes, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_quality_rules": rules.op2_quality_rules,
        "op3_lookup_shards": sharding.op3_lookup_shards,
        "op4_byte_network": classifier.op4_byte_network,
        "op5_cross_polytope": embeddings.op5_cross_polytope,
        "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_warc_archive": warc.op9_warc_archive,
        "op10_source_mix": mixing.op10_source_mix,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_lookup_shards": sharding.oracle(),
        "op9_warc_archive": warc.ORACLE,
        "op10_source_mix": mixing.ORACLE,
    }
