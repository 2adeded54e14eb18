"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, decontam, langid, maintext, mixing, quality, recompression, secrets, sharding, simhash, suffixes, toxicity, turns

QUERIES = {
    f.__name__: f
    for f in (
        recompression.op1_recompression,
        simhash.op2_simhash,
        toxicity.op3_toxicity,
        decontam.op4_decontaminate,
        mixing.op5_mix_sources,
        langid.op6_langid,
        secrets.op7_secrets,
        sharding.op8_shard,
        sharding.small_shards,
        suffixes.op9_suffix_array,
        quality.op10_quality,
        maintext.op11_main_text,
        centroids.op12_centroids,
        turns.op13_repair_turns,
    )
}

ORACLE_SQL = {"op1_recompression": recompression.ORACLE_SQL, "op4_decontaminate": decontam.ORACLE_SQL, "op5_mix_sources": mixing.ORACLE_SQL, "op8_shard": sharding.ORACLE_SQL, "small_shards": sharding.SMALL_SQL, "op12_centroids": centroids.ORACLE_SQL, "op13_repair_turns": turns.ORACLE_SQL}
