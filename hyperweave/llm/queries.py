"""The queries of this package, the corpus pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, licenses, mixing, packing, periods, pii, quality, secrets, sharding, simhash, tries, urls
from .sql import CHAT, DECONTAMINATION


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_sharding,
        urls.op2_url_filter,
        packing.op3_pack_tokens,
        mixing.op4_poisson_mix,
        pii.op5_pii,
        chat.op6_chat_format,
        quality.op7_quality_rules,
        secrets.op8_secret_scan,
        decontam.op9_decontamination,
        simhash.op10_simhash_dedup,
        tries.op11_prefix_trie,
        licenses.op12_license_scan,
        periods.op13_periodic_runs,
        pipeline,
    )
}

SQL = {
    "op1_sharding": sharding.SQL,
    "op2_url_filter": urls.SQL,
    "op4_poisson_mix": mixing.SQL,
    "op6_chat_format": CHAT,
    "op9_decontamination": DECONTAMINATION,
    "op11_prefix_trie": tries.SQL,
    "op12_license_scan": licenses.SQL,
}
