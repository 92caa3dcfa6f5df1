"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from strataloom.llm import ann, bpe, chat, clustering, divergence, line_dedup, mixing, quality, sharding, simhash, toxicity, url_filters, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_warc": warc.op6_warc,
    "op7_mixing": mixing.op7_mixing,
    "op8_ann": ann.op8_ann,
    "op9_simhash": simhash.op9_simhash,
    "op10_bpe": bpe.op10_bpe,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_centroid_clustering": clustering.op12_centroid_clustering,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {
    "op1_sharding": sharding.SQL,
    "op2_quality_rules": quality.SQL,
    "op3_chat_formatting": chat.SQL,
    "op5_url_filters": url_filters.SQL,
    "op6_warc": warc.SQL,
    "op7_mixing": mixing.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op12_centroid_clustering": clustering.SQL,
    "op13_source_divergence": divergence.SQL,
}
