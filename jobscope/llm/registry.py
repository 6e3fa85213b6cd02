"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from jobscope.llm import chat, clustering, decontaminate, jaccard, langid, licenses, media, mixing, periodic, pii, substrings, toxicity, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_language_id": langid.op3_language_id,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_pii": pii.op9_pii,
    "op10_media_chunks": media.op10_media_chunks,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_centroid_clusters": clustering.op12_centroid_clusters,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op11_periodic_runs": periodic.OP11_SQL,
    "op12_centroid_clusters": clustering.OP12_SQL,
}
