"""Name -> query and name -> oracle SQL of the corpus operators."""

from __future__ import annotations

from clinframe.llm import chatlog, decontam, editcounts, fim, licenses, merkle, mixing, neardups, pseudonyms, quality, sharding, tokenfile, warc

QUERIES = {
    "op1_fertility": quality.op1_fertility,
    "op2_huffman_tokens": tokenfile.op2_huffman_tokens,
    "op3_probminhash": neardups.op3_probminhash,
    "op4_label_shards": sharding.op4_label_shards,
    "op5_feistel_pii": pseudonyms.op5_feistel_pii,
    "op6_license_digests": licenses.op6_license_digests,
    "op7_edit_counts": editcounts.op7_edit_counts,
    "op8_warc_segments": warc.op8_warc_segments,
    "op9_suffix_decontam": decontam.op9_suffix_decontam,
    "op10_poisson_mix": mixing.op10_poisson_mix,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_event_chat": chatlog.op12_event_chat,
    "op13_fim_units": fim.op13_fim_units,
}
ORACLE = {
    "op6_license_digests": licenses.SQL_OP6,
    "op8_warc_segments": warc.SQL_OP8,
    "op10_poisson_mix": mixing.SQL_OP10,
    "op11_merkle_manifest": merkle.SQL_OP11,
    "op12_event_chat": chatlog.SQL_OP12,
    "op13_fim_units": fim.SQL_OP13,
}
