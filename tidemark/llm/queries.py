"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, centroids, collocations, exact_dedup, jaccard, langid, minhash, packing, quality, secrets, substrings, syncmers, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_language": langid.op2_language,
    "op3_syncmers": syncmers.op3_syncmers,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op6_minhash": minhash.op6_minhash,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality": quality.op9_quality,
    "op10_suffix_dedup": substrings.op10_suffix_dedup,
    "op11_centroids": centroids.op11_centroids,
    "op12_collocations": collocations.op12_collocations,
    "op13_jaccard_join": jaccard.op13_jaccard_join,
}

ORACLE_SQL = {
    "op11_centroids": centroids.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_jaccard_join": jaccard.ORACLE_SQL,
    "op6_minhash": jaccard.oracle(4, ", coalesce(f.component, l.doc_id) = l.doc_id AS kept"),
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
}
