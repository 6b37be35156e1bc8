"""Registry of the operators' queries and of their DuckDB counterparts."""

from __future__ import annotations

from trustlake.llm import centroids, chat_format, decontamination, license_scan, merkle, substring_dedup
from trustlake.llm.centroids import op12_centroids
from trustlake.llm.chat_format import op6_chat_format
from trustlake.llm.decontamination import op10_benchmark_decontamination
from trustlake.llm.language_id import op4_language_id
from trustlake.llm.license_scan import op3_license_scan
from trustlake.llm.merkle import op11_merkle_manifest
from trustlake.llm.mixing import op7_source_mix
from trustlake.llm.order_minhash import op2_order_minhash
from trustlake.llm.pii import op9_pii_pseudonyms
from trustlake.llm.simhash import op8_simhash_near_dedup
from trustlake.llm.substring_dedup import op13_substring_dedup
from trustlake.llm.token_ids import op1_token_ids
from trustlake.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_order_minhash": op2_order_minhash,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_source_mix": op7_source_mix,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroids": op12_centroids,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op3_license_scan": license_scan.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op10_benchmark_decontamination": decontamination.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_substring_dedup": substring_dedup.ORACLE,
}
