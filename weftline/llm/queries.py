"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from weftline.llm import audit, bpe, jaccard, language, merkle, packing, pii, quality, ranked, simhash, suffix, warc, windows

QUERIES = {"op1_pii": pii.op1_pii, "op2_bpe": bpe.op2_bpe, "op3_warc": warc.op3_warc, "op4_packing": packing.op4_packing, "op5_simhash": simhash.op5_simhash, "op6_suffix": suffix.op6_suffix, "op7_merkle": merkle.op7_merkle, "op10_language_id": language.op10_language_id, "op8_windows": windows.op8_windows, "op9_host_rules": quality.op9_host_rules, "op11_ranked": ranked.op11_ranked, "op12_jaccard": jaccard.op12_jaccard, "op13_filter_audit": audit.op13_filter_audit}
ORACLE_SQL: dict[str, str] = {"op3_warc": warc.OP3_SQL, "op7_merkle": merkle.OP7_SQL, "op8_windows": windows.OP8_SQL, "op9_host_rules": quality.OP9_SQL, "op11_ranked": ranked.OP11_SQL, "op12_jaccard": jaccard.OP12_SQL, "op13_filter_audit": audit.OP13_SQL}
