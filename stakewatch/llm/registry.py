"""The queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from stakewatch.llm import exact_search, hard_negatives, line_dedup, merkle_manifest, quality_rules
from stakewatch.llm.byte_bpe import op8_byte_bpe
from stakewatch.llm.decontaminate import op9_decontaminate
from stakewatch.llm.html_text import op2_html_text
from stakewatch.llm.language_id import op7_language_id
from stakewatch.llm.licenses import op5_license_scan
from stakewatch.llm.near_dedup import op10_minhash
from stakewatch.llm.personal_data import op6_personal_data
from stakewatch.llm.token_files import op3_token_files

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_html_text": op2_html_text,
    "op3_token_files": op3_token_files,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_personal_data": op6_personal_data,
    "op7_language_id": op7_language_id,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_decontaminate": op9_decontaminate,
    "op10_minhash": op10_minhash,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_exact_search": exact_search.op13_exact_search,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_merkle_manifest": merkle_manifest.ORACLE_SQL,
    "op13_exact_search": exact_search.ORACLE_SQL,
}
