"""The queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from routeloom.llm import linededup, mixing, packing, pii, quality, rules, simhash, tiff, toxicity, warc

QUERIES = {
    "op1_pii_bootstrap": pii.op1_pii_bootstrap,
    "op2_rule_ledger": rules.op2_rule_ledger,
    "op3_quality_pu": quality.op3_quality_pu,
    "op4_warc_seekable": warc.op4_warc_seekable,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_toxicity_crf": toxicity.op6_toxicity_crf,
    "op7_line_winnowing": linededup.op7_line_winnowing,
    "op8_cube_mixing": mixing.op8_cube_mixing,
    "op9_simhash_golay": simhash.op9_simhash_golay,
    "op10_tiff": tiff.op10_tiff,
    "tiff_page_rows": tiff.tiff_page_rows,
}

ORACLE_SQL: dict[str, str] = {
    "op2_rule_ledger": rules.ORACLE,
    "op7_line_winnowing": linededup.ORACLE,
}
