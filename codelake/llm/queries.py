"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import attention_lm, decontaminate, html_template, mixing, pii, quality_gam, quality_rules, simhash, substring_dedup, suffix_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_mixing": mixing.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_quality_gam": quality_gam.op4,
    "op5_html_template": html_template.op5,
    "op6_attention_lm": attention_lm.op6,
    "op7_simhash": simhash.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_pii": pii.op10,
}
SQL: dict[str, str] = {"op2_mixing": mixing.SQL}
