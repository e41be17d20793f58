"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from skein.llm import ann, decontaminate, langid, licenses, lines, lm, mixing, neardup, quality, secrets


def queries() -> dict:
    return {
        "op4_secrets": secrets.op4_secrets,
        "op1_mixture": mixing.op1_mixture,
        "op2_neardup": neardup.op2_neardup,
        "op3_lm": lm.op3_lm,
        "op5_nearest": ann.op5_nearest,
        "op6_lines": lines.op6_lines,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_quality": quality.op8_quality,
        "op9_language": langid.op9_language,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_neardup": neardup.op2_sql(), "op10_licenses": licenses.op10_sql()}
