"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> module that has it.
QUERIES = {
    "op1_substring_dedup": "substrings",
    "op2_language": "language",
    "op3_exact_dedup": "exact",
    "op4_token_counts": "counts",
    "op5_decontaminate": "decontaminate",
    "op6_pii": "pii",
    "op7_packing": "packing",
    "op8_simhash": "simhash",
    "op9_url_filter": "urls",
    "op10_quality": "quality",
    "op11_spelling": "spelling",
    "op12_alignment": "alignment",
    "op13_licenses": "licenses",
}


def queries() -> dict:
    out = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in dict.fromkeys(QUERIES.values()):
        out |= getattr(import_module(f"{__package__}.{module}"), "ORACLE", {})
    return out
