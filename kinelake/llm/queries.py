"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Operator number: module, query.
_QUERIES = {
    1: ("token_counts", "op1_token_counts"),
    2: ("exact_dedup", "op2_exact_dedup"),
    3: ("toxicity", "op3_toxicity"),
    4: ("mixing", "op4_mixing"),
    5: ("language", "op5_language"),
    6: ("warc", "op6_warc"),
    7: ("substring_dedup", "op7_substring_dedup"),
    8: ("decontamination", "op8_decontamination"),
    9: ("html_extraction", "op9_html_extraction"),
    10: ("near_dedup", "op10_near_dedup"),
    11: ("lexical_search", "op11_lexical_search"),
    12: ("secrets", "op12_secrets"),
    13: ("window_panes", "op13_window_panes"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"kinelake.llm.{module}"), name) for module, name in _QUERIES.values()}


def oracle_sql() -> dict[str, str]:
    modules = {n: import_module(f"kinelake.llm.{module}") for n, (module, _) in _QUERIES.items()}
    return {_QUERIES[n][1]: sql for n, m in modules.items() if (sql := getattr(m, f"OP{n}_SQL", None))}
