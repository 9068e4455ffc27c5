"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["secret_scan", "decontaminate", "fixity", "near_dups", "html_text", "quality", "packing", "reply_trees", "mixing", "toxicity", "whitening", "url_rules", "vector_codes"]

QUERIES, ORACLE = {}, {}
for _name in MODULES:
    _module = import_module(f"orderlark.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
