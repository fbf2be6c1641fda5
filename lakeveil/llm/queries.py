"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["quality_rules", "packing", "simhash", "topk", "mixing", "substrings", "quality_model", "toxicity", "html_text", "lines", "clustering", "collocations", "warc"]
QUERIES: dict = {}
SQL: dict[str, str] = {}

for _name in MODULES:
    _module = importlib.import_module(f"lakeveil.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
