"""Queries of these operators and their SQL counterparts."""

from __future__ import annotations

import corpus_pipeline
from notewright.llm import bpe, chosen_path, covertree, decontaminate, fptree, ivfpq, licenses, line_dedup, repeats, resample, toolcalls, toxicity, warc

MODULES = (resample, licenses, toolcalls, chosen_path, repeats, toxicity, bpe, line_dedup, ivfpq, decontaminate, covertree, warc, fptree)
QUERIES = {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {}
for module in MODULES:
    QUERIES.update(module.QUERIES)
    SQL.update(module.SQL)
