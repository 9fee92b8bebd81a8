"""The queries of the training-data operators and of the pipeline."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and SQL, in the order of the operators.
MODULES = ["warc", "suffix_dedup", "substring_dedup", "mixing", "sentencepieces", "quality_classifier", "near_dedup", "quality_rules", "page_text", "merkle"]


def _modules() -> list:
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict:
    import corpus_pipeline

    out = {k: f for m in _modules() for k, f in m.QUERIES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def sql() -> dict[str, str]:
    import corpus_pipeline

    out = {k: q for m in _modules() for k, q in m.SQL.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
