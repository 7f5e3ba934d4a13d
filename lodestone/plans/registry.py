"""All core queries by name."""

from __future__ import annotations

from . import audit, corpus, evaluation, grounding, metrics, references, relational, retrieval, runs, stores, streams, structure, texts

_MODULES = (references, corpus, retrieval, metrics, evaluation, audit, grounding, structure, runs, relational, streams, stores, texts)

QUERIES: dict = {}
ORACLE: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE

FLAGSHIP = "document_hybrid_topk"
