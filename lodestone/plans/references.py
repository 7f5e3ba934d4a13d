"""Queries of problem 1 over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import references as R
from ..tables import load

#: table, record id, id array, time
REFERENCES = (
    ("citation_audit_v1_queries", "case_id", "citation_chunk_ids", "created_at"),
    ("evidence_sufficiency", "result_id", "supporting_chunk_ids", "judged_at"),
    ("audited_claims", "claim_id", "candidate_chunk_ids", "audited_at"),
)


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, record, ids, at in REFERENCES:
        one = R.references_of(load(spark, sf_dir, table), table, record, ids, at)
        out = one if out is None else out.unionByName(one)
    return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orphans(_refs(spark, sf_dir), load(spark, sf_dir, "corpus_manifest"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orphan_report(p1_found(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}


def _norm(c: str) -> str:
    s = f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
    tail = f"regexp_extract({s}, '([0-9]+)$', 1)"
    bare = f"regexp_replace({tail}, '^0+', '')"
    return (
        f"CASE WHEN {s} = '' THEN NULL WHEN {tail} = '' THEN {s} ELSE "
        f"substr({s}, 1, length({s}) - length({tail})) || "
        f"CASE WHEN length({bare}) < 5 THEN lpad({bare}, 5, '0') ELSE {bare} END END"
    )


_EACH = " UNION ALL ".join(
    f"SELECT '{t}' AS ref_table, {r} AS record_id, {_norm('raw')} AS chunk_id, ts FROM "
    f"(SELECT {r}, {a} AS ts, unnest({i}) AS raw FROM {t})"
    for t, r, i, a in REFERENCES
)
_FOUND = f"""
WITH refs AS (SELECT DISTINCT * FROM ({_EACH}) WHERE chunk_id IS NOT NULL AND record_id IS NOT NULL),
man AS (SELECT {_norm('chunk_id')} AS chunk_id, ingested_at, deleted_at FROM corpus_manifest),
firsts AS (SELECT chunk_id, min(ingested_at) AS first_at FROM man GROUP BY 1),
alive AS (SELECT DISTINCT r.ref_table, r.record_id, r.chunk_id, r.ts FROM refs r JOIN man m ON r.chunk_id = m.chunk_id
          AND m.ingested_at <= r.ts AND (m.deleted_at IS NULL OR r.ts < m.deleted_at)),
states AS (SELECT r.*, CASE WHEN f.chunk_id IS NULL THEN 'missing' WHEN r.ts IS NULL THEN NULL
           WHEN r.ts < f.first_at THEN 'late' WHEN a.chunk_id IS NULL THEN 'deleted' END AS orphan_state
    FROM refs r LEFT JOIN firsts f ON r.chunk_id = f.chunk_id
    LEFT JOIN alive a ON r.ref_table = a.ref_table AND r.record_id = a.record_id AND r.chunk_id = a.chunk_id AND r.ts = a.ts),
found AS (SELECT ref_table, record_id, chunk_id, orphan_state, coalesce(strftime(ts, '%Y-%m'), 'unknown') AS period
          FROM states WHERE orphan_state IS NOT NULL)
"""
ORACLE = {
    "p1_found": _FOUND + "SELECT DISTINCT ref_table, record_id, chunk_id, orphan_state, period FROM found",
    "p1_report": _FOUND + """SELECT ref_table, period, orphan_state, count(*) AS n_references,
        count(DISTINCT record_id) AS n_records, count(DISTINCT chunk_id) AS n_chunks FROM found GROUP BY 1, 2, 3""",
}
