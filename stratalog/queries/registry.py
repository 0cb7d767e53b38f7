"""The registry of queries, and the SQL forms of the model's tables that their DuckDB texts are put together from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.model import Model

QUERIES: dict[str, tuple[Callable[[Model], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _revised(text: str) -> str:
    return f"""SELECT 'f:' || doc_id AS file_id, sha256({text}) AS content_hash, strlen({text})::BIGINT AS byte_size,
lang, source, doc_id"""


_PATH = "source || '/' || lang || '/' || doc_id || '.md'"
_EDITED = "CASE WHEN doc_id % 7 = 0 THEN text || '#' ELSE text END"
_MEMBER = """file_id, doc_id, path, lang, source, content_hash, byte_size,
CASE WHEN doc_id % 19 = 0 THEN 'excluded' WHEN doc_id % 37 = 0 THEN 'secret_excluded' ELSE 'present' END AS presence,
CASE WHEN doc_id % 19 <> 0 AND doc_id % 37 <> 0 THEN substr(sha256(file_id || chr(31) || content_hash), 1, 32) END AS revision_id"""

#: Table name: (tables it reads, its SELECT).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "g1": ((), f"{_revised('text')}, {_PATH} AS path FROM documents WHERE doc_id % 17 <> 0"),
    "g2": ((), f"{_revised(_EDITED)}, CASE WHEN doc_id % 13 = 0 THEN 'moved/' ELSE '' END || {_PATH} AS path FROM documents WHERE doc_id % 11 <> 0"),
    "ws": ((), "SELECT 'w1' AS workspace_id, 'g2' AS active_id"),
    "gen": (
        (),
        """SELECT * FROM (VALUES ('g0', NULL, 1::BIGINT, 'committed'), ('g1', 'g0', 2, 'committed'), ('g2', 'g1', 3, 'committed'),
('g3', 'g2', 4, 'failed'), ('g4', 'g2', 5, 'candidate')) AS t(generation_id, parent_id, sequence_no, state)""",
    ),
    "gf": (("g1", "g2"), f"SELECT 'g1' AS generation_id, {_MEMBER} FROM g1 UNION ALL SELECT 'g2', {_MEMBER} FROM g2"),
    "rev": (
        ("gf",),
        """SELECT DISTINCT revision_id, file_id, content_hash, byte_size, lang, doc_id,
CASE doc_id % 6 WHEN 0 THEN 'test' WHEN 1 THEN 'configuration' ELSE 'source' END AS artifact_class, doc_id % 6 = 0 AS is_test
FROM gf WHERE revision_id IS NOT NULL""",
    ),
    "cf": (
        ("ws", "gf", "rev"),
        """SELECT ws.workspace_id, gf.generation_id, gf.file_id, gf.path, gf.presence, gf.revision_id, rev.content_hash, rev.byte_size, rev.artifact_class, rev.is_test
FROM ws JOIN gf ON gf.generation_id = ws.active_id LEFT JOIN rev ON rev.revision_id = gf.revision_id""",
    ),
    "run": (
        (),
        """SELECT * FROM (VALUES ('run:0', 'provider.a', 'compiler', 'complete'), ('run:1', 'provider.b', 'semantic_index', 'partial'),
('run:2', 'provider.c', 'structural', 'complete'), ('run:3', 'provider.d', 'textual', 'failed'),
('run:4', 'provider.e', 'document_config', 'complete')) AS t(run_id, provider, tier, run_status)""",
    ),
    "sf": (
        ("rev",),
        """SELECT 's:' || p_partkey || '@' || substr(rev.revision_id, 1, 8) AS fact_id, 'run:' || (p_partkey % 5) AS run_id, rev.revision_id, rev.file_id,
'part:' || p_partkey AS symbol_key, p_type AS kind, p_name AS display_name, p_brand || '::' || p_name AS qualified_name, p_size::BIGINT AS start_byte, (p_size + 40)::BIGINT AS end_byte,
CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' ELSE 'structural' END AS method, round((p_size % 10) / 10.0 + 0.05, 2) AS confidence, p_partkey
FROM part JOIN rev ON rev.file_id = 'f:' || (p_partkey // 2)""",
    ),
    "cs": (("cf", "sf"), "SELECT sf.*, cf.path, cf.artifact_class, cf.is_test FROM sf JOIN cf ON cf.revision_id = sf.revision_id"),
    "se": (
        (),
        """SELECT DISTINCT 'e:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS fact_id, 'f:' || (l_partkey // 2) AS file_id,
'part:' || l_partkey AS source, 'part:' || l_suppkey AS target,
CASE l_linenumber WHEN 2 THEN 'imports' WHEN 3 THEN 'references' WHEN 4 THEN 'implements' WHEN 5 THEN 'tests' WHEN 6 THEN 'configures' ELSE 'calls' END AS type,
CASE l_linenumber % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'structural' ELSE 'exact' END AS method, (l_linenumber + 2) / 10.0::DOUBLE AS confidence,
l_suppkey AS t, l_linenumber AS ln, l_orderkey AS ok FROM lineitem""",
    ),
    "sr": (
        ("se",),
        """SELECT *, CASE WHEN t % 9 = 0 THEN 'stale' WHEN t % 5 = 0 THEN 'external' WHEN ln = 6 THEN 'ambiguous'
WHEN ln = 7 AND ok % 2 = 0 THEN 'unresolved' ELSE 'resolved_symbol' END AS status FROM se""",
    ),
    "ce": (("sr", "cf"), "SELECT sr.*, cf.path, cf.artifact_class, cf.is_test FROM sr JOIN cf ON cf.file_id = sr.file_id AND cf.revision_id IS NOT NULL"),
    "cov": (
        ("cf",),
        """SELECT cf.file_id, cf.path, split_part(replace(cf.path, 'moved/', ''), '/', 2) AS lang, cf.presence,
CASE WHEN cf.presence <> 'present' THEN 'excluded' WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'complete' WHEN quality = 0 THEN 'partial'
WHEN doc_id IS NOT NULL AND quality IS NULL THEN 'stale' ELSE 'unsupported' END AS status
FROM cf LEFT JOIN labels ON cf.file_id = 'f:' || labels.doc_id""",
    ),
    "conf": (
        (),
        """SELECT 'part:' || l_partkey AS subject_key, l_orderkey AS ok, CASE l_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'preferred_with_conflict' WHEN 2 THEN 'unresolved' ELSE 'resolved' END AS status
FROM lineitem GROUP BY l_partkey, l_orderkey HAVING count(DISTINCT l_suppkey) > 1""",
    ),
    "eff": (
        (),
        """SELECT 'x:' || event_id AS effect_id, 'part:' || json_extract_string(props, '$.k') AS subject, event_type AS effect_type,
CASE event_id % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'build' ELSE 'test' END AS phase, event_id FROM events""",
    ),
    "ev": (
        (),
        """SELECT event_id, ts, user_id, user_id || '|' || strftime(ts, '%Y-%m-%d') AS session_id, CASE event_type WHEN 'view' THEN 'context_supplied' WHEN 'click' THEN 'entity_queried'
WHEN 'purchase' THEN 'exact_source_requested' WHEN 'signup' THEN 'reasoning_use_reported' ELSE 'artifact_changed' END AS use_type,
json_extract_string(props, '$.k') AS entity, round(value)::BIGINT AS bytes FROM events""",
    ),
}


def tables(*names: str) -> str:
    """The WITH list (without WITH) of these tables and all that they read."""
    done: list[str] = []

    def visit(name: str) -> None:
        for n in TABLES[name][0]:
            visit(n)
        if name not in done:
            done.append(name)

    for name in names:
        visit(name)
    return ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in done)


def sql(names: str, body: str, recursive: bool = False) -> str:
    """body after the named tables; `body` may go on with CTEs of its own, beginning with a comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables(*names.split())}{'' if body.lstrip().startswith(',') else ' '}{body}"
