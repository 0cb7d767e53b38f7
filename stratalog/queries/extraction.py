"""Queries: classification of paths, extractors, code indexes, positions."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..functions import vocab
from ..operators import extractors, scip, table_functions, workspace
from ..sources.model import Model
from .registry import register

_FOLDERS = ["src", "node_modules/pkg", "dist", "vendor", "archive", "generated", "src/tests", ".stratalog", "lib", "tests"]
_SUFFIXES = ["md", "rs", "ts", "min.js", "png", "pem", "jar", "tar.gz", "lock", "sql", "gen.ts", "RS", "env.local"]
_PATHS = f"pt AS (SELECT doc_id, ({_FOLDERS})[doc_id % 10 + 1] || '/' || source || '_' || lang || '.' || ({_SUFFIXES})[doc_id % 13 + 1] AS path FROM documents)"


def paths(m: Model) -> DataFrame:
    """A path for every document: ten folders and thirteen suffixes, in all pairings."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values)).cast("int"))
    return m.table("documents").select("doc_id", F.concat(pick(_FOLDERS), F.lit("/"), F.col("source"), F.lit("_"), F.col("lang"), F.lit("."), pick(_SUFFIXES)).alias("path"))


def _rule_sql(value) -> str:
    return " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{value(code, state, p)}'" for code, state, patterns in vocab.PATH_RULES for p in patterns)


@register("p1_path_classes", f"""WITH {_PATHS} SELECT doc_id, path, CASE {_rule_sql(lambda c, s, p: s)} ELSE 'present' END AS state, CASE {_rule_sql(lambda c, s, p: c)} END AS code, CASE {_rule_sql(lambda c, s, p: p)} END AS detail FROM pt""")
def p1_path_classes(m: Model) -> DataFrame:
    return paths(m).select("doc_id", "path", X.classify_path(F.col("path")).alias("c")).select("doc_id", "path", "c.*")


_CLASSES = " ".join(f"WHEN lower(list_last(string_split(path, '.'))) IN ({', '.join(repr(e) for e in exts)}) THEN '{kind}'" for kind, exts in vocab.ARTIFACT_CLASSES.items())


@register("p2_artifact_classes", f"""WITH {_PATHS}, t AS (SELECT *, regexp_matches(path, '(^|/)tests/') AND lower(path) LIKE '%.rs' AS is_test FROM pt) SELECT doc_id, path, is_test, CASE WHEN is_test THEN 'test' {_CLASSES} ELSE 'other' END AS artifact_class FROM t""")
def p2_artifact_classes(m: Model) -> DataFrame:
    """P3 with it: Rust files below a folder `tests` are tests."""
    return paths(m).select("doc_id", "path", X.is_test(F.col("path")).alias("is_test"), X.artifact_class(F.col("path")).alias("artifact_class"))


@register("s3_provider_for", f"WITH {_PATHS} SELECT doc_id, CASE WHEN regexp_matches(lower(path), '\\.(md|markdown|json|ya?ml|toml)$') THEN 'document_config' WHEN regexp_matches(lower(path), '\\.[tj]sx?$') THEN 'structural_script' ELSE 'text_fallback' END AS provider FROM pt")
def s3_provider_for(m: Model) -> DataFrame:
    return paths(m).select("doc_id", extractors.provider_for(F.col("path")).alias("provider"))


_MD = "'# ' || source || chr(10) || text || chr(10) || '   ### ' || lang || ' x  ' || chr(10) || '####### no' || chr(10) || '#no'"


def rendered(m: Model, table: str, suffix: str, *parts) -> DataFrame:
    """path and content of one file a row."""
    key = {"documents": "doc_id", "orders": "o_orderkey", "customer": "c_custkey", "events": "event_id", "part": "p_partkey"}[table]
    body = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return m.table(table).select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("path"), body.alias("content"))


@register("s4_markdown_headings", f"""WITH l AS (SELECT doc_id || '.md' AS path, string_split({_MD}, chr(10)) AS t FROM documents), x AS (SELECT path, unnest(range(1, len(t) + 1)) AS line, unnest(t) AS s FROM l)
SELECT path, trim(regexp_extract(s, '^\\s*#+ (.*)$', 1)) AS name, 'h' || length(regexp_extract(s, '^\\s*(#+) ', 1)) AS signature, line, 0.9::DOUBLE AS confidence FROM x WHERE regexp_matches(s, '^\\s*#{{1,6}} ')""")
def s4_markdown_headings(m: Model) -> DataFrame:
    files = rendered(m, "documents", ".md", "# ", F.col("source"), "\n", F.col("text"), "\n   ### ", F.col("lang"), " x  \n####### no\n#no")
    return extractors.extract(files).select("path", "name", "signature", F.col("start_line").alias("line"), "confidence")


@register("s5_json_top_keys", """WITH x AS (SELECT event_id || '.json' AS path, unnest([event_type, 'nested', 'k' || user_id, 'props']) AS name, unnest(range(1, 5)) AS place, event_type, user_id FROM events)
SELECT path, name, 0.85::DOUBLE AS confidence, CASE place WHEN 1 THEN 2 WHEN 2 THEN length(event_type) + 9 WHEN 3 THEN length(event_type) + 42 ELSE length(event_type) + length(user_id::VARCHAR) + 55 END::BIGINT AS start_byte FROM x""")
def s5_json_top_keys(m: Model) -> DataFrame:
    """Texts that never close their last object are scanned all the same."""
    files = rendered(m, "events", ".json", '{ "', F.col("event_type"), '": 1, "nested": {"x": [1, {"y": 2}]}, \n"k', F.col("user_id").cast("string"), '": "a\\"b", "props": ', F.col("props"))
    return extractors.extract(files).select("path", "name", "confidence", "start_byte")


@register("s6_yaml_keys", """WITH x AS (SELECT o_orderkey || '.yaml' AS path, unnest(['order.' || o_orderstatus, 'total-price', 'p' || o_orderkey]) AS name, unnest([1, 6, 7]) AS line FROM orders) SELECT path, name, line::BIGINT AS line, 0.8::DOUBLE AS confidence FROM x""")
def s6_yaml_keys(m: Model) -> DataFrame:
    files = rendered(m, "orders", ".yaml", "order.", F.col("o_orderstatus"), ": 1\n# c: 2\n- x: 1\n  nested: 3\nbad key!: 2\ntotal-price : ", F.col("o_totalprice").cast("string"), "\np", F.col("o_orderkey").cast("string"), ":\n")
    return extractors.extract(files).select("path", "name", F.col("start_line").alias("line"), "confidence")


@register("s7_toml_keys", """WITH x AS (SELECT c_custkey || '.toml' AS path, unnest(['customer.' || c_mktsegment, 'name', 'acct-bal', 'nation']) AS name, unnest(['config_section', 'config_key', 'config_key', 'config_section']) AS kind, unnest([1, 2, 4, 6]) AS line, unnest([0.9, 0.85, 0.85, 0.9])::DOUBLE AS confidence FROM customer)
SELECT path, kind, name, line::BIGINT AS line, confidence FROM x""")
def s7_toml_keys(m: Model) -> DataFrame:
    files = rendered(m, "customer", ".toml", "[customer.", F.col("c_mktsegment"), ']\nname = "', F.col("c_name"), '"\n# c = 1\n  acct-bal = 1\nbad key = 2\n[ nation ]\n[open\n')
    return extractors.extract(files).select("path", "kind", "name", F.col("start_line").alias("line"), "confidence")


_TS_HEAD = 'import { x } from "./'
_TS = ("\";\nimport 'side';\nexport async function f_", "(a) {\n  if (a) { return \"}\"; }\n}\nexport default class C_", " {\n  m() { return '{'; }\n}\nexport const v_", " = [1,\n 2];\nlet w = 1\nnothing();\n")


@register("s8_script_declarations", """WITH b AS (SELECT p_partkey::VARCHAR AS k, p_partkey || '.ts' AS path, strlen(p_type) AS t FROM part),
x AS (SELECT path, unnest(['symbol', 'symbol', 'symbol', 'symbol', 'relationship', 'relationship']) AS record, unnest(['function', 'class', 'variable', 'variable', 'imports', 'imports']) AS kind, unnest(['f_' || k, 'C_' || k, 'v_' || k, 'w', './' || t, 'side']) AS name,
unnest([3, 6, 9, 11, 1, 2])::BIGINT AS start_line, unnest([5, 8, 10, 11, 1, 2])::BIGINT AS end_line FROM (SELECT k, path, p_type AS t FROM b JOIN part ON p_partkey::VARCHAR = k)) SELECT * FROM x""")
def s8_script_declarations(m: Model) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    files = rendered(m, "part", ".ts", _TS_HEAD, F.col("p_type"), _TS[0], key, _TS[1], key, _TS[2], key, _TS[3])
    return extractors.extract(files).select("path", "record", "kind", "name", "start_line", "end_line")


@register("s9_file_symbols", "SELECT 'file:' || source || '/' || doc_id || '.txt' AS symbol_key, 'file' AS kind, doc_id || '.txt' AS name, strlen(text)::BIGINT AS end_byte FROM documents")
def s9_file_symbols(m: Model) -> DataFrame:
    d = m.table("documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return extractors.file_symbol(d)


@register("s9_text_fallback", "SELECT doc_id || '.txt' AS path, 'no_structural_provider' AS kind FROM documents")
def s9_text_fallback(m: Model) -> DataFrame:
    return extractors.extract(rendered(m, "documents", ".txt", F.col("text"))).where("record = 'diagnostic'").select("path", "kind")


_MARKERS = ["tsconfig.json", "jsconfig.json", "package.json", "Cargo.toml", "readme.md"]
_MARKED = f"""mk AS (SELECT DISTINCT source || CASE WHEN doc_id % 3 = 0 THEN '/' || lang ELSE '' END AS dir, ({_MARKERS})[doc_id % 5 + 1] AS marker FROM documents),
sc AS (SELECT dir, marker, row_number() OVER (PARTITION BY dir ORDER BY list_position({_MARKERS}, marker)) AS k FROM mk WHERE marker <> 'readme.md' AND NOT regexp_matches(dir, '(^|/)(node_modules|target)(/|$)'))"""


def scopes(m: Model) -> DataFrame:
    """dir, marker: the first marker by priority of each folder that has one."""
    d = m.table("documents")
    order = F.array(*map(F.lit, _MARKERS))
    folder = F.concat(F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), F.col("lang"))).otherwise(""))
    rows = d.select(folder.alias("dir"), F.get(order, (F.col("doc_id") % 5).cast("int")).alias("marker")).distinct()
    rows = rows.where((F.col("marker") != "readme.md") & ~F.col("dir").rlike("(^|/)(node_modules|target)(/|$)"))
    return rows.groupBy("dir").agg(F.min_by("marker", F.array_position(order, F.col("marker"))).alias("marker"))


@register("s15_project_scopes", f"WITH {_MARKED} SELECT dir, marker FROM sc WHERE k = 1")
def s15_project_scopes(m: Model) -> DataFrame:
    return scopes(m)


@register("j13_owning_scope", f"""WITH {_MARKED}, s AS (SELECT dir AS scope, marker AS kind FROM sc WHERE k <= 2), f AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents),
j AS (SELECT path, scope, kind, rank() OVER (PARTITION BY path ORDER BY len(string_split(scope, '/')) DESC) AS r FROM f JOIN s ON starts_with(path, scope || '/')), o AS (SELECT path, min(scope) AS scope, count(*) AS n FROM j WHERE r = 1 GROUP BY 1)
SELECT path, CASE WHEN n = 1 THEN scope END AS scope, CASE WHEN n = 1 THEN 'owned' ELSE 'ambiguous' END AS status FROM o""")
def j13_owning_scope(m: Model) -> DataFrame:
    """The deepest scope among a file's ancestors; two of them at one depth are ambiguous. An equi join on ancestors."""
    d = m.table("documents")
    order = F.array(*map(F.lit, _MARKERS))
    folder = F.concat(F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), F.col("lang"))).otherwise(""))
    rows = d.select(folder.alias("scope"), F.get(order, (F.col("doc_id") % 5).cast("int")).alias("kind")).distinct().where("kind != 'readme.md'")
    two = rows.withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy(F.array_position(order, F.col("kind"))))).where("k <= 2")
    parts = F.split("path", "/")
    up = m.files().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("scope"))
    per = up.join(two, "scope").groupBy("path", "scope").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("path").agg(F.max_by(F.struct("scope", "n"), F.size(F.split("scope", "/"))).alias("b"))
    alone = F.col("b.n") == 1
    return best.select("path", F.when(alone, F.col("b.scope")).alias("scope"), F.when(alone, "owned").otherwise("ambiguous").alias("status"))


# --- code indexes -----------------------------------------------------------------------------------------------

_OCC = """oc AS (SELECT p_brand || '/' || p_partkey || '.ts' AS path, p_size::BIGINT AS line, 4::BIGINT AS a, (4 + strlen(p_name))::BIGINT AS b, 'npm ' || p_partkey || '#' AS symbol, 1 AS roles FROM part
UNION ALL SELECT p_brand || '/' || p_partkey || '.ts', l_linenumber + 50, l_suppkey, l_suppkey + 3, CASE WHEN l_linenumber = 3 THEN 'local ' || l_suppkey ELSE 'npm ' || l_suppkey || '#' END, CASE WHEN l_linenumber = 2 THEN 2 ELSE 0 END FROM (SELECT DISTINCT l_partkey, l_linenumber, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey),
sy AS (SELECT p_brand || '/' || p_partkey || '.ts' AS path, 'npm ' || p_partkey || '#' AS symbol, p_name AS name, 'npm type ' || p_type || '#' AS other, CASE WHEN p_partkey % 2 = 0 THEN 'IMPLEMENTS' ELSE 'TYPE_DEFINITION' END AS kind FROM part)"""


def indexes(m: Model, forms: tuple[str, ...] = ("packed",)) -> DataFrame:
    """content: one code-index file a part, with its definition, an occurrence for each of its lines and the type that it names;
    the forms of ranges take turns."""
    p = m.table("part")
    own = F.struct(F.col("p_size").cast("long").alias("line"), F.lit(4).cast("long").alias("a"), (4 + F.octet_length("p_name")).cast("long").alias("b"), F.concat(F.lit("npm "), F.col("p_partkey").cast("string"), F.lit("#")).alias("symbol"), F.lit(1).alias("roles"))
    # one shuffle by part for distinct lines, their gathering and the join; its tasks are not merged, as Python works in them
    tasks = int(m.spark.conf.get("spark.sql.shuffle.partitions"))
    li = m.table("lineitem").select("l_partkey", "l_linenumber", "l_suppkey").repartition(tasks, "l_partkey").distinct()
    supplier = F.col("l_suppkey").cast("string")
    symbol = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("local "), supplier)).otherwise(F.concat(F.lit("npm "), supplier, F.lit("#")))
    used = F.struct((F.col("l_linenumber") + 50).cast("long").alias("line"), F.col("l_suppkey").cast("long").alias("a"), (F.col("l_suppkey") + 3).cast("long").alias("b"), symbol.alias("symbol"), F.when(F.col("l_linenumber") == 2, 2).otherwise(0).alias("roles"))
    uses = li.groupBy("l_partkey").agg(F.collect_list(used).alias("uses"))
    rows = p.join(uses, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.concat(F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), own.alias("own"), F.coalesce("uses", F.array().cast(uses.schema["uses"].dataType)).alias("uses"), F.col("p_name").alias("name"),
        F.concat(F.lit("npm type "), F.col("p_type"), F.lit("#")).alias("other"), F.when(F.col("p_partkey") % 2 == 0, "IMPLEMENTS").otherwise("TYPE_DEFINITION").alias("kind"),
        F.get(F.array(*map(F.lit, forms)), (F.col("p_partkey") % len(forms)).cast("int")).alias("form"), F.col("p_type").alias("type"),
    )

    def run(batches):
        for batch in batches:
            out = []
            uses = batch.column("uses")
            line, a, b, symbol, roles = (uses.values.field(i).to_pylist() for i in range(5))
            ends = uses.offsets.to_pylist()
            for i, r in enumerate(batch.drop_columns(["uses"]).to_pylist()):
                own = r["own"]
                occurrences = [((own["line"], own["a"], own["line"], own["b"]), own["symbol"], own["roles"])]
                occurrences += [((line[j], a[j], line[j], b[j]), symbol[j], roles[j]) for j in range(ends[i], ends[i + 1])]
                out.append(scip.encode_index([{"path": r["path"], "occurrences": occurrences, "symbols": [(own["symbol"], r["name"], [(r["other"], r["kind"])])]}], r["form"], [(r["other"], r["type"], [])]))
            yield pa.RecordBatch.from_pydict({"content": pa.array(out, pa.binary())})

    return rows.mapInArrow(run, "content binary")


@register("s11_decode_index", f"WITH {_OCC} SELECT path, count(*) AS occurrences, sum(b - a)::BIGINT AS chars, (SELECT min(name) FROM sy WHERE sy.path = oc.path) AS name FROM oc GROUP BY path")
def s11_decode_index(m: Model) -> DataFrame:
    d = scip.decoded(indexes(m))
    chars = F.aggregate("occurrences", F.lit(0).cast("long"), lambda acc, o: acc + o["end_char"] - o["start_char"])
    return d.select("path", F.size("occurrences").cast("long").alias("occurrences"), chars.alias("chars"), F.get("symbols", 0)["name"].alias("name"))


@register("s11_index_records", f"""WITH {_OCC} SELECT 'occurrence' AS record, path, count(*) AS n, sum(line)::BIGINT AS lines, sum(b - a)::BIGINT AS chars, max(symbol) AS symbol, '' AS name FROM oc GROUP BY path
UNION ALL SELECT 'symbol', path, 1, 0, 0, symbol, name FROM sy UNION ALL SELECT 'related', path, 1, 0, 0, symbol, name FROM sy UNION ALL SELECT 'external', '', count(*), 0, 0, other, max(p_type) FROM sy JOIN part ON path = p_brand || '/' || p_partkey || '.ts' GROUP BY other""")
def s11_index_records(m: Model) -> DataFrame:
    """Index files in all three forms of ranges through a table function in SQL, external symbols with them."""
    spark = table_functions.register(m.spark)
    view = f"indexes_{uuid.uuid4().hex}"
    indexes(m, ("packed", "plain", "typed")).createOrReplaceTempView(view)
    return spark.sql(f"""SELECT record, coalesce(path, '') AS path, count(*) AS n, coalesce(sum(start_line), 0) AS lines, coalesce(sum(end_char - start_char), 0) AS chars, max(symbol) AS symbol, coalesce(max(name), '') AS name
        FROM index_records(TABLE(SELECT content FROM {view})) GROUP BY record, path, CASE WHEN record = 'external' THEN symbol END""")


_KEY = "CASE WHEN {s} LIKE 'local %' THEN 'scip-local:' || path || ':' || {s} ELSE 'scip:' || {s} END"


@register("s12_map_index", f"""WITH {_OCC} SELECT path, 'symbol' AS record, 'definition' AS type, {_KEY.format(s='symbol')} AS source, NULL AS target FROM oc WHERE roles & 1 <> 0
UNION ALL SELECT path, 'relation', 'REFERENCES', path, {_KEY.format(s='symbol')} FROM oc UNION ALL SELECT path, 'relation', 'IMPORTS', path, {_KEY.format(s='symbol')} FROM oc WHERE roles & 2 <> 0
UNION ALL SELECT path, 'relation', kind, {_KEY.format(s='symbol')}, {_KEY.format(s='other')} FROM sy""")
def s12_map_index(m: Model) -> DataFrame:
    """P16 with it: the canonical key of a symbol."""
    return scip.map_documents(scip.decoded(indexes(m))).select("path", "record", "type", "source", "target")


@register("s13_document_digest", f"""WITH {_OCC}, o AS (SELECT path, string_agg(concat_ws(':', line, a, line, b, symbol, roles), chr(10) ORDER BY concat_ws(':', line, a, line, b, symbol, roles)) AS x FROM oc GROUP BY 1)
SELECT o.path, sha256(x || chr(31) || symbol || ':' || name || ':' || kind || '>' || other) AS digest FROM o JOIN sy USING (path)""")
def s13_document_digest(m: Model) -> DataFrame:
    return scip.document_digest(scip.decoded(indexes(m)))


_LINE2 = "string_split(text, chr(10))[1]"


@register("s14_byte_offsets", """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS t FROM documents), x AS (SELECT *, len(t) - 1 AS line, least(length(t[len(t)]), 7) AS c, coalesce(strlen(array_to_string(t[1:len(t) - 1], chr(10))) + 1, 0) AS before FROM l WHERE text IS NOT NULL)
SELECT doc_id, (CASE WHEN line = 0 THEN 0 ELSE before END + strlen(left(t[line + 1], c)))::BIGINT AS utf32, (CASE WHEN line = 0 THEN 0 ELSE before END + strlen(left(t[line + 1], c)))::BIGINT AS utf16, (CASE WHEN line = 0 THEN 0 ELSE before END + least(c, strlen(t[line + 1])))::BIGINT AS utf8 FROM x""")
def s14_byte_offsets(m: Model) -> DataFrame:
    lines = F.split("text", "\n")
    rows = m.table("documents").where("text is not null").select("doc_id", "text", (F.size(lines) - 1).cast("long").alias("line"), F.least(F.length(F.element_at(lines, -1)), F.lit(7)).alias("c"))
    at = lambda e: extractors.byte_offset(F.col("text"), F.col("line"), F.col("c"), e)
    return rows.select("doc_id", at("utf-32").alias("utf32"), at("utf-16").alias("utf16"), at("utf-8").alias("utf8"))


@register("p17_line_ranges", """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS t FROM documents), n AS (SELECT doc_id, CASE WHEN t[len(t)] = '' AND len(t) > 1 THEN t[1:len(t) - 1] ELSE t END AS t, text LIKE '%' || chr(10) AS closed FROM l)
SELECT doc_id, CASE WHEN len(t) < 2 THEN '' ELSE array_to_string(t[2:4], chr(10)) || CASE WHEN len(t) > 4 OR closed THEN chr(10) ELSE '' END END AS body, CASE WHEN len(t) < 500 THEN 'empty' ELSE 'some' END AS far FROM n""")
def p17_line_ranges(m: Model) -> DataFrame:
    """Lines 2 to 4 with their ends, clamped; past the end there is nothing."""
    text = F.col("text")
    far = extractors.line_range(text, 500, 600)
    return m.table("documents").select("doc_id", extractors.line_range(text, 2, 4).alias("body"), F.when(far == "", "empty").otherwise("some").alias("far"))


@register("p18_line_and_column", """WITH h AS (SELECT doc_id, left(text, length(text) // 2) AS head FROM documents) SELECT doc_id, (length(head) - length(replace(head, chr(10), '')) + 1)::BIGINT AS line, (length(list_last(string_split(head, chr(10)))) + 1)::BIGINT AS col FROM h""")
def p18_line_and_column(m: Model) -> DataFrame:
    half = F.octet_length(F.expr("left(text, length(text) div 2)"))
    line, col = extractors.line_and_column(F.col("text"), half)
    return m.table("documents").select("doc_id", line.alias("line"), col.alias("col"))


@register("p26_canonical_paths", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'a/' || lang || '/x.md' WHEN 3 THEN source || '/x.md' ELSE 'b/' || source END AS path FROM documents""")
def p26_canonical_paths(m: Model) -> DataFrame:
    s, lang, by = F.col("source"), F.col("lang"), F.col("doc_id") % 5
    raw = F.when(by == 0, F.concat(F.lit("/"), s)).when(by == 1, F.concat(s, F.lit("/../../x"))).when(by == 2, F.concat(F.lit("a/./"), s, F.lit("/../"), lang, F.lit("/x.md")))
    raw = raw.when(by == 3, F.concat(F.lit("q//../"), s, F.lit("/x.md"))).otherwise(F.concat(F.lit("b\\"), s))
    return m.table("documents").select("doc_id", workspace.canonical_path(raw).alias("path"))
