"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import binary_ids, decontamination, fingerprints, golden, packing, quality, residual_packing, sharding, similarity_join, substring_dedup, token_counts, url_filter, whitening
from .common import small_batches
from .labelled_urls import labelled_urls
from .tokens import word_tokenizer_path

RULES = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"), url_filter.Rule("www.example.com", "/en/", "allow"), url_filter.Rule("net", "/es/", "block"), url_filter.Rule("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(ship_package(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), sharding.Topology.uniform())


def op2_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated_spans(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = decontamination.hit_words("spans")
    ids = F.array_join("items", ",").cast("binary")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.exp("_lm_score").alias("perplexity"), F.exp("_lm_threshold").alias("threshold"), (~F.col("_lm_keep")).alias("rejected"))


def op5_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"), word_tokenizer_path())


def op6_suffix_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate(spark, _table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_simple8b_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ids = binary_ids.round_trip(spark, docs, word_tokenizer_path(), end_id=2)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents")).drop("edited")


@cache
def url_model() -> url_filter.UrlModel:
    return url_filter.train(labelled_urls())


def op9_url_logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES, url_model()).select("page_id", "host", "path", "rule", "verdict")


def op10_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_sections(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = counted.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.posexplode("sections").alias("section", "s"))
    return rows.select("doc_id", "doc_tokens", F.col("section").cast("long").alias("section"), "s.*")


def op11_gramian_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(spark, _table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c")
    rows = white.select(F.col("id").alias("vec_id"), "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op12_hierarchical_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.pack_whole_documents(spark, _table(spark, sf_dir, "documents"), word_tokenizer_path())


def op13_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golden.client_records(_table(spark, sf_dir, "clients"))
    cents = F.floor(F.lit(100.0) * F.col("balance") + F.lit(0.5)).alias("balance_cents")
    return found.select("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", cents, "name_from", "email_from", "segment_from", "balance_from", "address_from")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_hash_tree_sharding, op2_wu_manber_decontamination, op3_ngram_jaccard_join, op4_kneser_ney_quality, op5_minimum_slack_packing, op6_suffix_automaton_dedup, op7_simple8b_token_ids, op8_closed_syncmers, op9_url_logistic_regression, op10_offset_token_counts, op11_gramian_whitening, op12_hierarchical_residual_packing, op13_golden_records)
    return {f.__name__: f for f in all_}


_OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id::VARCHAR AS item_id, least(10, len(ws)) AS m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
m AS (SELECT DISTINCT m FROM p),
d AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, m WHERE len(ws) >= m),
f AS (SELECT d.doc_id, d.i, d.m, p.item_id FROM d JOIN p ON p.m = d.m AND p.win = array_to_string(d.ws[d.i : d.i + d.m - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.reach) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n"""

_OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
c AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS pos FROM r) GROUP BY doc_id),
k AS (SELECT w.doc_id, p.pos, w.ws[p.pos] AS word FROM w, unnest(range(1, len(ws) + 1)) AS p(pos) ANTI JOIN (SELECT doc_id, unnest(gone) AS pos FROM c) g ON g.doc_id = w.doc_id AND g.pos = p.pos),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


_BLANK = r"^[\x20\x09-\x0D]*$"

_OP13_SQL = rf"""
WITH r AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id, balance,
                  CASE source WHEN 'partner' THEN 0 WHEN 'store' THEN 1 WHEN 'web' THEN 2 WHEN 'crm' THEN 3 ELSE 4 END AS trust,
                  CASE WHEN NOT regexp_full_match(name, '{_BLANK}') THEN name END AS name, CASE WHEN NOT regexp_full_match(email, '{_BLANK}') THEN email END AS email,
                  CASE WHEN NOT regexp_full_match(city, '{_BLANK}') THEN city END AS city, CASE WHEN NOT regexp_full_match(segment, '{_BLANK}') THEN segment END AS segment FROM clients),
s AS (SELECT *, updated_at IS NULL OR updated_at < max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 720 HOUR AS stale, (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS filled FROM r),
c AS (SELECT *, first_value(segment) OVER (PARTITION BY cluster_id ORDER BY (segment IS NULL), updated_at DESC NULLS LAST, trust, client_id) AS chosen FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY (name IS NULL), length(name) DESC, stale, trust, updated_at DESC NULLS LAST, client_id) AS k_name,
             row_number() OVER (PARTITION BY cluster_id ORDER BY (email IS NULL), stale, trust, updated_at DESC NULLS LAST, client_id) AS k_email,
             row_number() OVER (PARTITION BY cluster_id ORDER BY (segment IS NULL), updated_at DESC NULLS LAST, trust, client_id) AS k_segment,
             row_number() OVER (PARTITION BY cluster_id ORDER BY (balance IS NULL), (segment IS NULL OR segment <> chosen), updated_at DESC NULLS LAST, trust, client_id) AS k_balance,
             row_number() OVER (PARTITION BY cluster_id ORDER BY filled DESC, stale, trust, updated_at DESC NULLS LAST, client_id) AS k_address FROM c)
SELECT cluster_id, count(*)::BIGINT AS n_records, count(*) FILTER (WHERE stale)::BIGINT AS n_stale, max(name) FILTER (WHERE k_name = 1) AS name, max(email) FILTER (WHERE k_email = 1) AS email,
       max(segment) FILTER (WHERE k_segment = 1) AS segment, max(city) FILTER (WHERE k_address = 1) AS city, max(nation_id) FILTER (WHERE k_address = 1) AS nation_id,
       floor(100 * max(balance) FILTER (WHERE k_balance = 1) + 0.5)::BIGINT AS balance_cents,
       max(client_id) FILTER (WHERE k_name = 1 AND name IS NOT NULL) AS name_from, max(client_id) FILTER (WHERE k_email = 1 AND email IS NOT NULL) AS email_from,
       max(client_id) FILTER (WHERE k_segment = 1 AND segment IS NOT NULL) AS segment_from, max(client_id) FILTER (WHERE k_balance = 1 AND balance IS NOT NULL) AS balance_from,
       max(client_id) FILTER (WHERE k_address = 1 AND filled > 0) AS address_from
FROM k GROUP BY cluster_id"""


def _url_sql() -> str:
    model = url_model()
    weights = ", ".join(map(str, model.weights))
    rules = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: -len(r.name)))
    verdicts = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in RULES)
    sizes = ", ".join(map(str, model.sizes))
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
ruled AS (SELECT *, CASE {rules} END AS rule, '^' || host || '$' || path AS t FROM u),
grams AS (SELECT DISTINCT page_id, substr(t, i::BIGINT, n) AS g FROM (SELECT page_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM ruled, (SELECT unnest([{sizes}]) AS n) WHERE length(t) >= n)),
score AS (SELECT page_id, sum(([{weights}])[('0x' || substr(md5(g), 1, 4))::BIGINT % {len(model.weights)} + 1]) AS s FROM grams GROUP BY page_id)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END WHEN coalesce(s, 0) + ({model.intercept}) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN score USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_wu_manber_decontamination": _OP2_SQL, "op3_ngram_jaccard_join": _OP3_SQL, "op6_suffix_automaton_dedup": _OP6_SQL, "op9_url_logistic_regression": _url_sql(), "op13_golden_records": _OP13_SQL}
