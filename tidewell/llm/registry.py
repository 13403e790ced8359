"""The queries of this subpackage: each operator over its whole table, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_collapse, decontaminate, hash_tree, host_reputation, jaccard_join, line_dedup, packing, robust_quality, runtime, substring_dedup, token_store


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = runtime.fresh_path(spark, "store")
    token_store.write_store(_read(spark, sf_dir, "documents"), target)
    return token_store.verify_store(spark, target)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), k=3, percent=90)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), count=True, every=True)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.render(_read(spark, sf_dir, "conversations"))


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_documents(_read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op10_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_quality.quality_verdicts(_read(spark, sf_dir, "documents")).drop("distance2")


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_store, op2_ngram_jaccard_join, op3_substring_dedup, op4_line_dedup, op5_chat_collapse, op6_hash_tree_sharding, op7_best_fit_packing, op8_benchmark_decontamination, op9_url_reputation, op10_robust_quality)
}


def _op2_sql() -> str:
    return r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""


def _op3_sql() -> str:
    return r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS g FROM later, range(0, 20) t(k) GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n, CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(g, p[2])), lambda p: p[1]) END AS k
  FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


def _op5_sql() -> str:
    return r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS idx,
         count(*) OVER (PARTITION BY conv_id) AS total
  FROM conversations WHERE conv_id IS NOT NULL
), upto AS (
  SELECT conv_id, idx, total,
    string_agg(coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-'), '') OVER w AS p,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '') OVER w AS rendered
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), whole AS (SELECT p, idx, min(conv_id) AS conv_id, count(*) AS n_copies, min(rendered) AS rendered FROM upto WHERE idx = total GROUP BY p, idx)
SELECT conv_id, idx AS n_turns, n_copies, rendered FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM upto u WHERE u.idx < u.total AND u.idx = w.idx AND u.p = w.p)
"""


def _op8_sql() -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
keys AS (
  SELECT item_id, i - 1 AS q, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM keys),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT p.doc_id, p.i, p.n, k.item_id, k.q FROM places p JOIN keys k ON p.n = k.n AND p.x = k.x),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, range(0, 13) t(k) WHERE k < n GROUP BY doc_id),
runs AS (
  SELECT doc_id, item_id, min(i) - 1 AS first, min(q) AS place, count(*) + any_value(n) - 1 AS size
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - q ORDER BY i) AS g FROM found) GROUP BY doc_id, item_id, i - q, g
), longest AS (
  SELECT doc_id, size AS longest_words, first AS longest_start, CAST(item_id AS VARCHAR) AS longest_item, place AS longest_item_start
  FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, first, CAST(item_id AS VARCHAR) NULLS LAST, place) = 1
),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(longest_words, 0) AS longest_words, coalesce(longest_start, -1) AS longest_start, longest_item, coalesce(longest_item_start, -1) AS longest_item_start
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


def _op9_sql() -> str:
    rules = sorted(host_reputation.RULES, key=lambda r: (-len(str(r)), str(r)))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    pick = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in rules) + " END"
    strength = lambda t, own: f"""{own} AS (
  SELECT 1 / least(greatest(coalesce(CASE WHEN k > 1 AND a - (k - 1) > 1e-9 THEN (s - (k - 1)) / (a - (k - 1)) END, {host_reputation.LEAST_RHO}), {host_reputation.LEAST_RHO}), {host_reputation.MOST_RHO}) - 1 AS m, rate
  FROM (SELECT k, rate, t - t2 / CAST(t AS DOUBLE) AS a, (b2 - 2 * rate * b + rate * rate * t) / (rate * (1 - rate)) AS s
        FROM (SELECT count(*) AS k, sum(n) AS t, sum(bad) AS b, sum(n * n) AS t2, sum(bad * bad / CAST(n AS DOUBLE)) AS b2,
                     CAST((coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS DOUBLE) AS rate FROM {t} WHERE n > 0)))"""  # noqa: E731
    return rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), outcome AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id
), bares AS (
  SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM urls
), levels AS (
  SELECT host, CASE WHEN number THEN bare WHEN wide THEN regexp_extract(bare, '([^.]*\.)?[^.]*\.[^.]*$', 0) ELSE regexp_extract(bare, '([^.]*\.)?[^.]*$', 0) END AS domain,
         CASE WHEN number THEN '' WHEN wide THEN regexp_extract(bare, '[^.]*\.[^.]*$', 0) ELSE regexp_extract(bare, '[^.]*$', 0) END AS suffix
  FROM (SELECT *, regexp_matches(bare, '^([0-9]+(\.[0-9]+){{3}}|\[.*\])$') AS number, regexp_extract(bare, '[^.]*\.[^.]*$', 0) IN ({", ".join(f"'{x}'" for x in host_reputation.SUFFIXES)}) AS wide FROM bares)
), hosts AS (
  SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM urls JOIN levels USING (host) LEFT JOIN outcome ON page_id = doc_id GROUP BY host
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
{strength("suffixes", "ms")}, {strength("domains", "md")}, {strength("hosts", "mh")},
s AS (SELECT suffix, (bad + ms.m * mh.rate) / (n + ms.m) AS mean FROM suffixes, ms, mh),
d AS (SELECT domain, (bad + md.m * s.mean) / (n + md.m) AS mean FROM domains JOIN s USING (suffix), md),
h AS (SELECT host, n, bad, bad + mh.m * d.mean AS a, n - bad + mh.m * (1 - d.mean) AS b FROM hosts JOIN d USING (domain), mh)
SELECT page_id, host, path, {pick(str)} AS rule,
       coalesce({pick(lambda r: r.verdict)}, CASE WHEN a / (a + b) - {host_reputation.BOUND_Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {host_reputation.MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS n_labelled, CAST(bad AS BIGINT) AS n_bad
FROM urls JOIN h USING (host)
"""


ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": _op2_sql(),
    "op3_substring_dedup": _op3_sql(),
    "op5_chat_collapse": _op5_sql(),
    "op8_benchmark_decontamination": _op8_sql(),
    "op9_url_reputation": _op9_sql(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {**OPERATORS, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
