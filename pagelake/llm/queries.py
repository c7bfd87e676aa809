"""The queries op1 to op10 and the pipeline over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embedding_dedup, language_id, packing, simhash, suffix_dedup, token_files, toxicity, url_filter
from .common import cut, scratch
from .tokens import public_path as vocabulary  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", 2)
    return token_files.read(spark, path)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cut(packing.pieces(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", 1), "pieces")
    return packing.pack(items)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.page_outcomes(_table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


#: The conversation that holds control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    back = chat.read_chats(chat.format_chats(turns.union(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(language_id.learned_rows(docs))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(language_id.crc32_mod4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, toxicity.grades(_table(spark, sf_dir, "labels"))))


OP7_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
e AS (SELECT *, length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>')) + (role = 'end' OR starts_with(role, '>'))::INT AS r,
             length(regexp_replace(replace(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>'), '\\[(image|audio|document) ', '\\\\[\\1 ', 'g')) AS x FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(2 + r + 2 + x + 7)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

#: All pairs of a label: right at any size, quick on small tables only.
OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(DISTINCT b) AS n_links FROM l GROUP BY a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

_TWO = ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL_SUFFIXES)
OP5_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
k AS (SELECT doc_id, min(CASE WHEN coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels
      WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
s AS (SELECT u.*, k.good, string_split(host, '.') AS p FROM u LEFT JOIN k ON k.doc_id = u.page_id),
s2 AS (SELECT *, array_to_string(p[-2:], '.') AS two FROM s),
d AS (SELECT page_id, host, path, good, CASE WHEN two IN ({_TWO}) THEN array_to_string(p[-3:], '.') ELSE two END AS domain,
             CASE WHEN two IN ({_TWO}) THEN two ELSE p[-1] END AS suffix FROM s2),
t AS (SELECT (coalesce(sum(good), 0) + 8.0 * 0.5) / (count(good) + 8.0) AS base FROM d),
gh AS (SELECT 'h' AS level, domain AS parent, count(good)::DOUBLE AS n, sum(good)::DOUBLE AS g FROM d GROUP BY host, domain HAVING count(good) > 0),
gd AS (SELECT 'd' AS level, suffix AS parent, count(good)::DOUBLE AS n, sum(good)::DOUBLE AS g FROM d GROUP BY domain, suffix HAVING count(good) > 0),
gs AS (SELECT 's' AS level, '' AS parent, count(good)::DOUBLE AS n, sum(good)::DOUBLE AS g FROM d GROUP BY suffix HAVING count(good) > 0),
pa AS (SELECT level, parent, sum(n) AS pn, sum(g) AS pg, sum(n * n) AS nn, sum(g * g / n) AS s, count(*) AS k
       FROM (SELECT * FROM gh UNION ALL SELECT * FROM gd UNION ALL SELECT * FROM gs) GROUP BY level, parent),
lv AS (SELECT level, sum(k) AS k, count(*) AS p, sum(pn) AS n, sum(pg) AS g, sum(s) AS s, sum(pg * pg / pn) AS t, sum(nn / pn) AS q FROM pa GROUP BY level),
ms AS (SELECT level, (s - t) / (k - p) AS b, (g - s) / (n - k) AS w, (n - q) / (k - p) AS z FROM lv WHERE k > p AND n > k),
st AS (SELECT level, round(CASE WHEN (b - w) / (b + (z - 1) * w) > 0 THEN greatest(1.0, least(1000.0, 1 / ((b - w) / (b + (z - 1) * w)) - 1)) ELSE 1000.0 END, 6) AS weight
       FROM ms WHERE b + (z - 1) * w <> 0),
wt AS (SELECT coalesce(max(weight) FILTER (level = 'h'), 8.0) AS hw, coalesce(max(weight) FILTER (level = 'd'), 8.0) AS dw, coalesce(max(weight) FILTER (level = 's'), 8.0) AS sw FROM st),
sx AS (SELECT suffix, (coalesce(sum(good), 0) + any_value(sw) * any_value(base)) / (count(good) + any_value(sw)) AS sm FROM d, t, wt GROUP BY suffix),
dx AS (SELECT domain, (coalesce(sum(good), 0) + any_value(dw) * any_value(sm)) / (count(good) + any_value(dw)) AS dm FROM d JOIN sx USING (suffix), wt GROUP BY domain),
hx AS (SELECT host, coalesce(sum(good), 0) + any_value(hw) * any_value(dm) AS a, count(good) - coalesce(sum(good), 0) + any_value(hw) * (1 - any_value(dm)) AS b
       FROM d JOIN dx USING (domain), wt GROUP BY host),
v AS (SELECT host, a / (a + b) + 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM hx),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) x(verdict, h, p)),
m AS (SELECT page_id, host, path, upper, h || p AS rule, r.verdict AS rv, row_number() OVER (PARTITION BY u.page_id, host, path ORDER BY length(h || p) DESC) AS n
      FROM u JOIN v USING (host) LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM m WHERE n = 1"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_simhash, op2_token_files, op3_decontaminate, op4_packing, op5_url_filter, op6_suffix_dedup, op7_chat, op8_embedding_dedup, op9_language_id, op10_toxicity]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op5_url_filter": OP5_SQL, "op7_chat": OP7_SQL, "op8_embedding_dedup": OP8_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
