"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, minhash, pieces, pii, toxicity, urlrules, warc
from .common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
v AS (SELECT k, item, least(len(w), 13) AS n, unnest(range(greatest(len(w) - 12, 1))) AS q, w FROM b WHERE len(w) > 0),
v2 AS (SELECT k, item, n, q, array_to_string(w[q + 1 : q + n], ' ') AS s FROM v),
u AS (SELECT r, n, unnest(range(len(w) - n + 1)) AS p, w FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
u2 AS (SELECT r, n, p, array_to_string(w[p + 1 : p + n], ' ') AS s FROM u),
m AS (SELECT r, k, item, v2.n, p, q FROM u2 JOIN v2 ON u2.n = v2.n AND u2.s = v2.s),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r),
i AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY r),
g AS (SELECT r, k, n, p, p - q AS lag, p - row_number() OVER (PARTITION BY r, k, p - q ORDER BY p) AS run FROM m),
o AS (SELECT r, min(p) AS place, max(p) + max(n) - min(p) AS size FROM g GROUP BY r, k, lag, run),
l AS (SELECT r, max(size) AS longest_match, arg_min(place, place - size * 1000000000) AS match_at FROM o GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest_match, 0) AS longest_match, coalesce(match_at, -1) AS match_at
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r) LEFT JOIN l USING (r)
"""


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = shared_dir(spark, "warc"), table(spark, sf_dir, "pages")
    warc.write(pages, folder)
    warc.build_index(spark, folder)
    return warc.lookup(pages, folder)


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out(table(spark, sf_dir, "documents"))


def op8_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.by_parity(table(spark, sf_dir, "conversations")))


OP8_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side,
         CAST(turn AS BIGINT) AS pos, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations),
m AS (
  SELECT pair_id, pos,
         coalesce(list_sort(list({'r': role, 't': text}) FILTER (side = 0)), []) AS c,
         coalesce(list_sort(list({'r': role, 't': text}) FILTER (side = 1)), []) AS r
  FROM t GROUP BY ALL),
d AS (SELECT pair_id, min(pos) FILTER (c <> r) AS differs FROM m GROUP BY pair_id),
i AS (SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id FROM t GROUP BY pair_id),
s AS (
  SELECT t.pair_id, t.pos, t.side, t.role, t.text,
         CASE WHEN d.differs IS NULL OR t.pos < d.differs THEN 'p' WHEN t.side = 0 THEN 'c' ELSE 'r' END AS kind,
         '<|im_start|>' || t.role || chr(10) AS head, t.text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN d ON t.pair_id = d.pair_id),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, kind, side ORDER BY pos, role, text) AS upto
  FROM s)
SELECT i.pair_id, CAST(0 AS BIGINT) AS part, i.chosen_id, i.rejected_id,
       CAST(count(*) FILTER (kind = 'p' AND side = 0) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(head || body, '' ORDER BY pos, role, text) FILTER (kind = 'p' AND side = 0), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY pos, role, text) FILTER (kind = 'c'), '') AS chosen,
       coalesce(string_agg((upto - length(body))::BIGINT || ':' || upto::BIGINT, ',' ORDER BY pos, role, text) FILTER (kind = 'c' AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(head || body, '' ORDER BY pos, role, text) FILTER (kind = 'r'), '') AS rejected,
       coalesce(string_agg((upto - length(body))::BIGINT || ':' || upto::BIGINT, ',' ORDER BY pos, role, text) FILTER (kind = 'r' AND role = 'assistant'), '') AS rejected_spans
FROM o JOIN i ON o.pair_id = i.pair_id GROUP BY ALL
"""


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.production(spark, pages).select("page_id", "host", "path", "rule", "verdict", "method_rule")


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
v AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
         list_transform(list_filter(@RULES@, lambda r: regexp_matches(host || path, r.p)), lambda r: r.n) AS ws
  FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN len(ws) > 0 THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL AND len(ws) > 0 THEN list_reverse_sort(list_transform(ws, lambda w: {'n': len(w), 'w': w}))[1].w END AS method_rule
FROM v
""".replace("@RULES@", "[" + ", ".join(f"{{'n': '{r.name}', 'p': '{r.pattern}'}}" for r in urlrules.METHOD) + "]")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_warc_index": op2_warc_index,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_toxicity": op4_toxicity,
        "op5_pii": op5_pii,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_nearest": op7_nearest,
        "op8_chat_preferences": op8_chat_preferences,
        "op9_language": op9_language,
        "op10_url_rules": op10_url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1_SQL,
        "op2_warc_index": OP2_SQL,
        "op8_chat_preferences": OP8_SQL,
        "op10_url_rules": OP10_SQL,
    }
