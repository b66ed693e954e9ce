"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitlens.llm import (
    chat, contamination, html_text, langid, license_scan, mixing, periodic_runs, prefix_trie, simhash, token_file,
    topk, toxicity, url_filter,
)
from admitlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 5
""")
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query("op7_token_file")
def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_file(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_decontamination", """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[0-9a-z\\x{80}-\\x{10FFFF}]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len, list_aggregate(w[s:s + len - 1], 'string_agg', ' ') AS gram
  FROM (SELECT item_id, w, least(13, len(w)) AS len, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s
        FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, s, len, list_aggregate(w[s:s + len - 1], 'string_agg', ' ') AS gram
  FROM (SELECT rid, w, l.len, unnest(range(1, len(w) - l.len + 2)) AS s
        FROM d, (SELECT DISTINCT len FROM bw) l WHERE len(w) >= l.len)
), m AS (
  SELECT rid, s, dw.len, item_id FROM dw JOIN bw USING (gram)
), h AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(s, s + len)) AS p FROM m) GROUP BY rid
), i AS (
  SELECT rid, count(DISTINCT item_id) AS n_items,
         list_aggregate(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), 'string_agg', ',') AS ids
  FROM m GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(table(spark, sf_dir, "documents"))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op10_preferences", """
WITH said AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), replied AS (
  SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS n
  FROM said
), picked AS (
  SELECT conv_id, turns, n, turns[n].text AS reply, least((row_number() OVER (ORDER BY conv_id) - 1) // 1024,
         greatest(count(*) OVER () // 1024, 1) - 1) AS block FROM replied WHERE n IS NOT NULL
), swapped AS (
  SELECT *, coalesce(lead(reply) OVER (PARTITION BY block ORDER BY conv_id),
                     first_value(reply) OVER (PARTITION BY block ORDER BY conv_id)) AS other
  FROM picked
), cut AS (
  SELECT *, CASE WHEN reply = other THEN n ELSE n - 1 END AS k FROM swapped
)
SELECT conv_id AS pair_id,
       coalesce(list_aggregate(list_transform(turns[1:k], lambda t: '<|' || replace(t.role, '<|', '< |') || '|>' || chr(10)
                || replace(t.text, '<|', '< |') || '<|end|>' || chr(10)), 'string_agg', ''), '') AS prompt,
       CAST(k AS INTEGER) AS prompt_turns,
       CASE WHEN k = n THEN '' ELSE '<|assistant|>' || chr(10) || replace(reply, '<|', '< |') || '<|end|>' || chr(10) END AS chosen,
       CASE WHEN k = n THEN '' ELSE '<|assistant|>' || chr(10) || replace(other, '<|', '< |') || '<|end|>' || chr(10) END AS rejected,
       CASE WHEN k = n THEN 0 ELSE len(replace(reply, '<|', '< |')) + 8 END AS chosen_learnt,
       CASE WHEN k = n THEN 0 ELSE len(replace(other, '<|', '< |')) + 8 END AS rejected_learnt,
       k < n AS valid
FROM cut
""")
def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    def learnt(name):   # characters to learn of a completion
        return F.aggregate(F.filter(name, lambda s: s["learn"]), F.lit(0).cast("bigint"),
                           lambda n, s: n + F.char_length(s["text"]))

    p = chat.preferences(chat.exchanged_replies(table(spark, sf_dir, "conversations")))
    return p.select("pair_id", "prompt", "prompt_turns", "chosen", "rejected",
                    learnt("chosen_segments").alias("chosen_learnt"),
                    learnt("rejected_segments").alias("rejected_learnt"), "valid")


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = periodic_runs.with_periodic_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digest(periodic_runs.find_runs(texts))


@query("op12_url_filter")
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
                                   ("net/es/", "block"), ("net/fr/", "block")], "rule string, verdict string")
    examples = spark.createDataFrame(url_filter.LABELLED, "url string, block boolean")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, examples)


@query("op11_prefix_trie", """
WITH said AS (
  SELECT conv_id, crc AS h, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, sha256(text)) AS t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
          xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
            list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                     lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS crc
        FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id, crc
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) AS t
  FROM said c LEFT JOIN said b ON b.conv_id = c.conv_id - c.conv_id % 100
), cut AS (
  SELECT conv_id, len(t) AS size, unnest(range(0, len(t) + 1)) AS depth, t FROM rebuilt
), at_node AS (
  SELECT conv_id, size, depth, CASE WHEN depth > 0 THEN length(t[depth].text) ELSE 0 END AS chars, t[1:depth] AS node FROM cut
), nodes AS (
  SELECT node, depth, min(conv_id) AS first, count(*) AS n, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends,
         bool_and(size = depth) AS leaf
  FROM at_node GROUP BY node, depth
), below AS (
  SELECT DISTINCT a.first AS conv_id, a.depth, b.first AS low_id, b.depth AS low_depth, b.n, b.chars, b.leaf
  FROM nodes a JOIN at_node m ON m.node = a.node AND m.depth = a.depth
  JOIN at_node l ON l.conv_id = m.conv_id AND l.depth >= a.depth
  JOIN nodes b ON b.node = l.node AND b.depth = l.depth
), sums AS (
  SELECT conv_id, depth, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n - 1) * chars) AS saved,
         count(*) FILTER (WHERE low_depth = depth + 1) AS n_children
  FROM below GROUP BY conv_id, depth
)
SELECT a.first AS conv_id, a.depth, p.first AS parent_conv_id, a.n AS n_convs, s.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM nodes a JOIN sums s ON s.conv_id = a.first AND s.depth = a.depth
LEFT JOIN nodes p ON p.depth = a.depth - 1 AND p.node = a.node[1:a.depth - 1]
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.rebuilt(prefix_trie.placed_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, convs)
