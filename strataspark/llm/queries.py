"""The queries of the corpus operators, with SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import burst_trie, decontaminate, language, license_scan, media, minhash, packing, periodic, pii, secret_scan, sharding, suffix_dedup, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op6_minhash_near_duplicates", rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)


@query("op9_language_viterbi")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs)).withColumn("held_out", language.held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "spans")


@query("op1_suffix_array_decontamination", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
seen AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT doc_id, item, i, seen.k FROM seen JOIN win ON win.s = seen.s AND win.k = seen.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


@query("op4_minimum_slack_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer_path(), ranks=ranks_path(), end_id=2, capacity=1024)


@query("op8_secret_novelty")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


@query("op2_signature_sniffing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(table(spark, sf_dir, "documents"))


@query("op3_anchor_expansion")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op7_kd_tree_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumns({f"{c}_order": sharding.ordered_code(F.col(c)) for c in ("source", "lang")})
    placed = sharding.kd_shards(docs, 40, dims=("n_bytes", "source_order", "lang_order"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_license_winnowing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), width=100)


@query("op13_recompression_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), prepare=periodic.planted)


@query("op11_burst_trie", r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS tid, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t),
r AS (SELECT conv_id, tid, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tid) - 1 AS pos FROM d),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM r)),
b AS (SELECT i.conv_id, 0 AS part, pos, tid, w FROM ids i JOIN r ON r.conv_id = i.base AND r.pos < i.h
  UNION ALL SELECT i.conv_id, 1, pos, tid, w FROM ids i JOIN r ON r.conv_id = i.conv_id AND r.pos >= i.h),
seq AS (SELECT ids.conv_id, coalesce(list(tid ORDER BY part, pos) FILTER (tid IS NOT NULL), []) AS t, coalesce(list(w ORDER BY part, pos) FILTER (tid IS NOT NULL), []) AS w
  FROM ids LEFT JOIN b ON b.conv_id = ids.conv_id GROUP BY ids.conv_id),
steps AS (SELECT conv_id, d, array_to_string(t[1:d], '') AS k, CASE WHEN d > 0 THEN array_to_string(t[1:d - 1], '') END AS up, coalesce(w[d], 0) AS w, d = len(t) AS ends
  FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM seq)),
node AS (SELECT d, k, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM steps GROUP BY d, k),
kids AS (SELECT up, count(*) AS n FROM node WHERE d > 0 GROUP BY up),
sub AS (SELECT s.k, sum((u.n - 1) * u.w) AS saved, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM node u LEFT JOIN kids ON kids.up = u.k JOIN steps s ON s.conv_id = u.conv_id AND s.d <= u.d GROUP BY s.k)
SELECT node.conv_id, node.d::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN sub ON sub.k = node.k LEFT JOIN kids ON kids.up = node.k LEFT JOIN node p ON node.d > 0 AND p.k = node.up
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_trie.prefix_trie(*burst_trie.shared_starts(burst_trie.turns(table(spark, sf_dir, "conversations"))))


@query("op12_channel_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", toxicity.held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted", "restored")
