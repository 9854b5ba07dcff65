"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm import embedding_dedup, line_dedup, minhash, packing, quality_rules, sentencepiece_fst, sharding, token_counts, url_filter, warc
from gridstone.llm.common import shared_folder, table

#: The rules that op2's contract names: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The table of listed urls that op2 blocks where no rule of the contract fits; without one it blocks LISTED.
URL_LIST = "spark.gridstone.url.list"
#: Listed canonical hosts, blocked with their subdomains.
LISTED = tuple((f"{name}.example.{top}", "", "block") for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
N_SHARDS = 16


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", "source", (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    dealt = sharding.interleave(narrow, N_SHARDS, ties=("text_crc32", "size"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    folder = spark.conf.get(URL_LIST, None)
    listed = url_filter.read_listing(spark, folder) if folder else url_filter.listing(spark, LISTED)
    judged = url_filter.judge_by_rules(pages, url_filter.listing(spark, RULES), listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, tokenizer("word_bpe_49k.json"), token_counts.own_cache(spark))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_fst.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.octet_length("decoded").cast("long").alias("decoded_bytes"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_url_filter, op3_minhash, op4_quality_rules, op5_token_counts, op6_packing, op7_sentencepiece, op8_warc, op9_embedding_dedup, op10_line_dedup)} | {"pipeline": pipeline}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


def _unescaped(column: str) -> str:
    """url_filter.unescaped() of a column."""
    letter = "chr(TRY_CAST('0x' || substr(p, 1, 2) AS INT))"
    known = f"CASE WHEN regexp_full_match({letter}, '[A-Za-z0-9._~-]') THEN {letter} || substr(p, 3) ELSE '%' || upper(substr(p, 1, 2)) || substr(p, 3) END"
    part = f"CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[0-9A-Fa-f]{{2}}') THEN {known} ELSE '%' || p END"
    return f"array_to_string(list_transform(string_split({column}, '%'), lambda p, i: {part}), '')"


_FILLED = r"[^\x20\x09-\x0D]"

#: The table of CRC-32 by its rule, and a text's checksum by it.
_CRC_TABLE = "SELECT list(v ORDER BY i) tab FROM (SELECT i, list_reduce(range(0, 8), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), i) v FROM range(0, 256) r(i))"
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: ('0x' || b)::BIGINT), lambda a, n: xor(a >> 8, list_extract(tab, CAST(xor(a, n) & 255 AS INT) + 1)), 4294967295::BIGINT), 4294967295::BIGINT)"

SQL = {
    "op1_sharding": f"""
WITH t AS ({_CRC_TABLE}),
d AS (SELECT doc_id, coalesce('=' || source, '') s, coalesce(text, '') x FROM documents),
k AS (SELECT doc_id, s, CAST(strlen(x) + 1 AS BIGINT) size, {_CRC} crc, ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT key FROM d, t),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY key, doc_id NULLS FIRST, crc, size) rk, count(*) OVER (PARTITION BY s) c FROM k),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * rk - 1 AS DOUBLE) / CAST(2 * c AS DOUBLE), s, key, doc_id NULLS FIRST, crc, size) - 1 place, count(*) OVER () n FROM r)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(place * {N_SHARDS} // n AS INT) AS shard, CAST(place - ((place * {N_SHARDS} // n) * n + {N_SHARDS - 1}) // {N_SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM o""",
    "op9_embedding_dedup": """
WITH RECURSIVE e AS (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings),
g AS (SELECT r, vec_id, v, coalesce(len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0, FALSE) ok FROM e),
p AS (SELECT a.r a, b.r b FROM g a JOIN g b ON a.r <> b.r AND a.ok AND b.ok AND len(a.v) = len(b.v) WHERE a.v = b.v OR list_cosine_similarity(a.v, b.v) >= 0.95),
c(node, seen) AS (SELECT r, r FROM g UNION SELECT c.node, p.b FROM c JOIN p ON c.seen = p.a),
m AS (SELECT node, min(vec_id) low FROM c JOIN g ON g.r = c.seen GROUP BY node),
n AS (SELECT a, count(*) n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low AS component_id, vec_id IS NOT DISTINCT FROM low AS kept FROM g JOIN m ON m.node = g.r LEFT JOIN n ON n.a = g.r""",
    "op2_url_filter": rf"""
WITH p AS (SELECT page_id, coalesce(url, '') u FROM pages),
h AS (SELECT page_id, CASE WHEN contains(u, '://') THEN translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END host,
  CASE WHEN contains(u, '://') THEN regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END path FROM p),
r(rh, rp, rv) AS (VALUES {_values(RULES)}),
l(lh, lp, lv) AS (VALUES {_values(LISTED)}),
e AS (SELECT DISTINCT host, path, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\z', '') bare FROM h),
x AS (SELECT host, path, {_unescaped('bare')} bh, {_unescaped('path')} bp FROM e),
d AS (SELECT host, path, regexp_replace(translate(bh, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\.+\z', '') ch, CASE WHEN contains(bp, '/.') THEN
  list_reduce(string_split(bp, '/')[2:], lambda a, s: CASE WHEN s = '.' THEN a WHEN s = '..' THEN regexp_replace(a, '/[^/]*\z', '') ELSE a || '/' || s END, '')
  || CASE WHEN string_split(bp, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE bp END cp FROM x),
f AS (SELECT host, path, max_by(rh || rp, length(rh || rp) * 1000 + length(rh)) AS rule, max_by(rv, length(rh || rp) * 1000 + length(rh)) v FROM d JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
g AS (SELECT host, path, max_by(lv, length(lh || lp) * 1000 + length(lh)) w FROM d JOIN l ON (ch = lh OR ends_with(ch, '.' || lh)) AND starts_with(cp, lp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, w, 'allow') AS verdict FROM h LEFT JOIN f USING (host, path) LEFT JOIN g USING (host, path)""",
    "op8_warc": """
WITH r AS (SELECT page_id, coalesce(html, '') p FROM pages),
k AS (SELECT p, max(page_id) keeper FROM r GROUP BY p),
b AS (SELECT page_id, p, keeper, sha1(p) hx FROM r JOIN k USING (p)),
n AS (SELECT *, list_transform(range(0, 32), lambda i: ('0x' || CASE WHEN (i * 5) // 4 < 39 THEN substr(hx || '0', CAST((i * 5) // 4 + 1 AS INT), 2) ELSE '00' END)::BIGINT) q FROM b)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((q[i + 1] >> (3 - (i * 5) % 4)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM n""",
    "op10_line_dedup": rf"""
WITH t AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) l FROM documents),
b AS (SELECT l, min(doc_id) owner FROM t WHERE regexp_matches(l, '{_FILLED}') GROUP BY l HAVING count(DISTINCT coalesce('=' || source, '')) >= {line_dedup.LEAST_SITES}),
s AS (SELECT doc_id, text, string_split(text, chr(10)) a FROM documents),
e AS (SELECT doc_id, text, a, unnest(a) l, generate_subscripts(a, 1) i FROM s),
k AS (SELECT doc_id, text, a, l, i, owner IS NOT NULL AND owner <> doc_id gone FROM e LEFT JOIN b USING (l))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
