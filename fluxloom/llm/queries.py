"""The registered corpus queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, decontaminate, embedding_dedup, mixing, quality, simhash, spelling, suffix_dedup, token_counts, token_files, toxicity, url_filter
from .common import table

#: Host and path rules of the url query.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, table(spark, sf_dir, "labels"), URL_RULES, support=0.0001, rows=3)
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.classes(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.col("lang"), F.exp("_score").alias("perplexity"), F.exp("_threshold").alias("threshold"), F.col("_keep").alias("keep"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.misspelled(spelling.runs(table(spark, sf_dir, "documents")), every=97)
    return spelling.variants(spelling.vocabulary(found))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_toxicity,
        op3_decontaminate,
        op4_embedding_dedup,
        op5_quality,
        op6_token_files,
        op7_mix,
        op8_suffix_dedup,
        op9_token_counts,
        op10_simhash,
        op11_spelling,
        op12_bpe,
        op13_align,
    )
}

OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '') AS query
  FROM pages),
words AS (
  SELECT page_id, url, unnest(list_distinct(list_filter(
           [ 'h:' || x for x in string_split(host, '.')] || [ 'p:' || x for x in string_split(path, '/')]
           || [ 'q:' || string_split(x, '=')[1] for x in string_split(query, '&')], lambda x: length(x) > 2))) AS token
  FROM parts),
bad AS (SELECT doc_id AS page_id, min(quality) = 0 AS block FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
known AS (SELECT w.page_id, w.token, b.block FROM words w JOIN bad b USING (page_id)),
least AS (SELECT greatest(3, ceil(0.0001 * count(DISTINCT page_id))) AS n FROM known),
sets AS (
  SELECT page_id, block, [token] AS rule FROM known
  UNION ALL SELECT a.page_id, a.block, [a.token, b.token] FROM known a JOIN known b ON a.page_id = b.page_id AND a.token < b.token
  UNION ALL SELECT a.page_id, a.block, [a.token, b.token, c.token] FROM known a JOIN known b ON a.page_id = b.page_id AND a.token < b.token JOIN known c ON a.page_id = c.page_id AND b.token < c.token),
rules AS (
  SELECT rule FROM sets GROUP BY rule
  HAVING count(*) FILTER (block) >= (SELECT n FROM least) AND count(*) FILTER (block) >= 0.5 * count(*)),
members AS (SELECT rule, len(rule) AS size, unnest(rule) AS token FROM rules),
hits AS (
  SELECT DISTINCT url FROM (
    SELECT url, rule FROM (SELECT DISTINCT url, token FROM words) w JOIN members USING (token) GROUP BY url, rule, size HAVING count(*) = size)),
fixed(verdict, name, start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled AS (
  SELECT p.page_id, p.url, p.host, p.path,
         (SELECT max_by({'rule': f.name || f.start, 'verdict': f.verdict}, length(f.name || f.start)) FROM fixed f
          WHERE (p.host = f.name OR ends_with(p.host, '.' || f.name)) AND starts_with(p.path, f.start)) AS found
  FROM parts p)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, CASE WHEN h.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN hits h USING (url)
"""

OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, text)), 1, 12))::BIGINT AS k
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM sources),
capped AS (
  SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS ratio,
         (1.5 * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2.0 * source_size) OVER b, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, CASE WHEN ratio <= level OR free IS NULL THEN cap ELSE least(cap, free * w) END AS target
  FROM (SELECT *, max(level) FILTER (ratio > level) OVER () AS free FROM capped)),
run AS (
  SELECT d.doc_id, d.size, a.source_size, a.target::DOUBLE AS target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before,
         coalesce(floor(a.target / nullif(a.source_size, 0)), 0)::BIGINT AS epochs
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN size > 0 AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM run
"""

OP11_SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entry FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
long_runs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
           lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [195::UBIGINT, (unicode(x) - 64)::UBIGINT] END)),
           lambda s, b: xor(s >> 8, entry[(xor(s, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h
  FROM long_runs, crc),
planted AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM planted WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
skips AS (SELECT word, n, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON b.word = a.p || a.s
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON b.word = a.p || a.s),
counted AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, encode(other))) AS form FROM near GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN c.form_n >= 2 * w.n THEN c.form END AS form, CASE WHEN c.form_n >= 2 * w.n THEN c.form_n END AS form_n
  FROM words w LEFT JOIN counted c USING (word)),
followed(word, reached) AS (SELECT word, word FROM judged UNION ALL SELECT f.word, j.form FROM followed f JOIN judged j ON j.word = f.reached WHERE j.form IS NOT NULL),
ended AS (SELECT f.word, f.reached AS root FROM followed f JOIN judged j ON j.word = f.reached WHERE j.form IS NULL)
SELECT j.word, j.form, e.root, j.n, j.n_near, j.form_n FROM judged j JOIN ended e USING (word)
"""

ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op7_mix": OP7_SQL, "op11_spelling": OP11_SQL}
