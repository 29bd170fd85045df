"""The queries of the training-data operators, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import table


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.sentencepieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), max_words=300_000)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), n_shards=24)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.language import predict, train

    docs, path = table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = train(docs.where(~held_out), path, docs_per_language=400)
    return predict(docs, model, path).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.token_ids import read_token_ids, write_token_ids

    return read_token_ids(write_token_ids(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), limit=4096)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.jaccard import link_components

    return link_components(table(spark, sf_dir, "documents"), percent=75)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"), rated_per_grade=6000), least=0.6)


def op11_copartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.copartition import crc_bucket, report_pair, write_pair
    from spanloom.storage import new_folder

    sales, lines = table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines")
    b = F.coalesce(crc_bucket(F.col("sale_id"), 150, "pair"), F.lit(151))
    starts = (b - (b % 5 == 1).cast("int"), F.coalesce(crc_bucket(F.col("item_id"), 150), F.lit(0)))
    return report_pair(write_pair(sales, lines, new_folder(spark, "pair"), "sale_id", starts, files=152, names=("sales", "sale_lines")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = train(docs.where(~held_out), table(spark, sf_dir, "labels"), toxic_docs=4000, clean_docs=12000)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.divergence import audit_sources

    return audit_sources(table(spark, sf_dir, "documents"), min_docs=30, top=50)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontaminate": op2_decontaminate,
    "op3_shards": op3_shards,
    "op4_language": op4_language,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_ids": op6_token_ids,
    "op7_token_counts": op7_token_counts,
    "op8_fingerprints": op8_fingerprints,
    "op9_jaccard": op9_jaccard,
    "op10_quality": op10_quality,
    "op11_copartition": op11_copartition,
    "op12_toxicity": op12_toxicity,
    "op13_divergence": op13_divergence,
}

_OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (
  SELECT DISTINCT item, list_slice(words, i, i + 9) AS win, least(10, len(words)) AS n
  FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, i, n, list_slice(words, i, i + n - 1) AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, lens)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item FROM pos p JOIN win ON p.win = win.win AND p.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

#: CRC-32 by its table: 256 entries made from the polynomial 0xEDB88320.
_OP3_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sized AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size FROM documents),
crc AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM sized, tab),
run AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS first_byte, sum(size) OVER () AS total FROM crc),
cut AS (SELECT *, CAST(first_byte * 24 // total AS INTEGER) AS shard FROM run)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

_OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

_OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS MATERIALIZED (SELECT row, lang, source, unnest(words) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
every AS (SELECT lang, term, sum(n) AS n FROM cell GROUP BY lang, term),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM every),
p AS MATERIALIZED (
  SELECT *, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cell),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.v, 0) AS v
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(v AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY v DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY v DESC, item) <= 50
"""

ORACLE_SQL = {"op13_divergence": _OP13_SQL, "op9_jaccard": _OP9_SQL, "op2_decontaminate": _OP2_SQL, "op3_shards": _OP3_SQL, "op5_line_dedup": _OP5_SQL}
