"""The operators' registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import alignment, ans, bpe, covertree, html, language, lexical, mixing, neardup, packing, pii, syncmers, urls
from riskweave.llm.common import bounded_batches
from riskweave.session import scratch_dir

#: The tokenizer file is a parameter of the operators; the queries take this one.
TOKENIZER = "byte_bpe_50k.json"
OTHER_TOKENIZER = "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents"))


def op2_top_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.top_k(_table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_table(spark, folder, "pages"))


def op4_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op5_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op6_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    out = language.held_out(F.col("doc_id"))
    found = language.identify(docs, language.fit(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_dir(spark, "tokens")
    ans.write_tokens(_table(spark, folder, "documents"), files, public_tokenizers.path(TOKENIZER))
    return ans.read_tokens(spark, files, digest=True)


def op8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_table(spark, folder, "documents")).drop("source")


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"), neardup.MinHash(shingle=3, percent=85))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprints(_table(spark, folder, "documents"))


def op11_encoded(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op12_aligned_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER),
                             public_tokenizers.path(OTHER_TOKENIZER))


def op13_ranked_documents(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {q.__name__: q for q in (
    op1_personal_data, op2_top_inner_products, op3_main_text, op4_packed_sequences, op5_url_verdicts,
    op6_languages, op7_token_files, op8_mixture, op9_near_duplicates, op10_fingerprints, op11_encoded,
    op12_aligned_tokens, op13_ranked_documents)}

_OP2 = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""

_OP5 = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS place
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, parts.host, parts.path, fits.rule, coalesce(fits.verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) fits
  ON parts.page_id = fits.page_id AND parts.host = fits.host AND parts.path = fits.path
"""

_OP8 = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, source_size / w AS ratio,
    coalesce(sum(3 * source_size) OVER upto, 0) AS gone, coalesce(sum(w) OVER upto, 0) AS out_w,
    sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
  FROM per WINDOW upto AS (ORDER BY source_size / w, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, CAST(total - gone AS DOUBLE) / CAST(all_w - out_w AS DOUBLE) AS level FROM ordered),
found AS (SELECT min(ratio) AS ratio, arg_min(level, ratio) AS level FROM levels WHERE w * level <= 3 * source_size),
targets AS (
  SELECT source, source_size, CASE WHEN levels.ratio < found.ratio THEN CAST(3 * source_size AS DOUBLE)
    ELSE least(w * found.level, CAST(3 * source_size AS DOUBLE)) END AS target FROM levels, found),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs,
    CAST(round(target) AS BIGINT) AS budget FROM targets),
dealt AS (
  SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'),
      doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM dealt
"""

_OP13 = """
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents),
held AS (SELECT doc_id, doc, t, CAST(len(t) AS BIGINT) AS n FROM terms WHERE len(t) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM held),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
posts AS (
  SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM held)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM posts, totals GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM posts JOIN weights USING (term) JOIN held USING (doc) JOIN asked USING (term), totals GROUP BY item_id, doc)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN held USING (doc) WHERE score > 0)
WHERE rank <= 10
"""

ORACLES = {"op13_ranked_documents": _OP13, "op2_top_inner_products": _OP2, "op5_url_verdicts": _OP5, "op8_mixture": _OP8}
