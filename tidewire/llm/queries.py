"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.substring import remove_duplicates

    return remove_duplicates(table(spark, sf_dir, "documents"), ["kept_sha256"])


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.toxicity import held_out, score_documents, train

    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = score_documents(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_start", "worst_end")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digests=True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_url_filter, op3_minhash_near_dedup, op4_substring_dedup, op5_best_fit_packing, op6_toxicity, op7_sentencepiece, op8_token_counts, op9_top_k, op10_embedding_dedup, op11_spelling_variants, op12_filter_audit, op13_warc)}

_SPLIT_URLS = r"""
SELECT page_id, url,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
FROM pages"""

ORACLES = {
    "op2_url_filter": rf"""
WITH split AS ({_SPLIT_URLS}),
judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged""",
    "op9_top_k": """
WITH parts AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
q AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM q a JOIN q b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_spelling_variants": r"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT range::UINTEGER, 0, range::UINTEGER FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
bytes AS (
  SELECT doc_id, run, n, t, list_transform(string_split(regexp_replace(hex(encode(doc_id || ':' || run)), '(..)', '\1 ', 'g'), ' '), lambda x: x) AS pairs FROM counted, crc),
digests AS (
  SELECT doc_id, run, n, xor(4294967295::UINTEGER, list_reduce(
    list_prepend(4294967295::UINTEGER, list_transform(pairs[1:-2], lambda x: CAST('0x' || x AS UINTEGER))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM bytes),
results AS (
  SELECT n, CASE WHEN doc_id IS NOT NULL AND h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM digests),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS (
  SELECT a.word AS word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT near.word AS word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, encode(other)) AS r
  FROM near JOIN words o ON near.other = o.word),
formed AS (
  SELECT w.word AS word, w.n AS n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
chain(word, root, form) AS (
  SELECT word, word, form FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.form = f.word)
SELECT f.word AS word, f.form AS form, c.root AS root, n, n_near, form_n FROM formed f JOIN chain c ON f.word = c.word AND c.form IS NULL""",
    "op12_filter_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text),
f AS (
  SELECT w.doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * length(w.text))::INT
    + 8 * regexp_matches(w.text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS fails
  FROM w JOIN firsts ON w.text = firsts.text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, fails),
letters AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda k: chr(65 + k)), '') AS filter_order, s AS step, CAST(power(2, o[s]) AS INT) AS own,
    CAST(coalesce(list_sum(list_transform(o[1:s - 1], lambda k: power(2, k))), 0) AS INT) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (WHERE fails & (own | earlier) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE fails & own > 0 AND fails & earlier = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE fails & own > 0 AND fails & earlier > 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE fails = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE fails & own > 0 AND fails & earlier = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE fails & own > 0 AND fails & earlier = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 / bit_count(fails)) FILTER (WHERE fails & own > 0), 0) AS BIGINT) AS shapley
FROM m, steps GROUP BY part, filter_order, step""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, row_number() OVER same AS r, max(page_id) OVER (PARTITION BY html) AS last FROM p WINDOW same AS (PARTITION BY html ORDER BY page_id DESC))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND r > 1 THEN last END AS refers_to
FROM d""",
}
