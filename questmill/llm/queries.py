"""The thin queries of this subpackage, one for each operator, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questmill.llm.bpe import bpe_decode, bpe_encode
from questmill.llm.common import fresh_path, table
from questmill.llm.embed_dedup import embedding_components
from questmill.llm.exact_dedup import exact_dedup
from questmill.llm.html_extract import extract, fit
from questmill.llm.lexical import build_index, search
from questmill.llm.license_scan import PHRASES, TEMPLATES, scan_licenses
from questmill.llm.lm_score import backoff_scores
from questmill.llm.ngram_join import ngram_components
from questmill.llm.packing import pack_sequences, pieces_of
from questmill.llm.quality import score, train
from questmill.llm.token_align import align
from questmill.llm.token_store import crc_of_tokens, read_tokens, write_tokens
from questmill.llm.url_filter import host_of, judge_urls, path_of

#: The tokenizer files of the contracts.
BYTE_BPE, BYTE_VOCABULARY, END = public_tokenizers.path("byte_bpe_50k.json"), 50_257, 0
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

# Fixed values of the URL contract.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Hosts of the block list, under each of three domains.
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_DOMAINS = ["example.com", "example.net", "example.org"]
# There is no list of urls among the tables: those whose md5 begins with this digit, a sixteenth of all, stand in for one.
LISTED_DIGIT = "7"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, length(text) AS n, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS norm FROM t),
g AS (SELECT norm, count(*) AS group_size, arg_max(doc_id, (n, -doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g ON n.norm = g.norm
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "lang", "n_symbols", "perplexity", F.col("good").alias("kept"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents")).withColumn("log10_score", F.round("log10_score", 6))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS b, unnest(list_concat([NULL], w[:-2])) AS a FROM t WHERE len(w) > 0),
c1 AS (SELECT b AS w, count(*) AS c FROM g GROUP BY b),
c2 AS (SELECT a, b, count(*) AS c FROM g WHERE a IS NOT NULL GROUP BY a, b HAVING count(*) >= 2),
s AS (SELECT doc_id, CASE WHEN c2.c IS NOT NULL THEN log10(c2.c / x.c) WHEN g.a IS NULL THEN log10(y.c / (SELECT count(*) FROM g)) ELSE log10(0.4 * y.c / (SELECT count(*) FROM g)) END AS s
  FROM g JOIN c1 y ON y.w = g.b LEFT JOIN c1 x ON x.w = g.a LEFT JOIN c2 ON c2.a = g.a AND c2.b = g.b)
SELECT t.doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(z, 0), 6) AS log10_score FROM t LEFT JOIN (SELECT doc_id, count(*) AS n, sum(s) AS z FROM s GROUP BY doc_id) q ON q.doc_id = t.doc_id
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), WORD_BPE), WORD_BPE)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = [f"{name}.{domain}" for name in BLOCKED_NAMES for domain in BLOCKED_DOMAINS]
    blocked = spark.createDataFrame([(h,) for h in hosts], "key string")
    pages = table(spark, sf_dir, "pages")
    url = F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("key")
    listed = pages.select(url).where(F.substring(F.md5("key"), 1, 1) == LISTED_DIGIT)
    judged = judge_urls(pages, URL_RULES, blocked, host_labels=[3], blocked_urls=listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(regexp_replace(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '[/?#](.|\n)*$', ''), '') AS raw,
    coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS tail FROM pages),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_replace(substr(tail, length(raw) + 1), '[?#](.|\n)*$', '') AS path FROM u),
r AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN md5(host || path) LIKE '7%' THEN 'block'
  WHEN regexp_full_match(host, '(.*\.)?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)') THEN 'block'
  ELSE 'allow' END AS verdict FROM r
"""


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages"), fit(spark))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, BYTE_BPE, BYTE_VOCABULARY, END)
    return crc_of_tokens(read_tokens(spark, path))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pieces_of(table(spark, sf_dir, "documents"), BYTE_BPE, END)
    return pack_sequences(pieces).withColumn("length", F.col("length").cast("long"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH w AS (SELECT doc_id,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
v AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s WHERE term IN (SELECT term FROM q) GROUP BY term),
x AS (SELECT item_id, t.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // l))))::BIGINT AS score
  FROM q JOIN v USING (term) JOIN t USING (term) JOIN d ON d.doc_id = t.doc_id CROSS JOIN s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), TEMPLATES, PHRASES)
    labels = F.array_union(F.col("places.label"), F.col("spans.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.col("coverage").alias("score"),
    )


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)[0]


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_lm_score": op3_lm_score,
    "op4_bpe": op4_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_html_extract": op6_html_extract,
    "op7_token_store": op7_token_store,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_lexical_search": op11_lexical_search,
    "op12_license_scan": op12_license_scan,
    "op13_token_align": op13_token_align,
}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op3_lm_score": OP3_SQL, "op5_url_filter": OP5_SQL, "op11_lexical_search": OP11_SQL}
