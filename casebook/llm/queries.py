"""The registered queries of this subpackage, each an operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casebook.llm import bpe, centroids, fm_index, language, packing, perplexity, prefix_free, product_codes, simhash, sketches, token_counts, token_store, wrappers
from casebook.llm.storage import shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(_table(spark, folder, "pages"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.fingerprint_edits(_table(spark, folder, "documents"))


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, ids=False)


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return fm_index.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("items")


def token_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = shared_folder(spark)
    token_store.write_tokens(_table(spark, folder, "documents"), files, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.token_checks(token_store.read_tokens(spark, files))


def quality(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels")).drop("text_key")


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_free.removal_digests(_table(spark, folder, "documents"))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language.identify(docs, language.train(docs))


def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return product_codes.compress(_table(spark, folder, "embeddings"))


def best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_report(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_texts": page_texts,
    "op2_fingerprints": fingerprints,
    "op3_byte_bpe": byte_bpe,
    "op4_decontamination": decontamination,
    "op5_token_counts": token_lengths,
    "op6_token_files": token_files,
    "op7_quality": quality,
    "op8_simhash": simhash_groups,
    "op9_suffix_dedup": suffix_dedup,
    "op10_languages": languages,
    "op11_vector_codes": vector_codes,
    "op12_best_fit": best_fit,
    "op13_centroids": clusters,
}

#: Words of both tables as the operator takes them, windows of item words found in the texts, and their words counted.
_DECONTAMINATION = r"""WITH upper_case AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a),
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, lower(a)), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents, upper_case),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), a, lower(a)), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark, upper_case),
phrases AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, (SELECT DISTINCT n FROM phrases))),
found AS (SELECT doc_id, i, n, item FROM places JOIN phrases USING (n, phrase)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

#: Every 100-byte window of every text by its content, all but the first in order again, and the runs they cover.
_SUFFIX_DEDUP = r"""WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, s, md5(substr(h, 2 * s - 1, 200)) AS content
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 98)) AS s FROM bytes)),
again AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, s) > 1),
opened AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS opens FROM again),
runs AS (
  SELECT doc_id, min(s) AS first_byte, max(s) + 99 AS last_byte
  FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM opened) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(last_byte) OVER (PARTITION BY doc_id ORDER BY first_byte), 0) + 1 AS a, first_byte - 1 AS z FROM runs
  UNION ALL SELECT doc_id, max(last_byte) + 1, 9223372036854775807 // 4 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a - 1, least(2 * (z - a + 1), length(h))), '' ORDER BY a) AS h FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(last_byte - first_byte + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, length(b.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.h, b.h))) AS kept_sha256
FROM bytes b LEFT JOIN kept k USING (doc_id) LEFT JOIN sums USING (doc_id)"""

#: Vectors that both vector operators take, and the exact floor of a sum s of n integers.
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
_MEAN = "CAST((s - (s % n + n) % n) // n AS BIGINT)"
_APART = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _integers(factor: int) -> str:
    return f"list_transform(embedding, lambda e: CAST(floor({factor} * CAST(e AS DOUBLE)) AS BIGINT))"


def _refined(rounds: int, keys: str, vectors: str) -> str:
    """CTEs c1, a1 ... of so many rounds from entries c0 (part, c, x): nearest entries of `vectors`, then their means."""
    steps = []
    for at in range(rounds + 1):
        steps.append(f"""a{at} AS MATERIALIZED (
  SELECT {keys}, part, x, c, d FROM (
    SELECT v.*, c.c, {_APART} AS d, row_number() OVER (PARTITION BY v.vec_id, v.part ORDER BY {_APART}, c.c) AS place
    FROM {vectors} v JOIN c{at} c USING (part)) WHERE place = 1)""")
        if at < rounds:
            steps.append(f"""c{at + 1} AS MATERIALIZED (
  SELECT o.part, o.c, coalesce(f.x, o.x) AS x FROM c{at} o LEFT JOIN (
    SELECT part, c, list({_MEAN} ORDER BY i) AS x FROM (
      SELECT part, c, i, CAST(sum(e) AS HUGEINT) AS s, count(*) AS n
      FROM (SELECT part, c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{at}) GROUP BY part, c, i)
    GROUP BY part, c) f USING (part, c))""")
    return ",\n".join(steps)


_VECTOR_CODES = f"""WITH kept AS (
  SELECT vec_id, label, {_integers(4096)} AS x FROM embeddings WHERE {_FINITE}),
cut AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // 8) + 1:(part + 1) * (len(x) // 8)] AS x FROM kept, range(8) r(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM kept QUALIFY c < 16),
c0 AS MATERIALIZED (SELECT part, c, x FROM cut JOIN first USING (vec_id)),
{_refined(6, "vec_id, label", "cut")},
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, c)) AS codebooks_sha256 FROM c6),
rows AS (SELECT vec_id, label, string_agg(printf('%02x', c), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM rows, books"""

_CENTROIDS = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, 0 AS part, {_integers(64)} AS x FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM kept QUALIFY c < 16),
{_refined(3, "vec_id", "kept")}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON a.c = c.c"""

#: The other operators tokenise, hash with XXH64, sketch or train: SQL can't express them.
ORACLES: dict[str, str] = {
    "op4_decontamination": _DECONTAMINATION,
    "op9_suffix_dedup": _SUFFIX_DEDUP,
    "op11_vector_codes": _VECTOR_CODES,
    "op13_centroids": _CENTROIDS,
}
