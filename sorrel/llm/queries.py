"""The operators' queries: name -> f(spark, sf_dir), and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.warc import dedupe_pages

    return dedupe_pages(spark, _read(spark, sf_dir, "pages")).drop("file")


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.wavelet import tokenize_to_shards

    return tokenize_to_shards(spark, _read(spark, sf_dir, "documents")).drop("file")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.quality import score_quality

    return score_quality(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.gumbel import segmentation_report

    return segmentation_report(spark, _read(spark, sf_dir, "documents"))


def op6_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.toxicity import score_toxicity

    return score_toxicity(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.simhash import near_duplicates

    return near_duplicates(spark, _read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.secrets import secret_report

    return secret_report(_read(spark, sf_dir, "documents"))


def op9_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.crosspolytope import nearest

    return nearest(spark, _read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_itq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.itq import near_vectors

    return near_vectors(spark, _read(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.spelling import spelling_variants

    return spelling_variants(spark, _read(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.prefix_trie import prefix_trie

    return prefix_trie(spark, _read(spark, sf_dir, "conversations"))


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sorrel.llm.context_tree import score_texts

    return score_texts(spark, _read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: base32 of a SHA-1: eight groups of five hexadecimal digits, each four characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {shift}) & 31 AS BIGINT), 1)" for g in range(8) for shift in (15, 10, 5, 0)
)

#: crc32 of the decimal digits of c: a byte is mixed in, then eight shifts.
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))))"


_SQL = {
    "op1_warc_revisits": f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages), w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, url, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM w""",
    "op12_conversation_trie": f"""WITH own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, ts, CAST({_CRC} % 6 AS INTEGER) AS h FROM own), r AS (SELECT h.c, CASE WHEN b.c IS NULL THEN h.ts[h.h + 1:] ELSE list_concat(b.ts[1:h.h], h.ts[h.h + 1:]) END AS ts FROM h LEFT JOIN own AS b ON b.c = h.c - h.c % 100),
p AS (SELECT c, d, ts[1:d] AS p, d = len(ts) AS ends FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.p = k.p AND n.d = k.d),
a AS (SELECT p[1:u] AS p, u AS d, n_children = 0 AS leaf, CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d].text) ELSE 0 END AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM m)),
s AS (SELECT p, d, count_if(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.p = s.p AND m.d = s.d LEFT JOIN n AS above ON above.d = m.d - 1 AND above.p = m.p[1:m.d - 1]""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
