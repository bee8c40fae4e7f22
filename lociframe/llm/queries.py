"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, bestfit_packing, embedding_dedup, language_id, line_quality, lz_fingerprint, maxent_lm, partenum_join, secret_scan, sentencepiece_codec, warc_archive


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = line_quality.fit_quality(docs, table(spark, sf_dir, "labels"), _shared.fold_of("doc_id", 5) != 0)
    out = line_quality.score_quality(docs, field)
    return out.select("doc_id", (_shared.fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_language(docs, _shared.fold_of("doc_id", 4) != 2)
    out = language_id.identify(docs, model)
    return out.select("doc_id", (_shared.fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.round_trip(table(spark, sf_dir, "pages"))


def op8_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = maxent_lm.fit(docs, _shared.fold_of("doc_id", 7) != 2)
    out = maxent_lm.score(docs, model, counts)
    return out.withColumn("held_out", _shared.fold_of("doc_id", 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (op1_sentencepiece, op2_quality_classifier, op3_secret_scan, op4_lz_fingerprint, op5_embedding_dedup, op6_language_id, op7_warc, op8_bestfit_packing, op9_lm_scoring, op10_ngram_jaccard_join)
    return {f.__name__: f for f in names}


#: What SQL can express over whole tables: pages by digest, and the links of all pairs with the components they make.
_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
bits AS (SELECT page_id, string_agg(lpad(bin(('0x' || substr(hex, i, 1))::INT), 4, '0'), '' ORDER BY i) AS b
         FROM p, range(1, 41) AS r(i) GROUP BY page_id),
b32 AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + list_sum(list_transform(range(0, 5), lambda k: CASE WHEN substr(b, 5 * j + k + 1, 1) = '1' THEN 2 ** (4 - k) ELSE 0 END))::INT, 1), '' ORDER BY j) AS digest
        FROM bits, range(0, 32) AS r(j) GROUP BY page_id)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex) JOIN b32 USING (page_id)
"""


_REACH = """
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
low AS (SELECT a, min(b) AS b FROM r GROUP BY a)
"""
_JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 90 * (na + nb - common)),
{_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id FROM g LEFT JOIN low ON low.a = doc_id
"""
_EMBEDDING_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id < b.vec_id
      WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END),
{_REACH},
n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id <= coalesce(low.b, vec_id) AS kept
FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_embedding_dedup": _EMBEDDING_SQL, "op7_warc": _WARC_SQL, "op10_ngram_jaccard_join": _JACCARD_SQL}
