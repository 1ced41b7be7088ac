"""The registered queries of the text operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tiegraph.llm import common, decontaminate, fingerprint, html_extraction, huffman, jaccard_join, lm_scoring, packing, pii, quality, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


#: A key of the test queries; production takes its own.
PII_KEY = b"tiegraph test key"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "huffman")
    huffman.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return huffman.read(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_LINKS = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) >= 4 THEN list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END g FROM w),
x AS (SELECT doc_id, len(g) n, unnest(g) t FROM s),
p AS (SELECT a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) o FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
k AS (SELECT a, b FROM p WHERE 100 * o >= 85 * (na + nb - o)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id, doc_id reached FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT s.doc_id, len(g)::BIGINT n_shingles, min(reached) component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": _LINKS}
