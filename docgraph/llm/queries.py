"""The registered queries of this subpackage, and their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, url_filter
from .alignment import alignment_counts
from .exact_dedup import exact_groups
from .minhash import minhash_components
from .packing import pack_documents
from .phrases import collocations
from .piece_lattice import encoding_digests
from .shared import documents
from .sharding import shard_documents
from .simhash import simhash_components
from .suffix_dedup import repeated_spans
from .topk_join import exact_top_k
from .toxicity import fit, score_toxicity


def op1_simhash_golay_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=40)


def op4_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op5_msd_radix_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).assignments()


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir))


def op9_prefix_free_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).digests()


def op10_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_filter.page_captures(spark, sf_dir)
    return url_filter.filter_urls(captures, url_filter.page_list(spark, captures))


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(documents(spark, sf_dir))


def op12_byte_label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(documents(spark, sf_dir))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_golay_near_dedup,
        op2_toxic_segments,
        op3_virtual_slot_sharding,
        op4_voronoi_top_k,
        op5_msd_radix_exact_dedup,
        op6_sum_of_squares_packing,
        op7_license_rules,
        op8_piece_lattice,
        op9_prefix_free_suffix_dedup,
        op10_temporal_url_filter,
        op11_circulant_minhash,
        op12_byte_label_alignment,
        op13_phrase_collocations,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_voronoi_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
              FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_license_rules": license_scan.oracle(),
    "op10_temporal_url_filter": url_filter.oracle(),
    "op5_msd_radix_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY k) AS group_size
              FROM n WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id))
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(k) AS text_sha256 FROM r""",
}
