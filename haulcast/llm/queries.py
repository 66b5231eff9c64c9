"""The numbered operators as queries over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.llm import alignment, centroids, decontaminate, extraction, fuzzy_lines, language_model, licenses, mixing, neardup, quality, sharding, substrings, token_files
from haulcast.llm.tables import documents, small_batches, table
from haulcast.session import tune
from haulcast.staging import new_path

Query = Callable[[SparkSession, str], DataFrame]


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(documents(spark, sf_dir)).drop("text")
    return quality.judge(measured).select("doc_id", *quality.MEASURES, "base_failed", "host_failed", "kept")


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    whole = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return sharding.shard_records(sized, spread_by=["text_crc32"])


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "leaked_item", "leaked_share")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extraction.extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy_lines.judge_lines(documents(spark, sf_dir))
    numbers = F.array_join(F.col("removed").cast("array<string>"), ",")
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), numbers.alias("removed_lines"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(documents(spark, sf_dir))
    labels = F.array_sort(F.array_distinct(F.col("phrases.label")))
    both = F.array_sort(F.array_union(F.col("phrases.label"), F.col("notices.label")))
    return out.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.first").alias("first_word"),
        F.array_max("phrases.first").alias("last_word"),
        F.concat_ws(",", labels).alias("base_labels"),
        F.concat_ws(",", both).alias("labels"),
        F.coalesce(F.greatest(F.array_max("phrases.score"), F.array_max("notices.score")), F.lit(0.0)).alias("score"),
    )


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(documents(spark, sf_dir))


def remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = mixing.mix_sources(docs)
    return out.select("doc_id", "source", "copy", "rate", "mix_order", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    token_files.write_tokens(documents(spark, sf_dir), path, token_files.Format(public_tokenizers.path("word_bpe_49k.json")))
    return token_files.read_tokens(spark, path)


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align_texts(documents(spark, sf_dir), pair).drop("groups")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]
    return out.select(*columns, centroids.text_digest(F.col("centroid")).alias("centroid_sha256"))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": near_duplicates,
    "op2_benchmark_leaks": leaks,
    "op3_quality_rules": quality_rules,
    "op4_page_texts": page_texts,
    "op5_repeated_lines": repeated_lines,
    "op6_license_scan": license_scan,
    "op7_rendezvous_shards": sharded,
    "op8_model_scores": model_scores,
    "op9_remove_repeats": remove_repeats,
    "op10_mix_sources": mixed,
    "op11_token_ids": token_ids,
    "op12_token_alignment": aligned,
    "op13_vector_clusters": clusters,
}


def all_queries() -> dict[str, Query]:
    def tuned(query: Query) -> Query:
        return lambda spark, sf_dir: query(small_batches(tune(spark)), sf_dir)

    return {name: tuned(query) for name, query in QUERIES.items()}
