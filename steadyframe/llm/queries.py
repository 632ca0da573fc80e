"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyframe.llm import decontam, iblt, langid, linededup, nearest, packing, pii, resample, reweight, simhash, suffix, trie, urlfilter

from steadyframe.llm.oracles import oracle_sql  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("item_ids"), ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)))
    model = langid.fit(docs.where("not held_out"), "text", "lang", "doc_id")
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resample.resample(docs, good, fraction=0.8, keep_text=False).select("doc_id", "log_weight", "gumbel_key", "selected")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*pii.KINDS, "key", "context")]
    base = pii.rendered(list(pii.KINDS))
    return found.select("doc_id", *counts[:4], F.sha2(base, 256).alias("base_sha256"), pii.rendered([*pii.KINDS, "key", "context"]).alias("spans"), *counts[4:])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"), cut=iblt.word_groups)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), c - c % 100, F.crc32(c.cast("string")) % 6, most=5)


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = reweight.reweight(docs, table(spark, sf_dir, "benchmark").select("text"), shortest=1, longest=1)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_language_id, op3_quality_resampling, op4_best_fit_packing, op5_personal_data, op6_line_dedup, op7_suffix_dedup, op8_simhash_near_dedup, op9_document_fingerprints, op10_url_filters, op11_exact_top_k, op12_conversation_prefix_trie, op13_target_resampling)}
