"""Registered queries of the operators, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.llm import alignment, exact_dedup, license_scan, merkle, minhash, packing, quality_rules, secret_scan, sentencepiece_nbest, sharding, simhash, token_counts, url_filter
from spotlake.llm.queries_sql import EXACT_SQL, LICENSES_SQL, MERKLE_SQL, URLS_SQL
from spotlake.llm.tables import ascii_lower, stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, bare=True)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_nbest.segment(table(spark, sf_dir, "documents"), PIECES)
    return found.select("doc_id", "nth", F.round("score", 6).alias("score"), "n_pieces", "ids_crc32", "decoded")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_slots(sharding.assign_shards(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in secret_scan.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda no: F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")
    strong = F.filter("spans", lambda s: s["kind_no"] < len(secret_scan.STRONG))
    return found.select(
        "doc_id", *[count(no).alias(f"n_{kind}") for no, kind in enumerate(secret_scan.STRONG)],
        F.sha2(_joined(strong), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def packed(docs: DataFrame) -> DataFrame:
    ids_crc32 = F.crc32("ids").alias("ids_crc32")
    return packing.pack(docs, TOKENIZER).select("doc_id", "start", "length", ids_crc32, "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    presented = merkle.leaf_digest(*[F.when(tampered, ascii_lower(F.col(f))).otherwise(F.col(f)) if f == "text" else F.col(f) for f in fields])
    proofs = merkle.manifest(table(spark, sf_dir, "documents"), fields, also={"presented": presented})
    shown = proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"),
        merkle.folded(F.col("presented"), F.col("path")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = stored(alignment.align_documents(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECES, groups=False), "aligned")
    return alignment.score_documents(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_url_filters, op3_sentencepiece, op4_sharding, op5_simhash, op6_exact_dedup, op7_license_scan,
              op8_secret_scan, op9_quality_rules, op10_packing, op11_merkle_manifest, op12_minhash, op13_alignment)
}
ORACLES: dict[str, str] = {"op2_url_filters": URLS_SQL, "op6_exact_dedup": EXACT_SQL, "op7_license_scan": LICENSES_SQL, "op11_merkle_manifest": MERKLE_SQL}
