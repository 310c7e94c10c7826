"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import (
    bpe, decontaminate, exact_dedup, lm, negatives, pieces, pii, quality, ranked, simhash, suffix_dedup, tokenfile, warc,
)
from clickloom.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per page, as read back from the archives; fails if a page does not come back."""
    pages = table(spark, sf_dir, "pages")
    return warc.read_back(pages, warc.write(pages)).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    found = pieces.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(F.array_join("ids", " ")).alias("ids_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates. In production the key comes from a secret store."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), b"key of this run")


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, code = tokenfile.write(table(spark, sf_dir, "documents"))
    return tokenfile.read(path, code, spark, ids=False)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; every seventh row counts under the next label."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the bytes that they decode to."""
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), packed=True).drop("text")
    return bpe.decode(ids).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


Q = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_tokenfile": op5_tokenfile,
    "op6_lm": op6_lm,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}
