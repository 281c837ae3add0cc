"""Registered queries of the operators over the given tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import balltree, extraction, merkle, negatives, packing, pieces, quality_classifier, quality_rules, simhash, substring, suffix_dedup, token_files, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark, folder):
    return substring.digests(_table(spark, folder, "documents"))


def op2_warc_packages(spark, folder):
    found = warc.read_packages(warc.write_packages(_table(spark, folder, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_files(spark, folder):
    return token_files.read_token_files(token_files.write_token_files(_table(spark, folder, "documents"), WORD_BPE))


def op4_best_fit_packing(spark, folder):
    return packing.pack_documents(_table(spark, folder, "documents"), WORD_BPE)


def op5_quality_rules(spark, folder):
    return quality_rules.judge(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left_words")


def op6_quality_classifier(spark, folder):
    docs = _table(spark, folder, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, _table(spark, folder, "labels")))


def op7_exact_topk(spark, folder):
    rows = _table(spark, folder, "embeddings").where(balltree.usable("embedding") & F.col("vec_id").isNotNull())
    vectors = rows.select("vec_id", balltree.whole_numbers("embedding").alias("vector"))
    return balltree.top_k(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


def op8_simhash_near_dedup(spark, folder):
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_sentencepiece(spark, folder):
    return pieces.encode_and_decode(_table(spark, folder, "documents"), PIECE_BPE)


def op10_html_extraction(spark, folder):
    pages = _table(spark, folder, "pages")
    return extraction.extract(pages, extraction.fit(extraction.sample_words(pages)))


def op11_suffix_array_dedup(spark, folder):
    return suffix_dedup.without_repeats(_table(spark, folder, "documents"), texts=False)


def op12_hard_negatives(spark, folder):
    rows = _table(spark, folder, "embeddings").where(balltree.usable("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", label.alias("label"), balltree.whole_numbers("embedding").alias("vector")), F.col("vec_id") % 50 == 0)


def op13_merkle_manifest(spark, folder):
    docs = _table(spark, folder, "documents")
    one_more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1)
    fields, seen = ([F.col(c) for c in merkle.FIELDS] for _ in "ab")
    seen[merkle.FIELDS.index("n_chars")] = one_more
    leaf = merkle.leaf_hash(*fields)
    rows = docs.select("doc_id", F.col("lang").alias("group"), leaf.alias("leaf"), F.when(one_more.isNull(), leaf).otherwise(merkle.leaf_hash(*seen)).alias("seen"))
    return merkle.proofs(merkle.build(rows))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_warc_packages, op3_token_files, op4_best_fit_packing, op5_quality_rules, op6_quality_classifier, op7_exact_topk, op8_simhash_near_dedup, op9_sentencepiece, op10_html_extraction,
    op11_suffix_array_dedup, op12_hard_negatives, op13_merkle_manifest)}
ORACLES: dict[str, str] = {"op1_substring_dedup": substring.ORACLE, "op7_exact_topk": balltree.ORACLE, "op5_quality_rules": quality_rules.ORACLE, "op2_warc_packages": warc.ORACLE,
                            "op11_suffix_array_dedup": suffix_dedup.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
