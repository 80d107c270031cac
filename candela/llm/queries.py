"""Registered queries of the corpus operators; each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from candela.llm import boosting, decontaminate, langid, licenses, oracles, outliers, packing, pieces, prefixes, rans, repair, secrets, shards, simhash
from candela.llm.common import crc_rest
from candela.session import prepare, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op2_license_scan": oracles.license_scan(), "op3_decontaminate": oracles.decontaminated(),
    "op12_prefix_trie": oracles.prefix_trie(), "op13_structure_repair": oracles.structure_repair()}

BATCH_ROWS = "1000"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus jobs: small Arrow batches, as one text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(ready(spark), sf_dir)
        return fn

    return register


@query("op1_best_fit_shards")
def op1(spark, sf_dir):
    return shards.pack(table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@query("op2_license_scan")
def op2(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op3_decontaminate")
def op3(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@query("op4_simhash_groups")
def op4(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_quality_rules")
def op5(spark, sf_dir):
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


@query("op6_sentencepiece")
def op6(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).drop("ids")


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    filters = langid.learn_languages(docs.filter(crc_rest("doc_id", 4) != 2))
    return langid.identify_languages(docs, filters).select(
        "doc_id", (crc_rest("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op8_secret_scan")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_secrets(docs, secrets.learn_formats(docs))


@query("op9_token_files")
def op9(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    rans.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return rans.read_token_digests(spark, path)


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    forest = boosting.train(docs, table(spark, sf_dir, "labels").filter(crc_rest("doc_id", 3) != 1))
    return boosting.score_documents(docs, forest).select("doc_id", (crc_rest("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op11_retrieval_packing")
def op11(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op12_prefix_trie")
def op12(spark, sf_dir):
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_structure_repair")
def op13(spark, sf_dir):
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))
