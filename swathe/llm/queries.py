"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepairs, chat, fingerprints, jaccard, langid, licences, packing, pieces, pii, quality, repair, runs, suffixes

#: The registered queries run on made-up people, with a key that anybody may know; a deployment's is ``pii.key_from_environment()``.
TEST_KEY = b"public test key"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeated(documents(spark, sf_dir)))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edited(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.train(docs.where(~F.coalesce("held_out", F.lit(False))), vocabulary("piece_bpe_32k.model"))
    return langid.identify(docs, model, ["doc_id", "held_out"])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymise(docs, TEST_KEY, kinds_col="kinds")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.windows(rows))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(documents(spark, sf_dir), links=True)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.digest(bytepairs.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(runs.with_repetition(documents(spark, sf_dir))))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.report(repair.damaged(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_suffix_array, op3_fingerprints, op4_language_id, op5_pii, op6_chat, op7_quality, op8_licences, op9_ngram_jaccard, op10_packing, op11_byte_pairs, op12_runs, op13_repair)
}
SQL = {"op7_quality": quality.OP7_SQL, "op8_licences": licences.scan_sql(), "op12_runs": runs.DIGEST_SQL, "op13_repair": repair.REPORT_SQL}
