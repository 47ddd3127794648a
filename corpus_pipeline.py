"""A corpus pipeline: language, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a table, which is written
as Parquet and read again for the next.  All but the last return the columns of ``documents``.

Defined cases: a null or empty text, or one without a letter, has no language and goes in the first stage, as does one that no
language is likelier than all others together for; a null ``lang`` is filled with the prediction, one that is there stays; a
null ``source`` or ``n_chars`` stays; of near copies the least id stays, with every row of that id; rows that repeat one
another are repeated passages in the third stage and lose their text, and a document that loses all of it goes; a very long
text is treated whole; an empty table gives no rows; other columns, whatever their names, go along to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.llm import jaccard, langid, packing, pii, suffixes
from swathe.llm.common import column, free_name, written
from swathe.llm.queries import TEST_KEY, documents, vocabulary
from swathe.sources.files import WRITTEN, drop

#: A document whose likeliest language has less than this share of the probability is rejected.
LEAST_SCORE = 0.5
#: Near copies of the corpus: word shingles and the least likeness in percent; those of ``op9_ngram_jaccard`` are its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learned; one without a language gets the prediction."""
    learned = docs.where(~F.coalesce(langid.held_out(), F.lit(False)))
    model = langid.train(learned, vocabulary("piece_bpe_32k.model"))
    name = free_name(docs, "found")
    found = column(name)
    rows = docs.withColumn(name, langid.language(model, F.col("text"))).where((found["lang_pred"] != "und") & (found["score"] >= LEAST_SCORE))
    return rows.withColumn("lang", F.coalesce("lang", found["lang_pred"])).select(*map(column, docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that with the least id."""
    return jaccard.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that repeat; a document that was nothing else goes."""
    return suffixes.rewrite(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str, key: bytes = TEST_KEY) -> DataFrame:
    """Replace personal data and secrets; only the registered query leaves the key out."""
    rows = pii.pseudonymise(docs, key)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*map(column, docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", suffix_array),
    ("PII", pseudonyms),
    ("best-fit packing", best_fit_packing),
]

#: No stage of these can be said in SQL; tests hold each stage against a version of it that is written plainly.
ORACLE_SQL = None


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str, key: bytes) -> DataFrame:
    """All stages over a table of documents, with pseudonyms under a deployment's key, such as ``pii.key_from_environment()``.

    What a stage wrote for itself, and what it read, is deleted once its result is written.
    """
    before: list[str] = []
    for k, (_, stage) in enumerate(STAGES):
        own = len(WRITTEN)
        docs = stage(spark, docs, sf_dir, key) if stage is pseudonyms else stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return docs
        inner = WRITTEN[own:]
        docs, path = written(docs, f"stage{k}")
        for done in (*inner, *before):
            drop(spark, done)
        before = [path]
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark, documents(spark, sf_dir), sf_dir, TEST_KEY)
