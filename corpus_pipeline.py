"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns what it keeps.

Stages are pure functions of the table they are given; run() writes each one's result to the shared folder and reads it
again, so a lost executor costs one stage. A run that is started again begins anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.llm import bpe_chunks, decontaminate, langid, minhash, secrets
from routeloom.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Cosines of unrelated texts scatter around 0 by 1 / sqrt(DIMS). A text whose distinct words hold at least so many letters
#: and whose cosine to every prototype is below three times that is in none of the learned languages; fewer words, however
#: often repeated, say too little to be rejected.
NOISE, LETTERS = 3 / langid.DIMS**0.5, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter, which have no language, and longer texts that no profile is near go; missing
    labels are filled in."""
    labelled = docs.where(langid.remainder() != 2).select("doc_id", "text", "lang")
    said = langid.identify(docs.select(*COLUMNS), labelled).where(F.col("lang_pred") != "und")
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"\P{L}+", " "), " "))
    return said.where((F.col("score") >= NOISE) | (F.length(F.array_join(words, "")) < LETTERS)).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group the document of the smallest doc_id stays, once. Null doc_ids are in no group."""
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    own = docs.where("doc_id IS NOT NULL").select(*COLUMNS).join(kept, "doc_id", "left_semi")
    first = own.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))).where("_k = 1")
    return first.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: findings are replaced by their kind; all documents stay."""
    found, _ = secrets.scan(docs.select(*COLUMNS), keep=tuple(COLUMNS))
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("findings")))
    return clean.withColumn("n_chars", F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding: token ids of every text, and digests of them and of what they decode to."""
    return bpe_chunks.encode_decode(docs, keep=["doc_id", "lang", "source"], outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("encoding", encoding)]

#: Neither language profiles nor BPE can be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
