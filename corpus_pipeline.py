"""A corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept; ``run`` writes each stage's
rows as Parquet in the cluster's shared folder and reads them again as the next one's documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataspark.llm import decontaminate, language, minhash, packing, secret_scan
from strataspark.llm.common import filter_documents, replace_texts, table
from strataspark.llm.queries import ranks_path, tokenizer_path
from strataspark.session import drop_folder, scratch_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    model = language.train(docs)
    if not model.languages:  # no labelled row to learn from: letters alone decide
        return filter_documents(docs, "text", lambda texts: [any(map(str.isalpha, x or "")) for x in texts])
    return filter_documents(docs, "text", lambda texts: [x != "und" for x in language.predict(texts, model)[0]], language.BLOCK)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: that with the
    smallest doc_id."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with an item of the benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), width=10)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars follows."""
    return replace_texts(docs, "text", lambda texts: [secret_scan.redact(t) for t in texts], n_chars="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of at most 1024 tokens."""
    return packing.best_fit(docs, tokenizer_path(), ranks=ranks_path(), end_id=2, capacity=1024)


STAGES = [("language", language_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("secrets", secret_stage), ("packing", packing_stage)]
#: Tokenizers, trained models and graph search have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        folder = f"{scratch_dir(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last:  # what the stage read
            drop_folder(spark, last)
        last = folder
    return docs
