"""A corpus pipeline of five operators: rules, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factspark.session import scratch_folder
from factspark.llm import mixing, packing, partenum, quality, secrets
from factspark.llm.common import documents, numbered_documents
from factspark.llm.queries import END_ID, MIX_WEIGHTS, POLICY, word_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of the current policy."""
    return quality.passing(docs, POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by id, then by row) of each group of near-duplicates.

    Texts without words are in no group and stay.
    """
    rows = numbered_documents(docs)
    groups = partenum.near_groups(rows.select("document.doc_id", "document.text", "row"), row_col="row").select("row", "doc_id", "component")
    first = Window.partitionBy("component").orderBy(F.asc_nulls_last("doc_id"), "row")
    one = groups.where("component IS NOT NULL").withColumn("at", F.row_number().over(first)).where("at = 1").select("row")
    kept = groups.where("component IS NULL").select("row").unionAll(one)
    return rows.join(kept, "row", "left_semi").select("document.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the text."""
    model = secrets.fit(secrets.labelled_samples(docs))
    clean = secrets.redact(docs, model)
    if "n_chars" not in docs.columns:
        return clean
    changed = F.when(F.col("text").contains("[secret]"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it, repeats as rows of their own."""
    rows = numbered_documents(docs)
    taken = mixing.mix(rows.select("document.doc_id", "document.source", "document.text", "row"), MIX_WEIGHTS, row_col="row")
    taken = taken.where("copies > 0").select("row", "copies")
    return rows.join(taken, "row").select("document", F.explode(F.sequence(F.lit(1), "copies"))).select("document.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids of power-of-two length, none of which crosses a document."""
    return packing.pack(docs, word_tokenizer(), END_ID, longest=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources", source_mixture),
    ("packing", packed_sequences),
]

#: Two stages (a trained model, a tokenizer) have no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; every stage is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        folder = scratch_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
