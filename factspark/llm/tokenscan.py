"""Token counts from flat files without an index, by a vectorised search for the separator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved
from .tokenfiles import store

#: Ids in one block; a block is read and searched at once.
BLOCK = 1 << 20


def scan_blocks(spark: SparkSession, folder: str, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per block: file, block, n_ids, ends (positions after each separator, in ids of the file).

    Files are listed by Spark and cut into blocks of ``block`` ids, which are dealt over
    tasks whatever file they lie in; a task reads its range and compares it as one array.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    n = F.ceil(F.col("length") / (block * width)).cast("long")
    blocks = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    blocks = blocks.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "block").repartition("file", "block")

    def search(batches):
        import numpy as np
        import pyarrow as pa

        system, path = store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if r["length"] % width:
                    raise ValueError(f"{r['file']} is cut within an id")
                first = r["block"] * block
                with system.open_input_file(f"{path}/{r['file']}") as f:
                    ids = np.frombuffer(f.read_at(min(block * width, r["length"] - first * width), first * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + first + 1
                yield pa.RecordBatch.from_pydict({"file": pa.array([r["file"]]), "block": pa.array([r["block"]]), "n_ids": pa.array([len(ids)], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int64()))})

    return blocks.mapInArrow(search, "file string, block bigint, n_ids bigint, ends array<bigint>")


def token_counts(spark: SparkSession, folder: str, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per document of the files: file, ordinal, start, n_tokens (separator included), closed.

    A document that spans blocks is stitched by a prefix scan over one line per block: the
    last separator before the block (running maximum) and the documents before it (running
    sum), per file.  Ids after a file's last separator are one document with ``closed``
    false.  A document never spans files.  Empty files and folders give no rows.
    """
    blocks = saved(scan_blocks(spark, folder, end_id, width, block), "blocks")
    prior = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lines = blocks.select("file", "block", "n_ids", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    lines = lines.select(
        "file", "block",
        F.coalesce(F.max("last").over(prior), F.lit(0)).alias("open_at"),
        F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("docs_before"),
        F.when(F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull(), F.sum("n_ids").over(Window.partitionBy("file"))).alias("file_ids"),
    )
    rows = blocks.join(lines, ["file", "block"])
    # the starts of a block's documents are its ends moved by one, after the open start
    starts = F.concat(F.array("open_at"), "ends")
    tail = F.when(F.col("file_ids") > F.element_at(starts, -1), F.array("file_ids")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumns({"_starts": starts, "_ends": F.concat("ends", tail), "_closed": F.size("ends")})
    spans = F.arrays_zip(F.slice("_starts", F.lit(1), F.size("_ends")).alias("start"), F.col("_ends").alias("end"))
    rows = rows.select("file", "docs_before", "_closed", F.posexplode(spans).alias("at", "span"))
    return rows.select(
        "file", (F.col("docs_before") + F.col("at")).alias("ordinal"), F.col("span.start").alias("start"),
        (F.col("span.end") - F.col("span.start")).alias("n_tokens"), (F.col("at") < F.col("_closed")).alias("closed"),
    )
