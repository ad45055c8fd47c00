"""Written intermediate tables, gapless numbering and other helpers shared by the operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factspark.session import scratch_folder

#: Spark's own switch that removes a statement's shuffle files once it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The characters that separate words, as a set for trim/translate and as a pattern.
SPACES = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends here."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.options(**options).mode("overwrite").parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.scratch_folder = folder
    return table


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like ``saved``, in buckets of a column: joins on it read the table where it lies."""
    spark = df.sparkSession
    folder, entry = scratch_folder(spark, name), f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).option("path", folder).mode("overwrite").saveAsTable(entry)
    table = spark.table(entry)
    table.scratch_folder, table.scratch_entry = folder, entry
    return table


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, the shuffle files of a statement are removed as it ends, not when the driver's heap is next swept."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``saved`` and ``bucketed`` of which everything was written that was derived from them."""
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        if hasattr(table, "scratch_entry"):
            spark.sql(f"DROP TABLE IF EXISTS {table.scratch_entry}")
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def numbered_documents(docs: DataFrame) -> DataFrame:
    """Stored rows (document, row): all columns in a struct, whatever their names, and a number.

    The numbers depend on how a scan is split, which may differ from job to job, so they
    are given in one job only and read from there.
    """
    return saved(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("document"), F.monotonically_increasing_id().alias("row")), "documents")


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """A null-safe join condition on columns of the same names."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def numbered(rows: DataFrame, group: list[str], order: list[tuple[str, bool]], rows_per_block: int = 50_000) -> DataFrame:
    """Number equal rows together, gapless from 0 within each group of any size.

    Returns one line per distinct row with ``copies`` (how often it occurs) and ``rank``
    (how many rows of its group stand before its first copy).  ``order`` names the leading
    sort columns with True for descending, nulls last; ties follow a hash block and then
    the other columns.  Equal rows are counted before the shuffle, and a (group, order)
    cell with more than ``rows_per_block`` distinct rows is cut into hash blocks, so no task
    holds a whole group; only one line per block is summed in order.
    """
    lead = [c for c, _ in order]
    keys = group + lead
    distinct = saved(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "distinct")
    cells = distinct.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("_blocks"))
    cells = cells.select(*[F.col(c).alias(f"_{c}") for c in keys], "_blocks")
    matched = F.lit(True)
    for c in keys:
        matched = matched & distinct[c].eqNullSafe(cells[f"_{c}"])
    cut = distinct.join(cells, matched).drop(*[f"_{c}" for c in keys])
    cut = cut.withColumn("_block", F.pmod(F.xxhash64(*rows.columns), F.col("_blocks"))).drop("_blocks")
    sort = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]
    before = Window.partitionBy(*group).orderBy(*sort, "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_block").agg(F.sum("copies").alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = starts.select(*[F.col(c).alias(f"_{c}") for c in [*keys, "_block"]], "_start")
    matched = F.lit(True)
    for c in [*keys, "_block"]:
        matched = matched & cut[c].eqNullSafe(starts[f"_{c}"])
    placed = cut.join(starts, matched).drop(*[f"_{c}" for c in [*keys, "_block"] if c != "_block"], "__block")
    rest = [c for c in rows.columns if c not in keys]
    inside = Window.partitionBy(*keys, "_block").orderBy(*(rest or keys)).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_start") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    return placed.withColumn("rank", rank).drop("_start", "_block")
