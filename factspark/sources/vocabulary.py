"""Maintenance of vocabularies, taxonomy moves, code renames and stored projections."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_vocabulary(seed: DataFrame, current: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Merged vocabulary with ``action`` created / updated / skipped / kept per row."""
    fields = [c for c in seed.columns if c not in keys]
    s = seed.select(*keys, *[F.col(c).alias(f"seed_{c}") for c in fields], F.lit(True).alias("in_seed"))
    c = current.select(*keys, *fields, F.lit(True).alias("in_current"))
    merged = c.join(s, keys, "full_outer")
    use_seed = F.col("in_seed").isNotNull() & (F.lit(overwrite) | F.col("in_current").isNull())
    action = (
        F.when(F.col("in_seed").isNull(), "kept")
        .when(F.col("in_current").isNull(), "created")
        .otherwise("updated" if overwrite else "skipped")
    )
    values = [F.when(use_seed, F.col(f"seed_{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    return merged.select(*keys, *values, action.alias("action"))


def remap_nodes(classification: DataFrame, node: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classifications moved to their new node, and nodes with the old ones deprecated.

    ``moves``: facet, path, new_facet, new_path.
    """
    moved = classification.join(moves, ["facet", "path"], "left").withColumns(
        {"facet": F.coalesce("new_facet", "facet"), "path": F.coalesce("new_path", "path")}
    )
    old = moves.select("facet", "path", F.lit("deprecated").alias("moved_status")).distinct()
    nodes = node.join(old, ["facet", "path"], "left").withColumn(
        "status", F.coalesce("moved_status", "status")
    )
    return moved.drop("new_facet", "new_path"), nodes.drop("moved_status")


def rename_values(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Replace whole values of one column by a fixed mapping."""
    old = F.col(column)
    return df.withColumn(column, reduce(lambda acc, kv: F.when(old == kv[0], kv[1]).otherwise(acc), names.items(), old))


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def _folder(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(root, name)


def _published(spark: SparkSession, path: str) -> list[str]:
    """Names ``version.turn.folder`` of everything published, oldest first."""
    files, place = _folder(spark, path)
    if not files.exists(place("_published")):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(place("_published")))


def materialize(df: DataFrame, path: str, keys: list[str], version: int) -> None:
    """Store one version of a projection; readers keep the version they started with.

    The rows are computed and written once, into a folder of their own.  Keys are checked on
    the written rows, then an empty pointer file that names version and folder publishes it.
    Nothing is moved or deleted, so a reader in between sees the old version or the new one; a
    version that is stored again gets a later pointer.
    """
    spark = df.sparkSession
    files, place = _folder(spark, path)
    name = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    if not key_violations(spark.read.schema(df.schema).parquet(f"{path}/{name}"), keys).isEmpty():
        files.delete(place(name), True)
        raise ValueError(f"projection is not unique on {keys}")
    turn = 1 + sum(int(p.split(".")[0]) == version for p in _published(spark, path))
    files.create(place(f"_published/{version:012d}.{turn:06d}.{name}"), False).close()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The newest stored version (only its folder is read)."""
    return spark.read.parquet(f"{path}/{_published(spark, path)[-1].split('.')[2]}")


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the ``keep`` newest versions, once no reader uses them any more."""
    files, place = _folder(spark, path)
    for pointer in _published(spark, path)[:-keep]:
        files.delete(place(f"_published/{pointer}"), False)
        files.delete(place(pointer.split(".")[2]), True)


def snapshot_is_fresh(taken_at: Column, as_of: Column, hours: int = 6) -> Column:
    """May a stored snapshot still be served?"""
    return taken_at >= as_of - F.make_dt_interval(hours=F.lit(hours))
