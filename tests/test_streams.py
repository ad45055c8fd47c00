"""Streams read a table stored as one file or as a folder of part files."""

import pytest

import __spark_entry__ as entry
from factspark.sources.tables import GIVEN

from .conftest import SMALL


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The smallest tables with each given table as a folder of three files."""
    folder = tmp_path_factory.mktemp("parts")
    for name in GIVEN:
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_ingest", "stream_status", "stream_cooldown", "stream_adjudicate"])
def test_tables_in_part_files(spark, parts, name):
    query = entry.queries()[name]
    rows = lambda folder: sorted(map(str, query(spark, folder).collect()))
    assert rows(parts) == rows(SMALL)
    assert rows(parts)
