"""The pipeline's stages one by one against plain Python, and their whole run."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factspark.llm import mixing, partenum, queries
from factspark.llm.common import documents, saved

from ..conftest import SMALL
from .test_operators import AWKWARD, brute_base, brute_components


@pytest.fixture(scope="module", params=["small", "awkward", "empty"])
def inputs(request, spark, tmp_path_factory):
    """The input of every stage, written and read again as the driver does."""
    docs = documents(spark, SMALL)
    if request.param != "small":
        rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s in AWKWARD] if request.param == "awkward" else []
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stage"))
        if name == "quality rules":
            docs.write.parquet(f"{folder}/0")
            docs = found[0] = spark.read.parquet(f"{folder}/0")
        stage(spark, docs, SMALL).write.parquet(f"{folder}/1")
        docs = spark.read.parquet(f"{folder}/1")
        found.append(docs)
    return found


def rows(df):
    return collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_columns(inputs):
    assert all(df.columns == inputs[0].columns for df in inputs[1:5])
    assert {"doc_id", "start", "length", "sequence_id"} <= set(inputs[5].columns)


def test_rules_stage(spark, inputs):
    passing = rows(inputs[1])
    assert not passing - rows(inputs[0])
    assert all(len((t or "").split()) >= 10 for _, t, *_ in passing)


def test_duplicates_stage(inputs):
    before = [(r.doc_id, r.text) for r in inputs[1].collect()]
    groups = brute_components(before)
    after = rows(inputs[2])
    assert not after - rows(inputs[1])
    kept = collections.Counter(d for d, *_ in after.elements())
    heads = {c for d, n, c in groups if n and c is not None}
    assert kept == collections.Counter({d: 1 for d in heads}) + collections.Counter(d for d, n, c in groups.elements() if not n or c is None)


@pytest.fixture
def changing_splits(spark, monkeypatch):
    """Cuts scans into small splits while the table of sizes is written, and into large ones before and after."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def shake(df, name):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000" if name == "sizes" else before)
        try:
            return saved(df, name)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    for module in (partenum, mixing):
        monkeypatch.setattr(module, "saved", shake)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def small_groups(spark, folder):
    """120 documents in 40 groups of three near copies, in files of many row groups."""
    rows = [(3 * g + i, " ".join(f"w{g}x{k}" for k in range(60)) + f" end{i}", "en", "abc"[g % 3], 0) for g in range(40) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.option("parquet.block.size", 2_000).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).parquet(folder)
    return spark.read.parquet(folder)


def test_duplicates_do_not_depend_on_splits(spark, tmp_path, changing_splits):
    docs = small_groups(spark, str(tmp_path / "docs"))
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 120, 3))


def test_mixture_does_not_depend_on_splits(spark, tmp_path, changing_splits):
    docs = small_groups(spark, str(tmp_path / "docs"))
    wanted = {r.doc_id: r.copies for r in mixing.mix(docs, queries.MIX_WEIGHTS).collect()}
    taken = corpus_pipeline.source_mixture(spark, docs, SMALL)
    assert collections.Counter(r.doc_id for r in taken.collect()) == collections.Counter({d: n for d, n in wanted.items() if n})


def test_secrets_stage(inputs):
    assert inputs[3].count() == inputs[2].count()
    old = {r.doc_id: r.text for r in inputs[2].collect()}
    for r in inputs[3].collect():
        assert not brute_base(r.text)
        if not brute_base(old[r.doc_id]) and "[secret]" not in r.text:
            assert r.text == old[r.doc_id]


def test_mixture_stage(inputs):
    wanted = {r.doc_id: r.copies for r in mixing.mix(inputs[3], queries.MIX_WEIGHTS).collect()}
    got = collections.Counter(r.doc_id for r in inputs[4].collect())
    assert got == collections.Counter({d: n for d, n in wanted.items() if n})


def test_packing_stage(inputs):
    n = inputs[5].where("start = 0").count()
    assert n == inputs[4].count()
    assert inputs[5].where("length > 2048 OR bit_count(length) <> 1").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
