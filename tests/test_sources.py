"""Intake jobs on small fixtures."""

import json

from pyspark.sql import functions as F

from factspark.sources import documents, responses, vocabulary


def test_parse_pages(spark):
    html = "<html><head><title> A  title </title><meta name='date' content='2020-01-02'><script>bad()</script></head><body><nav>menu</nav><div class='ad'>buy</div><p>One &amp; two<p>One &amp; two<br>three</body>"
    rows = [(1, "u", html), (2, "u", None), (3, "u", "<script>x</script>")]
    got = {r.page_id: r for r in documents.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text_content == "One & two\nthree" and got[1].title == "A title" and got[1].pipeline_status == "parsed"
    assert str(got[1].published_at).startswith("2020-01-02")
    assert got[2].pipeline_status == "failed" and got[3].pipeline_status == "skipped"


def test_salvage(spark):
    whole = json.dumps({"claims": [{"attribute_key": "a"}], "events": [{"event_type": "ipo"}], "notes": 1})
    cut = '{"claims": [{"attribute_key": "a", "q": "brace } in \\" text"}, {"attribute_key": "b"}], "events": [{"event_type": "ipo", "x": {"y": 1}}], "relations": [{"predicate": "p", "object_mention": "o"}, {"pred'
    rows = [(1, "text ```json\n" + whole + "\n``` end"), (2, whole), (3, cut), (4, "no json"), (5, None)]
    got = responses.salvage_responses(spark.createDataFrame(rows, "response_id long, response string"))
    found = {}
    for r in got.orderBy("response_id", "position").collect():
        found.setdefault(r.response_id, []).append(r.section)
    assert found[1] == found[2] == ["claims", "events"]
    assert found[3] == ["claims", "claims", "events", "relations"]
    assert found[4] == ["error"]


def test_materialize(spark, tmp_path):
    path = str(tmp_path / "p")
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    vocabulary.materialize(one, path, ["k"], 1)
    vocabulary.materialize(one.withColumn("v", F.lit(2)), path, ["k"], 2)
    assert [tuple(r) for r in vocabulary.read_current(spark, path).collect()] == [("a", 2)]
    vocabulary.materialize(one.withColumn("v", F.lit(3)), path, ["k"], 2)
    assert [tuple(r) for r in vocabulary.read_current(spark, path).collect()] == [("a", 3)]
    try:
        vocabulary.materialize(one.union(one), path, ["k"], 3)
        raise AssertionError("duplicate keys must fail")
    except ValueError:
        pass
    assert vocabulary.read_current(spark, path).first().v == 3
    held = vocabulary.read_current(spark, path)
    vocabulary.materialize(one.withColumn("v", F.lit(4)), path, ["k"], 2)
    assert held.first().v == 3  # a reader keeps what it started with
    vocabulary.drop_old_versions(spark, path, 1)
    assert vocabulary.read_current(spark, path).first().v == 4


def test_feed_limit(spark):
    rows = [("f", i, f"u{i}") for i in range(60)] + [("g", 1, None), ("g", 2, "seen")]
    entries = spark.createDataFrame(rows, "feed_id string, position int, link string")
    known = spark.createDataFrame([("seen",), ("u3",)], "url string")
    got = {(r.feed_id): (r.queued, r.skipped) for r in documents.feed_counts(entries, known, per_feed=50).collect()}
    assert got == {"f": (49, 1), "g": (0, 1)}
    assert documents.feed_counts(entries, known).filter("feed_id = 'f'").first().queued == 59
